"""Written tables in the shared checkpoint folder: the way this subpackage cuts lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only where that is unset in local mode (tests on one machine) a temporary one is made and set; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="folioflow-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        folder = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/folioflow-{uuid.uuid4().hex}-{name}"


_open = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end, but for those stored with ``keep``; what uses the others has to be stored by then."""
    scopes = _open.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            _delete(spark, path)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again, so that lost executors cost no recomputation of what came before. ``keep``: it outlives the innermost ``scratch``."""
    spark = df.sparkSession
    path = new_path(spark, name)
    scopes = _open.__dict__.get("scopes", [])
    if len(scopes) > keep:
        scopes[-1 - keep].append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_paths(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more; whatever was made of them has to be stored itself."""
    for frame in frames:
        _delete(spark, frame.stored_at)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder made by ``new_path``."""
    _delete(spark, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, upper and lower case being the same."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"{name}_"
        have.add(name.lower())
        out.append(name)
    return out


def parts(spark: SparkSession, least: int = 8) -> int:
    """Partitions for a shuffle whose number has to be given by hand."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
