"""Session settings shared by queries, tests and the bench."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(name: str = "folioflow", cores: int | None = None, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution. On a cluster the session comes from spark-submit; nothing in the library depends on this one."""
    return (
        SparkSession.builder.master(f"local[{cores or '*'}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
        .getOrCreate()
    )


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver did (local mode, or a cluster that shares the path; elsewhere use --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
    return spark
