"""File sources: the library scan, JSON configurations, plain text, stored pages behind an injectable reader."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def scan_library(spark: SparkSession, root: str, known: DataFrame | None = None) -> DataFrame:
    """(path, class, subject, title, chapter, length, modified) of the PDFs under ``root``, without folders named 'extracted' and, if given, without paths in ``known``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pdf,PDF}").load(root).drop("content")
    p = F.col("path")
    x = files.where(~F.contains(p, F.lit("/extracted/")))
    _, chapter, klass = T.path_parts(p)
    x = x.select("path", klass.alias("class"), T.subject_from_path(p).alias("subject"), T.title_from_path(p).alias("title"), chapter.alias("chapter"), "length", F.col("modificationTime").alias("modified"))
    return x if known is None else x.join(known.select("path"), "path", "left_anti")


def read_configs(spark: SparkSession, root: str) -> DataFrame:
    """A row per JSON document under ``root``: (id, config_json), id being the document's or the file's name."""
    x = spark.read.option("pathGlobFilter", "*.json").text(root, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return x.select(F.coalesce(F.get_json_object("value", "$.id"), F.regexp_replace("file", r"\.json$", "")).alias("id"), F.col("value").alias("config_json"))


def read_whole_texts(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(name, path, length, modified) of the files in a folder whose name fits, by name."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root).drop("content")
    return x.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length", F.col("modificationTime").alias("modified")).orderBy("name")


def last_by_name(df: DataFrame, n: int = 1) -> DataFrame:
    """The last files of a listing by name, as names with dates in them need."""
    return df.orderBy(F.desc("name")).limit(n)


def list_newest(df: DataFrame, n: int = 1) -> DataFrame:
    """The newest files of a listing by time, ties by name from behind."""
    return df.orderBy(F.desc("modified"), F.desc("path")).limit(n)


def read_pages(files: DataFrame, reader: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page, text) of files (path, content) through ``reader``; a file that it can't read is one page of empty text with the error told."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                try:
                    pages, error = reader(bytes(content)), None
                except Exception as e:  # noqa: BLE001  a reader may raise anything
                    pages, error = [""], str(e)
                yield pd.DataFrame({"path": path, "page": range(len(pages)), "text": [p.strip() for p in pages], "error": error})

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string, error string")


def read_structured(files: DataFrame, reader: Callable[[bytes], Iterable[tuple]], fields: str) -> DataFrame:
    """(path, ``fields``, error) of files (path, content): a row per tuple that ``reader`` gives; a file that it can't read is one row of nulls with the error told."""
    names = [f.split()[0] for f in fields.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                try:
                    rows, error = list(reader(bytes(content))), None
                except Exception as e:  # noqa: BLE001  a reader may raise anything
                    rows, error = [(None,) * len(names)], str(e)
                if rows:
                    yield pd.DataFrame(rows, columns=names, dtype=object).assign(path=path, error=error)[["path", *names, "error"]]

    return files.select("path", "content").mapInPandas(run, f"path string, {fields}, error string")


def read_blocks(files: DataFrame, reader: Callable[[bytes], Iterable[tuple]], least: int = 4) -> DataFrame:
    """Blocks (page, x0, y0, x1, y1, text) of pages, white space squeezed, those under ``least`` characters left out."""
    x = read_structured(files, reader, "page int, x0 double, y0 double, x1 double, y1 double, text string")
    return x.withColumn("text", T.strip(F.regexp_replace("text", r"(?U)\s+", " "))).where(F.col("error").isNotNull() | (F.length("text") >= least))


def read_lines(files: DataFrame, reader: Callable[[bytes], Iterable[tuple]]) -> DataFrame:
    """Lines (page, line, x0, y0, x1, y1, text) out of spans (page, line, span, x0, y0, x1, y1, text): texts joined in order, boxes around all."""
    x = read_structured(files, reader, "page int, line int, span int, x0 double, y0 double, x1 double, y1 double, text string")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda s: s["text"]), "")
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return x.groupBy("path", "page", "line", "error").agg(*box, text.alias("text"))


def read_images(files: DataFrame, reader: Callable[[bytes], Iterable[tuple]]) -> DataFrame:
    """Images (page, width, height, n_bytes) embedded in files."""
    return read_structured(files, reader, "page int, width int, height int, n_bytes long")
