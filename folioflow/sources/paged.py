"""Paged files as a Python data source: page ranges are partitions, and filters on path and page reach the reader.

The caller gives a ``PageReader`` for a kind of file: how many pages a file has and what
rows a range of its pages gives. A reader opens paths itself, so they have to lie where all
executors see them; files of a store that only Spark opens go through
``files.read_pages``. As with Spark's own file sources the list of files, not what is in
them, is on the driver.

* A partition is a range of pages of one file, or several small files whole; pages are
  counted only of files larger than ``split_bytes``.
* Equality, IN and comparisons on ``page`` cut the ranges, equality and IN on ``path``
  leave files out: a query for one page reads that page.
* A file that can't be read gives one row with the error told; other files are read on.
* As a stream, files that are new or have changed are read once each, in the order of their
  times; files younger than ``settle`` seconds wait, so that a file that comes with the same
  time as another isn't passed over.
"""

from __future__ import annotations

import fnmatch
import os
import time
from collections.abc import Iterable, Iterator, Sequence
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
LAST = 1 << 31


class PageReader(Protocol):
    fields: str  # DDL of what a page's rows hold, after path and page

    def count(self, path: str) -> int:
        """The number of pages."""

    def read(self, path: str, first: int, end: int) -> Iterable[tuple]:
        """(page, *fields) of pages first to end - 1, as far as there are any."""


class Range(InputPartition):
    def __init__(self, paths: list[str], first: int = 0, end: int = LAST):
        self.paths, self.first, self.end = paths, first, end


def listed(root: str, pattern: str) -> list[tuple[str, int, int]]:
    """(path, length, time in nanoseconds) of the files under ``root`` whose name fits, folders named 'extracted' left out; ``root`` may be a file."""
    root = root.removeprefix("file://")
    if os.path.isfile(root):
        s = os.stat(root)
        return [(root, s.st_size, s.st_mtime_ns)]
    out = []
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(d for d in folders if d != "extracted")
        for name in sorted(names):
            if fnmatch.fnmatch(name.lower(), pattern.lower()):
                s = os.stat(path := os.path.join(folder, name))
                out.append((path, s.st_size, s.st_mtime_ns))
    return out


def _rows(reader: PageReader, width: int, part: Range) -> Iterator[tuple]:
    for path in part.paths:
        try:
            for page, *rest in reader.read(path, part.first, part.end):
                yield (path, page, *rest, None)
        except Exception as e:  # noqa: BLE001  a reader may raise anything
            yield (path, None, *[None] * width, str(e) or type(e).__name__)


class _Batch(DataSourceReader):
    def __init__(self, reader: PageReader, width: int, options: dict[str, str]):
        self.reader, self.width, self.options = reader, width, options
        self.low, self.high, self.paths = 0, LAST, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            at, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if at == ("path",) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = wanted if self.paths is None else self.paths & wanted
            elif at == ("page",) and value is not None:
                if isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, value), min(self.high, value + 1)
                elif isinstance(f, In):
                    known = [v for v in value if v is not None]
                    self.low, self.high = max(self.low, min(known, default=LAST)), min(self.high, max(known, default=-1) + 1)
                elif isinstance(f, GreaterThan):
                    self.low = max(self.low, value + 1)
                elif isinstance(f, GreaterThanOrEqual):
                    self.low = max(self.low, value)
                elif isinstance(f, LessThan):
                    self.high = min(self.high, value)
                elif isinstance(f, LessThanOrEqual):
                    self.high = min(self.high, value + 1)
            yield f  # Spark looks at the rows again: ranges may hold more than an IN asks for, and errors have no page

    def partitions(self) -> Sequence[Range]:
        pages, split = int(self.options.get("pages", 64)), int(self.options.get("split_bytes", 8 << 20))
        out: list[Range] = []
        small, held = [], 0
        if self.low >= self.high:
            return [Range([])]
        for path, length, _ in listed(self.options["path"], self.options.get("pattern", "*")):
            if self.paths is not None and path not in self.paths:
                continue
            if length <= split or self.high - self.low <= pages:
                small.append(path)
                held += length
                if held > split:
                    out.append(Range(small, self.low, self.high))
                    small, held = [], 0
                continue
            try:
                end = min(self.high, self.reader.count(path))
            except Exception:  # noqa: BLE001  it is told when the file is read
                end = self.low + 1
            out += [Range([path], a, min(end, a + pages)) for a in range(self.low, end, pages)]
        return out + [Range(small, self.low, self.high)] if small or not out else out

    def read(self, partition: Range) -> Iterator[tuple]:
        return _rows(self.reader, self.width, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, reader: PageReader, width: int, options: dict[str, str]):
        self.reader, self.width, self.options = reader, width, options

    def _files(self) -> list[tuple[int, str]]:
        ripe = time.time_ns() - int(float(self.options.get("settle", 1)) * 1e9)
        return sorted((t, path) for path, _, t in listed(self.options["path"], self.options.get("pattern", "*")) if t <= ripe)

    def initialOffset(self) -> dict[str, Any]:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict[str, Any]:
        files = self._files()
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict[str, Any], end: dict[str, Any]) -> Sequence[Range]:
        new = [path for t, path in self._files() if (start["time"], start["path"]) < (t, path) <= (end["time"], end["path"])]
        return [Range([path]) for path in new]

    def read(self, partition: Range) -> Iterator[tuple]:
        return _rows(self.reader, self.width, partition)


def source(reader: PageReader, name: str = "pages") -> type[DataSource]:
    """The data source of a reader, to be registered under ``name``: path, page, the reader's fields and error."""
    width = len([f for f in reader.fields.split(",") if f.strip()])

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"path string, page int, {reader.fields}, error string"

        def reader(self, schema) -> DataSourceReader:
            return _Batch(reader, width, dict(self.options))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Stream(reader, width, dict(self.options))

    return Pages


def _registered(spark: SparkSession, reader: PageReader, name: str) -> None:
    spark.dataSource.register(source(reader, name))


def read_paged(spark: SparkSession, root: str, reader: PageReader, pattern: str = "*", pages: int = 64, split_bytes: int = 8 << 20, name: str = "pages") -> DataFrame:
    """The pages of the files under ``root`` as a table."""
    spark.conf.set(PUSHDOWN, "true")
    _registered(spark, reader, name)
    return spark.read.format(name).option("pattern", pattern).option("pages", pages).option("split_bytes", split_bytes).load(root)


def stream_paged(spark: SparkSession, root: str, reader: PageReader, pattern: str = "*", settle: float = 1, name: str = "pages") -> DataFrame:
    """The pages of files that come into ``root`` as a stream; a checkpoint makes each version of a file count once."""
    _registered(spark, reader, name)
    return spark.readStream.format(name).option("pattern", pattern).option("settle", settle).load(root)
