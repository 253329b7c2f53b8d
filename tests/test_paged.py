"""Paged files: what is read and what is not."""

import os
import time

import pytest
from pyspark.sql import functions as F

from folioflow.sources import paged


class Counting:
    """Pages divided by form feeds; tells every page that it reads by a line in a file."""

    fields = "text string, n int"

    def __init__(self, log):
        self.log = str(log)

    def _pages(self, path):
        text = open(path).read()
        if text == "broken":
            raise ValueError("no pages here")
        return text.split("\x0c")

    def count(self, path):
        return len(self._pages(path))

    def read(self, path, first, end):
        for i, t in enumerate(self._pages(path)[first:end], first):
            with open(self.log, "a") as f:
                f.write(f"{os.path.basename(path)} {i}\n")
            yield i, t, len(t)


@pytest.fixture
def library(tmp_path):
    root = tmp_path / "lib"
    (root / "sub").mkdir(parents=True)
    (root / "extracted").mkdir()
    (root / "a.txt").write_text("\x0c".join(f"a page {i}" for i in range(10)))
    (root / "sub" / "b.TXT").write_text("\x0c".join(f"b page {i} " + "x" * 50 for i in range(100)))
    (root / "bad.txt").write_text("broken")
    (root / "extracted" / "c.txt").write_text("no")
    (root / "d.bin").write_text("no")
    return root, tmp_path / "log"


def read_log(log):
    return sorted(log.read_text().split("\n")[:-1]) if log.exists() else []


def test_all_pages_and_errors(spark, library):
    root, log = library
    df = paged.read_paged(spark, str(root), Counting(log), "*.txt", pages=7, split_bytes=1000, name="all_pages")
    rows = df.collect()
    assert sorted((os.path.basename(r.path), r.page) for r in rows if r.error is None) == sorted([("a.txt", i) for i in range(10)] + [("b.TXT", i) for i in range(100)])
    assert [(os.path.basename(r.path), r.page, r.text, r.error) for r in rows if r.error] == [("bad.txt", None, None, "no pages here")]
    assert all(r.n == len(r.text) for r in rows if r.error is None)
    assert df.rdd.getNumPartitions() == 16  # fifteen ranges of seven pages, and the small files


@pytest.mark.parametrize("split", [1000, 1 << 20])
def test_one_page_is_read_alone(spark, library, split):
    root, log = library
    df = paged.read_paged(spark, str(root), Counting(log), "*.txt", pages=7, split_bytes=split, name="one_page")
    rows = df.where((F.col("page") == 42) & F.col("path").endswith("b.TXT")).collect()
    assert [r.text[:9] for r in rows] == ["b page 42"] and read_log(log) == ["b.TXT 42"]


def test_ranges_and_paths(spark, library):
    root, log = library
    df = paged.read_paged(spark, str(root), Counting(log), "*.txt", pages=7, split_bytes=1000, name="page_ranges")
    path = str(root / "a.txt")
    assert df.where((F.col("path") == path) & (F.col("page") > 2) & (F.col("page") <= 5)).count() == 3
    assert read_log(log) == ["a.txt 3", "a.txt 4", "a.txt 5"]
    log.unlink()
    assert df.where((F.col("path") == path) & F.col("page").isin(1, 3)).count() == 2 and read_log(log) == ["a.txt 1", "a.txt 2", "a.txt 3"]
    log.unlink()
    assert df.where("page > 5 and page < 3").count() == 0 and read_log(log) == []
    assert df.where(F.col("path") == "/not/there").count() == 0 and read_log(log) == []


def test_one_file_and_none(spark, library, tmp_path):
    root, log = library
    assert paged.read_paged(spark, str(root / "a.txt"), Counting(log), name="one_file").count() == 10
    (tmp_path / "empty").mkdir()
    assert paged.read_paged(spark, str(tmp_path / "empty"), Counting(log), name="no_file").count() == 0


def test_new_files_are_streamed_once(spark, library, tmp_path):
    root, log = library
    (root / "bad.txt").unlink()

    def run():
        df = paged.stream_paged(spark, str(root), Counting(log), "*.txt", settle=0, name="page_stream")
        q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        q.processAllAvailable()
        q.stop()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 110
    (root / "e.txt").write_text("new\x0cpages")
    time.sleep(0.1)
    assert run() == 112 and run() == 112
    assert len(read_log(log)) == 112  # nothing was read twice
