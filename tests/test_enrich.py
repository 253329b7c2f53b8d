"""Model calls: batched, resumed, asked once a text; prompts."""

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioflow.operators import enrich, sinks


class Model:
    """Tells every text that it is asked for by a line in a file; may fail, at first or always."""

    def __init__(self, log, broken=(), shy=()):
        self.log, self.broken, self.shy = str(log), broken, shy

    def __call__(self, texts):
        seen = open(self.log).read().split("\n") if os.path.exists(self.log) else []
        with open(self.log, "a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        if any(t in self.broken for t in texts) or any(t in self.shy and t not in seen for t in texts):
            raise RuntimeError("not now")
        return [{"n": len(t)} for t in texts]


def pages(spark, n=20, docs=3):
    rows = [(d, p, f"text {d} {p}") for d in range(docs) for p in range(n)] + [(9, 0, "text 0 0"), (9, 1, None), (9, 2, "")]
    return spark.createDataFrame(rows, "doc long, page int, text string").repartition(4)


def asked(log):
    return Counter(log.read_text().split("\n")[:-1])


def test_each_text_is_asked_once(spark, tmp_path):
    log, df = tmp_path / "log", pages(spark)
    got = {(r.doc, r.page): (json.loads(r.result), r.error) for r in enrich.enrich(df, Model(log), str(tmp_path / "store"), wave=5).collect()}
    assert got == {(r.doc, r.page): ({"n": len(r.text or "")}, None) for r in df.collect()}
    assert set(asked(log).values()) == {1} and len(asked(log)) == 61
    assert enrich.enrich(df, Model(log), str(tmp_path / "store")).count() == 63 and set(asked(log).values()) == {1}  # nothing is left to ask
    assert [f for f in os.listdir(tmp_path / "store")] == ["results"]


def test_a_killed_job_goes_on(spark, tmp_path):
    log, df = tmp_path / "log", pages(spark)

    def die(wave):
        if wave == 1:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        enrich.enrich(df, Model(log), str(tmp_path / "store"), wave=4, after_wave=die)
    first = asked(log)
    assert 0 < len(first) < 61
    got = enrich.enrich(df, Model(log), str(tmp_path / "store"), wave=4).collect()
    assert len(got) == 63 and all(r.error is None for r in got)
    assert set(asked(log).values()) == {1} and len(asked(log)) == 61  # no key twice


def test_failures_are_asked_again(spark, tmp_path):
    log, df = tmp_path / "log", pages(spark, 4, 2)
    got = {(r.doc, r.page): r.error for r in enrich.enrich(df, Model(log, broken=["text 1 1"], shy=["text 0 0"]), str(tmp_path / "store"), size=1, attempts=3).collect()}
    assert {k for k, e in got.items() if e} == {(1, 1)} and got[1, 1] == "not now"
    assert asked(log)["text 1 1"] == 3 and asked(log)["text 0 0"] == 2 and asked(log)["text 0 1"] == 1
    got = {(r.doc, r.page): r.error for r in enrich.enrich(df, Model(log), str(tmp_path / "store"), size=1).collect()}
    assert not any(got.values()) and asked(log)["text 1 1"] == 4 and asked(log)["text 0 0"] == 2


def test_wrong_replies_are_errors(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "doc long, page int, text string")
    got = enrich.enrich(df, lambda texts: [{}], str(tmp_path / "store"), attempts=1).collect()
    assert {r.error for r in got} == {"1 results for 2 pages"}
    none = spark.createDataFrame([], "doc long, page int, text string")
    assert enrich.enrich(none, lambda texts: 1 / 0, str(tmp_path / "other")).collect() == []


def test_calls_at_once(spark):
    assert sinks.bounded(spark.range(100).repartition(8), 2).rdd.getNumPartitions() == 2


def test_prompts(spark):
    df = spark.createDataFrame([("ctx", "body", True, True, "a cell"), ("", "body", True, False, " "), (None, None, False, True, None), ("c", "b", None, None, "")], "c string, t string, first boolean, last boolean, d string")
    got = [r.p.split("\n") for r in df.select(enrich.prompt(F.col("c"), F.col("t"), F.col("first"), F.col("last"), 5, F.col("d")).alias("p")).collect()]
    assert got[0][:4] == ["ctx", "The chunk is the ENTIRE chapter.", "DIAGRAMS of the pages, to be kept to in image prompts:", "a cell"] and got[0][-1] == "body"
    assert got[1][0] == "The chunk is the START of the chapter." and not any("DIAGRAMS" in line for line in got[1]) and any("opens the chapter" in line for line in got[1])
    assert got[2][0] == "The chunk is the END of the chapter." and got[2][-1] == ""
    assert got[3][:2] == ["c", "The chunk is from the MIDDLE of the chapter."] and "At most 5 scripts" in got[3][2]
    t = spark.createDataFrame([("diagram", "x"), ("nonsense", ""), (None, None)], "t string, c string").select(enrich.task_prompt(F.col("t"), F.col("c")).alias("p")).collect()
    assert [r.p for r in t] == ["x\n\n" + enrich.TASKS["diagram"], enrich.TASKS["full"], enrich.TASKS["full"]]
