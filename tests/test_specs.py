"""Operators against their plain-Python specifications, and properties that hold whatever the data."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import boxes, enrich, queue, segment, sinks, timing
from folioflow.plans import registry
from folioflow.sources import files, tables
from folioflow.streaming import queue as stream

from . import spec


def test_chunk_chars(spark, sf):
    rows = tables.v_docs(spark, sf).select("raw_text", segment.chunk_chars(F.col("raw_text")).alias("c")).collect()
    assert all(r.c == spec.chunk_chars(r.raw_text) for r in rows)


def test_chunk_overlap(spark):
    texts = ["\n\n".join(f"para {i} " + "x" * (i * 37 % 90) for i in range(n)) for n in (0, 1, 2, 9, 30)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", segment.chunk_overlap(F.col("t"), 200, 60).alias("c")).collect():
        assert r.c == spec.chunk_overlap(r.t, 200, 60)


def test_chunks_keep_all_words(spark, sf):
    rows = tables.v_docs(spark, sf).select("raw_text", segment.chunk_words(F.col("raw_text")).alias("c")).collect()
    assert all(" ".join(r.c).split() == r.raw_text.split() for r in rows)


def test_proportional_durations_add_up(spark):
    df = spark.createDataFrame([(1, i, 10 + i) for i in range(8)], "v int, k int, n int")
    rows = timing.proportional(df, ["v"], "k", "n", 60.0, 1e9).collect()
    assert abs(sum(r.duration for r in rows) - 60) < 1e-9


def test_votes_ignore_row_order(spark, sf):
    name = "vote_page_name"
    a = sorted(registry.QUERIES[name](spark, sf).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    b = sorted(registry.QUERIES[name](spark, sf).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b


def test_align_words():
    heard = [("one", 0.0, 0.5), ("to", 0.5, 1.0), ("three", 1.0, 1.5)]
    assert timing.align_words(["One", "two", "three", "four"], heard) == [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5), (1.5, 1.9)]
    assert timing.align_words([], heard) == [] == timing.align_words(["a"], [])
    gap = [("x", 1.0, 1.5), ("y", 4.0, 4.5)]
    got = timing.align_words(["p", "x", "q", "r", "s", "y", "t", "u"], gap)
    want = [(1.0, 1.0), (1.0, 1.5), (1.5, 1.9), (1.9, 2.3), (2.3, 4.0), (4.0, 4.5), (4.5, 4.9), (4.9, 5.3)]
    assert [(round(a, 6), round(b, 6)) for a, b in got] == want
    assert timing.align_words(["a", "b"], [("c", 0.0, 1.0), ("d", 1.0, 3.0)]) == [(0.0, 3.0)] * 2


def test_boxes():
    assert boxes.dedupe_page([(0, 0, 10, 10), (1, 1, 9, 9), (20, 0, 30, 10)]) == [True, False, True]
    assert boxes.cluster_page([(0, 0, 10, 10, 1), (15, 0, 25, 10, 2), (50, 50, 60, 60, 4)]) == [[0, 0, 25, 10, 3], [50, 50, 60, 60, 4]]
    assert boxes.nearest_page([(0, 0, 10, 10), (0, 0, 2, 2)], [(0, 0, 8, 8)]) == [0, None]


def test_box_queries_follow_their_rules(spark, sf):
    pages = {}
    for r in sorted(tables.v_boxes(spark, sf).collect(), key=lambda r: (r.y0, r.x0, r.grp, r.seq, r.x1, r.y1)):
        pages.setdefault((r.doc, r.page), []).append(r)
    want = sorted((*k, r.grp, r.seq) for k, v in pages.items() for r, ok in zip(v, boxes.dedupe_page([(r.x0, r.y0, r.x1, r.y1) for r in v])) if ok)
    assert sorted(map(tuple, registry.QUERIES["box_dedupe"](spark, sf).collect())) == want


EVENTS = [(1, 1, "queued", "a"), (1, 2, "claimed", "a"), (1, 3, "claimed", "b"), (1, 4, "rendering", "a"), (1, 5, "preview_rejected", "a"), (2, 1, "bogus", "c"), (2, 2, "ready", None)]
STATES = {(1, "preview_rejected", 2, None, 1, 1), (2, "ready", 1, None, 0, 1)}


def _events(spark):
    return spark.createDataFrame([(i, t, t, s, a) for i, t, s, a in EVENTS], "item long, t long, event_id long, status string, agent string").select("item", F.timestamp_seconds("t").alias("ts"), "event_id", "status", "agent")


def test_queue_states(spark):
    assert set(map(tuple, queue.states(_events(spark)).collect())) == STATES


def test_queue_stream_equals_batch(spark, tmp_path):
    e = _events(spark)
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stream.queue_states(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("states").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert set(map(tuple, spark.table("states").collect())) == STATES


def test_windows_stream_equals_batch(spark, sf, tmp_path):
    e = tables.table(spark, sf, "events")
    s = spark.readStream.schema(e.schema).parquet(sf + "/events.parquet*")
    q = stream.tumbling(s).writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    pick = lambda df: {(r.window_start, r.event_type, r.n) for r in df.collect()}
    assert pick(spark.table("days")) == pick(stream.tumbling(e))


def test_folder_watch_counts_each_file_once(spark, tmp_path):
    root = tmp_path / "lib" / "class-9" / "science"
    root.mkdir(parents=True)
    (root / "iesc_ch04.pdf").write_bytes(b"x")
    (root / "a.txt").write_bytes(b"x")

    def poll():
        q = stream.watch_folder(spark, str(tmp_path / "lib")).writeStream.format("memory").queryName("found").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2"))
        run = q.outputMode("append").foreachBatch(lambda df, k: seen.extend(r.path for r in df.collect())).start()
        run.awaitTermination(120)

    seen: list = []
    poll()
    (root / "iesc_ch05.PDF").write_bytes(b"y")
    poll()
    assert sorted(p.rsplit("/", 1)[1] for p in seen) == ["iesc_ch04.pdf", "iesc_ch05.PDF"]


def test_library_scan_and_configs(spark, tmp_path):
    for p in ("class-9/science/iesc_ch04.pdf", "class-9/extracted/x.pdf", "class-10/maths/jemh_ch02_real_numbers.PDF"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"abc")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.scan_library(spark, str(tmp_path)).collect()}
    assert set(rows) == {"iesc_ch04.pdf", "jemh_ch02_real_numbers.PDF"}
    assert (rows["iesc_ch04.pdf"]["class"], rows["iesc_ch04.pdf"].subject, rows["iesc_ch04.pdf"].title, rows["iesc_ch04.pdf"].chapter) == ("9", "science", "Chapter 4", 4)
    known = spark.createDataFrame([(rows["iesc_ch04.pdf"].path,)], "path string")
    assert files.scan_library(spark, str(tmp_path), known).count() == 1
    (tmp_path / "a.json").write_text(json.dumps({"id": "science", "x": {"y": 1}}, indent=1))
    (tmp_path / "b.json").write_text("{}")
    assert sorted(r.id for r in files.read_configs(spark, str(tmp_path)).collect()) == ["b", "science"]


def test_read_pages_tells_errors(spark):
    df = spark.createDataFrame([("a", bytearray(b"one\x0ctwo ")), ("b", bytearray(b"\xff"))], "path string, content binary")
    rows = sorted(files.read_pages(df, lambda b: b.decode().split("\x0c")).collect())
    assert [(r.path, r.page, r.text, r.error is None) for r in rows] == [("a", 0, "one", True), ("a", 1, "two", True), ("b", 0, "", False)]


def test_structured_readers(spark):
    df = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"")), ("c", bytearray(b"y"))], "path string, content binary")

    def blocks(b):
        if not b:
            raise ValueError("empty")
        return [(0, 1.0, 2.0, 3.0, 4.0, "  some\n text "), (0, 1.0, 2.0, 3.0, 4.0, "abc")] if b == b"x" else []

    assert [(r.path, r.page, r.text, r.error) for r in sorted(files.read_blocks(df, blocks).collect())] == [("a", 0, "some text", None), ("b", None, None, "empty")]
    spans = lambda b: [(0, 1, 1, 5.0, 0.0, 9.0, 3.0, "b"), (0, 1, 0, 0.0, 1.0, 5.0, 2.0, "a "), (1, 0, 0, 0.0, 0.0, 1.0, 1.0, "z")]
    got = sorted(tuple(r)[1:] for r in files.read_lines(df.where("path = 'a'"), spans).collect())
    assert got == [(0, 1, None, 0.0, 0.0, 9.0, 3.0, "a b"), (1, 0, None, 0.0, 0.0, 1.0, 1.0, "z")]
    assert [tuple(r) for r in files.read_images(df.where("path = 'c'"), lambda b: [(0, 10, 20, len(b))]).collect()] == [("c", 0, 10, 20, 1, None)]


def test_checkpoint_and_resume(spark, tmp_path):
    todo = spark.createDataFrame([(1, p) for p in range(6)], "doc int, page int")
    write = sinks.checkpoint(str(tmp_path / "results"))
    done = todo.where("page < 4").withColumn("error", F.when(F.col("page") == 1, "timeout"))
    write(done.where("page < 2"), 0)
    write(done.where("page >= 2"), 1)
    write(done.where("page >= 2"), 1)  # a batch that runs again replaces itself
    have = spark.read.parquet(str(tmp_path / "results"))
    assert have.count() == 4
    assert sorted(r.page for r in sinks.left_to_do(todo, have, ["doc", "page"]).collect()) == [1, 4, 5]
    write(todo.where("page = 1").withColumn("error", F.lit(None).cast("string")), 2)
    rows = sinks.latest_results(spark.read.parquet(str(tmp_path / "results")), ["doc", "page"]).collect()
    assert sorted((r.page, r.batch, r.error) for r in rows) == [(0, 0, None), (1, 2, None), (2, 1, None), (3, 1, None)]


def test_sequential_ids(spark):
    rows = spark.createDataFrame([(k * 7,) for k in range(50)], "k long")
    assert sorted((r.k, r.id) for r in sinks.sequential_ids(rows, "k", F.lit(10), width=30).collect()) == [(k * 7, 11 + k) for k in range(50)]


def test_synthesis(spark):
    pages = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c")], "doc int, page int, summary string")
    got = {r.doc: (r.pages, r.synthesis) for r in enrich.synthesise(pages, ["doc"], lambda t: {}["x"] if "c" in t else t.upper()).collect()}
    assert got == {1: (2, "PAGE 1: A\nPAGE 2: B"), 2: (1, "Page 1: c")}
    results = {r.page: json.loads(r.result) for r in enrich.analyse_pages(pages.where("doc = 1").withColumnRenamed("summary", "text"), lambda t: {"n": len(t)} if t == "a" else {}["x"]).collect()}
    assert results == {0: {"n": 1}, 1: {"error": "'x'"}}


def test_a_model_is_asked_once(spark, tmp_path):
    log = str(tmp_path / "asked")
    long = "This is a sentence that goes on for a while. " * 3

    def model(t):
        with open(log, "a") as f:
            f.write("x\n")
        return '["x"]' if "yes" in t else "no"

    df = spark.createDataFrame([(1, long + "yes"), (2, "short"), (3, long + "no"), (4, None)], "id int, t string")
    got = {r.id: r.scripts for r in enrich.generate_scripts(df, "t", model).collect()}
    assert got[1] == ["x"] and got[2] == got[4] == [] and got[3] and len(open(log).readlines()) == 2


def test_generate_scripts_falls_back(spark):
    long = "This is a sentence that goes on for a while. " * 3
    df = spark.createDataFrame([(1, long), (2, "short"), (3, long + "no")], "id int, t string")
    rules = {r.id: r.scripts for r in enrich.generate_scripts(df, "t").collect()}
    asked = {r.id: r.scripts for r in enrich.generate_scripts(df, "t", lambda t: "broken" if t.endswith("no") else '```json\n["x"]\n```').collect()}
    assert rules[2] == asked[2] == [] and asked[1] == ["x"] and asked[3] == rules[3] and rules[1]


@pytest.mark.parametrize("reply, want", [("[1]", ["1"]), ('{"scripts": ["a"]}', ["a"]), ("no", None), (None, None), ('{"x": 1}', None)])
def test_parse_reply(reply, want):
    assert enrich.parse_reply(reply) == want


def test_gaps_are_filled_as_one_walks(spark):
    words = [(k, i, *t) for k, times in enumerate([[None, None, (1.0, 1.5), None, (2.0, 2.25), None, None], [None, None], [(0.0, 0.5)], [None, (0.9, 1.0), None, None, None, (1.5, 2.0)]]) for i, t in enumerate([x or (None, None) for x in times])]
    df = spark.createDataFrame([(*w, 1) for w in words], "k int, i int, t0 double, t1 double, at_ int")
    got = {(r.k, r.i): (round(r.t0, 6), round(r.t1, 6)) for r in timing.fill_gaps(df, ["k"], "i", "t0", "t1", F.lit(0.25)).collect()}
    for k in range(4):
        mine = [w for w in words if w[0] == k]
        end = 0.25
        for n, (_, i, t0, t1) in enumerate(mine):
            if t0 is None:
                after = mine[n + 1][2] if n + 1 < len(mine) else None
                t0, t1 = end, after if after is not None else end + 0.4
            assert got[k, i] == (round(t0, 6), round(t1, 6))
            end = t1


def test_queue_states_by_walking(spark):
    r = random.Random(8)
    kinds = ["queued", "claimed", "claimed", "rendering", "preview_ready", "preview_rejected", "ready", "failed", "nonsense", None]
    events = [(r.randrange(12), r.randrange(40), r.randrange(9), r.choice(kinds), r.choice([None, "a", "b"])) for _ in range(500)] + [(50, 1, 1, "claimed", "a"), (51, 1, 1, None, None)]
    got = {x.item: tuple(x)[1:] for x in queue.states(spark.createDataFrame([(i, dt.datetime(2026, 1, 1) + dt.timedelta(seconds=t), e, s, a) for i, t, e, s, a in events], "item long, ts timestamp, event_id long, status string, agent string")).collect()}
    want = {}
    for i, *_ in events:
        now = ("none", 1, None, 0, 0)
        for _, _, _, s, a in sorted((e for e in events if e[0] == i), key=lambda e: (e[1], e[2], e[3] or "", e[4] or "")):
            now = queue.fold(now, s, a)
        want[i] = now
    assert got == want
