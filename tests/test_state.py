"""Stateful streams: shuffled micro-batches end in the batch form's states."""

import datetime as dt
import random

import pytest

from folioflow.operators import queue
from folioflow.streaming import state

START = dt.datetime(2026, 1, 1)
EVENT = "item long, ts timestamp, event_id long, status string, agent string"
REPORT = "task long, ts timestamp, done long, total long"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset(state.STORE)


def streamed(spark, tmp_path, batches, schema, make, restart=False):
    """The rows that a stream over files, a micro-batch each, gives in the order of the batches."""
    source, out = tmp_path / "in", []
    source.mkdir()

    def keep(df, number):
        out.extend(df.collect())

    def run():
        df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
        q = make(df).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()

    for k, rows in enumerate(batches):
        folder = tmp_path / f"one{k}"
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(folder))
        next(folder.glob("part-*.json")).rename(source / f"{k:03}.json")
        if restart:
            run()
    if not restart:
        run()
    return out


@pytest.mark.parametrize("restart", [False, True])
def test_shuffled_batches_give_the_batch_result(spark, tmp_path, restart):
    r = random.Random(1)
    kinds = ["queued", "claimed", "rendering", "preview_ready", "preview_rejected", "ready", "nonsense", "claimed", "queued"]
    events = [(r.randrange(4), START + dt.timedelta(minutes=10 * i, seconds=r.randrange(3)), i, r.choice(kinds), f"a{i % 3}") for i in range(60)]
    events += [(1, START + dt.timedelta(minutes=5), 7, s, "x") for s in ("queued", "claimed")]  # an id twice, at one time
    shuffled = sorted(events, key=lambda e: e[1] + dt.timedelta(minutes=r.uniform(0, 100)))  # up to ten events out of order
    size = 12 if not restart else 21
    batches = [shuffled[i : i + size] for i in range(0, len(shuffled), size)]
    flush = [[(99, START + dt.timedelta(days=30 + k), 1000 + k, "queued", None)] for k in range(2)]
    rows = streamed(spark, tmp_path, batches + flush, EVENT, lambda df: state.queue_states(df, "3 hours"), restart)
    last = {x.item: x for x in rows}
    want = {x.item: x for x in queue.states(spark.createDataFrame(events, EVENT)).collect()}
    assert {i: (x.status, x.version, x.agent, x.claims, x.rejected) for i, x in last.items() if i != 99} == {i: tuple(x)[1:] for i, x in want.items()}
    for item in want:
        now = state.EMPTY
        for _, ts, _, status, agent in sorted((e for e in events if e[0] == item), key=lambda e: e[1:]):
            now = state.stamped(now, ts, status, agent)
        assert (last[item].claimed_at, last[item].preview_ready_at, last[item].completed_at, last[item].changed_at) == now[5:]


def test_stamps():
    t = [START + dt.timedelta(hours=h) for h in range(6)]
    now = state.EMPTY
    for ts, status in zip(t, ["queued", "claimed", "claimed", "preview_ready", "preview_rejected", "ready"]):
        now = state.stamped(now, ts, status, "a")
    assert now == ("ready", 2, None, 1, 1, t[1], t[3], t[5], t[5])


def test_progress(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    batches = [[(1, at(0), 0, 10), (2, at(0), 1, 4)], [(1, at(5), 7, 10), (1, at(3), 5, 10), (2, at(1), 4, 4)], [(1, at(2), 3, 10)], [(3, at(60), 1, 2)], [(3, at(61), 2, 2)]]
    rows = streamed(spark, tmp_path, batches, REPORT, lambda df: state.task_progress(df, "30 minutes", stall_ms=600_000))
    seen = [(r.task, r.done, r.percent, r.stalled) for r in rows]
    assert [x for x in seen if x[0] == 1] == [(1, 0, 0, False), (1, 7, 70, False), (1, 7, 70, False), (1, 7, 70, True)]
    assert [x for x in seen if x[0] == 2] == [(2, 1, 25, False), (2, 4, 100, False)]  # finished: it can't stall
    assert [x for x in seen if x[0] == 3][-1] == (3, 2, 100, False)
