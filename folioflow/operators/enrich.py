"""Steps that call a model: injectable callables with deterministic fall-backs."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from ..functions.names import fresh
from . import segment, sinks


def generate_scripts(df: DataFrame, text: str, backend: Callable[[str], str] | None = None) -> DataFrame:
    """``df`` with ``scripts`` (array of strings): the backend's reply where it holds a list, the rule-based segmenter's scripts otherwise. Texts under 50 characters have none."""
    rules = F.transform(segment.scripts(F.col(text)), lambda s: F.array_join(s, " "))
    short = F.length(text) < 50
    none = F.array().cast("array<string>")
    if backend is None:
        return df.withColumn("scripts", F.when(short, none).otherwise(rules))

    @F.pandas_udf(types.ArrayType(types.StringType()))
    def ask(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else parse_reply(backend(t)))

    # The model is asked once a text, and only for texts long enough; it may answer otherwise the next time.
    long = ~short & F.col(text).isNotNull()
    asked = df.withColumn("scripts", ask.asNondeterministic()(F.when(long, F.col(text))))
    return asked.withColumn("scripts", F.when(F.coalesce(F.size("scripts"), F.lit(0)) > 0, F.col("scripts")).when(long, rules).otherwise(none))


def parse_reply(reply: str | None) -> list[str] | None:
    """The scripts in a reply, fenced or not: a list, or an object's 'scripts'; None otherwise."""
    body = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", (reply or "").strip())).strip()
    try:
        found = json.loads(body)
    except ValueError:
        return None
    if isinstance(found, dict):
        found = found.get("scripts")
    if not isinstance(found, list):
        return None
    return [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in found]


def analyse_pages(pages: DataFrame, analyser: Callable[[str], dict]) -> DataFrame:
    """``pages`` (doc, page, text) with ``result`` as JSON; an analyser's failure is a result with an error."""

    @F.pandas_udf(types.StringType())
    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str:
            try:
                return json.dumps(analyser(t or ""), ensure_ascii=False)
            except Exception as e:  # noqa: BLE001  an analyser may raise anything
                return json.dumps({"error": str(e)})

        return s.map(one)

    return pages.withColumn("result", run("text"))


#: What a model is asked for, by task.
TASKS = {
    "diagram": "Describe each diagram, figure or chart of the page: what it shows, its labels, how the text refers to it. If there is none, answer 'No diagram on this page.'",
    "activity": "List the page's activities, experiments, side notes and tips word by word, and where each stands. If there are none, answer 'No activity boxes on this page.'",
    "hook": "Name one or two surprising facts or questions of the page that could open a one-minute video, and one that could end a part of it.",
    "full": "Return a JSON object with main_text, activity_text, side_notes, diagrams, hook_idea and cliffhanger; null where the page has nothing.",
    "chapter": "Return a JSON object with chapter_number, chapter_name (as printed), subject and class of the chapter that the page opens. Only JSON.",
}


def task_prompt(task: Column, context: Column | None = None) -> Column:
    """The prompt of a task, 'full' for one that isn't known; the context, where there is one, stands before it."""
    asked = F.coalesce(*[F.when(task == k, F.lit(t)) for k, t in TASKS.items()], F.lit(TASKS["full"]))
    return asked if context is None else F.concat_ws("\n\n", F.nullif(context, F.lit("")), asked)


def prompt(context: Column, text: Column, first: Column, last: Column, most: int, diagrams: Column | None = None) -> Column:
    """A prompt for one chunk: its context, where it stands in its chapter, the chapter's diagrams if any are known, the limits and the text."""
    first, last = F.coalesce(first, F.lit(False)), F.coalesce(last, F.lit(False))
    place = F.when(first & last, "The chunk is the ENTIRE chapter.").when(first, "The chunk is the START of the chapter.").when(last, "The chunk is the END of the chapter.").otherwise("The chunk is from the MIDDLE of the chapter.")
    opening, closing = F.when(first, "The first script opens the chapter's topic."), F.when(last, "The last script ends with a question that leads to the next chapter.")
    seen = F.lit(None).cast("string") if diagrams is None else F.when(F.trim(diagrams) != "", F.concat(F.lit("DIAGRAMS of the pages, to be kept to in image prompts:\n"), diagrams))
    return F.concat_ws("\n", F.nullif(context, F.lit("")), place, seen, opening, closing, F.lit(f"At most {most} scripts, as JSON {{\"scripts\": [...]}}."), F.lit("Text:"), F.coalesce(text, F.lit("")))


def enrich(pages: DataFrame, model: Callable[[list[str]], list[dict]], store: str, size: int = 3, at_once: int = 2, wave: int = 1000, attempts: int = 3, after_wave: Callable[[int], None] | None = None) -> DataFrame:
    """``pages`` (doc, page, text) with ``key``, ``result`` (JSON) and ``error``, by a model that is asked for up to ``size`` pages of a document at a time.

    A text is asked for once, wherever it stands: it is keyed by its hash. Calls go in waves of
    about ``wave``, ``at_once`` at a time; each wave's results are added to the folder ``store``
    when it is over, so a job that was killed goes on with what its last whole wave left.
    What failed, a call that raised or gave another number of results, is asked again up to
    ``attempts`` times in a job and once more in the next; an error is stored where nothing
    better came. Null texts are empty ones; an empty table asks nothing. The calls of an
    attempt are planned as a stored table with a folder a wave, so a wave reads its own only.
    """
    spark = pages.sparkSession
    results, schema = f"{store}/results", "key string, result string, error string, attempt int, at timestamp"
    keyed = pages.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))

    def stored() -> DataFrame:
        at = spark._jvm.org.apache.hadoop.fs.Path(results)
        return spark.read.schema(schema).parquet(results) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else spark.createDataFrame([], schema)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def call(rows: list[tuple[str, str]]) -> pd.DataFrame:
            try:
                got = model([t for _, t in rows])
                if len(got) != len(rows):
                    raise ValueError(f"{len(got)} results for {len(rows)} pages")
                out = [(k, json.dumps(r, ensure_ascii=False), None) for (k, _), r in zip(rows, got)]
            except Exception as e:  # noqa: BLE001  a model may raise anything
                out = [(k, None, str(e) or type(e).__name__) for k, _ in rows]
            return pd.DataFrame(out, columns=["key", "result", "error"], dtype=object)

        now, held = None, []
        for f in frames:
            for doc, n, key, text in zip(f["doc"], f["call"], f["key"], f["text"]):
                if (doc, n) != now and held:
                    yield call(held)
                    held = []
                now = (doc, n)
                held.append((key, text))
        if held:
            yield call(held)

    for attempt in range(attempts):
        once = keyed.groupBy("key").agg(F.min_by(F.struct("doc", "page", F.coalesce("text", F.lit("")).alias("text")), F.struct("doc", "page")).alias("p")).select("key", "p.*")
        todo = sinks.batches(sinks.left_to_do(once, stored(), ["key"]), ["doc"], "page", size).withColumnRenamed("batch", "call")
        calls = todo.select("doc", "call").distinct().count()
        if not calls:
            break
        waves, plan = -(-calls // wave), f"{store}/plan-{uuid.uuid4().hex}"
        todo.withColumn("wave", F.pmod(F.xxhash64("doc", "call"), F.lit(waves)).cast("int")).write.partitionBy("wave").parquet(plan)
        planned = spark.read.parquet(plan)
        for i in range(waves):
            part = planned.where(F.col("wave") == i).repartition(at_once, "doc", "call").sortWithinPartitions("doc", "call", "page")
            got = part.select("doc", "call", "key", "text").mapInPandas(ask, "key string, result string, error string")
            got.select("key", "result", "error", F.lit(attempt).alias("attempt"), F.current_timestamp().alias("at")).write.mode("append").parquet(results)
            if after_wave:
                after_wave(i)
        path = spark._jvm.org.apache.hadoop.fs.Path(plan)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    best = sinks.latest_results(stored().withColumn("batch", F.struct("at", "attempt")), ["key"])
    return keyed.join(best.select("key", "result", "error"), "key", "left")


def synthesise(pages: DataFrame, keys: list[str], reducer: Callable[[str], str] | None = None, most: int = 200) -> DataFrame:
    """Per document: how many ``pages`` (page, summary) it has and one synthesis of the first ``most`` of them in order.

    Summaries are put together first and the reducer is asked once a document; where there is none,
    or it fails, the digest itself is the synthesis. A document's pages are few; those after the
    first ``most`` are not collected.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("page"))
    line = F.concat(F.lit("Page "), (F.col("page") + 1).cast("string"), F.lit(": "), F.col("summary"))
    rn, lines = fresh(["rn_", "lines_"], pages)
    x = pages.withColumn(rn, rank).groupBy(*keys).agg(F.count("*").alias("pages"), F.array_sort(F.collect_list(F.when(F.col(rn) <= most, F.struct("page", line.alias("line"))))).alias(lines))
    x = x.withColumn("synthesis", F.array_join(F.transform(lines, lambda p: p["line"]), "\n")).drop(lines)
    if reducer is None:
        return x

    @F.pandas_udf(types.StringType())
    def ask(s: pd.Series) -> pd.Series:
        def one(t: str) -> str:
            try:
                return reducer(t) or t
            except Exception:  # noqa: BLE001  a model may raise anything
                return t

        return s.map(one)

    return x.withColumn("synthesis", ask.asNondeterministic()("synthesis"))
