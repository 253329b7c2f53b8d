"""Queries over sinks, settings, progress, synthesis and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions import text as T
from ..operators import enrich, progress, relational, sinks
from ..sources.tables import table, v_audit, v_docs, v_versions, with_views

Q: dict = {}
O: dict = {}


def query(sql: str | None, *views: str):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return keep


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_suppkey) AS id, s_name AS name FROM supplier")
def append_ids(spark, d):
    """New rows behind those that are there, with the next ids."""
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return sinks.append_rows(base, table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), "k")


DONE = ", done AS (SELECT pdf_id, page, error FROM v_audit WHERE page <> 3)"


@query(DONE + " SELECT pdf_id, page FROM v_audit a WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.pdf_id = a.pdf_id AND d.page = a.page AND d.error IS NULL)", "v_audit")
def resume_pages(spark, d):
    """Pages without a result, and those whose result is an error, after a stop."""
    a = v_audit(spark, d)
    return sinks.left_to_do(a.select("pdf_id", "page"), a.where("page <> 3").select("pdf_id", "page", "error"), ["pdf_id", "page"])


@query(", r AS (SELECT pdf_id, page, error, page % 2 AS batch FROM v_audit UNION ALL SELECT pdf_id, page, NULL AS error, 7 AS batch FROM v_audit WHERE error IS NOT NULL AND page < 2), k AS (SELECT *, row_number() OVER (PARTITION BY pdf_id, page ORDER BY error IS NOT NULL, batch DESC) AS rn FROM r) SELECT pdf_id, page, batch, error FROM k WHERE rn = 1", "v_audit")
def report_rows(spark, d):
    """A report that several runs appended to, with one result a page."""
    a = v_audit(spark, d).select("pdf_id", "page", "error", (F.col("page") % 2).cast("long").alias("batch"))
    again = a.where("error is not null and page < 2").select("pdf_id", "page", F.lit(None).cast("string").alias("error"), F.lit(7).cast("long").alias("batch"))
    return sinks.latest_results(a.unionByName(again), ["pdf_id", "page"]).select("pdf_id", "page", "batch", "error")


@query("SELECT video_id, version_no, CAST((row_number() OVER (PARTITION BY video_id ORDER BY version_no) - 1) // 3 AS BIGINT) AS batch FROM v_versions", "v_versions")
def page_batches(spark, d):
    return sinks.batches(v_versions(spark, d), ["video_id"], "version_no").select("video_id", "version_no", "batch")


@query("SELECT event_type, round(sum(value), 1) AS elapsed, round(avg(value), 3) AS mean FROM events GROUP BY event_type")
def elapsed_totals(spark, d):
    return progress.elapsed(table(spark, d, "events"), ["event_type"], "value")


@query("SELECT event_id, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) // 1000000 AS age FROM events")
def age_seconds(spark, d):
    """Seconds up to a time that is given, here that of the last event."""
    e = table(spark, d, "events")
    return e.select("event_id", progress.age(F.col("ts"), e.agg(F.max("ts")).scalar()).alias("age"))


@query("WITH g AS (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS done, arg_max(event_type, {'t': ts, 'i': event_id}) AS last FROM events GROUP BY user_id) SELECT user_id, total, done, round(100.0 * done / total, 1)::DOUBLE AS percent, CASE WHEN last = 'error' THEN 'failed' WHEN done = total THEN 'done' ELSE 'running' END AS state FROM g")
def task_progress(spark, d):
    return progress.tasks(table(spark, d, "events"), "user_id", F.struct("ts", "event_id"), F.col("event_type") != "error")


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN '/' || substr(url, 9) END AS local FROM pages")
def url_local(spark, d):
    """Addresses under a root as paths below it; null for others."""
    return table(spark, d, "pages").select("page_id", progress.below(F.col("url"), "https://").alias("local"))


@query("SELECT event_id, CAST(event_id % 10 AS INTEGER) AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS value FROM events WHERE event_id % 4 <> 0")
def json_int_keys(spark, d):
    """A manifest's keys as integers; entries whose key is none are left out."""
    key = F.when(F.col("event_id") % 4 == 0, F.lit("x")).otherwise((F.col("event_id") % 10).cast("string"))
    doc = F.concat(F.lit('{"'), key, F.lit('": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return table(spark, d, "events").select("event_id", F.explode(J.int_keys(doc, "bigint")).alias("key", "value"))


SETTING = "CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN props WHEN 3 THEN 'say \"' || event_type || '\"' END"


@query("WITH s AS (SELECT event_id, " + SETTING + " AS v FROM events) SELECT event_id, CASE WHEN v IS NULL THEN '\"none\"' WHEN json_valid(v) THEN v ELSE CAST(to_json(v) AS VARCHAR) END AS value FROM s")
def setting_value(spark, d):
    """Settings: JSON where they are, else text as a JSON string; a default where there is none."""
    i, kind = F.col("event_id"), F.col("event_type")
    v = F.when(i % 5 == 0, kind).when(i % 5 == 1, i.cast("string")).when(i % 5 == 2, F.col("props")).when(i % 5 == 3, F.concat(F.lit('say "'), kind, F.lit('"')))
    return table(spark, d, "events").select("event_id", J.setting(v, "none").alias("value"))


@query(", p AS (SELECT video_id, version_no, split_part(text, '.', 1) AS s FROM v_versions), r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY version_no) AS rn FROM p) SELECT video_id, count(*) AS pages, 'Page ' || string_agg((version_no + 1)::VARCHAR || ': ' || s, '\n' || 'Page ' ORDER BY version_no) FILTER (WHERE rn <= 200) AS synthesis FROM r GROUP BY video_id", "v_versions")
def page_synthesis(spark, d):
    """Page summaries put together for one document; without a model the digest itself."""
    p = v_versions(spark, d).select("video_id", F.col("version_no").alias("page"), F.split_part("text", F.lit("."), F.lit(1)).alias("summary"))
    return enrich.synthesise(p, ["video_id"]).select("video_id", "pages", "synthesis")


@query("WITH b AS (SELECT c_custkey AS id, '{}' AS config_json, 0::BIGINT AS version FROM customer), n AS (SELECT user_id AS id, props AS config_json, event_id AS version FROM events WHERE event_type = 'click'), u AS (SELECT * FROM b UNION ALL SELECT * FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, config_json DESC) AS rn FROM u) SELECT id, config_json, version FROM r WHERE rn = 1")
def config_upsert(spark, d):
    """JSON configurations seeded over those that are there, the latest of each id."""
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("{}").alias("config_json"), F.lit(0).cast("long").alias("version"))
    seeds = table(spark, d, "events").where("event_type = 'click'").select(F.col("user_id").alias("id"), F.col("props").alias("config_json"), F.col("event_id").alias("version"))
    return relational.latest_per_key(base.unionByName(seeds), ["id"], [F.desc("version"), F.desc("config_json")]).select("id", "config_json", "version")


@query("WITH f AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'ABCDEF+' || p_name WHEN 1 THEN 'GHIJKL+Walkman-' || ['" + "', '".join(T.LEGACY_FONTS) + "'][p_partkey // 4 % " + str(len(T.LEGACY_FONTS)) + " + 1] || '905' WHEN 2 THEN upper(['" + "', '".join(T.LEGACY_FONTS) + "'][p_partkey // 4 % " + str(len(T.LEGACY_FONTS)) + " + 1]) ELSE p_brand END AS font FROM part) SELECT id, font, " + " OR ".join(f"contains(lower(font), '{x}')" for x in T.LEGACY_FONTS) + " AS legacy FROM f")
def legacy_fonts(spark, d):
    """Names of fonts, and whether their text needs conversion."""
    i = F.col("p_partkey")
    old = F.element_at(F.array(*map(F.lit, T.LEGACY_FONTS)), (F.call_function("div", i, F.lit(4)) % len(T.LEGACY_FONTS) + 1).cast("int"))
    font = F.when(i % 4 == 0, F.concat(F.lit("ABCDEF+"), "p_name")).when(i % 4 == 1, F.concat(F.lit("GHIJKL+Walkman-"), old, F.lit("905"))).when(i % 4 == 2, F.upper(old)).otherwise(F.col("p_brand"))
    return table(spark, d, "part").select(i.alias("id"), font.alias("font")).withColumn("legacy", T.is_legacy_font(F.col("font")))


@query("SELECT id, left(raw_text, 500) AS preview, length(raw_text) > 500 AS cut, length(raw_text) >= 50 AS long_enough FROM v_docs", "v_docs")
def text_preview(spark, d):
    """The beginnings of texts, and whether they are long enough to be worked on."""
    n = F.length("raw_text")
    return v_docs(spark, d).select("id", F.left("raw_text", F.lit(500)).alias("preview"), (n > 500).alias("cut"), (n >= 50).alias("long_enough"))


@query("SELECT event_type, round(avg(value), 2) AS mean, round(min(value), 1) AS low, CAST(floor(max(value)) AS BIGINT) AS whole, CAST(round(100.0 * count(*) / (SELECT count(*) FROM events), 0) AS BIGINT) AS percent FROM events GROUP BY event_type")
def rounded_figures(spark, d):
    """Figures as reports show them: two places, one, cut off, whole per cent."""
    e = table(spark, d, "events")
    whole = e.agg(F.count("*")).scalar()
    return e.groupBy("event_type").agg(F.round(F.avg("value"), 2).alias("mean"), F.round(F.min("value"), 1).alias("low"), F.floor(F.max("value")).cast("long").alias("whole"), F.round(100.0 * F.count("*") / whole, 0).cast("long").alias("percent"))
