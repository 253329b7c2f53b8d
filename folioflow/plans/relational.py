"""Queries over the relational operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import curriculum as C
from ..functions import text as T
from ..operators import relational as R
from ..sources.tables import table, v_catalogue, v_docs, v_items, v_labels, v_parts, v_queue, v_versions, v_videos, with_views

Q: dict = {}
O: dict = {}


def query(sql: str | None, *views: str):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return keep


@query("SELECT id, class, subject, title FROM v_docs", "v_docs")
def scan_project(spark, d):
    return v_docs(spark, d).select("id", "class", "subject", "title")


@query("SELECT id, class, subject FROM v_docs WHERE class = 'en' AND subject = 'src0'", "v_docs")
def filter_optional(spark, d):
    return R.filter_optional(v_docs(spark, d), **{"class": "en", "subject": "src0", "title": None}).select("id", "class", "subject")


@query("SELECT id, title FROM v_docs WHERE CAST(id AS VARCHAR) ILIKE '%the%' OR subject ILIKE '%the%' OR title ILIKE '%the%'", "v_docs")
def search_multi(spark, d):
    return R.search_multi(v_docs(spark, d), "the", "id", "subject", "title").select("id", "title")


@query("SELECT d.id FROM v_docs d LEFT JOIN v_labels l ON l.pdf_id = d.id WHERE l.quality IS NULL", "v_docs", "v_labels")
def null_filter(spark, d):
    return v_docs(spark, d).select("id").join(v_labels(spark, d), F.col("id") == F.col("pdf_id"), "left").where(F.col("quality").isNull()).select("id")


@query(", x AS (SELECT video_id, version_no, CASE WHEN version_no = 0 THEN NULL WHEN version_no = 1 THEN '' WHEN version_no = 2 THEN 'no DIAGRAM here' ELSE text END AS description FROM v_versions) SELECT video_id, version_no FROM x WHERE description IS NULL OR description = '' OR description ILIKE 'No diagram%'", "v_versions")
def needs_label(spark, d):
    v = v_versions(spark, d).withColumn("description", F.when(F.col("version_no") == 0, F.lit(None)).when(F.col("version_no") == 1, "").when(F.col("version_no") == 2, "no DIAGRAM here").otherwise(F.col("text")))
    return v.where(R.needs_label(F.col("description"))).select("video_id", "version_no")


@query(", x AS (SELECT video_id, version_no, CASE WHEN author = 'user' THEN 'analyzed' ELSE 'pending' END AS status, CASE WHEN version_no % 3 = 0 THEN NULL WHEN version_no % 3 = 1 THEN 'There is no diagram on it' ELSE text END AS description FROM v_versions) SELECT video_id, version_no FROM x WHERE status = 'analyzed' AND description NOT ILIKE '%No diagram%'", "v_versions")
def analyzed_real(spark, d):
    v = v_versions(spark, d).withColumn("status", F.when(F.col("author") == "user", "analyzed").otherwise("pending"))
    v = v.withColumn("description", F.when(F.col("version_no") % 3 == 0, F.lit(None)).when(F.col("version_no") % 3 == 1, "There is no diagram on it").otherwise(F.col("text")))
    return v.where(R.analyzed_real(F.col("status"), F.col("description"))).select("video_id", "version_no")


@query("SELECT d.id, d.class, d.subject FROM v_docs d LEFT JOIN v_labels l ON l.pdf_id = d.id WHERE l.quality IS NULL OR l.quality = 0 ORDER BY d.class, d.subject, d.id LIMIT 5", "v_docs", "v_labels")
def batch_candidates(spark, d):
    """The first five documents that still need work."""
    x = v_docs(spark, d).select("id", "class", "subject").join(v_labels(spark, d), F.col("id") == F.col("pdf_id"), "left")
    return x.where(F.col("quality").isNull() | (F.col("quality") == 0)).orderBy("class", "subject", "id").limit(5).select("id", "class", "subject")


@query(", x AS (SELECT id, list_filter([-1, 0, 1, 5, id % 12, 40], lambda p: p >= 0 AND p < id % 10 + 1) AS pages FROM v_docs) SELECT id, pages FROM x", "v_docs")
def page_range_filter(spark, d):
    total = F.col("id") % 10 + 1
    return v_docs(spark, d).select("id", F.filter(F.array(*[F.lit(p).cast("long") for p in (-1, 0, 1, 5)], F.col("id") % 12, F.lit(40).cast("long")), lambda p: (p >= 0) & (p < total)).alias("pages"))


@query(", x AS (SELECT id, class, subject, title, row_number() OVER (ORDER BY class, subject, title, id) AS pos FROM v_docs) SELECT id, CAST(pos AS INTEGER) AS pos FROM x WHERE pos <= 100", "v_docs")
def sort_multi(spark, d):
    """The first hundred documents by class, subject, title, with their places."""
    top = v_docs(spark, d).select("id", "class", "subject", "title").orderBy("class", "subject", "title", "id").limit(100)
    return top.select("id", F.row_number().over(Window.orderBy("class", "subject", "title", "id")).alias("pos"))


@query("SELECT id, class, subject FROM v_docs ORDER BY class, subject, id LIMIT 50 OFFSET 100", "v_docs")
def page_limit_offset(spark, d):
    return v_docs(spark, d).select("id", "class", "subject").orderBy("class", "subject", "id").offset(100).limit(50)


@query(", x AS (SELECT id, str_split(raw_text, chr(10)) AS pages FROM v_docs) SELECT id, CAST(i AS INTEGER) AS page, pages[i + 1] AS text FROM x, unnest(range(0, len(pages))) AS t(i) WHERE i >= 2 AND i < least(len(pages), 2 + greatest(1, least(20, 50)))", "v_docs")
def page_slice(spark, d):
    """Pages 2 and on of every document, 20 at most: the requested 50 are clamped."""
    n = max(1, min(20, 50))
    x = v_docs(spark, d).select("id", F.posexplode(F.split("raw_text", "\n")).alias("page", "text"))
    return x.where((F.col("page") >= 2) & (F.col("page") < 2 + n))


@query(", c AS (SELECT pdf_id, count(*) AS n_children, count(DISTINCT CASE WHEN quality = 1 THEN pdf_id END) AS n_real FROM v_labels GROUP BY pdf_id) SELECT d.id, d.class, d.subject, d.title, coalesce(c.n_children, 0) AS n_children, coalesce(c.n_real, 0) AS n_real FROM v_docs d LEFT JOIN c ON c.pdf_id = d.id WHERE d.class = 'en' AND (CAST(d.id AS VARCHAR) ILIKE '%1%' OR d.title ILIKE '%an%') ORDER BY d.class, d.subject, d.title, d.id LIMIT 200", "v_docs", "v_labels")
def catalog_search(spark, d):
    """The catalogue: filters and search, children counted before the join, sorted and paged."""
    docs = R.filter_optional(v_docs(spark, d), **{"class": "en"}).where(F.col("id").cast("string").ilike("%1%") | F.col("title").ilike("%an%")).select("id", "class", "subject", "title")
    out = R.child_counts(docs, v_labels(spark, d), "id", "pdf_id", n_children=F.count("*"), n_real=F.count_distinct(F.when(F.col("quality") == 1, F.col("pdf_id"))))
    return out.orderBy("class", "subject", "title", "id").limit(200)


@query("SELECT 'class' AS facet, class AS value, count(*) AS n FROM v_docs WHERE class IS NOT NULL GROUP BY class UNION ALL SELECT 'subject', subject, count(*) FROM v_docs WHERE subject IS NOT NULL GROUP BY subject", "v_docs")
def facets(spark, d):
    return R.facets(v_docs(spark, d), "class", "subject")


@query("SELECT class, count(*) AS n, count(DISTINCT subject) AS n_subjects, count(*) FILTER (WHERE n_chars > 1000) AS n_long FROM v_docs GROUP BY class", "v_docs")
def agg_count(spark, d):
    return v_docs(spark, d).groupBy("class").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("n_subjects"), F.count_if(F.col("n_chars") > 1000).alias("n_long"))


@query("SELECT status, count(*) AS n, count(*) FILTER (WHERE status = 'failed') AS n_error FROM v_queue GROUP BY status", "v_queue")
def status_histogram(spark, d):
    return v_queue(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("n_error"))


@query(", l AS (SELECT pdf_id, max(quality) AS quality, max(toxic) AS toxic FROM v_labels GROUP BY pdf_id) SELECT d.id, d.title IS NOT NULL AND d.title <> '' AS identified, coalesce(l.quality, 0) > 0 AS has_diagrams, l.pdf_id IS NOT NULL AS has_labels, length(rtrim(d.title, ':;, ')) >= 5 AND NOT regexp_matches(rtrim(d.title, ':;, '), '(?i)^Chapter\\s+\\d+$') AND NOT regexp_matches(rtrim(d.title, ':;, '), '^\\d+$') AS name_ok FROM v_docs d LEFT JOIN l ON l.pdf_id = d.id", "v_docs", "v_labels")
def catalog_processing(spark, d):
    from ..functions import text as T

    x = R.child_counts(v_docs(spark, d).select("id", "title"), v_labels(spark, d), "id", "pdf_id", quality=F.max("quality"), n=F.count("*"))
    return x.select("id", (F.col("title").isNotNull() & (F.col("title") != "")).alias("identified"), (F.col("quality") > 0).alias("has_diagrams"), (F.col("n") > 0).alias("has_labels"), T.name_ok_catalogue(F.col("title")).alias("name_ok"))


@query(", x AS (SELECT subject, count(*) AS total, count(*) FILTER (WHERE l.pdf_id IS NOT NULL) AS done FROM v_docs d LEFT JOIN (SELECT DISTINCT pdf_id FROM v_labels) l ON l.pdf_id = d.id GROUP BY subject) SELECT subject, total, done, CASE WHEN total = 0 THEN 0.0 ELSE round(done * 100.0 / total, 1) END::DOUBLE AS pct FROM x", "v_docs", "v_labels")
def progress_pct(spark, d):
    done = v_labels(spark, d).select("pdf_id").distinct()
    x = v_docs(spark, d).select("id", "subject").join(done, F.col("id") == F.col("pdf_id"), "left").groupBy("subject").agg(F.count("*").alias("total"), F.count("pdf_id").alias("done"))
    return x.withColumn("pct", F.coalesce(F.round(F.try_divide(F.col("done") * 100.0, F.col("total")), 1), F.lit(0.0)))


@query("SELECT q.id, q.status, c.c_name FROM v_videos q JOIN customer c ON c.c_custkey = q.owner WHERE q.status = 'O' ORDER BY q.updated_at, q.id LIMIT 100", "v_videos")
def join_inner(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("owner"), "c_name")
    return v_videos(spark, d).where("status = 'O'").join(c, "owner").orderBy("updated_at", "id").limit(100).select("id", "status", "c_name")


@query("SELECT d.id, d.class, l.quality FROM v_docs d LEFT JOIN v_labels l ON l.pdf_id = d.id", "v_docs", "v_labels")
def join_left(spark, d):
    return v_docs(spark, d).select("id", "class").join(v_labels(spark, d), F.col("id") == F.col("pdf_id"), "left").select("id", "class", "quality")


@query("SELECT i.video_id, i.seq, i.status, v.author FROM v_items i LEFT JOIN v_versions v ON v.video_id = i.video_id AND v.version_no = i.seq", "v_items", "v_versions")
def join_left_composite(spark, d):
    v = v_versions(spark, d).select("video_id", F.col("version_no").alias("seq"), "author")
    return v_items(spark, d).select("video_id", "seq", "status").join(v, ["video_id", "seq"], "left")


@query("SELECT d.id FROM v_docs d WHERE NOT EXISTS (SELECT 1 FROM v_labels l WHERE l.pdf_id = d.id)", "v_docs", "v_labels")
def join_anti(spark, d):
    return v_docs(spark, d).select("id").join(v_labels(spark, d).select(F.col("pdf_id").alias("id")), "id", "left_anti")


@query("SELECT id FROM v_docs WHERE id NOT IN (SELECT DISTINCT pdf_id FROM v_labels)", "v_docs", "v_labels")
def join_not_in(spark, d):
    v_docs(spark, d).createOrReplaceTempView("_ni_docs")
    v_labels(spark, d).createOrReplaceTempView("_ni_labels")
    return spark.sql("SELECT id FROM _ni_docs WHERE id NOT IN (SELECT DISTINCT pdf_id FROM _ni_labels)")


@query("SELECT id, subject FROM v_docs WHERE id IN (SELECT pdf_id FROM v_labels WHERE quality = 1)", "v_docs", "v_labels")
def join_semi(spark, d):
    return v_docs(spark, d).select("id", "subject").join(v_labels(spark, d).where("quality = 1").select(F.col("pdf_id").alias("id")), "id", "left_semi")


@query("SELECT v.id, (SELECT count(*) FROM v_items i WHERE i.video_id = v.id) AS n_items, (SELECT count(*) FROM v_items i WHERE i.video_id = v.id AND i.status = 'R') AS n_returned FROM v_videos v", "v_videos", "v_items")
def scalar_count(spark, d):
    return R.child_counts(v_videos(spark, d).select("id"), v_items(spark, d), "id", "video_id", n_items=F.count("*"), n_returned=F.count_if(F.col("status") == "R"))


@query(", x AS (SELECT v.id, v.status, (SELECT count(*) FROM v_items i WHERE i.video_id = v.id AND i.status = 'R') AS open_fb FROM v_videos v) SELECT id, status, open_fb FROM x WHERE status = 'P' OR open_fb > 2", "v_videos", "v_items")
def needs_rework(spark, d):
    x = R.child_counts(v_videos(spark, d).select("id", "status"), v_items(spark, d).where("status = 'R'"), "id", "video_id", open_fb=F.count("*"))
    return x.where((F.col("status") == "P") | (F.col("open_fb") > 2))


@query(", x AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY version_no DESC) AS rn FROM v_versions) SELECT video_id, version_no, author, text FROM x WHERE rn = 1", "v_versions")
def latest_per_key(spark, d):
    return R.latest_per_key(v_versions(spark, d), ["video_id"], [F.desc("version_no")])


@query("SELECT video_id, CAST(coalesce(max(version_no), 0) + 1 AS BIGINT) AS next_version FROM v_versions GROUP BY video_id", "v_versions")
def next_version(spark, d):
    return R.next_version(v_versions(spark, d), ["video_id"], "version_no")


@query(", b AS (SELECT id, status, updated_at, 0 AS n FROM v_videos WHERE id % 3 <> 0), c AS (SELECT id, 'X' AS status, updated_at + INTERVAL 1 DAY AS updated_at, 1 AS n FROM v_videos WHERE id % 2 = 0), u AS (SELECT * FROM b UNION ALL SELECT * FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, n DESC) AS rn FROM u) SELECT id, status, updated_at FROM r WHERE rn = 1", "v_videos")
def upsert_latest(spark, d):
    v = v_videos(spark, d).select("id", "status", "updated_at")
    changes = v.where("id % 2 = 0").select("id", F.lit("X").alias("status"), (F.col("updated_at") + F.expr("INTERVAL 1 DAY")).alias("updated_at"))
    return R.upsert_latest(v.where("id % 3 <> 0"), changes, ["id"], "updated_at")


@query(", b AS (SELECT id, status FROM v_videos WHERE id % 3 <> 0) SELECT id, status FROM b UNION ALL SELECT id, 'new' FROM v_videos WHERE id % 2 = 0 AND id NOT IN (SELECT id FROM b)", "v_videos")
def insert_ignore(spark, d):
    v = v_videos(spark, d).select("id", "status")
    return R.insert_ignore(v.where("id % 3 <> 0"), v.where("id % 2 = 0").select("id", F.lit("new").alias("status")), ["id"])


@query(", i AS (SELECT video_id, seq, CASE WHEN seq % 2 = 1 THEN status END AS status FROM v_items) SELECT i.video_id, i.seq, coalesce(i.status, v.priority) AS status FROM i LEFT JOIN v_videos v ON v.id = i.video_id", "v_items", "v_videos")
def backfill_from_parent(spark, d):
    i = v_items(spark, d).select("video_id", "seq", F.when(F.col("seq") % 2 == 1, F.col("status")).alias("status"))
    return R.backfill_from_parent(i, v_videos(spark, d), "video_id", "id", "status", "priority")


@query("SELECT video_id, seq FROM v_items WHERE video_id IN (SELECT id FROM v_videos WHERE status <> 'F')", "v_items", "v_videos")
def cascade_delete(spark, d):
    return R.cascade_delete(v_items(spark, d).select("video_id", "seq"), v_videos(spark, d).where("status <> 'F'"), "video_id", "id")


@query("SELECT id, CASE WHEN id % 5 = 0 THEN 'hold' ELSE status END AS status, owner, updated_at FROM v_videos", "v_videos")
def patch_allowed(spark, d):
    """A patch of status and owner of which only status is allowed."""
    return R.patch(v_videos(spark, d), F.col("id") % 5 == 0, {"status": F.lit("hold"), "owner": F.lit(0).cast("long")}, {"status", "title"}).select("id", "status", "owner", "updated_at")


@query("SELECT i.video_id, i.seq, i.created_at, v.status AS video_status FROM v_items i JOIN v_videos v ON v.id = i.video_id WHERE i.status = 'R' ORDER BY i.created_at, i.video_id, i.seq LIMIT 100", "v_items", "v_videos")
def open_feedback(spark, d):
    v = v_videos(spark, d).select(F.col("id").alias("video_id"), F.col("status").alias("video_status"))
    return v_items(spark, d).where("status = 'R'").join(v, "video_id").orderBy("created_at", "video_id", "seq").limit(100).select("video_id", "seq", "created_at", "video_status")


@query(", g AS (SELECT video_id, list({'seq': seq, 'status': status} ORDER BY seq, status) AS items FROM v_items GROUP BY video_id) SELECT v.id, CAST(coalesce(len(g.items), 0) AS INTEGER) AS n, coalesce(array_to_string(list_transform(g.items, lambda x: x.seq || ':' || x.status), ','), '') AS items FROM v_videos v LEFT JOIN g ON g.video_id = v.id", "v_items", "v_videos")
def group_collect(spark, d):
    """Each parent with its children in order; a parent's children are few."""
    g = v_items(spark, d).groupBy(F.col("video_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seq", "status"))).alias("items"))
    x = v_videos(spark, d).select("id").join(g, "id", "left")
    return x.select("id", F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).alias("n"), F.coalesce(F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["seq"], i["status"])), ","), F.lit("")).alias("items"))


DIM = f"d(class, subject, code, chapters) AS ({C.values_sql()})"


@query(f"WITH {DIM} SELECT code, d.class, subject, chapters, n_name FROM d JOIN nation ON n_nationkey = CAST(d.class AS INTEGER)")
def dim_values_join(spark, d):
    """The inline dimension, of 34 rows, broadcast to a fact table."""
    n = table(spark, d, "nation")
    return n.join(F.broadcast(C.curriculum(spark)), F.col("n_nationkey") == F.col("class").cast("int")).select("code", "class", "subject", "chapters", "n_name")


@query(", m(k, no, name) AS (VALUES ('en', 0, 'First'), ('en', 1, 'Second'), ('de', 0, 'Erstes'), ('fr', 2, 'Troisième')) SELECT d.id, m.name FROM v_docs d LEFT JOIN m ON m.k = d.class AND m.no = d.id % 3", "v_docs")
def lookup_broadcast(spark, d):
    """A two-level map (class, number) to a name, null where unknown."""
    m = spark.createDataFrame([("en", 0, "First"), ("en", 1, "Second"), ("de", 0, "Erstes"), ("fr", 2, "Troisième")], "k string, no long, name string")
    x = v_docs(spark, d).select("id", "class")
    return x.join(F.broadcast(m), (F.col("k") == F.col("class")) & (F.col("no") == F.col("id") % 3), "left").select("id", "name")


FILE = "'class-' || class || '/' || regexp_replace(regexp_replace(lower(subject), '\\s+', '-', 'g'), '[^a-z0-9-]', '_', 'g') || '/' || code || '_ch' || lpad(CAST(label AS VARCHAR), CAST(greatest(2, length(CAST(label AS VARCHAR))) AS INTEGER), '0') || '.pdf'"


@query(
    ", o AS (SELECT key, part, chapters, coalesce(sum(chapters) OVER (PARTITION BY key ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v_parts), x AS (SELECT c.class, c.subject, c.code, c.pattern, coalesce(o.part, 1) AS part, coalesce(o.before, 0) AS before, unnest(range(1, coalesce(o.chapters, c.chapters) + 1)) AS chapter FROM v_catalogue c LEFT JOIN o ON o.key = c.key), "
    "l AS (SELECT *, CAST(chapter + before AS INTEGER) AS label FROM x) SELECT code, label, " + FILE + " AS file, replace(pattern, '{ch}', CAST(part * 100 + chapter AS VARCHAR)) AS url FROM l WHERE length(code || label) % 5 <> 0",
    "v_catalogue", "v_parts",
)
def curriculum_expand(spark, d):
    """What is left to fetch of a catalogue: a row a chapter with its file and address; counted parts override the catalogue, labels go on through them, and files that are there already go."""
    x = R.chapters(v_catalogue(spark, d), v_parts(spark, d), ["key"])
    label = F.col("label").cast("string")
    file = F.concat(F.lit("class-"), "class", F.lit("/"), T.slugify_subject(F.col("subject")), F.lit("/"), "code", F.lit("_ch"), F.lpad(label, F.greatest(F.lit(2), F.length(label)), F.lit("0")), F.lit(".pdf"))
    x = x.select("code", "label", file.alias("file"), "url")
    there = x.where(F.length(F.concat("code", label)) % 5 == 0).select("file")
    return x.join(there, "file", "left_anti").select("code", "label", "file", "url")


# Keywords in order of precedence.
KEYWORDS = [("brass", "metal"), ("copper", "metal"), ("steel", "metal"), ("tin", "metal"), ("nickel", "metal"), ("small", "size"), ("large", "size"), ("economy", "price")]


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN contains(lower(p_type), '{k}') THEN '{v}'" for k, v in KEYWORDS) + " END AS family FROM part")
def keyword_first_match(spark, d):
    """The first keyword, in list order, that the lower-cased text contains."""
    low = F.lower("p_type")
    return table(spark, d, "part").select("p_partkey", F.coalesce(*[F.when(F.contains(low, F.lit(k)), v) for k, v in KEYWORDS]).alias("family"))


@query("SELECT id FROM v_docs WHERE class = 'en' UNION SELECT pdf_id FROM v_labels", "v_docs", "v_labels")
def set_union(spark, d):
    return v_docs(spark, d).where("class = 'en'").select("id").union(v_labels(spark, d).select("pdf_id")).distinct()


@query("SELECT id FROM v_docs WHERE class = 'en' INTERSECT SELECT pdf_id FROM v_labels", "v_docs", "v_labels")
def set_intersect(spark, d):
    return v_docs(spark, d).where("class = 'en'").select("id").intersect(v_labels(spark, d).select(F.col("pdf_id").alias("id")))


@query("SELECT id FROM v_docs WHERE class = 'en' EXCEPT SELECT pdf_id FROM v_labels", "v_docs", "v_labels")
def set_except(spark, d):
    """What was found less what is known."""
    return v_docs(spark, d).where("class = 'en'").select("id").subtract(v_labels(spark, d).select(F.col("pdf_id").alias("id")))


@query("SELECT d.id, CASE WHEN l.pdf_id IS NULL THEN 'missing' WHEN d.n_chars = 0 THEN 'empty' WHEN l.quality = 0 THEN 'mismatch' WHEN l.toxic = 1 THEN 'corrupt' ELSE 'ok' END AS status FROM v_docs d LEFT JOIN v_labels l ON l.pdf_id = d.id", "v_docs", "v_labels")
def catalog_audit(spark, d):
    x = v_docs(spark, d).select("id", "n_chars").join(v_labels(spark, d), F.col("id") == F.col("pdf_id"), "left")
    s = F.when(F.col("pdf_id").isNull(), "missing").when(F.col("n_chars") == 0, "empty").when(F.col("quality") == 0, "mismatch").when(F.col("toxic") == 1, "corrupt").otherwise("ok")
    return x.select("id", s.alias("status"))


@query("SELECT item, status, ts FROM v_queue WHERE status = 'queued' ORDER BY ts, event_id LIMIT 100", "v_queue")
def queue_list(spark, d):
    return v_queue(spark, d).where("status = 'queued'").orderBy("ts", "event_id").limit(100).select("item", "status", "ts")


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY ts DESC, event_id DESC) AS rn FROM v_queue) SELECT item, status FROM r WHERE rn = 1", "v_queue")
def queue_latest(spark, d):
    return v_queue(spark, d).groupBy("item").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))


@query("SELECT item, min(ts) FILTER (WHERE status = 'queued') AS enqueued_at, min(ts) FILTER (WHERE status = 'claimed') AS claimed_at, min(ts) FILTER (WHERE status = 'rendering') AS rendering_at, max(ts) FILTER (WHERE status = 'ready') AS completed_at FROM v_queue GROUP BY item", "v_queue")
def queue_stage_times(spark, d):
    at = lambda s, f=F.min: f(F.when(F.col("status") == s, F.col("ts")))
    return v_queue(spark, d).groupBy("item").agg(at("queued").alias("enqueued_at"), at("claimed").alias("claimed_at"), at("rendering").alias("rendering_at"), at("ready", F.max).alias("completed_at"))


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY ts DESC, event_id DESC) AS rn FROM v_queue) SELECT item, CASE WHEN status = 'queued' THEN 'claimed' ELSE status END AS status, status = 'queued' AS claimed FROM r WHERE rn = 1", "v_queue")
def queue_claim(spark, d):
    """Claims every item whose latest state is queued, and only those."""
    x = v_queue(spark, d).groupBy("item").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    return x.select("item", F.when(F.col("status") == "queued", "claimed").otherwise(F.col("status")).alias("status"), (F.col("status") == "queued").alias("claimed"))


@query(", b AS (SELECT *, sum(CASE WHEN status <> 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY item ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM v_queue), r AS (SELECT item, event_id, status, row_number() OVER (PARTITION BY item, g, status = 'failed' ORDER BY ts, event_id) AS run FROM b) SELECT item, event_id FROM r WHERE status = 'failed' AND run = 2", "v_queue")
def consecutive_failures(spark, d):
    """The event that makes two failures in a row: where a watchdog restarts its service."""
    w = Window.partitionBy("item").orderBy("ts", "event_id")
    x = v_queue(spark, d).withColumn("g", F.sum(F.when(F.col("status") != "failed", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.row_number().over(Window.partitionBy("item", "g").orderBy("ts", "event_id"))
    return x.where("status = 'failed'").withColumn("run", run).where("run = 2").select("item", "event_id")


@query("SELECT id, left(sha1(title), 12) AS task_id FROM v_docs", "v_docs")
def hash_id(spark, d):
    return v_docs(spark, d).select("id", F.left(F.sha1("title"), F.lit(12)).alias("task_id"))
