"""Tables and the logical views that the queries are written over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a catalogue: id, class, subject, title, raw_text."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("lang").alias("class"), F.col("source").alias("subject"), F.left("text", F.lit(60)).alias("title"), F.col("text").alias("raw_text"), "n_chars")


def v_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pdf_id"), "quality", "toxic")


def v_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated_at"), F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("priority"))


def v_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("status"), F.col("l_quantity").alias("qty"), F.col("l_shipdate").alias("created_at"))


def v_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("version_no"), F.col("role").alias("author"), "text")


#: Event types as queue transitions.
QUEUE_STATUS = {"signup": "queued", "view": "claimed", "click": "rendering", "purchase": "ready", "error": "failed"}


def v_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in QUEUE_STATUS.items()], F.lit("other"))
    return e.select(F.col("event_id").alias("event_id"), F.col("user_id").alias("item"), "ts", status.alias("status"), "value")


def v_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page regions out of lineitem's integers: doc, page, seq and a box in points."""
    r = table(spark, sf_dir, "lineitem")
    x0, y0 = F.col("l_partkey") % 400, F.col("l_suppkey") * 7 % 600
    w, h = F.col("l_quantity").cast("long") * 4 + 20, (F.col("l_partkey") + F.col("l_linenumber")) % 180 + 10
    return r.select((F.col("l_orderkey") % 500).alias("doc"), (F.col("l_orderkey") % 7).alias("page"), F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("seq"), x0.alias("x0"), y0.alias("y0"), (x0 + w).alias("x1"), (y0 + h).alias("y1"), (F.col("l_suppkey") % 60 + 1).alias("n_items"))


def v_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text on the same pages: doc, page and a box."""
    r = table(spark, sf_dir, "lineitem")
    x0, y0 = F.col("l_partkey") % 160 + 40, F.col("l_suppkey") * 11 % 700 + F.col("l_linenumber")
    return r.select((F.col("l_orderkey") % 500).alias("doc"), (F.col("l_orderkey") % 7).alias("page"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity").cast("long") * 9 + 20).alias("x1"), (y0 + 12).alias("y1"))


def v_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded images on the same pages: a box and the size in pixels, one size being a background that nearly all pages have."""
    b, back = v_boxes(spark, sf_dir).where("seq = 1"), F.col("x0") % 3 == 0
    return b.select("doc", "page", "x0", "y0", "x1", "y1", F.when(back, 640).otherwise((F.col("x1") - F.col("x0")) * 2).alias("w"), F.when(back, 480).otherwise((F.col("y1") - F.col("y0")) * 2).alias("h"))


def v_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books to be fetched: class, subject, code, chapters and the pattern of their chapters' addresses."""
    code = F.concat(F.lower(F.left("p_brand", F.lit(2))), F.col("p_partkey").cast("string"))
    pattern = F.concat(F.lit("https://books.example/"), code, F.lit("${ch}.pdf"))
    return table(spark, sf_dir, "part").select((F.col("p_size") % 12 + 1).cast("string").alias("class"), F.col("p_type").alias("subject"), code.alias("code"), F.col("p_size").cast("int").alias("chapters"), pattern.alias("pattern"), F.col("p_partkey").alias("key"))


def v_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted chapters of books in parts: key, part, chapters."""
    x = table(spark, sf_dir, "lineitem").where((F.col("l_linenumber") <= 3) & (F.col("l_returnflag") == "R") & (F.col("l_partkey") % 4 > 0))
    return x.groupBy(F.col("l_partkey").alias("key"), F.col("l_linenumber").cast("int").alias("part")).agg((F.max(F.col("l_quantity").cast("long")) % 20).cast("int").alias("chapters"))


#: Subjects, imprints and labels of boxes among the headers.
HEADINGS = ["Physics", "Mathematics", "Social  Science", "Chapter 7", "1234", "Do You Know? more", "INDIA : PHYSICAL  ENVIRONMENT", "THEMES IN WORLD HISTORY"]
#: Directories of a library.
DIRS = ["science", "social-science-hindi", "physics-part-1", "health-and-physical-education", "misc", "sanskrit", "maths", "tamil"]


def _header() -> Column:
    w, i = F.left("text", F.lit(24)), F.col("doc_id")
    number = (i % 97).cast("string")
    kinds = [
        F.concat(number, F.lit(" | "), w), F.concat(w, F.lit("  "), number), F.lit("Reprint 2024-25"), F.concat(w, F.lit(" 2023-24")), F.left(w, F.lit(4)), F.concat(w, F.lit(" - Class IX")),
        F.element_at(F.array(*map(F.lit, HEADINGS)), (F.call_function("div", i, F.lit(10)) % 8 + 1).cast("int")), F.concat(F.lit("  7 –  "), w, F.lit(".;")), F.concat(w, F.lit(":;, ")), F.when(i % 50 != 9, F.concat(F.replace(w, F.lit(" "), F.lit("")), F.lit(" "), w)),
    ]
    return F.element_at(F.array(*kinds), (i % 10 + 1).cast("int"))


def v_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header lines: the beginnings of documents as books print them, with page numbers, imprints, classes and stray punctuation."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), _header().alias("t"))


def with_headers_and_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, raw_text, t and path of ``v_docs``, ``v_headers`` and ``v_paths`` together: all come from one row."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("raw_text"), _header().alias("t"), _path().alias("path"))


def v_page_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of the pages of books of five: most print the book's heading, in several spellings."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    heading = F.element_at(F.array(*map(F.lit, HEADINGS)), (F.call_function("div", i, F.lit(5)) % 8 + 1).cast("int"))
    t = F.when(i % 5 == 0, heading).when(i % 5 == 2, F.upper(heading)).when(i % 5 == 3, F.concat(heading, F.lit(": "))).otherwise(F.left("text", F.lit(24)))
    return d.select(F.call_function("div", i, F.lit(5)).alias("pdf"), (i % 5).alias("page"), t.alias("t"))


#: Titles as books print them, good ones and others, and the subjects of books.
TITLES = ["Describing Motion Around Us", "Sound Waves: Characteristics", "REAL NUMBERS", "Power Sharing", "Chapter 7", "Mathematics", "Physical Education: Relationship with Other Subjects", "Health and Physical Education - Class X"]
BOOK_SUBJECTS = ["science", "mathematics", "social-science", "hindi"]


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def v_book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of books of five documents: some begin with the chapter's title in one of several layouts; context is the title as a reader found it on the page."""
    k, p, text = F.call_function("div", F.col("doc_id"), F.lit(5)), F.col("doc_id") % 5, F.col("text")
    title, n = _pick(TITLES, k), (k % 17 + 1).cast("string")
    layouts = [F.concat(title, F.lit("\nChapter\n"), n, F.lit("\n"), text), F.concat(title, F.lit("\n"), n, F.lit(".1 "), text), F.concat(title, F.lit("\nChapter "), n, F.lit(" "), text), F.concat(title, F.lit(":\nMore of it\n"), n, F.lit("\n"), text)]
    page = F.coalesce(*[F.when((k + p) % 6 == i, x) for i, x in enumerate(layouts)], text)
    context = F.when((k % 3 == 0) | p.isin(1, 3), None).when(p == 2, F.upper(title)).otherwise(F.concat(title, F.lit(": ")))
    return table(spark, sf_dir, "documents").select(k.alias("doc"), p.alias("page"), _pick(BOOK_SUBJECTS, k).alias("subject"), page.alias("text"), context.alias("context"))


def v_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same books with what other sources say of their names."""
    k = F.col("doc")
    books = table(spark, sf_dir, "documents").select(F.call_function("div", F.col("doc_id"), F.lit(5)).alias("doc")).distinct()
    path = F.when(k % 3 == 0, F.concat(F.lit("/books/iesc_ch"), F.lpad((k % 40).cast("string"), 2, "0"), F.lit(".pdf"))).otherwise("/books/notes.pdf")
    return books.select(
        "doc", path.alias("path"), F.when(k % 7 == 0, "A Good Name").when(k % 7 == 1, "Chapter 3").alias("current"), F.when(k % 10 == 4, "Tissues in Action").alias("header"), F.when(k % 10 == 5, "Federalism").alias("known"),
        F.when(k % 10 == 6, "A Line That Looks Like One").alias("line"), F.when(k % 4 == 0, "Chapter 9").when(k % 4 == 1, "Synthesised name:").alias("synthesis"),
    )


def _path() -> Column:
    i = F.col("doc_id")
    slug = F.regexp_replace(T.lower(F.left("text", F.lit(18))), "[^a-z]+", "_")
    folder = F.when(i % 7 == 0, F.lit("misc")).otherwise(F.concat(F.lit("class-"), (i % 12 + 1).cast("string")))
    name = F.when(i % 3 == 0, F.concat(F.lit("iesc_ch"), F.lpad((i % 40).cast("string"), 2, "0"))).when(i % 3 == 1, F.concat(F.lit("jess_CH"), (i % 9).cast("string"), F.lit("-"), slug)).otherwise(slug)
    place = F.element_at(F.array(*map(F.lit, DIRS)), (i % 8 + 1).cast("int"))
    return F.concat(F.lit("/books/"), folder, F.lit("/"), place, F.lit("/"), name, F.lit(".pdf"))


def v_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of a library of documents, with codes, chapter numbers and slugs."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), _path().alias("path"))


def v_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as an audit sees them: what was extracted (ours) and what a reader saw (truth)."""
    i, n = F.col("doc_id"), F.col("n_chars")
    text = F.when(n % 7 == 0, F.lit("")).when(n % 7 == 1, F.lit("  ")).otherwise(F.left("text", (40 + n % 300).cast("int")))
    ours = F.struct(text.alias("text"), (n % 3).cast("int").alias("n_diagrams"), F.when(n % 4 == 0, 1).otherwise(0).alias("n_tables"))
    boxes = F.when(i % 4 != 3, F.array_repeat(F.array(*[F.lit(v) for v in (0, 0, 9, 9)]), (i % 3).cast("int")))
    truth = F.struct(
        (n % 6 != 0).alias("has_text"), F.when(n % 5 == 0, "garbled").when(n % 5 == 1, "scanned").otherwise("good").alias("text_quality"), (n % 4).cast("int").alias("num_figures"), boxes.alias("figure_bboxes"),
        F.when(i % 5 == 0, 3).otherwise(0).alias("num_equations"), (i % 3 == 0).alias("has_tables"), F.when(i % 9 != 0, 2).alias("num_tables"), (i % 6).cast("int").alias("num_charts"), F.when(i % 4 == 1, n % 5).cast("int").alias("verified_missed"),
    )
    return table(spark, sf_dir, "documents").select(F.call_function("div", i, F.lit(5)).alias("pdf_id"), (i % 5).alias("page"), ours.alias("ours"), truth.alias("truth"), F.when(i % 11 == 0, "timeout").alias("error"))


#: The same views in SQL, to be put before a query.
SQL = {
    "v_docs": "v_docs AS (SELECT doc_id AS id, lang AS class, source AS subject, left(text, 60) AS title, text AS raw_text, n_chars FROM documents)",
    "v_labels": "v_labels AS (SELECT doc_id AS pdf_id, quality, toxic FROM labels)",
    "v_videos": "v_videos AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderdate AS updated_at, o_custkey AS owner, o_orderpriority AS priority FROM orders)",
    "v_items": "v_items AS (SELECT l_orderkey AS video_id, l_linenumber AS seq, l_returnflag AS status, l_quantity AS qty, l_shipdate AS created_at FROM lineitem)",
    "v_versions": "v_versions AS (SELECT conv_id AS video_id, turn AS version_no, role AS author, text FROM conversations)",
    "v_queue": "v_queue AS (SELECT event_id, user_id AS item, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'claimed' WHEN 'click' THEN 'rendering' WHEN 'purchase' THEN 'ready' WHEN 'error' THEN 'failed' ELSE 'other' END AS status, value FROM events)",
    "v_boxes": "v_boxes AS (SELECT l_orderkey % 500 AS doc, l_orderkey % 7 AS page, l_orderkey AS grp, l_linenumber AS seq, l_partkey % 400 AS x0, l_suppkey * 7 % 600 AS y0, l_partkey % 400 + CAST(l_quantity AS BIGINT) * 4 + 20 AS x1, l_suppkey * 7 % 600 + (l_partkey + l_linenumber) % 180 + 10 AS y1, l_suppkey % 60 + 1 AS n_items FROM lineitem)",
    "v_lines": "v_lines AS (SELECT l_orderkey % 500 AS doc, l_orderkey % 7 AS page, l_partkey % 160 + 40 AS x0, l_suppkey * 11 % 700 + l_linenumber AS y0, l_partkey % 160 + 40 + CAST(l_quantity AS BIGINT) * 9 + 20 AS x1, l_suppkey * 11 % 700 + l_linenumber + 12 AS y1 FROM lineitem)",
    "v_images": "v_images AS (SELECT doc, page, x0, y0, x1, y1, CASE WHEN x0 % 3 = 0 THEN 640 ELSE (x1 - x0) * 2 END AS w, CASE WHEN x0 % 3 = 0 THEN 480 ELSE (y1 - y0) * 2 END AS h FROM v_boxes WHERE seq = 1)",
    "v_page_headers": "v_page_headers AS (SELECT doc_id // 5 AS pdf, doc_id % 5 AS page, CASE doc_id % 5 WHEN 0 THEN ['" + "', '".join(HEADINGS) + "'][doc_id // 5 % 8 + 1] WHEN 2 THEN upper(['" + "', '".join(HEADINGS) + "'][doc_id // 5 % 8 + 1]) WHEN 3 THEN ['" + "', '".join(HEADINGS) + "'][doc_id // 5 % 8 + 1] || ': ' ELSE left(text, 24) END AS t FROM documents)",
    "v_book_pages": "v_book_pages AS (SELECT k AS doc, p AS page, ['" + "', '".join(BOOK_SUBJECTS) + "'][k % 4 + 1] AS subject, CASE (k + p) % 6 WHEN 0 THEN t || chr(10) || 'Chapter' || chr(10) || n || chr(10) || text WHEN 1 THEN t || chr(10) || n || '.1 ' || text WHEN 2 THEN t || chr(10) || 'Chapter ' || n || ' ' || text WHEN 3 THEN t || ':' || chr(10) || 'More of it' || chr(10) || n || chr(10) || text ELSE text END AS text, CASE WHEN k % 3 = 0 OR p IN (1, 3) THEN NULL WHEN p = 2 THEN upper(t) ELSE t || ': ' END AS context FROM (SELECT *, doc_id // 5 AS k, doc_id % 5 AS p, CAST(doc_id // 5 % 17 + 1 AS VARCHAR) AS n, ['" + "', '".join(TITLES) + "'][doc_id // 5 % 8 + 1] AS t FROM documents))",
    "v_books": "v_books AS (SELECT doc, CASE WHEN doc % 3 = 0 THEN '/books/iesc_ch' || lpad(CAST(doc % 40 AS VARCHAR), 2, '0') || '.pdf' ELSE '/books/notes.pdf' END AS path, CASE doc % 7 WHEN 0 THEN 'A Good Name' WHEN 1 THEN 'Chapter 3' END AS current, CASE WHEN doc % 10 = 4 THEN 'Tissues in Action' END AS header, CASE WHEN doc % 10 = 5 THEN 'Federalism' END AS known, CASE WHEN doc % 10 = 6 THEN 'A Line That Looks Like One' END AS line, CASE doc % 4 WHEN 0 THEN 'Chapter 9' WHEN 1 THEN 'Synthesised name:' END AS synthesis FROM (SELECT DISTINCT doc_id // 5 AS doc FROM documents))",
    "v_catalogue": "v_catalogue AS (SELECT CAST(p_size % 12 + 1 AS VARCHAR) AS class, p_type AS subject, lower(left(p_brand, 2)) || p_partkey AS code, CAST(p_size AS INTEGER) AS chapters, 'https://books.example/' || lower(left(p_brand, 2)) || p_partkey || '${ch}.pdf' AS pattern, p_partkey AS key FROM part)",
    "v_parts": "v_parts AS (SELECT l_partkey AS key, CAST(l_linenumber AS INTEGER) AS part, CAST(max(CAST(l_quantity AS BIGINT)) % 20 AS INTEGER) AS chapters FROM lineitem WHERE l_linenumber <= 3 AND l_returnflag = 'R' AND l_partkey % 4 > 0 GROUP BY l_partkey, l_linenumber)",
    "v_headers": "v_headers AS (SELECT doc_id AS id, CASE doc_id % 10 WHEN 0 THEN (doc_id % 97)::VARCHAR || ' | ' || left(text, 24) WHEN 1 THEN left(text, 24) || '  ' || (doc_id % 97)::VARCHAR WHEN 2 THEN 'Reprint 2024-25' WHEN 3 THEN left(text, 24) || ' 2023-24' WHEN 4 THEN left(text, 4) WHEN 5 THEN left(text, 24) || ' - Class IX' WHEN 6 THEN ['" + "', '".join(HEADINGS) + "'][doc_id // 10 % 8 + 1] WHEN 7 THEN '  7 –  ' || left(text, 24) || '.;' WHEN 8 THEN left(text, 24) || ':;, ' ELSE CASE WHEN doc_id % 50 <> 9 THEN replace(left(text, 24), ' ', '') || ' ' || left(text, 24) END END AS t FROM documents)",
    "v_paths": "v_paths AS (SELECT doc_id AS id, '/books/' || CASE WHEN doc_id % 7 = 0 THEN 'misc' ELSE 'class-' || (doc_id % 12 + 1)::VARCHAR END || '/' || ['" + "', '".join(DIRS) + "'][doc_id % 8 + 1] || '/' || CASE doc_id % 3 WHEN 0 THEN 'iesc_ch' || lpad((doc_id % 40)::VARCHAR, 2, '0') WHEN 1 THEN 'jess_CH' || (doc_id % 9)::VARCHAR || '-' || regexp_replace(lower(left(text, 18)), '[^a-z]+', '_', 'g') ELSE regexp_replace(lower(left(text, 18)), '[^a-z]+', '_', 'g') END || '.pdf' AS path FROM documents)",
    "v_audit": "v_audit AS (SELECT doc_id // 5 AS pdf_id, doc_id % 5 AS page, CASE n_chars % 7 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE left(text, 40 + n_chars % 300) END AS text, n_chars % 3 AS ours, CASE WHEN n_chars % 4 = 0 THEN 1 ELSE 0 END AS our_tables, n_chars % 6 <> 0 AS has_text, CASE n_chars % 5 WHEN 0 THEN 'garbled' WHEN 1 THEN 'scanned' ELSE 'good' END AS quality, greatest(CASE WHEN doc_id % 4 <> 3 THEN doc_id % 3 ELSE 0 END, n_chars % 4) AS figures, CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 0 END AS equations, doc_id % 3 = 0 AS has_tables, CASE WHEN doc_id % 9 <> 0 THEN 2 ELSE 1 END AS num_tables, doc_id % 6 AS charts, CASE WHEN doc_id % 4 = 1 THEN n_chars % 5 END AS missed, CASE WHEN doc_id % 11 = 0 THEN 'timeout' END AS error FROM documents)",
}


#: Views that stand on others.
NEEDS = {"v_images": ("v_boxes",)}


def with_views(sql: str, *names: str) -> str:
    names = tuple(dict.fromkeys(x for n in names for x in (*NEEDS.get(n, ()), n)))
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names) + ("\n" if not sql.lstrip().startswith(",") else "") + sql
