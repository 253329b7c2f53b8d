"""Queries over text functions, votes and title cascades."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import identify, spelling, votes
from ..operators import segment as S
from ..sources.tables import table, v_book_pages, v_books, v_docs, v_headers, v_page_headers, v_paths, v_versions, with_headers_and_paths, with_views

Q: dict = {}
O: dict = {}


def query(sql: str | None, *views: str):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return keep


WS = r"[\s\x0B\x{85}\x{A0}]"
STRIP = "regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', '')"
LOW = "regexp_replace(lower(" + STRIP.format("regexp_replace({c}, '\\s+([:;,])', '\\1', 'g')") + "), '\\s+', ' ', 'g')"


@query("SELECT id, len(list_filter(regexp_split_to_array(raw_text, '\\s+'), lambda w: w <> '')) AS n_words, len(str_split(raw_text, chr(10))) AS n_pages FROM v_docs", "v_docs")
def word_stats(spark, d):
    return v_docs(spark, d).select("id", F.size(T.words(F.col("raw_text"))).cast("long").alias("n_words"), F.size(F.split("raw_text", "\n")).cast("long").alias("n_pages"))


@query(
    ", a AS (SELECT id, regexp_replace(raw_text, '([\\p{L}\\p{N}_])-\\s*\\n\\s*([\\p{L}\\p{N}_])', '\\1\\2', 'g') AS t FROM v_docs), b AS (SELECT id, regexp_replace(t, '([\\p{L}\\p{N}_])\\s*\\n([a-z])', '\\1\\2', 'g') AS t FROM a), c AS (SELECT id, regexp_replace(t, '([a-z0-9,;:])\\n', '\\1 ', 'g') AS t FROM b), e AS (SELECT id, regexp_replace(regexp_replace(t, '\\s*/\\s*', ' ', 'g'), ' {3,}', '  ', 'g') AS t FROM c), f AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(t, '\\n[0-9]{1,3}\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '[□■●▪▸➢➤✓✗]', '', 'g') AS t FROM e) SELECT id, " + STRIP.format("t") + " AS clean FROM f",
    "v_docs",
)
def clean_text(spark, d):
    return v_docs(spark, d).select("id", T.clean_text(F.col("raw_text")).alias("clean"))


@query(
    ", a AS (SELECT id, regexp_replace(regexp_replace(raw_text, '[□▪•●■◆»›]', '', 'g'), '\\bsquare6\\b', '', 'g') AS t FROM v_docs), b AS (SELECT id, regexp_replace(regexp_replace(t, 'Activity \\d+\\.\\d+Activity \\d+\\.\\d+(Activity \\d+\\.\\d+)*', 'Activity:', 'g'), '(Figure|Table) [\\d.]+.?', '<figure>', 'g') AS t FROM a), c AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(t, '\\s+[a-zA-Z]\\s+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '  +', ' ', 'g') AS t FROM b) SELECT id, "
    + STRIP.format("t")
    + " AS clean FROM c",
    "v_docs",
)
def preclean_text(spark, d):
    return v_docs(spark, d).select("id", T.preclean(F.col("raw_text")).alias("clean"))


@query(", x AS (SELECT id, str_split(regexp_replace(raw_text, '([.!?।])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM v_docs) SELECT id, CAST(i AS INTEGER) AS pos, s[i + 1] AS sentence FROM x, unnest(range(0, len(s))) AS t(i)", "v_docs")
def sentence_split(spark, d):
    return v_docs(spark, d).select("id", F.posexplode(T.sentences(F.col("raw_text"))).alias("pos", "sentence"))


@query(", x AS (SELECT id, regexp_replace(title, '\\s+([:;,])', '\\1', 'g') AS t FROM v_docs) SELECT id, regexp_replace(lower(" + STRIP.format("t") + "), '\\s+', ' ', 'g') AS norm FROM x", "v_docs")
def title_normalize(spark, d):
    return v_docs(spark, d).select("id", T.title_normalize(F.col("title")).alias("norm"))


@query(
    ", x AS (SELECT id, regexp_replace(t, '\\s+', ' ', 'g') AS x FROM v_headers), y AS (SELECT id, x, regexp_replace(regexp_replace(x, '^\\s*\\d+\\s*[|\\-–—•]?\\s*', ''), '\\s*[|\\-–—•]?\\s*\\d+\\s*$', '') AS y FROM x) SELECT id, CASE WHEN length(x) < 6 OR length(y) < 6 OR regexp_matches(y, '\\d{4}\\s*-\\s*\\d{2}$') OR contains(y, 'Reprint') THEN NULL ELSE regexp_replace(y, '[.,;:]+$', '') END AS header FROM y",
    "v_headers",
)
def header_cleanup(spark, d):
    return v_headers(spark, d).select("id", T.header_cleanup(F.col("t")).alias("header"))


@query(
    ", x AS (SELECT id, t, regexp_replace(lower(" + STRIP.format("regexp_replace(t, '\\s+([:;,])', '\\1', 'g')") + "), '\\s+', ' ', 'g') AS low FROM v_headers), y AS (SELECT *, regexp_replace(low, '\\s+', '', 'g') AS tight FROM x) SELECT id, "
    "length(low) >= 10 AND (" + " OR ".join(f"regexp_matches({c}, '{p}')" for p in ["class\\s*[ivxlcdm]+\\s*$", "[-–—]\\s*class\\s*[ivxlcdm]+", "(health|science|mathematics|maths|social\\s*science|english|hindi)\\s*and\\s*", "^(mathematics|maths|science|social\\s*science|health\\s*and\\s*physical\\s*education|english|hindi|sanskrit)$"] for c in ("low", "tight")) + ") AS page_header, "
    "regexp_matches(low, '" + T.BOOKS + "') OR regexp_matches(tight, '" + T.BOOKS + "') OR " + " OR ".join(f"contains(tight, '{s}')" for s in T.SERIES) + " AS book_header, "
    + " OR ".join("starts_with(tight, '" + s.replace("'", "''") + "')" for s in T.CALLOUTS) + " AS callout, length(regexp_replace(low, '[^a-z]', '', 'g')) >= 6 AND (regexp_matches(low, '[{}\\[\\]+`\"''=@#$%^*<>~\\\\/|]') OR regexp_matches(t, '\\b[a-z]+[A-Z][a-z]+\\b')) AS garbled FROM y",
    "v_headers",
)
def title_filters(spark, d):
    t = F.col("t")
    return v_headers(spark, d).select("id", T.is_page_header(t).alias("page_header"), T.is_book_header(t).alias("book_header"), T.is_callout(t).alias("callout"), T.is_garbled_title(t).alias("garbled"))


@query(", x AS (SELECT id, regexp_replace(" + STRIP.format("t") + ", '[:;, ]+$', '') AS n FROM v_headers) SELECT id, coalesce(length(n) >= 4 AND NOT regexp_matches(n, '(?i)^Chapter\\s+\\d+$') AND NOT regexp_matches(n, '^\\d+$') AND lower(n) NOT IN ('" + "', '".join(T.SUBJECTS) + "'), false) AS ok FROM x", "v_headers")
def name_quality(spark, d):
    return v_headers(spark, d).select("id", T.name_ok(F.col("t")).alias("ok"))


@query(", x AS (SELECT id, regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{N}]', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM v_docs) SELECT id, left(s, 60) AS slug FROM x", "v_docs")
def slugify(spark, d):
    return v_docs(spark, d).select("id", T.slugify(F.col("title")).alias("slug"))


@query(", x AS (SELECT id, subject, row_number() OVER (PARTITION BY subject ORDER BY id) AS rn FROM v_docs) SELECT id, CASE WHEN rn = 1 THEN subject ELSE subject || '-' || CAST(rn AS VARCHAR) END AS slug FROM x", "v_docs")
def slug_unique(spark, d):
    """Slugs made unique by a number in place of the clock."""
    rn = F.row_number().over(Window.partitionBy("subject").orderBy("id"))
    return v_docs(spark, d).select("id", F.when(rn == 1, F.col("subject")).otherwise(F.concat("subject", F.lit("-"), rn.cast("string"))).alias("slug"))


@query(
    ", s AS (SELECT id, path, regexp_replace(str_split(path, '/')[-1], '\\.[^.]*$', '') AS stem FROM v_paths), r AS (SELECT *, trim(translate(regexp_replace(stem, '^[a-z]{2,4}_ch\\d+', ''), '_-', '  ')) AS rest, TRY_CAST(nullif(regexp_extract(stem, '(?i)ch(\\d+)', 1), '') AS INTEGER) AS chapter FROM s) SELECT id, chapter, CASE WHEN rest = '' THEN 'Chapter ' || coalesce(CAST(chapter AS VARCHAR), '') ELSE array_to_string(list_transform(str_split(lower(rest), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') END AS title FROM r",
    "v_paths",
)
def title_from_path(spark, d):
    p = F.col("path")
    return v_paths(spark, d).select("id", T.path_parts(p)[1].alias("chapter"), T.title_from_path(p).alias("title"))


@query(
    ", s AS (SELECT id, lower(path) AS low, str_split(lower(path), '/')[-2] AS parent FROM v_paths) SELECT id, nullif(regexp_extract(low, '/class-(\\d+)/', 1), '') AS class, coalesce(" + ", ".join(f"CASE WHEN starts_with(parent, '{k}') THEN '{v}' END" for k, v in T.SUBJECT_DIRS) + ", " + ", ".join(f"CASE WHEN contains(low, '/{k}/') OR contains(low, '/{k}-') THEN '{v}' END" for k, v in T.SUBJECT_DIRS) + ") AS subject, coalesce(" + ", ".join(f"CASE WHEN contains(low, '{k}') THEN '{v}' END" for k, v in T.LANGUAGES) + ", 'eng') AS langs FROM s",
    "v_paths",
)
def path_dims(spark, d):
    p = F.col("path")
    return v_paths(spark, d).select("id", T.path_parts(p)[2].alias("class"), T.subject_from_path(p).alias("subject"), T.languages_from_path(p).alias("langs"))


@query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_escape(F.col("html")).alias("escaped"))


MARKED = ", m AS (SELECT video_id, version_no, CASE version_no % 4 WHEN 0 THEN '[ACTIVITY] ' || text WHEN 1 THEN text WHEN 2 THEN '[DID YOU KNOW] ' || left(text, 20) || ' [NOTE] ' || substr(text, 21) ELSE '[lower] ' || text END AS t FROM v_versions)"


def _marked(spark, d):
    n, x = F.col("version_no") % 4, F.col("text")
    t = F.when(n == 0, F.concat(F.lit("[ACTIVITY] "), x)).when(n == 1, x).when(n == 2, F.concat(F.lit("[DID YOU KNOW] "), F.left(x, F.lit(20)), F.lit(" [NOTE] "), F.substr(x, F.lit(21)))).otherwise(F.concat(F.lit("[lower] "), x))
    return v_versions(spark, d).select("video_id", "version_no", t.alias("t"))


@query(MARKED + " SELECT video_id, version_no, " + STRIP.format("regexp_replace(t, '\\[[A-Z ]+\\]\\s*', '', 'g')") + " AS clean, nullif(array_to_string(list_transform(str_split(lower(regexp_extract(t, '\\[([A-Z ]+)\\]', 1)), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' '), '') AS marker FROM m", "v_versions")
def marker_strip(spark, d):
    t = F.col("t")
    return _marked(spark, d).select("video_id", "version_no", T.marker_strip(t).alias("clean"), T.marker(t).alias("marker"))


@query(", x AS (SELECT video_id, version_no, list_filter(regexp_split_to_array(regexp_replace(text, '[^\\p{L}\\p{N}_\\p{M}\\s]', '', 'g'), '\\s+'), lambda w: length(w) > 4 AND lower(w) NOT IN ('" + "', '".join(T.STOP) + "')) AS w FROM v_versions) SELECT video_id, version_no, CASE WHEN len(w) > 0 THEN array_to_string(w[1:8], ', ') ELSE 'educational concept' END AS prompt FROM x", "v_versions")
def keyword_prompt(spark, d):
    return v_versions(spark, d).select("video_id", "version_no", T.keywords(F.col("text")).alias("prompt"))


CAPTIONED = ", c AS (SELECT video_id, version_no, CASE (video_id + version_no) % 6 WHEN 0 THEN 'Fig. ' || (video_id % 9)::VARCHAR || '.' || version_no::VARCHAR || ': ' || left(text, 40) WHEN 1 THEN 'Figure ' || video_id::VARCHAR WHEN 2 THEN '  Table 3.4 ' || left(text, 30) WHEN 3 THEN 'see Fig. 6.1 for ' || left(text, 20) WHEN 4 THEN 'fig ' || version_no::VARCHAR || ' - ' || left(text, 25) ELSE 'Costs ' || (video_id % 9 + 1)::VARCHAR || ',234 ' || left(text, 10) END AS t FROM v_versions)"


def _captioned(spark, d):
    v, n, x = F.col("video_id"), F.col("version_no"), F.col("text")
    s, some = lambda c: c.cast("string"), lambda k: F.left(x, F.lit(k))
    kinds = [F.concat(F.lit("Fig. "), s(v % 9), F.lit("."), s(n), F.lit(": "), some(40)), F.concat(F.lit("Figure "), s(v)), F.concat(F.lit("  Table 3.4 "), some(30)), F.concat(F.lit("see Fig. 6.1 for "), some(20)), F.concat(F.lit("fig "), s(n), F.lit(" - "), some(25)), F.concat(F.lit("Costs "), s(v % 9 + 1), F.lit(",234 "), some(10))]
    return v_versions(spark, d).select("video_id", "version_no", F.element_at(F.array(*kinds), ((v + n) % 6 + 1).cast("int")).alias("t"))


CAP = "(?i)^\\s*((?:Fig|Figure|Table)\\.?\\s*\\d+(?:\\.\\d+)?)\\s*[:.\\-]?\\s*(.*)$"


@query(CAPTIONED + f" SELECT video_id, version_no, nullif(regexp_extract(t, '{CAP}', 1), '') AS label, nullif(regexp_extract(t, '{CAP}', 2), '') AS title, TRY_CAST(replace(regexp_extract(t, '\\d[\\d,]*', 0), ',', '') AS BIGINT) AS number FROM c", "v_versions")
def caption_split(spark, d):
    label, title = T.caption(F.col("t"))
    return _captioned(spark, d).select("video_id", "version_no", label.alias("label"), title.alias("title"), T.first_number(F.col("t")).alias("number"))


@query("SELECT id, length(title) >= 4 AND NOT regexp_matches(title, '[\\x{0400}-\\x{04FF}]') AND NOT (length(title) > 4 AND length(regexp_replace(title, '[^A-Za-z]', '', 'g')) > 0.8 * length(title)) AS ok FROM v_docs", "v_docs")
def script_guard(spark, d):
    return v_docs(spark, d).select("id", T.script_guard(F.col("title")).alias("ok"))


GARBLED = (
    ", s AS (SELECT id, " + STRIP.format("left(raw_text, 1500)") + " AS sample FROM v_docs), t AS (SELECT id, sample, list_filter(regexp_split_to_array(sample, '\\s+'), lambda w: w <> '') AS tok FROM s), a AS (SELECT *, list_filter(tok, lambda w: regexp_matches(w, '^[a-zA-Z]+$')) AS alpha FROM t), n AS (SELECT id, sample, len(tok) AS n, len(alpha) AS na, len(list_filter(alpha, lambda w: regexp_matches(lower(w), '[^aeiouy]{3,}'))) AS cl, len(list_filter(alpha, lambda w: NOT regexp_matches(lower(w), '[aeiouy]'))) AS dry, len(list_filter(tok, lambda w: regexp_matches(w, '^[a-zA-Z]{3,}$'))) AS plain FROM a) SELECT id, CASE WHEN sample = '' THEN true WHEN na > 0 AND cl / na > 0.20::DOUBLE THEN true WHEN na > 0 AND dry / na > 0.40::DOUBLE THEN true WHEN length(regexp_replace(sample, '[^\\x{0900}-\\x{097F}]', '', 'g')) > 15 THEN false ELSE NOT (plain / n > 0.35::DOUBLE) END AS garbled FROM n"
)


@query(GARBLED, "v_docs")
def garbled_detect(spark, d):
    return v_docs(spark, d).select("id", T.is_garbled(F.col("raw_text")).alias("garbled"))


@query(", x AS (SELECT *, row_number() OVER (PARTITION BY " + STRIP.format("title") + " ORDER BY id) AS rn FROM v_docs WHERE " + STRIP.format("title") + " <> '') SELECT id, title FROM x WHERE rn = 1", "v_docs")
def dedupe_first(spark, d):
    """The first document of each stripped title that is not empty."""
    return votes.first_by(v_docs(spark, d).select("id", "title").where(T.strip(F.col("title")) != ""), T.strip(F.col("title")), "id")


VOTE = ", c AS (SELECT id, subject, rtrim(trim(split_part(raw_text, ' ', 1)), ':;, ') AS name FROM v_docs), k AS (SELECT id, subject, name, regexp_replace(lower(name), '\\s+', ' ', 'g') AS norm FROM c WHERE length(name) >= 4)"


@query(VOTE + ", g AS (SELECT subject, norm, count(*) AS n, arg_max(name, {'l': length(name), 'i': -id}) AS name FROM k GROUP BY subject, norm), r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC, length(norm) DESC, norm) AS rn FROM g) SELECT subject, name, n FROM r WHERE rn = 1", "v_docs")
def vote_page_name(spark, d):
    """The most frequent name of a source, ties to the longer; its first longest spelling."""
    x = v_docs(spark, d).select("id", "subject", F.rtrim(F.trim(F.split_part("raw_text", F.lit(" "), F.lit(1))), F.lit(":;, ")).alias("name")).where("length(name) >= 4")
    return votes.vote(x.withColumn("norm", F.regexp_replace(F.lower("name"), r"\s+", " ")), ["subject"], "norm", "name", "id", prefer="longest")


PRINTED = ", k AS (SELECT pdf, page, n AS name, " + LOW.format(c="n") + " AS norm FROM (SELECT pdf, page, regexp_replace(" + STRIP.format("t") + ", '[:;, ]+$', '') AS n FROM v_page_headers) WHERE length(n) >= 4)"


@query(PRINTED + ", t AS (SELECT pdf, count(*) AS total FROM v_page_headers GROUP BY pdf), g AS (SELECT pdf, norm, count(*) AS n, min(page) AS first, arg_max(name, {'l': length(name), 'i': -page}) AS name FROM k GROUP BY pdf, norm), r AS (SELECT *, row_number() OVER (PARTITION BY pdf ORDER BY n DESC, first) AS rn FROM g) SELECT r.pdf, name, n FROM r JOIN t ON t.pdf = r.pdf WHERE rn = 1 AND n >= greatest(2, total // 4)", "v_page_headers")
def vote_header(spark, d):
    """The header that most pages of a book print, ties to the first seen, if a quarter of its pages do."""
    return votes.header_winner(v_page_headers(spark, d), ["pdf"], "t", "page")


@query(VOTE + ", g AS (SELECT subject, norm FROM k GROUP BY subject, norm HAVING count(DISTINCT id) >= 2) SELECT k.id, k.name, g.norm IS NOT NULL AS shared FROM k LEFT JOIN g ON g.subject = k.subject AND g.norm = k.norm", "v_docs")
def shared_headers(spark, d):
    """Whether a document's header is that of another of its source too."""
    x = v_docs(spark, d).select("id", "subject", F.rtrim(F.trim(F.split_part("raw_text", F.lit(" "), F.lit(1))), F.lit(":;, ")).alias("name")).where("length(name) >= 4")
    x = x.withColumn("norm", F.regexp_replace(F.lower("name"), r"\s+", " "))
    g = x.groupBy("subject", "norm").agg(F.count_distinct("id").alias("_n")).where("_n >= 2")
    return x.join(g, ["subject", "norm"], "left").select("id", "name", F.col("_n").isNotNull().alias("shared"))


TAGS = STRIP.format("regexp_replace({}, '<[^>]+>', ' ', 'g')")
TABLE = "CASE WHEN NOT contains({c}, '<table') THEN {c} WHEN len(regexp_extract_all({c}, '(?s)<tr>(.*?)</tr>', 1)) = 0 THEN " + TAGS.format("{c}") + " ELSE array_to_string(list_transform(regexp_extract_all({c}, '(?s)<tr>(.*?)</tr>', 1), lambda r: array_to_string(list_transform(regexp_extract_all(r, '(?s)<td[^>]*>(.*?)</td>', 1), lambda y: " + TAGS.format("y") + "), chr(9))), chr(10)) END"
LAYOUT = "(?s)^\\s*(\\w+)\\s*\\[\\s*[\\d.,\\s-]*\\]\\s*(.*)$"
GROUND = (
    ", g AS (SELECT video_id, version_no, 'text [68, 323, 484, 420]' || left(text, 60) || chr(10) || 'image [1,2,3,4]' || chr(10) || 'page_number [1,2,3,4]' || version_no::VARCHAR || chr(10) || '  ' || role || CASE version_no % 3 WHEN 0 THEN chr(10) || 'The image contains no text.' WHEN 1 THEN chr(10) || 'table [9,9,9,9]<table><tr><td>' || role || '</td><td> <b>' || turn::VARCHAR || '</b> </td></tr><tr><td>z</td></tr></table>' ELSE chr(10) || '  header [71, 175, 195, 190]CHAPTER  ' || chr(10) END AS t FROM (SELECT conv_id AS video_id, turn AS version_no, turn, role, text FROM conversations)), "
    "l AS (SELECT video_id, version_no, list_filter(list_transform(regexp_split_to_array(t, '\\r?\\n'), lambda x: " + STRIP.format("x") + "), lambda x: x <> '' AND NOT (" + " OR ".join(f"contains(lower(x), '{p}')" for p in T.REFUSALS) + ")) AS l FROM g), "
    f"k AS (SELECT video_id, version_no, list_transform(l, lambda x: CASE WHEN regexp_extract(x, '{LAYOUT}', 1) IN ('image', 'page_number') THEN '' WHEN regexp_extract(x, '{LAYOUT}', 1) <> '' THEN " + STRIP.format(TABLE.format(c=STRIP.format(f"regexp_extract(x, '{LAYOUT}', 2)"))) + " ELSE x END) AS k FROM l) SELECT video_id, version_no, array_to_string(list_filter(k, lambda x: x <> ''), chr(10)) AS text FROM k"
)


@query("WITH " + GROUND[2:])
def ocr_ground_clean(spark, d):
    c, n = table(spark, d, "conversations"), F.col("turn").cast("string")
    table_ = F.concat(F.lit("\ntable [9,9,9,9]<table><tr><td>"), "role", F.lit("</td><td> <b>"), n, F.lit("</b> </td></tr><tr><td>z</td></tr></table>"))
    last = F.when(F.col("turn") % 3 == 0, F.lit("\nThe image contains no text.")).when(F.col("turn") % 3 == 1, table_).otherwise(F.lit("\n  header [71, 175, 195, 190]CHAPTER  \n"))
    t = F.concat(F.lit("text [68, 323, 484, 420]"), F.left("text", F.lit(60)), F.lit("\nimage [1,2,3,4]\npage_number [1,2,3,4]"), n, F.lit("\n  "), "role", last)
    return c.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("version_no"), T.grounded_to_text(t).alias("text"))


@query("WITH g AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN '<table><tr><td>' || url || '</td><td class=\"x\"><b>' || page_id::VARCHAR || '</b> <i>c</i></td></tr><tr><td>z</td></tr></table>' ELSE '<table> ' || url || '<br></table>' END AS t FROM pages) SELECT page_id, " + TABLE.format(c="t") + " AS text FROM g")
def html_table_to_text(spark, d):
    n = F.col("page_id")
    rows = F.concat(F.lit("<table><tr><td>"), "url", F.lit('</td><td class="x"><b>'), n.cast("string"), F.lit("</b> <i>c</i></td></tr><tr><td>z</td></tr></table>"))
    t = F.when(n % 3 == 0, F.col("html")).when(n % 3 == 1, rows).otherwise(F.concat(F.lit("<table> "), "url", F.lit("<br></table>")))
    return table(spark, d, "pages").select("page_id", T.html_table_to_text(t).alias("text"))


LOCALES = ["en-IN", "hi-IN", "fr-FR", "en-US", "de-DE"]


@query("WITH v AS (SELECT c_custkey AS id, CASE c_custkey WHEN 1 THEN 'Name                 Gender  Tags' WHEN 2 THEN '-----' ELSE rpad(['" + "', '".join(LOCALES) + "'][c_custkey % 5 + 1] || '-' || replace(c_name, '#', ''), 32, ' ') || CASE WHEN c_nationkey % 2 = 0 THEN 'Female' ELSE 'Male' END || '  ' || lower(c_mktsegment) || CASE WHEN c_custkey % 4 = 0 THEN '   Friendly  Warm' ELSE '' END END AS t FROM customer), s AS (SELECT id, list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '') AS w FROM v WHERE id > 2) SELECT id, w[1] AS name, w[2] AS gender, array_to_string(w[3:], ' ') AS tags FROM s WHERE regexp_matches(w[1], '^(en-IN|hi-IN|en-US|en-GB)')")
def text_table_parse(spark, d):
    """A command's table: two header lines, white-space columns, the rest joined; some locales only."""
    i = F.col("c_custkey")
    name = F.concat(F.element_at(F.array(*map(F.lit, LOCALES)), (i % 5 + 1).cast("int")), F.lit("-"), F.replace("c_name", F.lit("#"), F.lit("")))
    line = F.concat(F.rpad(name, 32, " "), F.when(F.col("c_nationkey") % 2 == 0, "Female").otherwise("Male"), F.lit("  "), F.lower("c_mktsegment"), F.when(i % 4 == 0, "   Friendly  Warm").otherwise(""))
    x = table(spark, d, "customer").select(i.alias("id"), F.when(i == 1, "Name                 Gender  Tags").when(i == 2, "-----").otherwise(line).alias("t"))
    w = T.words(F.col("t"))
    x = x.where("id > 2").select("id", w[0].alias("name"), w[1].alias("gender"), F.array_join(F.slice(w, F.lit(3), F.greatest(F.size(w) - 2, F.lit(0))), " ").alias("tags"))
    return x.where(F.col("name").rlike("^(en-IN|hi-IN|en-US|en-GB)"))


DESCRIBED = ", d AS (SELECT id, CASE id % 8 WHEN 0 THEN 'Fig. 6.1 shows ' || title WHEN 1 THEN 'No diagram on this page' WHEN 2 THEN ' ' WHEN 3 THEN NULL WHEN 4 THEN left(raw_text, 150) WHEN 5 THEN 'A simple flowchart of ' || title WHEN 6 THEN left(title, 12) || ' map' ELSE left(raw_text, 70) || ' shows ' || title END AS t FROM v_docs)"


def _described(spark, d):
    t, raw = F.col("title"), F.col("raw_text")
    kinds = [F.concat(F.lit("Fig. 6.1 shows "), t), F.lit("No diagram on this page"), F.lit(" "), F.lit(None).cast("string"), F.left(raw, F.lit(150)), F.concat(F.lit("A simple flowchart of "), t), F.concat(F.left(t, F.lit(12)), F.lit(" map")), F.concat(F.left(raw, F.lit(70)), F.lit(" shows "), t)]
    return v_docs(spark, d).select("id", F.element_at(F.array(*kinds), (F.col("id") % 8 + 1).cast("int")).alias("t"))


@query(DESCRIBED + " SELECT id, CASE WHEN coalesce(" + STRIP.format("t") + ", '') = '' THEN false WHEN starts_with(lower(t), 'no diagram') OR contains(lower(t), 'no diagram on this page') THEN false WHEN " + " OR ".join(f"regexp_matches(t, '{p}')" for p in T.LABELS) + " THEN true WHEN length(t) > 80 AND (length(t) - length(replace(t, '.', '')) >= 2 OR contains(t, 'shows')) THEN true ELSE length(t) > 40 AND (" + " OR ".join(f"contains(lower(t), '{x}')" for x in T.DIAGRAM_TYPES) + ") END AS keep FROM d", "v_docs")
def intentional_filter(spark, d):
    return _described(spark, d).select("id", T.intentional(F.col("t")).alias("keep"))


@query(GARBLED.replace(") SELECT id, CASE", "), g AS (SELECT id, CASE") + ") SELECT d.id, CASE WHEN g.garbled THEN 'ocr' ELSE 'text' END AS method, CAST(length(raw_text) + CASE WHEN g.garbled THEN 4 ELSE 0 END AS INTEGER) AS n FROM g JOIN v_docs d ON d.id = g.id", "v_docs")
def extract_cascade(spark, d):
    """The text layer where it is sound; only the others are read again."""
    return votes.cheap_first(v_docs(spark, d).select("id", "raw_text"), F.col("raw_text"), ~T.is_garbled(F.col("raw_text")), lambda x: F.concat(F.lit("ocr:"), x)).select("id", F.length("text").alias("n"), "method")


HEAD = ", h AS (SELECT id, array_to_string(str_split(raw_text, chr(10))[1:12], chr(10)) AS head FROM v_docs), m AS (SELECT id, [" + ", ".join(f"nullif(regexp_extract(head, '{p}', {g}), '')" for _, p, g in S.TITLE_PATTERNS) + "] AS m FROM h), f AS (SELECT id, m, list_filter(range(1, " + str(len(S.TITLE_PATTERNS) + 1) + "), lambda i: m[i] IS NOT NULL)[1] AS i FROM m)"


@query(HEAD + " SELECT id, " + STRIP.format("m[i]") + " AS title, ['" + "', '".join(n for n, _, _ in S.TITLE_PATTERNS) + "'][i] AS pattern FROM f", "v_docs")
def title_extract(spark, d):
    """Titles by ordered patterns over the first pages (lines), the first match winning."""
    return S.title_by_patterns(v_docs(spark, d), "raw_text").select("id", "title", "pattern")


LINES = "list_filter(list_transform(str_split(raw_text, chr(10)), lambda x: " + STRIP.format("x") + "), lambda x: x <> '')"
ANY = lambda c, ps: "(" + " OR ".join(f"regexp_matches({c}, '{p}')" for p in ps) + ")"
GOING = lambda c: f"coalesce(regexp_matches({c}, '{S.GOES_ON}'), false)"
SUBJECT_LINES = "('" + "', '".join([*T.SUBJECTS, *[f"{s}:" for s in T.SUBJECTS if s != "maths"]]) + "')"
TITLE_LINE = (
    "length(l[i]) > 10 AND length(l[i]) < 100 AND " + ANY("l[i]", S.DETECT) + " AND NOT " + ANY("l[i]", S.REJECT) + " AND NOT (" + " OR ".join(f"contains(lower(l[i]), '{w}')" for w in S.SKIP) + ") "
    "AND (lower(l[i]) NOT IN " + SUBJECT_LINES + " OR ends_with(l[i], ':') AND (" + GOING("l[i + 1]") + " OR NOT coalesce(regexp_matches(l[i + 1], '^\\d+$'), false) AND " + GOING("l[i + 2]") + "))"
)
HEURISTIC = (
    f", l AS (SELECT id, {LINES} AS l FROM v_docs), a AS (SELECT id, l, coalesce(list_filter(range(1, len(l) + 1), lambda i: {TITLE_LINE})[1], 0) AS k FROM l), "
    "g AS (SELECT id, l, k, coalesce(list_filter(range(k + 1, least(k + 3, len(l)) + 1), lambda i: NOT " + GOING("l[i]") + " OR (ends_with(l[i], '.') AND length(l[i]) > 30))[1], least(k + 3, len(l)) + 1) AS stop FROM a), "
    "t AS (SELECT id, CASE WHEN k > 0 THEN regexp_replace(" + STRIP.format("regexp_replace(array_to_string(l[k:stop - 1], ' '), '\\s+', ' ', 'g')") + ", '[.,;: ]+$', '') END AS title FROM g)"
)


@query(HEURISTIC + " SELECT id, title FROM t", "v_docs")
def title_heuristic(spark, d):
    return S.heuristic_titles(v_docs(spark, d).select("id", "raw_text")).select("id", "title")


#: A curated map: codes, chapters and names.
KNOWN = [("iesc", 4, "Describing Motion"), ("iesc", 8, "Journey Inside the Atom"), ("jess", 1, "Power Sharing"), ("jess", 2, "Federalism"), ("iesc", 12, "Improvement in Food Resources")]
IDENTIFY = (
    HEURISTIC + ", x AS (SELECT id, t, regexp_replace(t, '\\s+', ' ', 'g') AS x FROM v_headers), y AS (SELECT id, x, regexp_replace(regexp_replace(x, '^\\s*\\d+\\s*[|\\-–—•]?\\s*', ''), '\\s*[|\\-–—•]?\\s*\\d+\\s*$', '') AS y FROM x), "
    "h AS (SELECT id, CASE WHEN length(x) < 6 OR length(y) < 6 OR regexp_matches(y, '\\d{4}\\s*-\\s*\\d{2}$') OR contains(y, 'Reprint') THEN NULL ELSE regexp_replace(y, '[.,;:]+$', '') END AS h FROM y), "
    "w AS (SELECT id, h, " + LOW.format(c="h") + " AS low, regexp_replace(" + STRIP.format("h") + ", '[:;, ]+$', '') AS n FROM h), v AS (SELECT *, regexp_replace(low, '\\s+', '', 'g') AS tight FROM w), "
    "header AS (SELECT id, CASE WHEN length(n) >= 4 AND NOT regexp_matches(n, '(?i)^Chapter\\s+\\d+$') AND NOT regexp_matches(n, '^\\d+$') AND lower(n) NOT IN ('" + "', '".join(T.SUBJECTS) + "') AND NOT (length(low) >= 10 AND (" + " OR ".join(f"regexp_matches({c}, '{p}')" for p in T.PAGE_HEADERS for c in ("low", "tight")) + ")) "
    "AND NOT (regexp_matches(low, '" + T.BOOKS + "') OR regexp_matches(tight, '" + T.BOOKS + "') OR " + " OR ".join(f"contains(tight, '{k}')" for k in T.SERIES) + ") AND NOT (" + " OR ".join("starts_with(tight, '" + k.replace("'", "''") + "')" for k in T.CALLOUTS) + ") "
    "AND NOT (length(regexp_replace(low, '[^a-z]', '', 'g')) >= 6 AND (regexp_matches(low, '[{}\\[\\]+`\"''=@#$%^*<>~\\\\/|]') OR regexp_matches(h, '\\b[a-z]+[A-Z][a-z]+\\b'))) THEN h END AS header FROM v), "
    "s AS (SELECT id, regexp_replace(str_split(path, '/')[-1], '\\.[^.]*$', '') AS stem FROM v_paths), r AS (SELECT *, trim(translate(regexp_replace(stem, '^[a-z]{2,4}_ch\\d+', ''), '_-', '  ')) AS rest, TRY_CAST(nullif(regexp_extract(stem, '(?i)ch(\\d+)', 1), '') AS INTEGER) AS chapter FROM s), "
    "f AS (SELECT id, " + "coalesce(" + ", ".join(f"CASE WHEN starts_with(stem, '{k}_') AND chapter = {n} THEN '{t}' END" for k, n, t in KNOWN) + ") AS known, CASE WHEN rest = '' THEN 'Chapter ' || coalesce(CAST(chapter AS VARCHAR), '') ELSE array_to_string(list_transform(str_split(lower(rest), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') END AS file FROM r), "
    "p AS (SELECT id, " + STRIP.format("m[i]") + " AS pattern FROM (SELECT id, m, list_filter(range(1, " + str(len(S.TITLE_PATTERNS) + 1) + "), lambda i: m[i] IS NOT NULL)[1] AS i FROM (SELECT id, [" + ", ".join(f"nullif(regexp_extract(head, '{q}', {g}), '')" for _, q, g in S.TITLE_PATTERNS) + "] AS m FROM (SELECT id, array_to_string(str_split(raw_text, chr(10))[1:12], chr(10)) AS head FROM v_docs))))"
)


@query(
    IDENTIFY + " SELECT id, coalesce(header, known, pattern, t.title, file) AS name, CASE WHEN header IS NOT NULL THEN 'header' WHEN known IS NOT NULL THEN 'known' WHEN pattern IS NOT NULL THEN 'pattern' WHEN t.title IS NOT NULL THEN 'heuristic' ELSE 'file' END AS method FROM header JOIN f USING (id) JOIN p USING (id) JOIN t USING (id)",
    "v_docs", "v_headers", "v_paths",
)
def identify_cascade(spark, d):
    """Names by strategies in order: running header, curated map, title patterns, heuristic line, file name; the first that finds one wins and is told."""
    h = T.header_cleanup(F.col("t"))
    sound = T.name_ok(h) & ~T.is_page_header(h) & ~T.is_book_header(h) & ~T.is_callout(h) & ~T.is_garbled_title(h)
    stem, chapter, _ = T.path_parts(F.col("path"))
    known = F.coalesce(*[F.when(F.startswith(stem, F.lit(f"{k}_")) & (chapter == n), t) for k, n, t in KNOWN])
    every = with_headers_and_paths(spark, d).where("id is not null")
    x = S.title_by_patterns(every, "raw_text").withColumnRenamed("title", "by_pattern")
    strategies = [("header", F.when(sound, h)), ("known", known), ("pattern", F.col("by_pattern")), ("heuristic", S.heuristic_title(F.col("raw_text"))), ("file", T.title_from_path(F.col("path")))]
    name, method = votes.cascade(strategies)
    return x.select("id", name.alias("name"), F.coalesce(method, F.lit("file")).alias("method"))  # a document without a text has no name


TITLED = "array_to_string(list_transform(regexp_extract_all({c}, '\\p{{L}}+|\\P{{L}}+'), lambda x: upper(left(x, 1)) || lower(substr(x, 2))), '')"
NAMES = ", n AS (SELECT id, CASE id % 5 WHEN 0 THEN regexp_replace(path, '/([^/]*)$', '/class-9_Science-\\1') WHEN 1 THEN regexp_replace(path, '/([^/]*)$', '/maths') || '.pdf' WHEN 2 THEN regexp_replace(path, '/([^/]*)$', '/physics-it''s 3rd_\\1') ELSE path END AS path FROM v_paths), "


@query(
    NAMES + "b AS (SELECT id, str_split(path, '/') AS parts, " + TITLED.format(c="regexp_replace(" + STRIP.format("translate(regexp_replace(regexp_replace(replace(str_split(path, '/')[-1], '.pdf', ''), '(?i)class-?\\d+[-_]', '', 'g'), '(?i)^(science|maths|mathematics|physics|chemistry|biology|social|english|hindi|sanskrit)-?', ''), '-_', '  ')") + ", '\\s+', ' ', 'g')") + " AS base FROM n), "
    "f AS (SELECT *, list_filter(parts, lambda p: lower(p) IN ('sanskrit', 'hindi') AND NOT contains(lower(base), lower(p)))[1] AS folder FROM b) SELECT id, CASE WHEN folder IS NOT NULL THEN " + TITLED.format(c="folder") + " || ' ' || base WHEN base = '' THEN parts[-1] ELSE base END AS title FROM f",
    "v_paths",
)
def title_catalogue(spark, d):
    """The catalogue's title of a path, with its language directory before it."""
    last = lambda to: F.regexp_replace("path", "/([^/]*)$", to)
    path = F.when(F.col("id") % 5 == 0, last("/class-9_Science-$1")).when(F.col("id") % 5 == 1, F.concat(last("/maths"), F.lit(".pdf"))).when(F.col("id") % 5 == 2, last("/physics-it's 3rd_$1")).otherwise(F.col("path"))
    return v_paths(spark, d).select("id", T.catalogue_title(path).alias("title"))


@query(", s AS (SELECT id, CASE id % 3 WHEN 0 THEN t || ' (' || left(t, 5) || ')' WHEN 1 THEN t || ' &  ' || left(t, 5) ELSE t END AS t FROM v_headers) SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(t), '[()]', '', 'g'), '\\s*&\\s*', '-and-', 'g'), '\\s+', '-', 'g'), '[^a-z0-9-]', '_', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM s", "v_headers")
def slugify_subject(spark, d):
    """Subjects as parts of addresses."""
    t = F.when(F.col("id") % 3 == 0, F.concat("t", F.lit(" ("), F.left("t", F.lit(5)), F.lit(")"))).when(F.col("id") % 3 == 1, F.concat("t", F.lit(" &  "), F.left("t", F.lit(5)))).otherwise(F.col("t"))
    return v_headers(spark, d).select("id", T.slugify_subject(t).alias("slug"))


@query(", s AS (SELECT id, regexp_replace(regexp_replace(t, '[^\\x00-\\x7F]', 'x', 'g'), '\\b([A-Z])([a-z]{2,})', '\\1 \\2 ', 'g') AS t FROM v_headers) SELECT id, " + STRIP.format("regexp_replace(regexp_replace(regexp_replace(t, '\\b([A-Za-z])\\s([a-z]{2,}\\b)', '\\1\\2', 'g'), '\\s+([:;,.])\\s*', '\\1 ', 'g'), '\\s{2,}', ' ', 'g')") + " AS title FROM s", "v_headers")
def title_despace(spark, d):
    """Letter-spaced headers, put together again."""
    return v_headers(spark, d).select("id", T.despace(F.regexp_replace(F.regexp_replace("t", r"[^\x00-\x7F]", "x"), r"\b([A-Z])([a-z]{2,})", "$1 $2 ")).alias("title"))


#: The rules that RE2 can run too: all but those that look ahead.
PLAIN_RULES = {k: [r for r in v if "(?!" not in r[0]] for k, v in identify.RULES.items()}
PLAIN_RULES = {k: v for k, v in PLAIN_RULES.items() if v}
TIDY = "regexp_replace(regexp_replace(regexp_replace(" + STRIP.format("{c}") + ", '\\s+', ' ', 'g'), '[.,;:]+$', ''), '\\s+([,;.])', '\\1', 'g')"
GOOD = "coalesce(length(regexp_replace({c}, '[:;, ]+$', '')) >= 4 AND NOT regexp_matches(regexp_replace({c}, '[:;, ]+$', ''), '(?i)^Chapter\\s+\\d+$') AND NOT regexp_matches(regexp_replace({c}, '[:;, ]+$', ''), '^\\d+$') AND lower(regexp_replace({c}, '[:;, ]+$', '')) NOT IN ('" + "', '".join(T.SUBJECTS) + "'), false)"
HITS = " UNION ALL ".join(
    f"SELECT doc, page, {place} AS place, regexp_extract(text, '(?m){pattern}', {title}) AS name, " + (f"TRY_CAST(regexp_extract(text, '(?m){pattern}', {number}) AS INTEGER)" if number else "NULL") + f" AS number FROM first_pages WHERE rules = '{subject}'"
    for subject, each in PLAIN_RULES.items() for place, (pattern, number, title) in enumerate([(p.replace("\\w", "\\pL\\pN_"), n, t) for p, n, t in each])
)
RULED = ", first_pages AS (SELECT doc, page, text, CASE WHEN subject IN ('" + "', '".join(PLAIN_RULES) + "') THEN subject ELSE 'social-science' END AS rules FROM v_book_pages WHERE page < 4), hits AS (SELECT doc, page, place, " + TIDY.format(c="name") + " AS name, number FROM (" + HITS + ")), ruled AS (SELECT doc, r.name AS name, r.number AS number, r.page + 1 AS start_page FROM (SELECT doc, arg_min({'name': name, 'number': number, 'page': page}, {'p': page, 'q': place}) AS r FROM hits WHERE name <> '' GROUP BY doc))"


@query(RULED + " SELECT doc, name, number, start_page FROM ruled", "v_book_pages")
def rule_titles(spark, d):
    """Chapters by the rules of a book's subject over its first four pages, the first match by page and rule."""
    return identify.by_rules(v_book_pages(spark, d), identify.rules(spark, PLAIN_RULES), list(PLAIN_RULES))


VOTED = (
    ", said AS (SELECT doc, page, name, " + LOW.format(c="name") + " AS norm FROM (SELECT doc, page, regexp_replace(" + STRIP.format("context") + ", '[:;, ]+$', '') AS name FROM v_book_pages) WHERE " + GOOD.format(c="name") + "), "
    "fair AS (SELECT * FROM said WHERE NOT (length(norm) >= 10 AND (" + " OR ".join(f"regexp_matches({c}, '{p}')" for p in T.PAGE_HEADERS for c in ("norm", "regexp_replace(norm, '\\s+', '', 'g')")) + "))), "
    "voted AS (SELECT doc, name FROM (SELECT doc, arg_max(name, {'l': length(name), 'i': -page}) AS name, row_number() OVER (PARTITION BY doc ORDER BY count(*) DESC, length(norm) DESC, norm) AS rn FROM fair GROUP BY doc, norm) WHERE rn = 1)"
)


@query(
    RULED + VOTED + ", f AS (SELECT b.*, v.name AS voted, r.name AS ruled, r.number AS ruled_number, TRY_CAST(nullif(regexp_extract(path, '(?i)ch(\\d+)', 1), '') AS INTEGER) AS chapter FROM v_books b LEFT JOIN voted v ON v.doc = b.doc LEFT JOIN ruled r ON r.doc = b.doc), "
    "i AS (SELECT *, coalesce(header, known, ruled, line, 'Chapter ' || chapter) AS initial, CASE WHEN header IS NOT NULL THEN 'header' WHEN known IS NOT NULL THEN 'known' WHEN ruled IS NOT NULL THEN 'content' WHEN line IS NOT NULL THEN 'line' WHEN chapter IS NOT NULL THEN 'filename' END AS how FROM f), "
    "c AS (SELECT doc, CASE WHEN " + GOOD.format(c="current") + " THEN current WHEN voted IS NOT NULL THEN voted WHEN " + GOOD.format(c="initial") + " THEN initial ELSE regexp_replace(coalesce(synthesis, ''), '[:;, ]+$', '') END AS name, CASE WHEN how = 'content' THEN coalesce(ruled_number, chapter) ELSE chapter END AS number, CASE WHEN " + GOOD.format(c="current") + " THEN 'kept' WHEN voted IS NOT NULL THEN 'page-aggregated' WHEN " + GOOD.format(c="initial") + " THEN how ELSE 'comprehensive' END AS method FROM i) "
    "SELECT doc, name, number, CASE WHEN " + GOOD.format(c="name") + " THEN method ELSE 'heuristic' END AS method FROM c",
    "v_book_pages", "v_books",
)
def identify_votes(spark, d):
    """A book's chapter: a good name stays, then its pages' vote, its own sources in order, a synthesis; what is no title is flagged."""
    return identify.identify(v_books(spark, d), v_book_pages(spark, d), identify.rules(spark, PLAIN_RULES), list(PLAIN_RULES))


NAMED = "upper(left({w}, 1)) || lower(substr({w}, 2))"
KEYWORDS = (
    ", w AS (SELECT video_id, version_no, regexp_extract_all(regexp_replace(text, '\\[[A-Z ]+\\]\\s*', '', 'g'), '[A-Za-z]+') AS w FROM v_versions), h AS (SELECT *, list_filter(w, lambda x: lower(x) NOT IN ('" + "', '".join(S.STOPWORDS) + "')) AS h FROM w), "
    "r AS (SELECT *, list_transform(list_reverse_sort(list_transform(list_filter(h, lambda x: length(x) >= 4), lambda x: {'n': length(x) + CASE WHEN regexp_matches(x, '^[A-Z]') THEN 3 WHEN regexp_matches(x, '[A-Z]') THEN 1 ELSE 0 END, 'w': " + NAMED.format(w="x") + "})), lambda y: y.w) AS r FROM h), "
    "d AS (SELECT *, list_filter(r, lambda x, i: list_position(r, x) = i)[1:5] AS d FROM r), b AS (SELECT *, CASE WHEN len(d) > 0 THEN d ELSE list_transform(h[1:5], lambda x: " + NAMED.format(w="x") + ") END AS b FROM d)"
)


@query(KEYWORDS + " SELECT video_id, version_no, array_to_string(list_concat(b, CASE WHEN len(b) < 3 THEN list_transform(w[len(b) + 1:3], lambda x: " + NAMED.format(w="x") + ") ELSE [] END), ', ') AS keywords FROM b", "v_versions")
def top_keywords(spark, d):
    return S.top_keywords(v_versions(spark, d), F.col("text")).select("video_id", "version_no", F.array_join("keywords", ", ").alias("keywords"))


DICTIONARY = ", d AS MATERIALIZED (SELECT w FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(raw_text), '\\p{L}+'))) AS w FROM v_docs) WHERE length(w) <= 40 GROUP BY w HAVING count(*) >= 3 ORDER BY count(*) DESC, w LIMIT 20000)"
MERGED = "regexp_replace(raw_text, '([a-z]{4,}) ([a-z]{3,}) ([a-z]+)', '\\1\\2 \\3', 'g')"
TORN = "regexp_replace(raw_text, '([a-z]{3})([a-z]{4,})', '\\1 \\2', 'g')"
PLACES = ", x AS (SELECT id, regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+') AS ws FROM v_docs), o AS MATERIALIZED (SELECT id, i, ws[i] AS word, regexp_extract(ws[i], '[\\p{{L}}\\p{{N}}](?:.*[\\p{{L}}\\p{{N}}])?') AS core FROM (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS i FROM x))"
CUTS = (
    ", u AS MATERIALIZED (SELECT DISTINCT lower(core) AS w, length(core) AS n FROM o WHERE length(core) BETWEEN 7 AND 256 AND regexp_matches(core, '\\p{L}') AND lower(core) NOT IN (SELECT w FROM d)), "
    "p(w, n, pos, cuts, done) AS (SELECT w, n, 0, []::INTEGER[], false FROM u UNION ALL SELECT q.w, q.n, k, list_append(q.cuts, k), q.rest IN (SELECT w FROM d) FROM (SELECT w, n, cuts, k, substr(w, pos + 1, k - pos) AS head, substr(w, k + 1) AS rest FROM (SELECT w, n, pos, cuts, CAST(unnest(range(pos + 4, n - 2)) AS INTEGER) AS k FROM p WHERE NOT done)) q "
    "WHERE q.head IN (SELECT w FROM d) AND (q.rest IN (SELECT w FROM d) OR length(q.rest) >= 6)), "
    "c AS MATERIALIZED (SELECT w, cuts FROM (SELECT w, cuts, row_number() OVER (PARTITION BY w ORDER BY cuts DESC) AS rn FROM p WHERE done) WHERE rn = 1)"
)


@query(
    DICTIONARY + PLACES.format(MERGED) + CUTS + ", f AS (SELECT o.id, o.i, c.w IS NOT NULL AS cut, CASE WHEN c.w IS NULL THEN word ELSE substr(word, 1, strpos(word, core) - 1) || array_to_string(list_transform(range(0, len(cuts) + 1), lambda t: substr(core, CASE WHEN t = 0 THEN 0 ELSE cuts[t] END + 1, CASE WHEN t = len(cuts) THEN length(core) ELSE cuts[t + 1] END - CASE WHEN t = 0 THEN 0 ELSE cuts[t] END)), ' ') || substr(word, strpos(word, core) + length(core)) END AS t FROM o LEFT JOIN c ON c.w = lower(o.core)), "
    "g AS (SELECT id, count(*) FILTER (WHERE cut) AS n_split, string_agg(t, ' ' ORDER BY i) AS fixed FROM f GROUP BY id) SELECT x.id, CAST(coalesce(n_split, 0) AS INTEGER) AS n_split, coalesce(fixed, '') AS fixed FROM x LEFT JOIN g ON g.id = x.id",
    "v_docs",
)
def spell_split(spark, d):
    """Words that were run together, cut by a dictionary of the corpus's commonest words."""
    x = v_docs(spark, d).select("id", "raw_text")
    run_together = x.withColumn("raw_text", F.regexp_replace("raw_text", "([a-z]{4,}) ([a-z]{3,}) ([a-z]+)", "$1$2 $3"))
    return spelling.split(run_together, spelling.dictionary(x))


@query(
    DICTIONARY + PLACES.format(TORN) + ", b AS (SELECT id, i, word, core, lead(word) OVER w AS word2, lead(core) OVER w AS core2 FROM o WINDOW w AS (PARTITION BY id ORDER BY i)), "
    "k AS (SELECT id, i, word || word2 AS t, i - row_number() OVER (PARTITION BY id ORDER BY i) AS run FROM b WHERE word2 IS NOT NULL AND regexp_matches(word, '[\\p{L}\\p{N}]$') AND regexp_matches(word2, '^[\\p{L}\\p{N}]') AND length(core || core2) <= 40 AND lower(core || core2) IN (SELECT w FROM d) AND (lower(core) NOT IN (SELECT w FROM d) AND regexp_matches(core, '\\p{L}') OR lower(core2) NOT IN (SELECT w FROM d) AND regexp_matches(core2, '\\p{L}'))), "
    "j AS (SELECT id, i, t FROM (SELECT id, i, t, row_number() OVER (PARTITION BY id, run ORDER BY i) AS nth FROM k) WHERE nth % 2 = 1), "
    "g AS (SELECT o.id, count(j.i) AS n_joined, string_agg(coalesce(j.t, o.word), ' ' ORDER BY o.i) AS fixed FROM o LEFT JOIN j ON j.id = o.id AND j.i = o.i LEFT JOIN j l ON l.id = o.id AND l.i = o.i - 1 WHERE l.i IS NULL GROUP BY o.id) "
    "SELECT x.id, CAST(coalesce(n_joined, 0) AS INTEGER) AS n_joined, coalesce(fixed, '') AS fixed FROM x LEFT JOIN g ON g.id = x.id",
    "v_docs",
)
def spell_join(spark, d):
    """Fragments that extraction tore apart, put together."""
    x = v_docs(spark, d).select("id", "raw_text")
    return spelling.join(x.withColumn("raw_text", F.regexp_replace("raw_text", "([a-z]{3})([a-z]{4,})", "$1 $2")), spelling.dictionary(x))
