"""Queries over segmenters, timing and contexts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import segment as S
from ..operators import timing
from ..sources.tables import table, v_docs, v_versions, with_views

Q: dict = {}
O: dict = {}


def query(sql: str | None, *views: str):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return keep


STRIP = "regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', '')"
N = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''))"
SENTS = "list_filter(list_transform(str_split(regexp_replace({t}, '([{e}])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: " + STRIP.format("s") + "), lambda s: {f})"


def _fold(parts: str, size: str, limit: int, joint: int) -> str:
    """A close-before fold in SQL over a list of strings."""
    return (
        f"list_reduce(list_prepend({{'done': CAST([] AS VARCHAR[]), 'buf': '', 'n': 0::BIGINT}}, list_transform({parts}, lambda s: {{'done': CAST([] AS VARCHAR[]), 'buf': s, 'n': CAST({size} AS BIGINT)}})), "
        f"lambda a, x: CASE WHEN a.buf = '' THEN {{'done': a.done, 'buf': x.buf, 'n': x.n}} WHEN a.n + x.n + {joint} > {limit} THEN {{'done': list_append(a.done, a.buf), 'buf': x.buf, 'n': x.n}} ELSE {{'done': a.done, 'buf': a.buf || ' ' || x.buf, 'n': a.n + x.n + {joint}}} END)"
    )


FLAT = "regexp_replace(" + STRIP.format("raw_text") + ", '\\s+', ' ', 'g')"
CHUNKS = ", x AS (SELECT id, " + _fold(SENTS.format(t=FLAT, e=".!?", f="s <> ''"), N.format("s"), 110, 0) + " AS a FROM v_docs), c AS (SELECT id, CASE WHEN a.buf <> '' THEN list_append(a.done, a.buf) ELSE a.done END AS c FROM x)"


@query(CHUNKS + " SELECT id, CAST(i AS INTEGER) AS pos, c[i + 1] AS chunk FROM c, unnest(range(0, len(c))) AS t(i)", "v_docs")
def chunk_words(spark, d):
    return v_docs(spark, d).select("id", F.posexplode(S.chunk_words(F.col("raw_text"))).alias("pos", "chunk"))


SCRIPTS = (
    ", s AS (SELECT id, " + SENTS.format(t="raw_text", e=".!?।", f="length(s) > 10") + " AS s, list_filter(list_transform(str_split(raw_text, chr(10) || chr(10)), lambda b: " + STRIP.format("b") + "), lambda b: length(b) > 20) AS b, left(raw_text, 2000) AS t FROM v_docs), "
    "p AS (SELECT id, CASE WHEN len(s) > 0 THEN s WHEN len(b) > 0 THEN b ELSE [t] END AS s FROM s), "
    "x AS (SELECT id, list_reduce(list_prepend({'done': CAST([] AS VARCHAR[][]), 'cur': CAST([] AS VARCHAR[]), 'n': 0::BIGINT}, list_transform(s, lambda y: {'done': CAST([] AS VARCHAR[][]), 'cur': [y], 'n': CAST(" + N.format("y") + " AS BIGINT)})), "
    "lambda a, y: CASE WHEN a.n + y.n >= 180 THEN {'done': list_append(a.done, list_concat(a.cur, y.cur)), 'cur': CAST([] AS VARCHAR[]), 'n': 0::BIGINT} ELSE {'done': a.done, 'cur': list_concat(a.cur, y.cur), 'n': a.n + y.n} END) AS a FROM p), "
    "r AS (SELECT id, CASE WHEN len(a.cur) > 0 THEN list_append(a.done, a.cur) ELSE a.done END AS r FROM x), "
    "e AS (SELECT id, CAST(i AS INTEGER) AS script, r[i + 1] AS sents FROM r, unnest(range(0, len(r))) AS t(i))"
)


@query(SCRIPTS + ", f AS (SELECT id, script, " + STRIP.format("left(array_to_string(sents[1:greatest(2, len(sents) // 6 + 1)], ' '), 80)") + " AS t, len(sents) AS n FROM e) SELECT id, script, n AS n_sentences, CASE WHEN length(t) > 60 THEN left(t, 60) || '…' ELSE t END AS title FROM f", "v_docs")
def segment_scripts(spark, d):
    x = v_docs(spark, d).select("id", F.posexplode(S.scripts(F.col("raw_text"))).alias("script", "sents"))
    first = F.regexp_replace(F.regexp_replace(F.left(S.boxes(F.col("sents"))[0], F.lit(80)), r"(?U)^\s+", ""), r"(?U)\s+$", "")
    return x.select("id", "script", F.size("sents").cast("long").alias("n_sentences"), F.when(F.length(first) > 60, F.concat(F.left(first, F.lit(60)), F.lit("…"))).otherwise(first).alias("title"))


@query(SCRIPTS + ", b AS (SELECT id, script, sents, greatest(2, len(sents) // 6 + 1) AS t FROM e) SELECT id, script, CAST(k AS INTEGER) AS box, array_to_string(sents[k * t + 1:k * t + t], ' ') AS text FROM b, unnest(range(0, CAST(ceil(len(sents) / t) AS BIGINT))) AS u(k)", "v_docs")
def segment_boxes(spark, d):
    x = v_docs(spark, d).select("id", F.posexplode(S.scripts(F.col("raw_text"))).alias("script", "sents"))
    return x.select("id", "script", F.posexplode(S.boxes(F.col("sents"))).alias("box", "text"))


#: RE2 has no look-around and ASCII word edges only: spaces are doubled, so that a match leaves one for the next.
DESPACED = "replace(regexp_replace(replace(" + STRIP.format("regexp_replace(raw_text, '\\s+', ' ', 'g')") + ", ' ', '  '), '(^|[^\\p{L}\\p{N}\\p{M}_])([a-zA-Z])  ([a-z]{2,})($|[^\\p{L}\\p{N}\\p{M}_])', '\\1\\2\\3\\4', 'g'), '  ', ' ')"
PIECES = (
    ", x AS (SELECT id, " + _fold(SENTS.format(t=DESPACED, e=".!?", f="s <> ''"), "length(s)", 300, 1) + " AS a FROM v_docs), p AS (SELECT id, CASE WHEN a.buf <> '' THEN list_append(a.done, a.buf) ELSE a.done END AS p FROM x), "
    "f AS (SELECT id, i, p[i] AS s, sum(CASE WHEN i = 1 OR length(p[i]) >= 40 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS k FROM p, unnest(range(1, len(p) + 1)) AS t(i))"
)


@query(PIECES + " SELECT id, CAST(k - 1 AS INTEGER) AS pos, string_agg(s, ' ' ORDER BY i) AS chunk FROM f GROUP BY id, k", "v_docs")
def chunk_chars(spark, d):
    return v_docs(spark, d).select("id", F.posexplode(S.chunk_chars(F.col("raw_text"))).alias("pos", "chunk"))


OVERLAP = (
    ", t AS (SELECT video_id, string_agg(text, chr(10) || chr(10) ORDER BY version_no, text) AS t FROM v_versions GROUP BY video_id), p AS (SELECT video_id, t, list_filter(list_transform(regexp_split_to_array(t, '\\n\\n+'), lambda x: " + STRIP.format("x") + "), lambda x: x <> '') AS p FROM t), "
    "s AS (SELECT *, list_transform(range(0, len(p) + 1), lambda i: coalesce(list_sum(list_transform(p[1:i], lambda x: length(x) + 2)), 0)) AS s FROM p), "
    # Chunks [lo, hi) one after another: hi is the furthest that the size allows, the next lo the last that leaves enough to overlap.
    "r AS (SELECT video_id, 0 AS n, 0::BIGINT AS lo, greatest(1, len(list_filter(s, lambda x: x <= 1502)) - 1)::BIGINT AS hi FROM s WHERE len(p) > 0 UNION ALL SELECT video_id, n + 1, lo, greatest(hi + 1, len(list_filter(s, lambda x: x <= s[lo + 1] + 1502)) - 1)::BIGINT FROM (SELECT r.video_id, n, s, hi, greatest(lo, coalesce(list_max(list_filter(range(lo, hi), lambda k: s[hi + 1] - s[k + 1] >= 300)), lo)) AS lo FROM r JOIN s ON s.video_id = r.video_id WHERE hi < len(p)))"
)


@query(OVERLAP + " SELECT r.video_id, n AS pos, array_to_string(p[lo + 1:hi], chr(10) || chr(10)) AS chunk FROM r JOIN s ON s.video_id = r.video_id UNION ALL SELECT video_id, 0, t FROM s WHERE len(p) = 0", "v_versions")
def chunk_overlap(spark, d):
    """Conversations as paragraphs, in overlapping chunks."""
    v = v_versions(spark, d).groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("version_no", "text"))), lambda x: x["text"]), "\n\n").alias("t"))
    return v.select("video_id", F.posexplode(S.chunk_overlap(F.col("t"), 1500, 300)).alias("pos", "chunk"))


@query(CHUNKS + " SELECT id, CAST(i AS INTEGER) AS pos, CASE WHEN len(c) = 1 THEN 'only' WHEN i = 0 THEN 'first' WHEN i = len(c) - 1 THEN 'last' ELSE 'middle' END AS place FROM c, unnest(range(0, len(c))) AS t(i)", "v_docs")
def chunk_position(spark, d):
    x = v_docs(spark, d).select("id", S.chunk_words(F.col("raw_text")).alias("c"))
    n = F.size("c")
    return x.select("id", n.alias("n"), F.posexplode("c").alias("pos", "chunk")).select("id", "pos", F.when(F.col("n") == 1, "only").when(F.col("pos") == 0, "first").when(F.col("pos") == F.col("n") - 1, "last").otherwise("middle").alias("place"))


@query(", x AS (SELECT id, raw_text AS t, id % 5 + 1 AS n, greatest(1, length(raw_text) // (id % 5 + 1)) AS s FROM v_docs) SELECT id, CAST(k AS INTEGER) AS page, " + STRIP.format("CASE WHEN k = n - 1 THEN substr(t, k * s + 1) ELSE substr(t, k * s + 1, s) END") + " AS text FROM x, unnest(range(0, n)) AS u(k)", "v_docs")
def page_split(spark, d):
    return v_docs(spark, d).select("id", F.posexplode(S.page_split(F.col("raw_text"), (F.col("id") % 5 + 1).cast("int"))).alias("page", "text"))


@query(", x AS (SELECT video_id, version_no, text FROM v_versions WHERE version_no % 3 <> 1) SELECT video_id, version_no, row_number() OVER (PARTITION BY video_id ORDER BY version_no) - 1 AS idx FROM x", "v_versions")
def reindex_segments(spark, d):
    """Places 0, 1, ... of what is left after some segments went."""
    x = v_versions(spark, d).where("version_no % 3 <> 1")
    return x.select("video_id", "version_no", (F.row_number().over(Window.partitionBy("video_id").orderBy("version_no")) - 1).cast("long").alias("idx"))


SEG = ", s AS (SELECT video_id, version_no, length(text) AS len, CASE WHEN version_no % 4 = 0 THEN NULL ELSE CAST(length(text) % 50 + 1 AS DOUBLE) END AS duration, text FROM v_versions)"


def _segs(spark, d):
    n = F.length("text")
    return v_versions(spark, d).select("video_id", "version_no", n.alias("len"), F.when(F.col("version_no") % 4 == 0, F.lit(None)).otherwise((n % 50 + 1).cast("double")).alias("duration"), "text")


@query(SEG + ", f AS (SELECT *, coalesce(duration, 60.0 / count(*) OVER (PARTITION BY video_id)) AS dur FROM s) SELECT video_id, version_no, round(coalesce(sum(dur) OVER (PARTITION BY video_id ORDER BY version_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS start FROM f", "v_versions")
def running_offset(spark, d):
    return timing.running_offset(_segs(spark, d), ["video_id"], "version_no", "duration", 60.0).select("video_id", "version_no", F.round("start", 3).alias("start"))


@query(SEG + ", f AS (SELECT *, 90.0 * len / sum(len) OVER (PARTITION BY video_id) AS dur FROM s WHERE len > 0), r AS (SELECT *, coalesce(sum(dur) OVER (PARTITION BY video_id ORDER BY version_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM f) SELECT video_id, version_no, round(start, 3) AS start, round(dur, 3) AS duration FROM r WHERE start < 60", "v_versions")
def proportional_timing(spark, d):
    """Durations in proportion to lengths; what starts after the cut-off goes, what crosses it stays."""
    x = timing.proportional(_segs(spark, d), ["video_id"], "version_no", "len", 90.0, 60.0)
    return x.select("video_id", "version_no", F.round("start", 3).alias("start"), F.round("duration", 3).alias("duration"))


@query(SEG + ", f AS (SELECT *, CAST(version_no * 10 + len % 7 AS DOUBLE) AS start FROM s) SELECT video_id, version_no, coalesce(lead(start) OVER (PARTITION BY video_id ORDER BY version_no) - start, coalesce(duration, 5.0) + 0.5) AS clip FROM f", "v_versions")
def lead_clip(spark, d):
    x = _segs(spark, d).withColumn("start", (F.col("version_no") * 10 + F.col("len") % 7).cast("double")).withColumn("duration", F.coalesce("duration", F.lit(5.0)))
    return timing.clip_lengths(x, ["video_id"], "version_no").select("video_id", "version_no", "clip")


@query(", l AS (SELECT *, left(text, 50) AS title, lead(left(text, 50)) OVER (PARTITION BY video_id ORDER BY version_no) AS nxt FROM v_versions) SELECT video_id, version_no, CASE WHEN coalesce(nxt, '') <> '' AND NOT contains(lower(text), 'next') THEN rtrim(text, '.!?') || ' — but that''s just the beginning. Let''s see what happens when we ' || lower(left(nxt, 40)) || '...' ELSE text END AS text FROM l", "v_versions")
def lead_bridge(spark, d):
    """A teaser of the next part's title where the text doesn't speak of what comes next."""
    return timing.bridge(v_versions(spark, d).withColumn("title", F.left("text", F.lit(50))), ["video_id"], "version_no", "text", "title").select("video_id", "version_no", "text")


@query(SEG + ", w AS (SELECT video_id, version_no, len, unnest(range(0, len % 6 + 1)) AS k FROM s) SELECT video_id, version_no, k, round(version_no * 10 + 5.0 * k / (len % 6 + 1), 6) AS t0, round(version_no * 10 + 5.0 * (k + 1) / (len % 6 + 1), 6) AS t1 FROM w", "v_versions")
def even_split(spark, d):
    """Words spread evenly over a segment that has no timings."""
    n = (F.col("len") % 6 + 1).cast("long")
    x = _segs(spark, d).select("video_id", "version_no", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
    at = lambda k: F.round(F.col("version_no") * 10 + F.lit(5.0) * k / F.col("n"), 6)
    return x.select("video_id", "version_no", "k", at(F.col("k")).alias("t0"), at(F.col("k") + 1).alias("t1"))


@query(SEG + " SELECT video_id, sum(duration) AS total, max(version_no * 10 + duration) AS ends FROM s GROUP BY video_id", "v_versions")
def timing_total(spark, d):
    return _segs(spark, d).groupBy("video_id").agg(F.sum("duration").alias("total"), F.max(F.col("version_no") * 10 + F.col("duration")).alias("ends"))


@query(", p AS (SELECT video_id, version_no, nullif(left(text, 40), '') AS summary, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')[1:5] AS concepts FROM v_versions) SELECT video_id, version_no, concat_ws(' | ', summary, CASE WHEN author = 'user' THEN 'activity' END, nullif(array_to_string(concepts, ', '), '')) AS context FROM p JOIN v_versions USING (video_id, version_no)", "v_versions")
def page_context(spark, d):
    """A page's context: its parts that are there, joined; five concepts at most."""
    from ..functions import text as T

    c = F.nullif(F.array_join(F.slice(T.words(F.col("text")), 1, 5), ", "), F.lit(""))
    return v_versions(spark, d).select("video_id", "version_no", F.concat_ws(" | ", F.nullif(F.left("text", F.lit(40)), F.lit("")), F.when(F.col("author") == "user", "activity"), c).alias("context"))


@query("SELECT video_id, string_agg('Page ' || CAST(version_no + 1 AS VARCHAR) || ': ' || left(text, 300), chr(10) ORDER BY version_no) AS context FROM v_versions WHERE version_no < 200 GROUP BY video_id", "v_versions")
def doc_context(spark, d):
    """A document's pages in order, one line each, 200 at most."""
    v = v_versions(spark, d).where("version_no < 200").select("video_id", F.struct("version_no", F.concat(F.lit("Page "), (F.col("version_no") + 1).cast("string"), F.lit(": "), F.left("text", F.lit(300))).alias("line")).alias("p"))
    return v.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["line"]), "\n").alias("context"))


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY video_id, version_no // 2 ORDER BY version_no) AS rn FROM v_versions WHERE trim(text) <> '') SELECT video_id, string_agg('[Textbook Diagram on page ' || CAST(version_no // 2 + 1 AS VARCHAR) || ': ' || trim(left(text, 1500)) || CASE WHEN author = 'user' THEN ' (layout: ' || author || ')' ELSE '' END || ']', chr(10) ORDER BY version_no // 2) AS context FROM r WHERE rn = 1 GROUP BY video_id", "v_versions")
def diagram_context(spark, d):
    """The first described diagram of each page, in order of pages."""
    page = F.floor(F.col("version_no") / 2)
    first = v_versions(spark, d).where(F.trim("text") != "").groupBy("video_id", page.alias("page")).agg(F.min_by(F.struct("text", "author"), "version_no").alias("f"))
    line = F.concat(F.lit("[Textbook Diagram on page "), (F.col("page") + 1).cast("string"), F.lit(": "), F.trim(F.left("f.text", F.lit(1500))), F.when(F.col("f.author") == "user", F.concat(F.lit(" (layout: "), F.col("f.author"), F.lit(")"))).otherwise(""), F.lit("]"))
    return first.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", line.alias("line")))), lambda p: p["line"]), "\n").alias("context"))


IV = "WITH w AS (SELECT event_id, user_id, epoch_ms(ts) / 1000.0 AS t FROM events), s AS (SELECT user_id, event_id AS seg, epoch_ms(ts) / 1000.0 AS s, 3600.0 * (event_id % 5 + 1) AS d FROM events WHERE event_type = 'signup')"


@query(IV + " SELECT s.seg, w.event_id FROM s JOIN w ON w.user_id = s.user_id AND w.t >= s.s AND w.t < s.s + s.d + 0.001")
def join_interval(spark, d):
    """Words whose start lies in a segment of the same document, by time buckets."""
    e = table(spark, d, "events")
    t = F.unix_millis(F.col("ts").cast("timestamp")) / 1000.0
    w = e.select("event_id", "user_id", t.alias("t"))
    s = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("seg"), t.alias("s"), (3600.0 * (F.col("event_id") % 5 + 1)).alias("d"))
    return timing.join_interval(w, s, ["user_id"], "t", "s", F.col("s") + F.col("d") + 0.001, 3600.0).select("seg", "event_id")


SPOKEN = ", s AS (SELECT video_id, version_no, w, unnest(range(0, len(w))) AS word_no FROM (SELECT video_id, version_no, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM v_versions)), h AS (SELECT video_id, version_no, word_no, w[word_no + 1] AS word, CASE WHEN (word_no + version_no) % 7 < 3 THEN NULL ELSE 0.5::DOUBLE * word_no END AS t0, CASE WHEN (word_no + version_no) % 7 < 3 THEN NULL ELSE 0.5::DOUBLE * word_no + 0.25::DOUBLE END AS t1 FROM s)"


def _spoken(spark, d):
    """Words of turns, of which some have a time."""
    w = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    x = v_versions(spark, d).select("video_id", "version_no", F.posexplode(w).alias("word_no", "word"))
    known = (F.col("word_no") + F.col("version_no")) % 7 >= 3
    return x.withColumn("t0", F.when(known, 0.5 * F.col("word_no"))).withColumn("t1", F.when(known, 0.5 * F.col("word_no") + 0.25))


@query(SPOKEN + " SELECT video_id, version_no, CAST(word_no AS INTEGER) AS word_no, regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS token FROM h", "v_versions")
def token_normalize(spark, d):
    """Words as alignment compares them."""
    return _spoken(spark, d).select("video_id", "version_no", "word_no", timing.normal_token(F.col("word")).alias("token"))


@query(
    SPOKEN + ", k AS (SELECT *, max(CASE WHEN t0 IS NOT NULL THEN word_no END) OVER w AS last, lead(t0) OVER v AS upto FROM h WINDOW v AS (PARTITION BY video_id, version_no ORDER BY word_no), w AS (PARTITION BY video_id, version_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "f AS (SELECT *, coalesce(0.5::DOUBLE * last + 0.25::DOUBLE, 1.0::DOUBLE) AS since, word_no - coalesce(last, -1) AS nth FROM k) SELECT video_id, version_no, CAST(word_no AS INTEGER) AS word_no, round(coalesce(t0, since + 0.4::DOUBLE * (nth - 1)), 3) AS t0, round(coalesce(t1, upto, since + 0.4::DOUBLE * nth), 3) AS t1 FROM f",
    "v_versions",
)
def gap_fill(spark, d):
    """Words without a time get theirs from the words around them."""
    x = timing.fill_gaps(_spoken(spark, d), ["video_id", "version_no"], "word_no", "t0", "t1", F.lit(1.0))
    return x.select("video_id", "version_no", "word_no", F.round("t0", 3).alias("t0"), F.round("t1", 3).alias("t1"))


@query(None)
def align_words(spark, d):
    """Each conversation's turns against the next ones, word by word: the next one's words as if they were heard half a second each."""
    return timing.align(v_versions(spark, d)).select("video_id", "version_no", "word_no", F.round("t0", 3).alias("t0"), F.round("t1", 3).alias("t1"))
