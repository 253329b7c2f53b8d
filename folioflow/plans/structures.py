"""Queries over JSON, page regions, the audit, the queue's state machine and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import jsonx as J
from ..operators import audit
from ..operators import boxes as X
from ..operators import queue
from ..sources.tables import table, v_audit, v_boxes, v_images, v_lines, v_queue, v_versions, with_views
from ..streaming import queue as stream
from .text import STRIP

Q: dict = {}
O: dict = {}


def query(sql: str | None, *views: str):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return keep


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def json_extract(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"))


@query("SELECT event_id, '{\"k\":\"' || json_extract_string(props, '$.k') || '\",\"seen\":\"' || event_type || '\"}' AS props FROM events")
def json_set(spark, d):
    return table(spark, d, "events").select("event_id", J.json_set(F.col("props"), "seen", F.col("event_type")).alias("props"))


@query("SELECT video_id, version_no, '{\"index\":' || CAST(version_no AS VARCHAR) || ',\"author\":\"' || author || '\",\"n\":' || CAST(length(text) AS VARCHAR) || '}' AS doc FROM v_versions", "v_versions")
def json_build(spark, d):
    return v_versions(spark, d).select("video_id", "version_no", F.to_json(F.struct(F.col("version_no").alias("index"), "author", F.length("text").alias("n"))).alias("doc"))


NESTED = "c AS (SELECT conv_id AS doc, turn, role FROM conversations)"


@query("WITH " + NESTED + ", x AS (SELECT doc, turn, CASE WHEN turn % 3 = 2 THEN CAST([NULL] AS VARCHAR[]) ELSE [role, 'b'] END AS labels FROM c WHERE doc % 11 <> 0), e AS (SELECT doc, turn, labels, unnest(range(0, len(labels))) AS i FROM x) SELECT doc, CAST(turn AS INTEGER) AS page, CASE WHEN turn % 3 <> 2 THEN CAST(i AS INTEGER) END AS pos, labels[i + 1] AS label FROM e")
def json_explode(spark, d):
    """Pages, and in them diagrams; a page without any stays, a document that doesn't parse goes."""
    c = table(spark, d, "conversations")
    labels = F.when(F.col("turn") % 3 == 2, "").otherwise(F.concat(F.lit('{"label":"'), "role", F.lit('"},{"label":"b"}')))
    page = F.concat(F.lit('{"page":'), F.col("turn").cast("string"), F.lit(',"diagrams":['), labels, F.lit("]}"))
    docs = c.groupBy(F.col("conv_id").alias("doc")).agg(F.array_join(F.array_sort(F.collect_list(page)), ",").alias("p"))
    t = F.concat(F.when(F.col("doc") % 11 == 0, "broken").otherwise(""), F.lit('{"pages":['), "p", F.lit("]}"))
    j = F.from_json(t, "pages array<struct<page: int, diagrams: array<struct<label: string>>>>")
    x = docs.select("doc", F.explode(j["pages"]).alias("p"))
    return x.select("doc", F.col("p.page").alias("page"), F.posexplode_outer("p.diagrams").alias("pos", "g")).select("doc", "page", "pos", F.col("g.label").alias("label"))


REPLY = (
    "r AS (SELECT event_id AS id, CASE event_id % 8 WHEN 0 THEN '```json' || chr(10) || '{\"scripts\": [' || event_id || ', 2]}' || chr(10) || '```' WHEN 1 THEN '[' || event_id || ']' WHEN 2 THEN 'Sure: {\"a\": \"' || event_type || '\"} done' WHEN 3 THEN event_type "
    "WHEN 4 THEN '{\"scripts\": []}' WHEN 5 THEN '{\"segments\": [{\"text\": \"' || event_type || '\"}]}' WHEN 6 THEN NULL ELSE '{\"a\": ' || props || '} and {\"c\": 3}' END AS t FROM events), "
    "u AS (SELECT *, regexp_replace(regexp_replace(trim(t), '^```(?:json)?\\s*', ''), '\\s*```$', '') AS u, nullif(regexp_extract(t, '(?s)\\{.*\\}', 0), '') AS body, nullif(regexp_extract(t, '\\{[^{}]*\\}', 0), '') AS flat FROM r)"
)
LIST = "CASE WHEN {c} IS NULL OR NOT json_valid({c}) THEN '[]' WHEN json_type({c}) = 'ARRAY' THEN CAST(json_extract({c}, '$') AS VARCHAR) WHEN json_type({c}, '$.scripts') = 'ARRAY' THEN CAST(json_extract({c}, '$.scripts') AS VARCHAR) WHEN json_type({c}, '$.segments') = 'ARRAY' THEN CAST(json_extract({c}, '$.segments') AS VARCHAR) ELSE '[]' END"


def _replies(spark, d):
    """Replies as models give them: fenced, bare, in prose, empty, none, two at once."""
    i, kind, props = F.col("event_id"), F.col("event_type"), F.col("props")
    kinds = [
        F.concat(F.lit('```json\n{"scripts": ['), i.cast("string"), F.lit(", 2]}\n```")), F.concat(F.lit("["), i.cast("string"), F.lit("]")), F.concat(F.lit('Sure: {"a": "'), kind, F.lit('"} done')), kind,
        F.lit('{"scripts": []}'), F.concat(F.lit('{"segments": [{"text": "'), kind, F.lit('"}]}')), F.lit(None).cast("string"), F.concat(F.lit('{"a": '), props, F.lit('} and {"c": 3}')),
    ]
    return table(spark, d, "events").select(i.alias("id"), F.element_at(F.array(*kinds), (i % 8 + 1).cast("int")).alias("t"))


@query("WITH " + REPLY + " SELECT id, " + LIST.format(c="u") + " AS scripts, CASE WHEN body IS NOT NULL AND json_valid(body) THEN body END AS object, flat FROM u")
def json_llm_parse(spark, d):
    """What can be had from a model's reply: its list, its outer object if it parses, its first flat object."""
    t = F.col("t")
    return _replies(spark, d).select("id", J.script_list(J.unfence(t)).alias("scripts"), J.salvaged(t).alias("object"), J.flat_object(t).alias("flat"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(CASE WHEN event_id % 3 <> 0 THEN props END, '$.k') AS INTEGER), -1) AS k FROM events")
def json_tolerant_parse(spark, d):
    """Broken documents count as empty ones."""
    t = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{oops "), "props")).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.coalesce(F.from_json(t, "k int")["k"], F.lit(-1)).alias("k"))


@query("WITH " + REPLY + ", p AS (SELECT id, CASE WHEN id % 8 <> 7 THEN t END AS t FROM r) SELECT id, " + LIST.format(c="t") + " AS items FROM p")
def json_polymorphic(spark, d):
    """A list, or an object with scripts or segments."""
    return _replies(spark, d).select("id", J.script_list(F.when(F.col("id") % 8 != 7, F.col("t"))).alias("items"))


@query("SELECT event_id AS id, CASE WHEN event_type = 'view' AND coalesce(CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN props END, '') = '' THEN 'reference' ELSE 'real' END AS route FROM events")
def diagram_routing(spark, d):
    """Whole-page renderings without a description are references; anything else, also what doesn't parse, is real."""
    i, kind = F.col("event_id"), F.col("event_type")
    methods = F.when(kind == "view", '{"source":"full_page"}').when(kind == "click", "broken").when(kind == "error", F.lit(None)).otherwise(F.concat(F.lit('{"source":"'), kind, F.lit('"}')))
    x = table(spark, d, "events").select(i.alias("id"), methods.alias("methods"), F.when(i % 3 == 0, "").when(i % 3 == 1, F.col("props")).alias("t"))
    full = F.coalesce(F.get_json_object("methods", "$.source") == "full_page", F.lit(False))
    return x.select("id", F.when(full & (F.coalesce("t", F.lit("")) == ""), "reference").otherwise("real").alias("route"))


@query("SELECT doc, page, grp, seq, x0 * 150 // 72 AS px0, y1 * 150 // 72 AS py1, x1 * 1000 // 612 AS fx1, y0 * 1000 // 792 AS fy0 FROM v_boxes", "v_boxes")
def box_units(spark, d):
    c = F.col
    return v_boxes(spark, d).select("doc", "page", "grp", "seq", B.to_pixels(c("x0"), 150).cast("long").alias("px0"), B.to_pixels(c("y1"), 150).cast("long").alias("py1"), F.call_function("div", c("x1") * 1000, F.lit(612)).alias("fx1"), F.call_function("div", c("y0") * 1000, F.lit(792)).alias("fy0"))


@query("SELECT doc, page, grp, seq, (x1 - x0) * (y1 - y0) AS area, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, greatest(0, least(x1, 300) - greatest(x0, 100)) * greatest(0, least(y1, 400) - greatest(y0, 200)) AS inter FROM v_boxes", "v_boxes")
def box_metrics(spark, d):
    c = F.col
    ref = tuple(F.lit(v) for v in (100, 200, 300, 400))
    return v_boxes(spark, d).select("doc", "page", "grp", "seq", B.area(*X.box()).alias("area"), ((c("x0") + c("x1")) / 2).alias("cx"), ((c("y0") + c("y1")) / 2).alias("cy"), B.overlap_area(X.box(), ref).alias("inter"))


@query(", b AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM v_boxes) SELECT doc, page, grp, seq, (h > 100 AND w / h < 0.25) OR w <= 0 OR h <= 0 AS strip, least(w, h) >= 100 AND greatest(w, h) <= 2000 AND NOT (abs(w - h) <= 0.1 * greatest(w, h) AND greatest(w, h) < 300) AS image_ok FROM b WHERE n_items >= 40 AND x0 >= -0.5 AND x1 <= 612.5 AND NOT y1 > 777 AND NOT (h < 10 AND w > 0.4 * 612) AND NOT (w > 0.85 * 612 AND h < 0.5 * 792) AND w >= 80 AND h >= 60", "v_boxes")
def box_guards(spark, d):
    x = X.keep_region(v_boxes(spark, d), 612, 792)
    return x.select("doc", "page", "grp", "seq", X.is_strip(*X.box()).alias("strip"), X.keep_image(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("image_ok"))


COVER = ", t AS (SELECT * FROM v_boxes WHERE seq <= 2), o AS (SELECT * FROM v_boxes WHERE seq > 2)"


@query(COVER + ", b AS (SELECT t.doc, t.page, t.grp, t.seq, max(greatest(0, least(t.x1, o.x1) - greatest(t.x0, o.x0)) * greatest(0, least(t.y1, o.y1) - greatest(t.y0, o.y0)) / ((t.x1 - t.x0) * (t.y1 - t.y0))) AS best FROM t JOIN o ON o.doc = t.doc AND o.page = t.page GROUP BY ALL) SELECT t.doc, t.page, t.grp, t.seq, round(coalesce(best, 0), 6) AS best, coalesce(best, 0) >= 0.5 AS covered FROM t LEFT JOIN b ON b.doc = t.doc AND b.page = t.page AND b.grp = t.grp AND b.seq = t.seq", "v_boxes")
def box_coverage(spark, d):
    v = v_boxes(spark, d)
    return X.coverage(v.where("seq > 2"), v.where("seq <= 2")).select("doc", "page", "grp", "seq", F.round("best", 6).alias("best"), "covered")


@query(", c AS (SELECT * FROM v_boxes WHERE seq = 1), r AS (SELECT * FROM v_boxes WHERE seq > 1), h AS (SELECT c.doc, c.page, c.grp, c.seq, r.grp AS rg, r.seq AS rs, (r.x1 - r.x0) * (r.y1 - r.y0) AS area FROM c JOIN r ON r.doc = c.doc AND r.page = c.page AND r.y1 <= c.y0 AND r.x0 < c.x1 AND r.x1 > c.x0), k AS (SELECT *, row_number() OVER (PARTITION BY doc, page, grp, seq ORDER BY area DESC, rg, rs) AS rn FROM h) SELECT c.doc, c.page, c.grp, c.seq, k.rg AS region_grp, k.rs AS region_seq, k.area FROM c LEFT JOIN k ON k.doc = c.doc AND k.page = c.page AND k.grp = c.grp AND k.seq = c.seq AND k.rn = 1", "v_boxes")
def box_caption_match(spark, d):
    v = v_boxes(spark, d)
    return X.match_captions(v.where("seq = 1"), v.where("seq > 1")).select("doc", "page", "grp", "seq", F.col("region.r_grp").alias("region_grp"), F.col("region.r_seq").alias("region_seq"), "area")


@query(", c AS (SELECT * FROM v_boxes WHERE seq = 1), t AS (SELECT *, 't' || CAST(grp AS VARCHAR) || '.' || CAST(seq AS VARCHAR) AS txt FROM v_boxes WHERE seq > 1) SELECT c.doc, c.page, c.grp, c.seq, left(string_agg(t.txt, ' ' ORDER BY t.y0, t.x0, t.grp, t.seq, t.txt), 700) AS nearby FROM c JOIN t ON t.doc = c.doc AND t.page = c.page AND abs((t.x0 + t.x1) / 2 - (c.x0 + c.x1) / 2) < 160 AND abs((t.y0 + t.y1) / 2 - (c.y0 + c.y1) / 2) < 160 GROUP BY ALL", "v_boxes")
def box_neighbors(spark, d):
    v = v_boxes(spark, d)
    t = v.where("seq > 1").withColumn("text", F.concat(F.lit("t"), F.col("grp").cast("string"), F.lit("."), F.col("seq").cast("string")))
    return X.neighbours(v.where("seq = 1"), t).select("doc", "page", "grp", "seq", "nearby")


@query(", b AS (SELECT *, coalesce(max(y1) OVER (PARTITION BY doc, page ORDER BY y0, x0, grp, seq, x1, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 62)::DOUBLE AS band_top FROM v_boxes) SELECT doc, page, grp, seq, band_top FROM b", "v_boxes")
def caption_band(spark, d):
    return X.caption_bands(v_boxes(spark, d)).select("doc", "page", "grp", "seq", "band_top")


@query(", b AS (SELECT * FROM v_boxes WHERE seq = 1) SELECT b.doc, b.page, b.grp, b.seq, greatest(62, coalesce((SELECT max(l.y1) FROM v_lines l WHERE l.doc = b.doc AND l.page = b.page AND l.x0 < 110 AND l.x1 - l.x0 > 280 AND l.y1 <= b.y0 + 2), 62))::DOUBLE AS body_bottom FROM b", "v_boxes", "v_lines")
def body_bottom(spark, d):
    """The last full-width line of text above each caption."""
    return X.body_bottoms(v_boxes(spark, d).where("seq = 1"), v_lines(spark, d)).select("doc", "page", "grp", "seq", "body_bottom")


SIDES = ", c AS (SELECT * FROM v_boxes WHERE seq = 1), r AS (SELECT * FROM v_boxes WHERE seq > 1), k AS (SELECT c.doc, c.page, c.grp, c.seq, arg_max({{'g': r.grp, 's': r.seq}}, {{'a': (r.x1 - r.x0) * (r.y1 - r.y0), 'g': -r.grp, 's': -r.seq}}) AS r FROM c JOIN r ON r.doc = c.doc AND r.page = c.page AND r.x1 >= c.x0 AND r.x0 <= c.x1 AND {} GROUP BY ALL) SELECT c.doc, c.page, c.grp, c.seq, k.r.g AS region_grp, k.r.s AS region_seq FROM c LEFT JOIN k ON k.doc = c.doc AND k.page = c.page AND k.grp = c.grp AND k.seq = c.seq"


@query(SIDES.format("r.y1 <= c.y0 + 15 AND r.y0 <= c.y0 - 2"), "v_boxes")
def caption_region_above(spark, d):
    """The largest region that ends at a caption's top or a little below it."""
    v = v_boxes(spark, d)
    return X.match_captions(v.where("seq = 1"), v.where("seq > 1"), over=15, lead=2, touching=True).select("doc", "page", "grp", "seq", F.col("region.r_grp").alias("region_grp"), F.col("region.r_seq").alias("region_seq"))


@query(SIDES.format("r.y0 >= c.y1 - 30 AND r.y1 >= c.y0"), "v_boxes")
def caption_region_below(spark, d):
    """The largest region under a caption that stands above its figure."""
    v = v_boxes(spark, d)
    return X.match_captions(v.where("seq = 1"), v.where("seq > 1"), side="below", over=30, touching=True).select("doc", "page", "grp", "seq", F.col("region.r_grp").alias("region_grp"), F.col("region.r_seq").alias("region_seq"))


BACKGROUND = ", p AS (SELECT doc, count(DISTINCT page) AS pages FROM v_images GROUP BY doc), bg AS (SELECT doc, w, h, n FROM (SELECT doc, w, h, count(*) AS n FROM v_images GROUP BY ALL) JOIN p USING (doc) WHERE n >= greatest(2, CAST(floor(pages * 0.9::DOUBLE) AS BIGINT)))"


def _backgrounds(images):
    return X.background_sizes(images, images.groupBy("doc").agg(F.count_distinct("page").alias("pages")))


@query(BACKGROUND + " SELECT doc, w, h, n FROM bg", "v_images")
def background_freq(spark, d):
    """Image sizes so frequent in a document that they are its background."""
    return _backgrounds(v_images(spark, d))


HOLDS = "{m}.doc = t.doc AND {m}.page = t.page AND greatest(t.x0, {m}.x0) < least(t.x1, {m}.x1) AND greatest(t.y0, {m}.y0) < least(t.y1, {m}.y1)"


@query(
    BACKGROUND + ", t AS (SELECT * FROM v_boxes WHERE seq = 2), dr AS (SELECT t.doc, t.page, t.grp, t.seq, count(*) AS n FROM t JOIN v_boxes o ON o.seq > 2 AND " + HOLDS.format(m="o") + " GROUP BY ALL), "
    "real AS (SELECT i.* FROM v_images i ANTI JOIN bg ON bg.doc = i.doc AND bg.w = i.w AND bg.h = i.h WHERE i.w >= 100 AND i.h >= 100), im AS (SELECT t.doc, t.page, t.grp, t.seq, count(*) AS n FROM t JOIN real i ON " + HOLDS.format(m="i") + " GROUP BY ALL) "
    "SELECT t.doc, t.page, t.grp, t.seq, coalesce(dr.n, 0) AS n_drawings, coalesce(im.n, 0) AS n_images, coalesce(dr.n, 0) >= 25 OR coalesce(im.n, 0) > 0 AS artwork FROM t LEFT JOIN dr USING (doc, page, grp, seq) LEFT JOIN im USING (doc, page, grp, seq)",
    "v_boxes", "v_images",
)
def artwork_presence(spark, d):
    """Whether a region holds drawings enough, or an image that is no background."""
    v, images = v_boxes(spark, d), v_images(spark, d)
    return X.artwork(v.where("seq = 2"), v.where("seq > 2"), images, _backgrounds(images))


@query(", f AS (SELECT *, grp % 3 = 0 AS filled FROM v_boxes) SELECT doc, page, grp, seq FROM f WHERE NOT (x1 - x0 > 0.55 * 306 AND y1 - y0 > 0.55 * 250) AND x0 >= -0.5 AND y0 >= -0.5 AND x1 <= 306.5 AND y1 <= 250.5 AND NOT (filled AND n_items <= 3 AND (x1 - x0 < 200 OR y1 - y0 < 200))", "v_boxes")
def drawing_filter(spark, d):
    """Drawings that can belong to figures, on a small page."""
    return X.keep_drawing(v_boxes(spark, d).withColumn("filled", F.col("grp") % 3 == 0), 306, 250).select("doc", "page", "grp", "seq")


@query(", p AS (SELECT grp, max(CASE WHEN seq = 1 AND x0 % 5 = 0 THEN x0 END) AS raster, max(CASE WHEN seq = 2 THEN y0 END) AS above, max(CASE WHEN seq = 3 THEN y1 END) AS below, max(CASE WHEN seq = 4 THEN x1 END) AS vector, max(y1) AS ink FROM v_boxes GROUP BY grp) SELECT grp, coalesce(raster, CASE WHEN above IS NULL OR NOT coalesce(above % 2 = 0, false) THEN below END, CASE WHEN above % 2 = 0 THEN above END, vector, ink) AS region FROM p", "v_boxes")
def region_choice(spark, d):
    c = F.col
    p = v_boxes(spark, d).groupBy("grp").agg(F.max(F.when((c("seq") == 1) & (c("x0") % 5 == 0), c("x0"))).alias("raster"), F.max(F.when(c("seq") == 2, c("y0"))).alias("above"), F.max(F.when(c("seq") == 3, c("y1"))).alias("below"), F.max(F.when(c("seq") == 4, c("x1"))).alias("vector"), F.max("y1").alias("ink"))
    return p.select("grp", X.choose_region(c("raster"), c("above"), c("below"), c("vector"), c("ink"), c("above") % 2 == 0).alias("region"))


@query("WITH c AS (SELECT p_partkey AS id, p_partkey * 7919 % 16777216 AS n FROM part), l AS (SELECT id, 0.299::DOUBLE * (n // 65536) + 0.587::DOUBLE * (n // 256 % 256) + 0.114::DOUBLE * (n % 256) AS l, 0.2126::DOUBLE * (n // 65536 / 255) + 0.7152::DOUBLE * (n // 256 % 256 / 255) + 0.0722::DOUBLE * (n % 256 / 255) AS r FROM c) SELECT id, round(l, 3) AS luma, l > 128 AS light, round(r, 6) AS relative FROM l")
def color_luma(spark, d):
    n = F.col("p_partkey") * 7919 % 16777216
    luma = B.luma(F.col("c"))
    x = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("#"), F.lpad(F.hex(n), 6, "0")).alias("c"))
    return x.select("id", F.round(luma, 3).alias("luma"), (luma > 128).alias("light"), F.round(B.relative_luma(F.col("c")), 6).alias("relative"))


@query(
    ", g AS (SELECT doc, page, list({'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'grp': grp, 'seq': seq} ORDER BY y0, x0, grp, seq, x1, y1) AS b FROM v_boxes GROUP BY doc, page), "
    "k AS (SELECT doc, page, b, list_reduce(list_transform(range(1, len(b) + 1), lambda i: [i]), lambda a, x: CASE WHEN len(list_filter(a, lambda j: greatest(0, least(b[x[1]].x1, b[j].x1) - greatest(b[x[1]].x0, b[j].x0)) * greatest(0, least(b[x[1]].y1, b[j].y1) - greatest(b[x[1]].y0, b[j].y0)) / greatest(1e-9, (b[x[1]].x1 - b[x[1]].x0) * (b[x[1]].y1 - b[x[1]].y0)) > 0.7::DOUBLE)) = 0 THEN list_concat(a, x) ELSE a END) AS k FROM g), "
    "u AS (SELECT doc, page, b, unnest(k) AS i FROM k) SELECT doc, page, b[i].grp AS grp, b[i].seq AS seq FROM u",
    "v_boxes",
)
def box_dedupe(spark, d):
    return X.dedupe_boxes(v_boxes(spark, d))


CLOSE = "c.x0 < x[1].x1 + 8 AND c.x1 > x[1].x0 - 8 AND c.y0 < x[1].y1 + 8 AND c.y1 > x[1].y0 - 8"
NEAR = f"list_append(list_filter(a, lambda c: {CLOSE}), x[1])"
ALL_OF = lambda f, c: f"{f}(list_transform({NEAR}, lambda c: c.{c}))"


@query(
    ", s(doc, page, b, before) AS (SELECT doc, page, list({'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'n': CAST(n_items AS BIGINT)}) AS b, 1000000000 FROM v_boxes GROUP BY doc, page UNION ALL "
    f"SELECT doc, page, list_reduce(list_prepend(b[1:0], list_transform(b, lambda x: [x])), lambda a, x: list_append(list_filter(a, lambda c: NOT ({CLOSE})), {{'x0': {ALL_OF('list_min', 'x0')}, 'y0': {ALL_OF('list_min', 'y0')}, 'x1': {ALL_OF('list_max', 'x1')}, 'y1': {ALL_OF('list_max', 'y1')}, 'n': CAST({ALL_OF('list_sum', 'n')} AS BIGINT)}})), len(b) FROM s WHERE len(b) < before), "
    "u AS (SELECT doc, page, unnest(b) AS b FROM s WHERE len(b) = before) SELECT doc, page, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1, b.n AS n_items FROM u",
    "v_boxes",
)
def box_cluster(spark, d):
    return X.cluster_boxes(v_boxes(spark, d))


FREE = "list_sort(list_transform(list_filter(range(1, len(r) + 1), lambda j: NOT list_contains(list_transform(a, lambda z: z.r), j)), lambda j: {'d': (o[x[1].a].x0 + o[x[1].a].x1 - r[j].x0 - r[j].x1) * (o[x[1].a].x0 + o[x[1].a].x1 - r[j].x0 - r[j].x1) + (o[x[1].a].y0 + o[x[1].a].y1 - r[j].y0 - r[j].y1) * (o[x[1].a].y0 + o[x[1].a].y1 - r[j].y0 - r[j].y1), 'j': j}))[1]"


@query(
    ", g AS (SELECT doc, page, coalesce(list({'y0': y0, 'x0': x0, 'grp': grp, 'seq': seq, 'x1': x1, 'y1': y1, 'n': n_items % 7} ORDER BY y0, x0, grp, seq, x1, y1) FILTER (WHERE seq % 2 = 1), []) AS o, coalesce(list({'y0': y0, 'x0': x0, 'grp': grp, 'seq': seq, 'x1': x1, 'y1': y1, 'n': n_items % 7} ORDER BY y0, x0, grp, seq, x1, y1) FILTER (WHERE seq % 2 = 0), []) AS r FROM v_boxes GROUP BY doc, page), "
    "k AS (SELECT doc, page, o, r, list_transform(list_sort(list_transform(range(1, len(o) + 1), lambda i: {'s': -(o[i].x1 - o[i].x0) * (o[i].y1 - o[i].y0), 'i': i})), lambda z: [{'a': z.i, 'r': 0::BIGINT}]) AS k FROM g WHERE len(o) > 0), "
    f"f AS (SELECT doc, page, o, r, list_reduce(list_prepend([{{'a': 0::BIGINT, 'r': 0::BIGINT}}][1:0], k), lambda a, x: list_append(a, {{'a': x[1].a, 'r': coalesce(CASE WHEN {FREE}.d <= 4 * 425 * 425 AND r[{FREE}.j].n > 0 THEN {FREE}.j END, 0)}})) AS f FROM k), "
    "u AS (SELECT doc, page, o, r, unnest(f) AS f FROM f) SELECT doc, page, o[f.a].grp AS grp, o[f.a].seq AS seq, CASE WHEN f.r > 0 THEN r[f.r].grp END AS r_grp, CASE WHEN f.r > 0 THEN r[f.r].seq END AS r_seq FROM u",
    "v_boxes",
)
def nearest_greedy(spark, d):
    return X.nearest_greedy(v_boxes(spark, d).withColumn("n_items", F.col("n_items") % 7))


WORDS = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''))"
ISSUES = (
    ", i AS (SELECT pdf_id, page, error, concat_ws('; ', "
    "CASE WHEN missed IS NOT NULL AND figures > ours THEN CASE WHEN missed > 0 AND ours = 0 THEN 'FIGURES: ' || missed || ' verified, 0 extracted' WHEN missed > ours THEN 'FIGURES: ' || missed || ' verified, ' || ours || ' extracted' END WHEN figures > 0 AND ours = 0 THEN 'FIGURES: ' || figures || ' seen, 0 extracted' WHEN figures > ours THEN 'FIGURES: ' || figures || ' seen, ' || ours || ' extracted' END, "
    "CASE WHEN charts > figures THEN 'CHARTS: ' || charts || ' seen' END, CASE WHEN has_text AND quality <> 'good' THEN 'TEXT: ' || quality END, "
    "CASE WHEN has_text AND " + STRIP.format("text") + " = '' THEN 'TEXT: text layer empty' WHEN NOT has_text AND " + STRIP.format("text") + " <> '' THEN 'TEXT: not on the page' END, "
    "CASE WHEN equations > 0 AND length(" + STRIP.format("text") + ") < 200 THEN 'EQUATIONS: ' || equations END, "
    "CASE WHEN has_tables AND our_tables = 0 AND len(list_filter(str_split(text, chr(10)), lambda x: contains(x, chr(9)) OR (" + WORDS.format("x") + " >= 3 AND length(x) - length(replace(x, ' ', '')) >= 3))) = 0 AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: regexp_matches(w, '[0-9]'))) < 8 THEN 'TABLES: ' || num_tables END) AS issues FROM v_audit)"
)


@query(ISSUES + " SELECT pdf_id, page, issues FROM i", "v_audit")
def audit_classify(spark, d):
    return v_audit(spark, d).select("pdf_id", "page", F.array_join(audit.issues(), "; ").alias("issues"))


@query(ISSUES + " SELECT pdf_id, count(*) AS pages, count(*) FILTER (WHERE issues = '') AS clean, count(error) AS errors FROM i GROUP BY pdf_id", "v_audit")
def audit_rollup(spark, d):
    return audit.rollup(v_audit(spark, d).select("pdf_id", audit.issues().alias("issues"), "error"))


def _queue_events(spark, d):
    s = F.when((F.col("status") == "failed") & (F.col("event_id") % 2 == 0), "preview_rejected").otherwise(F.col("status"))
    return v_queue(spark, d).select("item", "ts", "event_id", s.alias("status"), F.concat(F.lit("agent-"), (F.col("event_id") % 3).cast("string")).alias("agent"))


FOLD = (
    "lambda a, x: CASE WHEN x.s = 'queued' THEN {'status': x.s, 'version': a.version, 'agent': NULL::VARCHAR, 'claims': a.claims, 'rejected': a.rejected, 's': '', 'g': ''} "
    "WHEN x.s = 'claimed' AND a.status = 'queued' THEN {'status': x.s, 'version': a.version, 'agent': x.g, 'claims': a.claims + 1, 'rejected': a.rejected, 's': '', 'g': ''} "
    "WHEN x.s = 'preview_rejected' THEN {'status': x.s, 'version': a.version + 1, 'agent': NULL::VARCHAR, 'claims': a.claims, 'rejected': a.rejected, 's': '', 'g': ''} "
    "WHEN x.s IN ('" + "', '".join(queue.AGENT_STATES) + "') THEN {'status': x.s, 'version': a.version, 'agent': a.agent, 'claims': a.claims, 'rejected': a.rejected, 's': '', 'g': ''} "
    "ELSE {'status': a.status, 'version': a.version, 'agent': a.agent, 'claims': a.claims, 'rejected': a.rejected + 1, 's': '', 'g': ''} END"
)


@query(
    ", e AS (SELECT item, list({'status': 'none', 'version': 1::INTEGER, 'agent': NULL::VARCHAR, 'claims': 0::INTEGER, 'rejected': 0::INTEGER, 's': CASE WHEN status = 'failed' AND event_id % 2 = 0 THEN 'preview_rejected' ELSE status END, 'g': 'agent-' || CAST(event_id % 3 AS VARCHAR)} ORDER BY ts, event_id) AS e FROM v_queue GROUP BY item), "
    "r AS (SELECT item, list_reduce(list_prepend({'status': 'none', 'version': 1::INTEGER, 'agent': NULL::VARCHAR, 'claims': 0::INTEGER, 'rejected': 0::INTEGER, 's': '', 'g': ''}, e), " + FOLD + ") AS a FROM e) SELECT item, a.status AS status, a.version AS version, a.agent AS agent, a.claims AS claims, a.rejected AS rejected FROM r",
    "v_queue",
)
def queue_state(spark, d):
    return queue.states(_queue_events(spark, d))


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    """tumbling windows, in their batch form."""
    return stream.tumbling(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR AND ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM g GROUP BY user_id, s")
def stream_session(spark, d):
    """session windows, in their batch form."""
    return stream.sessions(table(spark, d, "events"))
