"""The thin queries over the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import reachable
from . import automaton, bwt, cube, fst_tokens, kdtree, lshforest, ordinal, pfor, sortmeans, spacedseed, trie, vafile, warc
from ._store import drop_path, new_path, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vafile.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op2_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lshforest.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80).drop("text_hash")


def op3_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spacedseed.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("overlaps")


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("payload", "n_segments")


def op5_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.shard_documents(table(spark, sf_dir, "documents"), dimensions=("n_chars",))


def op7_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.dedup_bytes(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_ordinal_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_finite_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return fst_tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_matching_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.dedup_words(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "n_spans", "kept_sha256")


def op11_patched_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-files")
    pfor.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    out = stored(pfor.digest(spark, path), "pfor-out")
    drop_path(spark, path)
    return out


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sortmeans.cluster(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


#: Words, with A-Z in lower case.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
OP2_SQL = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM w
), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
k AS MATERIALIZED (SELECT min(doc_id) AS rep, list(doc_id) AS docs, any_value(n) AS n, any_value(sorted) AS sorted FROM (SELECT doc_id, len(s) AS n, list_sort(s) AS sorted FROM s WHERE len(s) > 0) GROUP BY sorted),
x AS MATERIALIZED (SELECT rep, n, unnest(sorted) AS x FROM k),
b AS (SELECT a.rep AS a, b.rep AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM b WHERE 100 * common >= 80 * (na + nb - common)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, label) AS (SELECT rep, rep FROM k UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node WHERE r.label < e.b),
c AS (SELECT node, min(label) AS label FROM r GROUP BY node),
d AS (SELECT unnest(docs) AS doc_id, rep FROM k)
SELECT n.doc_id, n.n AS n_shingles, coalesce(c.label, n.doc_id) AS component_id, n.doc_id = coalesce(c.label, n.doc_id) AS kept
FROM n LEFT JOIN d ON d.doc_id = n.doc_id LEFT JOIN c ON c.node = d.rep
"""

OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
h AS (SELECT page_id, octet_length(raw) AS n, sha1(raw) AS h, max(page_id) OVER (PARTITION BY raw) AS keeper FROM p),
g AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT)) AS g FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(g, lambda v: array_to_string(list_transform([32768, 1024, 32, 1], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v // s % 32 + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM g
"""

OP7_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 199))) AS i FROM h),
m AS MATERIALIZED (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM p),
o AS (SELECT m FROM m GROUP BY m HAVING count(*) > 1),
f AS (SELECT DISTINCT doc_id, i FROM m WHERE m IN (SELECT m FROM o)),
j AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM f),
t AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS t FROM j),
r AS (SELECT doc_id, t, min(i) AS low, max(i) + 200 AS high FROM t GROUP BY doc_id, t),
q AS (SELECT doc_id, low, high, lag(high, 1, 0) OVER (PARTITION BY doc_id ORDER BY low) AS before FROM r),
k AS (SELECT q.doc_id, sum(high - low) AS removed, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) AS kept, max(high) AS last FROM q JOIN h ON h.doc_id = q.doc_id GROUP BY q.doc_id)
SELECT h.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM h LEFT JOIN k ON k.doc_id = h.doc_id
"""

OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
m AS MATERIALIZED (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN md5(array_to_string(w[i:i + 19], ' ')) END AS m FROM p),
f AS (SELECT m, min({'d': doc_id, 'i': i}) AS first FROM m WHERE m IS NOT NULL GROUP BY m),
g AS (SELECT a.doc_id, a.i, a.word, CASE WHEN f.first IS NOT NULL AND {'d': a.doc_id, 'i': a.i} > f.first THEN 1 ELSE 0 END AS late FROM m a LEFT JOIN f ON f.m = a.m),
c AS (SELECT *, max(late) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM g),
s AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS new FROM c),
t AS (SELECT doc_id, count(*) AS n, sum(gone) AS removed, sum(new) AS spans, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM s GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN t ON t.doc_id = w.doc_id
"""


def _sort_means_sql(k: int = 8, length: int = 64, scale: int = 1024, rounds: int = 10, seed: int = 3) -> str:
    """Rounds written one after another: m holds the centroids, a the nearest one of every vector."""
    far = "list_sum(list_transform(list_zip(v.e, m.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = lambda i: f"SELECT v.n, arg_min(m.c, {{'d': {far}, 'c': m.c}}) AS c, min({far}) AS d FROM v CROSS JOIN m{i} m GROUP BY v.n"
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE len(embedding) = {length} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, e) - 1 AS c, e FROM (SELECT sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h, e FROM v) ORDER BY h NULLS LAST, e LIMIT {k})",
    ]
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({near(i)})")
        steps.append(f"s{i} AS MATERIALIZED (SELECT c, p, CAST((s - (s % n + n) % n) // n AS BIGINT) AS x FROM (SELECT a.c, p, sum(x) AS s, count(*) AS n FROM (SELECT n, unnest(e) AS x, unnest(range({length})) AS p FROM v) u JOIN a{i} a ON a.n = u.n GROUP BY a.c, p))")
        steps.append(f"m{i + 1} AS MATERIALIZED (SELECT m.c, coalesce(g.e, m.e) AS e FROM m{i} m LEFT JOIN (SELECT c, list(x ORDER BY p) AS e FROM s{i} GROUP BY c) g ON g.c = m.c)")
    steps.append(f"z AS MATERIALIZED ({near(rounds)})")
    return f"WITH {', '.join(steps)} SELECT v.vec_id, CAST(z.c AS INTEGER) AS cluster, CAST(z.d AS BIGINT) AS distance, CAST(sum(z.d) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia, CAST(sum(z.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.e, ',')) AS centroid_sha256 FROM z JOIN v ON v.n = z.n JOIN m{rounds} m ON m.c = z.c"


OP12_SQL = _sort_means_sql()

#: CRC-32 of the decimal conv_id, byte by byte and bit by bit.
CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::BIGINT) ELSE r // 2 END)), 4294967295::BIGINT)"
OP13_SQL = f"""
WITH t AS (
  SELECT conv_id AS conv, md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words, turn
  FROM conversations WHERE conv_id IS NOT NULL
), o AS MATERIALIZED (SELECT conv, list({{'g': g, 'w': words}} ORDER BY turn NULLS FIRST, g) AS own FROM t GROUP BY conv),
h AS MATERIALIZED (SELECT conv, own, CAST({CRC32.format(c="conv")} % 4 AS INTEGER) AS h FROM o),
r AS MATERIALIZED (SELECT h.conv, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS turns FROM h LEFT JOIN o b ON b.conv = h.conv - h.conv % 20),
p AS MATERIALIZED (
  SELECT conv, d, len(turns) AS total, md5(array_to_string(list_transform(turns[1:d], lambda x: x.g), ',')) AS k, CASE WHEN d > 0 THEN md5(array_to_string(list_transform(turns[1:d - 1], lambda x: x.g), ',')) END AS up, CASE WHEN d > 0 THEN turns[d].w ELSE 0 END AS w
  FROM (SELECT conv, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)
), n AS MATERIALIZED (
  SELECT d, k, min(up) AS up, min(conv) AS conv_id, count(*) AS n_convs, min(w) AS w, string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (WHERE total = d) AS ends FROM p GROUP BY d, k
), c AS MATERIALIZED (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY d, up),
s AS (
  SELECT p.d, p.k, count(*) FILTER (WHERE c.k IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.w) AS saved
  FROM n JOIN p ON p.conv = n.conv_id AND p.d <= n.d LEFT JOIN c ON c.d = n.d AND c.k = n.k GROUP BY p.d, p.k
)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN s ON s.d = n.d AND s.k = n.k LEFT JOIN c ON c.d = n.d AND c.k = n.k LEFT JOIN n u ON u.d = n.d - 1 AND u.k = n.up
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after another."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_va_file": op1_va_file,
        "op2_lsh_forest": op2_lsh_forest,
        "op3_spaced_seeds": op3_spaced_seeds,
        "op4_warc_round_trip": op4_warc_round_trip,
        "op5_cube_mixing": op5_cube_mixing,
        "op6_kd_tree_shards": op6_kd_tree_shards,
        "op7_interval_expansion": op7_interval_expansion,
        "op8_ordinal_severity": op8_ordinal_severity,
        "op9_finite_state_counts": op9_finite_state_counts,
        "pipeline": pipeline,
        "op10_matching_statistics": op10_matching_statistics,
        "op11_patched_frames": op11_patched_frames,
        "op12_sort_means": op12_sort_means,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_va_file": OP1_SQL, "op2_lsh_forest": OP2_SQL, "op4_warc_round_trip": OP4_SQL, "op7_interval_expansion": OP7_SQL, "op10_matching_statistics": OP10_SQL, "op12_sort_means": OP12_SQL, "op13_prefix_trie": OP13_SQL}
