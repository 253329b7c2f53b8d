"""Text functions against the patterns of their SQL, on characters that pattern engines read differently."""

import duckdb
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.plans import registry
from folioflow.plans import text as P


def in_sql(texts, expression):
    con = duckdb.connect()
    con.execute("CREATE TABLE x (t VARCHAR)")
    con.executemany("INSERT INTO x VALUES (?)", [(t,) for t in texts])
    return dict(con.execute(f"SELECT t, {expression} FROM x").fetchall())


def test_captions_with_odd_ends_and_spaces(spark):
    texts = [f"{a}Fig. 2.1{b}: Of it{c}" for a in ("", "\x0b", "\n") for b in (" ", "\x0b") for c in ("", "\n", "\n\n", "\r", "\u0085", " ", " a\nb", "\r\n", "a b\rc")] + ["Figure 12345678901"]
    label, title = in_sql(texts, f"nullif(regexp_extract(t, '{P.CAP}', 1), '')"), in_sql(texts, f"nullif(regexp_extract(t, '{P.CAP}', 2), '')")
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *T.caption(F.col("t")), T.first_number(F.col("t"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {t: (label[t], title[t]) for t in texts}
    assert {r[3] for r in got} == {2, 12345678901}


def test_capitals_inside_words_between_letters_of_any_script(spark):
    texts = ["vequilleEtoiêleaneux", "êtreQuelle", "someWord", "1someWord", "some Word", "éa someWordé", "हsomeWord", "some_wordWide", "AsóadoAsóado"]
    sql = in_sql(texts, r"regexp_matches(t, '\b[a-z]+[A-Z][a-z]+\b')")
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.is_garbled_title(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == sql and sql["vequilleEtoiêleaneux"]


def test_cascade_leaves_garbled_headers_as_its_sql(spark, tmp_path):
    texts = ["vequille Etoiê leaneux and more", "veju éeLe entreque èque", "Asóado Asóado Asóado Asóado", "A plain title of a page"]
    rows = [(10 * i + 19, t, "fr", "web", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in registry.QUERIES["identify_cascade"](spark, str(tmp_path)).select("id", "name", "method").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got) == sorted(con.execute("SELECT id, name, method FROM (" + registry.ORACLES["identify_cascade"] + ")").fetchall())


def test_cascade_reads_white_space_line_ends_and_capitals_as_its_sql(spark, tmp_path):
    spaces = ["\x0b", "\x85", "\xa0", " ", "　", "\r", "\r\n", "\x1c", "İ", "Σ"]
    lines = ["Some{}words of it", "Forces and Motion: a start{}\nsmall", "CHEMICAL REACTIONS AND\nEquations{}around us\n", "x{}\nTitle Of It{}\nChapter\n7\n", "{}Mathematics:\nEquations around us\nword", "MATHEMAT{}CS", "12{}", "word 2023-24{}"]
    texts = [None, "", *[x.replace("{}", s) for x in lines for s in spaces]]
    rows = [(None if i < 0 else i, t, "fr", "web", len(t or "")) for i, t in [(-1, "Without an id"), *[(20 * k + n, t) for k, t in enumerate(texts) for n in range(10)]]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {tuple(r) for r in registry.QUERIES["identify_cascade"](spark, str(tmp_path)).select("id", "name", "method").collect()}
    assert got == set(con.execute("SELECT id, name, method FROM (" + registry.ORACLES["identify_cascade"] + ")").fetchall())
    assert (1, None, "file") in got and len(got) == len(rows) - 1


def test_letters_of_titles_as_in_sql(spark):
    texts = [chr(i) for i in range(1, 0x33000) if not 0xD800 <= i < 0xE000]
    con = duckdb.connect()
    sql = {t for (t,) in con.execute(r"SELECT t FROM (SELECT unnest(?) AS t) WHERE regexp_matches(t, '^[\p{L} ]$')", [texts]).fetchall()}
    got = spark.createDataFrame([(t,) for t in texts], "t string").where(F.col("t").rlike(T.as_in_sql(r"^[\p{L} ]$"))).collect()
    assert {r.t for r in got} == sql and chr(0x870) in sql and chr(0x31350) in sql
