"""Which chapter a document is: rules as rows, votes of its pages, and an order of trust.

Rules are a table (subject, place, pattern, number, title): a page's text meets the rules of
its document's subject as rows, and the first match by (page, place) wins, over the first
``FIRST`` pages. A document reads its pages once for rules and votes; nothing is joined but
what was aggregated a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.names import fresh
from . import votes

FIRST = 4
GENERIC = "social-science"

# Patterns of title pages by subject, in order of precedence: the pattern, the group of the number (0: none) and that of the title.
WORDS = r"[A-Z][a-zA-Z][^-\n]"
COLON = r":\s*(?:\n?\s*[A-Za-z][a-zA-Z][^-\n]{0,80}){0,3}"
RULES = {
    "science": [
        (r"^([A-Z][\w\s]{2,60}(?:\s*\n\s*[A-Za-z][\w\s]{2,60})?)\s*\n\s*\d+CHAPTER", 0, 1),
        (rf"^({WORDS}{{3,60}}{COLON})\s*\n\s*Chapter\s*\n\s*(\d+)", 2, 1),
        (rf"^({WORDS}{{3,50}}(?:\s*\n\s*[A-Za-z][a-zA-Z][^-\n]{{3,60}})?)\s*\n\s*Chapter\s*\n\s*(\d+)", 2, 1),
        (rf"^({WORDS}{{3,60}})\s*\n\s*(?:Life\s|In the|Have you|Researchers|If you)", 0, 1),
        (rf"^(?!Chapter\s*$)({WORDS}{{3,80}})\s*\n\s*(\d+)\s*$", 2, 1),
        (rf"^({WORDS}{{3,60}}{COLON})\s*\n\s*(\d+)\s*\n", 2, 1),
        (rf"^({WORDS}{{3,60}}{COLON})\s*\n\s*(?:Think It Over|Activity|In this chapter)", 0, 1),
        (rf"Chapter\s*\n+\s*(\d+)\s*\n+\s*({WORDS}{{3,80}}?)(?:\n|$)", 1, 2),
    ],
    "mathematics": [
        (rf"^({WORDS}{{5,60}}(?::(?:\n?\s*[A-Za-z][a-zA-Z][^-\n]{{0,60}}){{0,3}})?)\s*\n\s*\d+\.\d+\s", 0, 1),
        (r"^([A-Z][A-Z\s]{3,60})\s+(\d+)\s*\n", 2, 1),
    ],
    "health-and-physical-education": [
        (rf"^(?!Fig(?:ure)?\.?\s+\d)(?!Table\s+\d)({WORDS}{{5,60}}{COLON})\s*\n\s*\d+\s*\n", 0, 1),
        (rf"^(?!Fig(?:ure)?\.?\s+\d)(?!Table\s+\d)({WORDS}{{5,60}}{COLON})\s*\n\s*\d+\s", 0, 1),
    ],
    "social-science": [
        (rf"^({WORDS}{{5,80}})\s*\n\s*Chapter\s+(\d+)", 2, 1),
        (r"CHAPTER\s+(\d+)\s*\n+\s*(.+?)(?:\n|$)", 1, 2),
        (r"^\s*\n*\s*Chapter\s+(\d+)\s*\n+\s*(.+?)(?:\n|$)", 1, 2),
    ],
}


def rules(spark: SparkSession, table: dict[str, list[tuple[str, int, int]]] | None = None) -> DataFrame:
    """The rules as a table; lines end at a line feed only, classes of characters are Unicode's."""
    rows = [(subject, place, f"(?dmU){pattern}", number, title) for subject, each in (table or RULES).items() for place, (pattern, number, title) in enumerate(each)]
    return spark.createDataFrame(rows, "subject string, place int, pattern string, number int, title int")


def tidy(title: Column) -> Column:
    """A title on one line, without the punctuation at its end and the spaces before punctuation."""
    one = T.strip(F.regexp_replace(title, r"(?U)\s+", " "))
    return F.regexp_replace(F.regexp_replace(one, "[.,;:]+$", ""), r"(?U)\s+([,;.])", "$1")


def by_rules(pages: DataFrame, table: DataFrame, subjects: list[str], first: int = FIRST) -> DataFrame:
    """(doc, name, number, start_page) of the documents of ``pages`` (doc, page from 0, subject, text) on whose first pages a rule of their subject matches; subjects without rules of their own take the generic ones. The rules, a few rows, go to all tasks."""
    group = F.when(F.col("subject").isin(subjects), F.col("subject")).otherwise(GENERIC)
    head = pages.where(F.col("page") < first).select("doc", "page", group.alias("subject"), F.col("text").alias("read"))
    hits = head.join(F.broadcast(table), "subject").select("doc", "page", "place", *[F.expr(f"regexp_extract(read, pattern, {g})").alias(c) for g, c in (("title", "name"), ("number", "digits"))], "number")
    found = hits.select("doc", "page", "place", tidy(F.col("name")).alias("name"), F.when(F.col("number") > 0, F.col("digits").try_cast("int")).alias("number")).where("name <> ''")
    best = found.groupBy("doc").agg(F.min_by(F.struct("name", "number", "page"), F.struct("page", "place")).alias("b"))
    return best.select("doc", "b.name", "b.number", (F.col("b.page") + 1).alias("start_page"))


def by_pages(pages: DataFrame) -> DataFrame:
    """(doc, name): the chapter's name as most pages (doc, page, context) print it, ties to the longer; names that are no titles don't vote."""
    name, norm = fresh(["name", "norm"], pages)
    x = pages.withColumn(name, F.regexp_replace(T.strip(F.col("context")), "[:;, ]+$", ""))
    x = x.where(T.name_ok(F.col(name)) & ~T.is_page_header(F.col(name))).withColumn(norm, T.title_normalize(F.col(name)))
    return votes.vote(x, ["doc"], norm, name, "page", prefer="longest").select("doc", F.col(name).alias("name"))


def identify(docs: DataFrame, pages: DataFrame, table: DataFrame, subjects: list[str]) -> DataFrame:
    """(doc, name, number, method) of ``docs`` (doc, path, current, header, known, line, synthesis), any of whose names may be null.

    A current name that is good stays. Else the pages' vote comes before what the document's
    own sources give, in this order: running header, curated name, rules, title-like line,
    file name; a synthesis comes last. Where the name chosen is no title, the method is
    'heuristic', for it to be looked at again.
    """
    voted = by_pages(pages).select("doc", F.col("name").alias("voted"))
    ruled = by_rules(pages, table, subjects).select("doc", F.col("name").alias("ruled"), F.col("number").alias("ruled_number"))
    x = docs.join(voted, "doc", "left").join(ruled, "doc", "left")
    _, chapter, _ = T.path_parts(F.col("path"))
    file = F.when(chapter.isNotNull(), F.concat(F.lit("Chapter "), chapter.cast("string")))
    own = [("header", F.col("header")), ("known", F.col("known")), ("content", F.col("ruled")), ("line", F.col("line")), ("filename", file)]
    initial, how = votes.cascade(own)
    number = F.when(how == "content", F.coalesce("ruled_number", chapter)).otherwise(chapter)
    choice = F.when(T.name_ok(F.col("current")), F.struct(F.col("current").alias("name"), F.lit("kept").alias("method")))
    choice = choice.when(F.col("voted").isNotNull(), F.struct(F.col("voted").alias("name"), F.lit("page-aggregated").alias("method")))
    choice = choice.when(T.name_ok(initial), F.struct(initial.alias("name"), how.alias("method")))
    choice = choice.otherwise(F.struct(F.regexp_replace(F.coalesce("synthesis", F.lit("")), "[:;, ]+$", "").alias("name"), F.lit("comprehensive").alias("method")))
    out = x.select("doc", choice.alias("c"), number.alias("number"))
    return out.select("doc", "c.name", "number", F.when(T.name_ok(F.col("c.name")), F.col("c.method")).otherwise("heuristic").alias("method"))
