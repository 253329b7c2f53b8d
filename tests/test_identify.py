"""Identification by rules and votes, titles out of paths, and listings."""

import os
import re

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import identify
from folioflow.sources import files

PAGES = [
    ("science", "Chemical Reactions\nand Equations\n1CHAPTER\nmore"), ("science", "Sound Waves:\nCharacteristics and\nApplications\nChapter\n10\nx"), ("science", "Describing Motion\nAround Us\nChapter\n4\nx"),
    ("science", "Tissues in Action\nLife begins with cells"), ("science", "Exploration: Entering the World\n1\n"), ("science", "Chapter\n13\n"), ("science", "Chapter\n\n7\n\nThe Big Story\nrest"),
    ("science", "Earth as a System:\nEnergy, Matter, and Life\nThink It Over\n"), ("mathematics", "REAL NUMBERS 1\n1.1 Introduction"), ("mathematics", "Predicting What Comes Next:\nExploring Sequences\n8.1 Introduction"),
    ("health-and-physical-education", "Physical Education: Relationship with Other Subjects\n3\nSocial efficiency"), ("health-and-physical-education", "Fig. 3 Something: here\n3\nx"), ("social-science", "Understanding Social Science\nChapter 1\n"),
    ("social-science", "x\nCHAPTER 5\n\n  A Title , with.;\nmore"), ("hindi", "Chapter 2\nGeneric Title\n"), ("science", "no title here"), ("science", ""),
]


def by_hand(subject, text):
    """The first rule that matches, as Python's expressions see it."""
    for pattern, number, title in identify.RULES.get(subject, identify.RULES["social-science"]):
        m = re.search(pattern, text, re.MULTILINE)
        if m and (name := re.sub(r"\s+([,;.])", r"\1", re.sub(r"\s+", " ", m.group(title)).strip().rstrip(".,;:"))):
            return name, int(m.group(number)) if number else None
    return None


def test_rules_by_hand(spark):
    df = spark.createDataFrame([(i, 0, s, t) for i, (s, t) in enumerate(PAGES)], "doc long, page int, subject string, text string")
    got = {r.doc: (r.name, r.number) for r in identify.by_rules(df, identify.rules(spark), list(identify.RULES)).collect()}
    want = {i: by_hand(s, t) for i, (s, t) in enumerate(PAGES)}
    assert got == {i: w for i, w in want.items() if w}
    assert got[2] == ("Describing Motion Around Us", 4) and got[10][0].startswith("Physical Education: Relationship") and 15 not in got


def test_first_page_before_first_rule(spark):
    rows = [(1, 1, "science", "Tissues in Action\nLife begins"), (1, 2, "science", "Chemical Reactions\n1CHAPTER"), (2, 4, "science", "Chemical Reactions\n1CHAPTER")]
    got = identify.by_rules(spark.createDataFrame(rows, "doc long, page int, subject string, text string"), identify.rules(spark), list(identify.RULES)).collect()
    assert [(r.doc, r.name, r.number, r.start_page) for r in got] == [(1, "Tissues in Action", None, 2)]  # the fifth page is too late


def test_order_of_trust(spark):
    pages = [(1, 0, "Good Vote"), (1, 1, "good vote:"), (1, 2, "Another"), (2, 0, "Health and Physical Education - Class X"), (3, 0, "Chapter 3"), (4, 0, "Long Name Here"), (4, 1, "Short Name"), (5, 0, None), (6, 0, "Voted Name")]
    p = spark.createDataFrame([(d, n, "science", "", c) for d, n, c in pages], "doc long, page int, subject string, text string, context string")
    docs = [(1, "a/x_ch04.pdf", None, "Header", None, None, None), (2, "a/x.pdf", None, "Header", "Known", None, None), (3, "a/x_ch05.pdf", "Chapter 5", None, None, None, "Made Up Name: "), (4, "a/x.pdf", None, None, None, None, None), (5, "a/x_ch06.pdf", None, None, None, None, "Chapter 6"), (6, "a/x.pdf", "Kept Name", "Header", None, None, None), (7, "a/x.pdf", None, None, None, None, None)]
    df = spark.createDataFrame(docs, "doc long, path string, current string, header string, known string, line string, synthesis string")
    got = {r.doc: (r.name, r.number, r.method) for r in identify.identify(df, p, identify.rules(spark), list(identify.RULES)).collect()}
    assert got == {1: ("Good Vote", 4, "page-aggregated"), 2: ("Header", None, "header"), 3: ("Made Up Name", 5, "comprehensive"), 4: ("Long Name Here", None, "page-aggregated"), 5: ("Chapter 6", 6, "heuristic"), 6: ("Kept Name", None, "kept"), 7: ("", None, "heuristic")}


@pytest.mark.parametrize("path, title", [("/b/class-9_science-motion_and-rest.pdf", "Motion And Rest"), ("/b/Hindi/kritika-1.pdf", "Hindi Kritika 1"), ("/b/sanskrit/on_Sanskrit.pdf", "On Sanskrit"), ("/b/maths.pdf", "maths.pdf"), ("/b/it's 3rd.pdf", "It'S 3Rd"), ("/hindi/sanskrit/x.pdf", "Hindi X")])
def test_catalogue_titles(spark, path, title):
    assert spark.createDataFrame([(path,)], "p string").select(T.catalogue_title(F.col("p")).alias("t")).first().t == title


def test_despace_and_subject_slugs(spark):
    row = spark.createDataFrame([("E ffects of P hysical A ctivities , now", "Hindi (Kritika) & More!")], "a string, b string").select(T.despace(F.col("a")).alias("a"), T.slugify_subject(F.col("b")).alias("b")).first()
    assert row.a == "Effects of Physical Activities, now" and row.b == "hindi-kritika-and-more_"


def test_listings_and_whole_texts(spark, tmp_path):
    for i, name in enumerate(["b.txt", "a.txt", "c.md", "2024-05.txt"]):
        (tmp_path / name).write_text(f"line one of {name}\nline two")
        os.utime(tmp_path / name, (1_000_000 - i, 1_000_000 - i))
    listing = files.list_files(spark, str(tmp_path), "*.txt")
    assert [r.name for r in listing.collect()] == ["2024-05.txt", "a.txt", "b.txt"]
    assert [r.name for r in files.list_newest(listing).collect()] == ["b.txt"] and [r.name for r in files.last_by_name(listing, 2).collect()] == ["b.txt", "a.txt"]
    texts = {os.path.basename(r.path): r.text for r in files.read_whole_texts(spark, str(tmp_path)).collect()}
    assert len(texts) == 4 and texts["c.md"] == "line one of c.md\nline two"


LINES = [
    "page 3\nCHEMICAL REACTIONS AND\nEquations around us\n12\nmore", "Physical Education:\nRelationship with Other Subjects\n3\nx", "Physical Education:\n3\nRelationship", "Table 4 Something: else\nSound Waves: how they move\nSee also.", "Introduction to Everything: part one\nForces and Motion: a start", "lower case only\nshort: x",
    "Forces and Motion: a start\nThis line ends with a stop and is far too long.\nNever", "THE EVENTS OF THE YEAR...,", "", "A" * 120 + ":", "List of Things: many",
]


def title_by_hand(text):
    from folioflow.operators import segment as S

    lines = [x.strip() for x in text.split("\n") if x.strip()]
    subjects = {*T.SUBJECTS, *(f"{s}:" for s in T.SUBJECTS if s != "maths")}
    for i, x in enumerate(lines):
        if any(re.match(p, x) for p in S.REJECT):
            continue
        if x.lower() in subjects:
            after = [bool(re.match(S.GOES_ON, y)) if not re.match(r"^\d+$", y) else None for y in lines[i + 1 : i + 3]]
            if not x.endswith(":") or True not in after or None in after[: after.index(True)]:
                continue
        if any(re.match(p, x) for p in S.DETECT) and not any(w in x.lower() for w in S.SKIP) and 10 < len(x) < 100:
            parts = [x]
            for y in lines[i + 1 : i + 4]:
                if re.match(r"^\d+$", y) or len(y) > 80 or y.endswith(".") and len(y) > 30 or not re.match(S.GOES_ON, y):
                    break
                parts.append(y)
            return re.sub(r"\s+", " ", " ".join(parts)).strip().rstrip(".,;: ")
    return None


def test_title_lines_by_hand(spark):
    from folioflow.operators import segment as S

    got = {r.id: r.title for r in S.heuristic_titles(spark.createDataFrame(list(enumerate(LINES)), "id int, raw_text string")).collect()}
    assert got == {i: title_by_hand(t) for i, t in enumerate(LINES)}
    assert got[0] == "CHEMICAL REACTIONS AND Equations around us" and got[1] == "Physical Education: Relationship with Other Subjects" and got[3] == "Sound Waves: how they move" and got[4] is None


def test_long_white_space_is_cleaned_in_time(spark):
    text = "a" + " " * 200_000 + "b / c" + "\n" * 50 + " " * 200_000 + "x" + " " * 200_000
    row = spark.createDataFrame([(text,)], "t string").select(T.strip(F.col("t")).alias("s"), F.length(T.clean_text(F.col("t"))).alias("n")).first()
    assert row.s == text.strip() and row.n < 100


def test_chapters_of_a_catalogue(spark):
    from folioflow.operators import relational as R

    books = spark.createDataFrame([("b1", 3, "u/b1${ch}.pdf", 7), ("b2", 2, "u/b2${ch}.pdf", 8), ("b3", 0, "u", 9)], "code string, chapters int, pattern string, part_ int")
    parts = spark.createDataFrame([("b2", 1, 2), ("b2", 2, 0), ("b2", 3, 1)], "code string, part int, chapters int")
    got = sorted((r.code, r.label, r.url, r.part_) for r in R.chapters(books, parts, ["code"]).collect())
    assert got == [("b1", i, f"u/b1$10{i}.pdf", 7) for i in (1, 2, 3)] + [("b2", 1, "u/b2$101.pdf", 8), ("b2", 2, "u/b2$102.pdf", 8), ("b2", 3, "u/b2$301.pdf", 8)]


def test_search_has_no_wildcards(spark):
    from folioflow.operators import relational as R

    df = spark.createDataFrame([("100% sure",), ("1000 sure",), ("a_b",), ("axb",), ("c\\d",)], "t string")
    assert [[r.t for r in R.search_multi(df, q, "t").collect()] for q in ("0% S", "a_B", "c\\")] == [["100% sure"], ["a_b"], ["c\\d"]]
