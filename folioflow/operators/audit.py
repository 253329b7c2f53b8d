"""The retention audit: what a page lost on its way into text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def issues(o: str = "ours", t: str = "truth") -> Column:
    """The list of losses of a page, given what we have and what a reader saw."""
    c = lambda s: F.col(s)
    zero = lambda s: F.coalesce(c(s), F.lit(0))
    text = F.coalesce(c(f"{o}.text"), F.lit(""))
    figures = F.greatest(F.coalesce(F.size(f"{t}.figure_bboxes"), F.lit(0)), zero(f"{t}.num_figures"))
    ours, charts, equations = zero(f"{o}.n_diagrams"), zero(f"{t}.num_charts"), zero(f"{t}.num_equations")
    missed = c(f"{t}.verified_missed")
    lines = F.split(text, "\n")
    tabular = F.size(F.filter(lines, lambda x: F.contains(x, F.lit("\t")) | ((F.size(T.words(x)) >= 3) & (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) >= 3))))
    numeric = F.size(F.filter(T.words(text), lambda w: w.rlike("[0-9]")))
    s = lambda x: x.cast("string")
    verified = F.when((missed > 0) & (ours == 0), F.concat(F.lit("FIGURES: "), s(missed), F.lit(" verified, 0 extracted"))).when(missed > ours, F.concat(F.lit("FIGURES: "), s(missed), F.lit(" verified, "), s(ours), F.lit(" extracted")))
    blanket = F.when((figures > 0) & (ours == 0), F.concat(F.lit("FIGURES: "), s(figures), F.lit(" seen, 0 extracted"))).when(figures > ours, F.concat(F.lit("FIGURES: "), s(figures), F.lit(" seen, "), s(ours), F.lit(" extracted")))
    has = F.coalesce(c(f"{t}.has_text"), F.lit(False))
    empty = T.strip(text) == ""
    return F.array_compact(
        F.array(
            F.when(missed.isNotNull() & (figures > ours), verified).otherwise(blanket),
            F.when(charts > figures, F.concat(F.lit("CHARTS: "), s(charts), F.lit(" seen"))),
            F.when(has & (c(f"{t}.text_quality") == "garbled"), F.lit("TEXT: garbled")).when(has & (c(f"{t}.text_quality") == "scanned"), F.lit("TEXT: scanned")),
            F.when(has & empty, F.lit("TEXT: text layer empty")).when(~has & ~empty, F.lit("TEXT: not on the page")),
            F.when((equations > 0) & (F.length(T.strip(text)) < 200), F.concat(F.lit("EQUATIONS: "), s(equations))),
            F.when(F.coalesce(c(f"{t}.has_tables"), F.lit(False)) & (zero(f"{o}.n_tables") == 0) & ~((tabular >= 1) | (numeric >= 8)), F.concat(F.lit("TABLES: "), s(F.coalesce(c(f"{t}.num_tables"), F.lit(1))))),
        )
    )


def rollup(pages: DataFrame) -> DataFrame:
    """Per document: pages, pages without issues, pages with an error."""
    return pages.groupBy("pdf_id").agg(F.count("*").alias("pages"), F.count_if(F.size("issues") == 0).alias("clean"), F.count_if(F.col("error").isNotNull()).alias("errors"))
