"""Relational operators of the catalogue: optional filters, search, facets, upserts, latest rows, cascades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fresh


def filter_optional(df: DataFrame, **equal: object) -> DataFrame:
    """Keeps rows equal to every value that is given; None means no condition."""
    terms = [F.col(c) == v for c, v in equal.items() if v is not None]
    return df.where(reduce(Column.__and__, terms)) if terms else df


def search_multi(df: DataFrame, query: str | None, *columns: str) -> DataFrame:
    """Rows in which any of ``columns`` (cast to text) contains ``query``, whatever the case."""
    if not query:
        return df
    plain = query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")  # no wildcards
    return df.where(reduce(Column.__or__, [F.col(c).cast("string").ilike(f"%{plain}%") for c in columns]))


def needs_label(c: Column) -> Column:
    return c.isNull() | (c == "") | c.ilike("No diagram%")


def analyzed_real(status: Column, description: Column) -> Column:
    """Analyzed and not a 'no diagram' note; a null description drops out, as in SQL."""
    return (status == "analyzed") & ~description.ilike("%No diagram%")


def facets(df: DataFrame, *columns: str) -> DataFrame:
    """(facet, value, n) for each column, nulls left out. One scan: rows are listed once a column and summed up before their shuffle."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(each.alias("x")).select("x.*").where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``. The window is cut to one row before its shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    (rn,) = fresh(["rn_"], df)
    return df.withColumn(rn, rank).where(F.col(rn) == 1).drop(rn)


def upsert_latest(base: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """``base`` with ``changes`` put over it: of rows with one key that with the largest ``version`` stays, a change before a base row."""
    (new,) = fresh(["new_"], base, changes)
    both = base.withColumn(new, F.lit(0)).unionByName(changes.withColumn(new, F.lit(1)))
    return latest_per_key(both, keys, [F.desc(version), F.desc(new)]).drop(new)


def insert_ignore(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` and those of ``rows`` whose key it lacks."""
    return base.unionByName(rows.join(base.select(*keys), keys, "left_anti"))


def patch(df: DataFrame, where: Column, values: dict[str, Column], allowed: set[str]) -> DataFrame:
    """Sets allowed columns in the rows that ``where`` holds for; other names are passed over."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items() if c in allowed and c in df.columns})


def backfill_from_parent(child: DataFrame, parent: DataFrame, fk: str, pk: str, column: str, source: str) -> DataFrame:
    """``column`` of the child where null, out of the parent's ``source``."""
    key, value = fresh(["pk_", "value_"], child)
    p = parent.select(F.col(pk).alias(key), F.col(source).alias(value))
    return child.join(p, F.col(fk) == F.col(key), "left").withColumn(column, F.coalesce(F.col(column), F.col(value))).drop(key, value)


def cascade_delete(child: DataFrame, parent_left: DataFrame, fk: str, pk: str) -> DataFrame:
    """The children whose parent is still there."""
    return child.join(parent_left.select(F.col(pk).alias(fk)), fk, "left_semi")


def next_version(versions: DataFrame, keys: list[str], column: str) -> DataFrame:
    return versions.groupBy(*keys).agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next_version"))


def child_counts(parent: DataFrame, child: DataFrame, pk: str, fk: str, **counts: Column) -> DataFrame:
    """Parent rows with aggregates of their children, 0 where there are none: children are summed up before the join."""
    (key,) = fresh(["fk_"], parent, child)
    c = child.groupBy(F.col(fk).alias(key)).agg(*[e.alias(n) for n, e in counts.items()])
    return parent.join(c, F.col(pk) == F.col(key), "left").drop(key).fillna(0, list(counts))


def chapters(books: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """A row a chapter of ``books`` (keys, chapters, pattern, ...): part, chapter in its part, label and url.

    Where ``parts`` (keys, part, chapters) has counted chapters of a book, those count and not
    the book's own number; labels go on through later parts. The url is the pattern with
    {ch} replaced by a hundred times the part and the chapter. Parts without chapters have no rows.
    """
    part, count, before = fresh(["part", "count_", "before_"], books)
    w = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = parts.select(*keys, F.col("part").alias(part), F.col("chapters").alias(count), F.coalesce(F.sum("chapters").over(w), F.lit(0)).cast("int").alias(before))
    x = books.join(counted, keys, "left").withColumn(part, F.coalesce(part, F.lit(1))).withColumn(count, F.coalesce(count, "chapters"))
    x = x.where(F.col(count) > 0).withColumn("chapter", F.explode(F.sequence(F.lit(1), F.col(count))))
    number = (F.col(part) * 100 + F.col("chapter")).cast("string")
    return x.withColumn("label", F.col("chapter") + F.coalesce(before, F.lit(0))).withColumn("url", F.replace("pattern", F.lit("{ch}"), number)).drop(count, before)
