"""Tolerant JSON: salvage, polymorphic roots, setting a key in a document."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def unfence(c: Column) -> Column:
    """A reply without its code fence."""
    c = F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(F.startswith(c, F.lit("```")), F.regexp_replace(F.regexp_replace(c, r"^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(c)


def outer_object(c: Column) -> Column:
    """From the first { to the last }; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def flat_object(c: Column) -> Column:
    """The first object without braces inside."""
    return F.nullif(F.regexp_extract(c, r"\{[^{}]*\}", 0), F.lit(""))


def script_list(c: Column) -> Column:
    """The array under 'scripts', or under 'segments', or the document itself if it is one; '[]' otherwise, and for what doesn't parse. VARIANT in, JSON text out."""
    v = F.try_parse_json(c)
    scripts, segments = F.try_variant_get(v, "$.scripts", "array<variant>"), F.try_variant_get(v, "$.segments", "array<variant>")
    return F.coalesce(F.to_json(scripts), F.to_json(segments), F.to_json(F.try_variant_get(v, "$", "array<variant>")), F.lit("[]"))


def salvaged(c: Column) -> Column:
    """A reply's object as text if it parses, else null."""
    body = outer_object(unfence(c))
    alone = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))  # the parser stops at the end of a value; inside brackets nothing may follow it
    return F.when(alone.isNotNull(), body)


def json_set(c: Column, key: str, value: Column) -> Column:
    """A flat document with one key set; null counts as {}. Keys keep their order, a new one comes last."""
    m = F.from_json(F.coalesce(c, F.lit("{}")), "map<string,string>")
    return F.to_json(F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(F.lit(key), value)))


def value_or_string(c: Column) -> Column:
    """A setting's value: JSON if it is, else the text as a JSON string."""
    alone = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))  # as in ``salvaged``
    return F.when(alone.isNotNull() & (F.coalesce(F.trim(c), F.lit("")) != ""), c).otherwise(F.to_json(F.parse_json(F.concat(F.lit('"'), _escaped(c), F.lit('"')))))


def _escaped(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def setting(c: Column, default: str) -> Column:
    """A setting's value as JSON, ``default`` where it is null."""
    return F.when(c.isNull(), F.lit(json.dumps(default))).otherwise(value_or_string(c))


def int_keys(c: Column, value: str) -> Column:
    """map<int, ...> out of a JSON object; entries whose key is no integer are left out."""
    entries = F.map_entries(F.from_json(c, f"map<string,{value}>"))
    cast = F.transform(entries, lambda e: F.struct(e["key"].try_cast("int").alias("key"), e["value"].alias("value")))
    return F.map_from_entries(F.filter(cast, lambda e: e["key"].isNotNull()))
