"""Names for helper columns that can't clash with a caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(names: list[str], *frames: DataFrame) -> list[str]:
    """Variants of ``names`` that none of the frames has, upper and lower case being the same."""
    have = {c.lower() for f in frames for c in f.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out
