"""Every query against DuckDB, on the two smaller scale factors."""

import os

import duckdb
import pytest

from folioflow.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return ("f", round(v, 6))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def scale(request):
    return f"/root/testdata/{request.param}"


@pytest.fixture(scope="module")
def con(scale):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(scale, t)}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, scale, con, name):
    df = registry.QUERIES[name](spark, scale)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = con.execute(registry.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    rows = r.fetchall()
    assert got == sorted((tuple(norm(x[names.index(c)]) for c in cols) for x in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0
