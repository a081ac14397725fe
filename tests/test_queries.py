"""Every query of the engine against its SQL."""

import math

import duckdb
import pytest

from tidemark.plans.driver import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "∅"
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows, cols = df.collect(), sorted(df.columns)
    assert rows or name in ("hybrid_retrieve",)
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        at = want.columns
        assert sorted(at) == cols
        assert sorted(tuple(plain(r[c]) for c in cols) for r in rows) == sorted(tuple(plain(r[at.index(c)]) for c in cols) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
