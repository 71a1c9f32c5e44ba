"""Every engine query against its SQL in DuckDB, and the entry points."""

import math
import os

import duckdb
import pytest

from capturelake.plans import oracle, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.10g}"
    return f"{float(v):.10g}" if isinstance(v, int) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equals_sql(spark, duck, name):
    rows = queries.QUERIES[name](spark, DATA)
    result = duck.execute(oracle.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(rows.columns)
    want = sorted(tuple(map(plain, r)) for r in result.fetchall())
    got = sorted(tuple(map(plain, r)) for r in rows.select(*names).collect())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
