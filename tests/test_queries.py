"""Every engine query with SQL against DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from palimpsest import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: round(float(v), 4) if type(v).__name__ in ("float", "Decimal") else str(v) if hasattr(v, "year") else v
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    want = duck.execute(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(c[0] for c in want.description)
    assert got == rows([c[0] for c in want.description], want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pushdown(spark):
    """Predicates and columns reach the scan; a top-k isn't a full sort."""
    plan = queries.QUERIES["d8_between"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_custkey,10)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan and "Sort" not in plan
    plan = queries.QUERIES["c5_top_k"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
