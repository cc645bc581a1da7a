"""Every registered query against its DuckDB statement on the smallest given tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_module  # noqa: E402
from tickerloom.plans.oracle import oracle_sql  # noqa: E402
from tickerloom.plans.registry import all_queries  # noqa: E402

SF = Path("/root/testdata/sf0.001")
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
ALL_QUERIES, ALL_STATEMENTS = entry_module.queries(), entry_module.oracle_sql()
# Those of the optional subpackage have their own tests.
QUERIES = all_queries()
ORACLE = oracle_sql()

pytestmark = pytest.mark.skipif(not SF.exists(), reason="given tables are absent")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as from '{SF}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(round(value, 9) + 0.0)
    return f"{type(value).__name__}:{value}"


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(ALL_QUERIES) and set(ORACLE) <= set(ALL_STATEMENTS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    got = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    assert got
    answer = duck.execute(ORACLE[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert got == sorted(tuple(normal(r[i]) for i in place) for r in answer.fetchall())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "avg_hedge" in df.columns
