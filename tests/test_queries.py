"""Every registered query next to its SQL on DuckDB, at the smallest scale."""

import sys

import duckdb
import pytest

import __spark_entry__ as entry
from suite import registry
from tests.conftest import ROOT, SMALL

sys.path.insert(0, f"{ROOT}/tools")
from compare import TABLES, canonical  # noqa: E402

# The training-data queries are tested in a folder of their own.
QUERIES, ORACLE = {n: q for n, q in entry.queries().items() if n in registry.QUERIES}, registry.ORACLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name in ORACLE:
        want = duck.execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["event_type", "time", "cnt"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
