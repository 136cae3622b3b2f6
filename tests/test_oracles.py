"""Every registered query against its SQL, run by DuckDB over the same Parquet files."""

import duckdb
import pytest

import __spark_entry__ as contract
from workload import queries as own
from workload.views import TABLES, view, with_views

# The training-data queries have tests of their own.
QUERIES, ORACLES = own.QUERIES, own.ORACLES
BUILT_VIEWS = ("m4_waits", "m7_lines", "m7_placed", "m8_tables", "m12_facts")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _sorted(rows):
    return sorted(rows, key=lambda t: tuple((v is not None, str(v)) for v in t))


def _same(df, relation):
    assert sorted(df.columns) == sorted(relation.columns)
    order = [relation.columns.index(c) for c in df.columns]
    expected = [tuple(r[i] for i in order) for r in relation.fetchall()]
    assert _sorted(tuple(r) for r in df.collect()) == _sorted(expected)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        _same(df, duck.sql(ORACLES[name]))
    else:
        assert df.count() >= 0


@pytest.mark.parametrize("name", BUILT_VIEWS)
def test_view_built_in_spark_equals_its_sql(name, spark, sf_dir, duck):
    _same(view(spark, sf_dir, name), duck.sql(with_views(f"select * from {{{name}}}")))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() == 100
