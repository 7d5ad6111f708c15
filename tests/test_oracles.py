"""Every named query against its DuckDB result on whole tables."""

import duckdb
import pytest

from waybill.plans.catalog import queries
from waybill.plans.oracles import oracle_sql

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def _in_order(rows):
    return sorted(rows, key=lambda row: [(v is None, str(v)) for v in row])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    check(spark, sf_dir, duck, name)


@pytest.mark.parametrize("name", ["org_order_day", "org_truck_model_day", "bound_org_sort_day", "route_dims"])
def test_query_where_nothing_fits_a_broadcast(spark, sf_dir, duck, name):
    """Large dimensions: every join goes by shuffle."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check(spark, sf_dir, duck, name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def check(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    expected = duck.execute(ORACLES[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    expected = [tuple(row[names.index(c)] for c in columns) for row in expected.fetchall()]
    got = [tuple(row) for row in df.select(*[f"`{c}`" for c in columns]).collect()]
    assert len(got) == len(expected)
    assert _in_order(got) == _in_order(expected)
