"""Registered queries against DuckDB where SQL has the result, and the shape of all of them."""

import pytest

from waybill.llm.queries import ORACLE_SQL, QUERIES


def _in_order(rows):
    return sorted(rows, key=lambda row: [(v is None, str(v)) for v in row])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    expected = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(df.columns)
    expected = [tuple(row[names.index(c)] for c in df.columns) for row in expected.fetchall()]
    assert _in_order(tuple(r) for r in df.collect()) == _in_order(expected)


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
