"""Queries with SQL give DuckDB's rows; the others give rows."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stepweave.llm import plans
from test_queries import rows

ROOT = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(ROOT):
        con.execute(f"create view {t.split('.')[0]} as select * from '{ROOT}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_as_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, ROOT)
    result = duck.execute(plans.SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in result.description], result.fetchall())


@pytest.mark.parametrize("name", sorted(plans.QUERIES.keys() - plans.SQL.keys()))
def test_others_give_rows(spark, name):
    assert plans.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
