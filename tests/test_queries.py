"""Every query with SQL gives the rows that DuckDB gives for it."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from stepweave.plans import nested, sql, trajectories

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(ROOT):
        con.execute(f"create view {t.split('.')[0]} as select * from '{ROOT}/{t}'")
    return con


def plain(value):
    if isinstance(value, (float, Decimal)):
        return "nan" if math.isnan(value) else repr(round(float(value), 9))
    return repr(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_same_as_sql(spark, duck, name):
    df = {**trajectories.QUERIES, **nested.QUERIES}[name](spark, ROOT)
    result = duck.execute(sql.SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in result.description], result.fetchall())


@pytest.mark.parametrize("name", sorted(({**trajectories.QUERIES, **nested.QUERIES}).keys() - sql.SQL.keys()))
def test_others_give_rows(spark, name):
    assert entry.queries()[name](spark, ROOT).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["accuracy_by_partition", "mode_metrics", "phase_summary", "accepted_prefix", "canonical_actions", "latency_quantiles", "split_lookup", "node_candidates", "bound_clicks", "p6_found"])
def test_empty_tables(spark, tmp_path, name):
    for t in os.listdir(ROOT):
        spark.read.parquet(f"{ROOT}/{t}").limit(0).write.parquet(str(tmp_path / t))
    assert trajectories.QUERIES.get(name, nested.QUERIES.get(name))(spark, str(tmp_path)).collect() == []
