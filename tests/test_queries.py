"""Queries against their SQL on the smallest tables, and the contract of the entry module."""

import math
import os

import duckdb
import pytest
from conftest import DATA

from loomline.plans import QUERIES, SQL


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.7g}")
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    rel = tables.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in df.columns]
    want = sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
    assert sorted(repr([plain(v) for v in r]) for r in df.collect()) == want


def test_entry_runs_with_a_fixed_schema(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["pair_index", "criterion", "x"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
