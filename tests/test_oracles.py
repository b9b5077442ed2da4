"""Every registered query of the reference's operators against its DuckDB SQL at the smallest scale."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from millrace.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def shown(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else repr(round(float(v), 5) + 0.0)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(shown(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    want = duck.execute(registry.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["source", "collected", "matched", "new"]
