import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from inkbed.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)


def rows(columns, values):
    return sorted(tuple(plain(x) for x in r) for r in values)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() == 1


def test_each_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    out = duck.sql(registry.ORACLES[name])
    assert columns == sorted(out.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = duck.sql(f"SELECT {quoted} FROM ({registry.ORACLES[name]})").fetchall()
    assert rows(columns, df.select(*columns).collect()) == rows(columns, expected)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() >= 0


def test_no_cartesian_product(spark, sf_dir):
    for name in ("overlapping_ranges", "object_span_links", "similarity_known_items", "correspondence_status"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
