"""Every registered query against its SQL, at the smallest scale, and the driver contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import compare
from checks.registry import ORACLES, QUERIES
from murmur.sources.views import TABLES, Tables
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "risk_level" in df.columns


def test_every_query_has_its_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, key):
    text, _, fine = compare(spark, duck, key, QUERIES[key], ORACLES[key], SMALL)
    assert fine, text


def test_views_have_the_same_rows_in_both_engines(spark, duck):
    from checks.registry import with_views
    t = Tables(spark, SMALL)
    for name in ("hot_events", "comments", "live_comments", "articles", "replies", "favorites", "monitors"):
        n = duck.execute(with_views(f"SELECT count(*) FROM {name}")).fetchone()[0]
        assert getattr(t, name).count() == n
