"""Every registered query against its SQL twin on the driver's tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points
from parley.plans import catalog, oracles

FOLDER = os.environ.get("PARLEY_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()

QUERIES, ORACLES = catalog.queries(), oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    yield con
    con.close()


def _plain(df):
    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        return v

    cols = sorted(df.columns)
    out = [tuple(value(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
    return cols, sorted(out, key=lambda r: tuple(str(x) for x in r))


def test_only_the_approximate_search_has_no_twin():
    assert set(QUERIES) - set(ORACLES) == {"knn_approx", "knn_index", "index_recall"}
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got_cols, got = _plain(QUERIES[name](spark, FOLDER).toPandas())
    assert got
    if name in ORACLES:
        want_cols, want = _plain(duck.execute(ORACLES[name]).df())
        assert got_cols == want_cols
        assert got == want


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["user_id", "total_interactions", "top_topics", "last_updated_at"]
    assert df.count() > 0
