"""Plans that must hold at scale."""

import os
import subprocess
import sys

import pytest
from frames import plan

from parley.operators import analytics
from parley.plans import catalog
from parley.plans.views import Inputs

FOLDER = "/root/testdata/sf0.01"
QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan(build(spark, FOLDER)) for name, build in QUERIES.items()}


def test_no_pairing_without_a_key(plans):
    for name, p in plans.items():
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_python_only_where_it_is_needed(plans):
    python = {n for n, p in plans.items() if any(w in p for w in ("Python", "InPandas", "InArrow"))}
    assert python == {
        "ttl_windows",
        "token_bucket",
        "token_bucket_cut",
        "pcm_roundtrip",
        "knn_exact",
        "knn_join",
        "knn_approx",
        "knn_index",
        "index_recall",
        "hash_embed",
        "ingest_batch",
        "search_report",
        "tool_search",
        "tool_dispatch",
    }


@pytest.mark.parametrize(
    "name",
    "html_to_markdown split_markdown token_windows chunk_tokens hash_embed ingest_batch decimate quantise"
    " parse_events event_validation uuid_canonical first_non_empty vector_dim_check tool_priority".split(),
)
def test_row_operators_do_not_shuffle(plans, name):
    assert "Exchange" not in plans[name]


def test_ranking_limits_before_the_shuffle(plans):
    for name in ("top_topics", "recent_per_user", "dedupe_events", "knn_join"):
        assert "WindowGroupLimit" in plans[name], name
    for name in ("recent_events", "knn_exact"):
        assert "TakeOrderedAndProject" in plans[name], name


def test_scans_read_only_what_is_used(spark, plans):
    assert "ReadSchema: struct<user_id:bigint>" in plans["interaction_counts"]
    lookup = plans["analytics_lookup"]
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,7)]" in lookup
    i = Inputs(spark, FOLDER)
    assert "html" not in plan(analytics.recent(i.table("pages").select("page_id", "url"), "page_id", "url"))


def test_counts_combine_before_the_shuffle(plans):
    for name in ("interaction_counts", "engagement", "unique_violations", "latest_status", "block_mean"):
        assert "partial_" in plans[name], name


def test_user_analytics_reads_the_logs_once(spark):
    df = QUERIES["user_analytics"](spark, FOLDER)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and final.count("FileScan") == 1


def test_the_session_splits_skewed_joins(spark):
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Python tasks run from a folder where the package cannot be imported."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as e
from parley.session import build_session
spark = build_session(master="local[2]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
for name in ("ttl_windows", "token_bucket", "pcm_roundtrip", "knn_approx"):
    print(name, e.queries()[name](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(done.stdout.split()) == 8
