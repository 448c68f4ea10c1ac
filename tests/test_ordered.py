"""Splitting hot keys must not change any result."""

import random

import pytest
from frames import plan, rows
from pyspark.sql import functions as F

from parley.operators import analytics, limits, ordered, status, text


def _log(spark, n=600, users=6, seed=1, step=7_000_000, hot_share=3):
    """Events where user 0 (and the NULL user) hold about a third of all rows, with equal times."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        user = 0 if i % hot_share == 0 else (None if i % 7 == 1 else rnd.randrange(1, users))
        us = 1_700_000_000_000_000 + rnd.randrange(0, n * step // 1_000_000) * 1_000_000
        kind = rnd.choice(["click", "view", "signup", "purchase", "error"])
        out.append((i, user, us, kind, rnd.random()))
    df = spark.createDataFrame(out, "id long, user_id long, us long, kind string, value double")
    return df.withColumn("created_at", F.timestamp_micros("us")).drop("us")


HOT = [dict(min_rows=1), dict(min_rows=100), dict(min_rows=150), dict(min_rows=8)]


@pytest.mark.parametrize("cut", HOT)
def test_interaction_gaps(spark, cut):
    log = _log(spark)
    assert rows(analytics.interaction_gaps(log, 60, **cut)) == rows(analytics.interaction_gaps(log, 60))


@pytest.mark.parametrize("cut", HOT)
def test_response_latency(spark, cut):
    log = _log(spark, seed=2)
    args = ("user_id", "created_at", "id", F.col("kind") == "click", F.col("kind") == "view")
    whole = rows(analytics.response_latency(log, *args))
    assert whole and rows(analytics.response_latency(log, *args, **cut)) == whole


@pytest.mark.parametrize("cut", HOT)
def test_status_transitions(spark, cut):
    name = F.when(F.col("kind") == "signup", "PENDING").when(F.col("kind") == "error", "FAILED").otherwise("PROCESSING")
    log = _log(spark, seed=3).select(
        F.col("id").alias("seq"), F.col("user_id").alias("doc_id"), name.alias("status"), F.col("created_at").alias("ts")
    )
    whole = rows(status.status_transitions(log))
    assert whole and rows(status.status_transitions(log, **cut)) == whole


@pytest.mark.parametrize("n", [1, 2, 5])
@pytest.mark.parametrize("min_rows", [1, 8, 20])
def test_rolling_history(spark, n, min_rows):
    data = [(c, t, "user", f"{c}.{t}") for c in (0, 1, None) for t in range(40) if (t * 7 + (c or 0)) % 3]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    whole = rows(text.rolling_history(turns, n))
    assert rows(text.rolling_history(turns, n, min_rows=min_rows)) == whole
    history = {(r[0], r[1]): r[2] for r in whole}
    for c in (0, 1, None):
        numbers = sorted(t for cc, t, *_ in data if cc == c)
        for at, t in enumerate(numbers):
            want = "\n".join(f"user: {c}.{x}" for x in numbers[max(0, at - n + 1) : at + 1])
            assert history[(c, t)] == want


@pytest.mark.parametrize("cut", HOT)
def test_rate_limit(spark, cut):
    requests = _log(spark, seed=4).withColumnRenamed("created_at", "ts")
    tiers = spark.createDataFrame([(0, "premium"), (1, "standard"), (2, "other")], "user_id long, usage_tier string")
    args = (requests, tiers, 1800, {"standard": 3, "premium": 20})
    whole = rows(limits.rate_limit(*args))
    assert {r[4] for r in whole} == {True, False}
    assert rows(limits.rate_limit(*args, **cut)) == whole


def test_running_sum_starts_blocks_from_the_total_before(spark):
    log = _log(spark, seed=5).withColumn("us", F.unix_micros("created_at"))
    cut = ordered.split_hot(log, ["user_id"], F.col("us"), 1)
    assert cut.filter("_blk IS NULL").count() == 0
    got = rows(ordered.running_sum(cut, ["user_id"], ["created_at", "id"], F.col("id"), "s").select("id", "s"))
    totals, want = {}, []
    for r in sorted(log.collect(), key=lambda r: (str(r["user_id"]), r["created_at"], r["id"])):
        totals[r["user_id"]] = totals.get(r["user_id"], 0) + r["id"]
        want.append((r["id"], totals[r["user_id"]]))
    assert sorted(got) == sorted(want)


def test_only_hot_keys_are_cut(spark):
    log = _log(spark).withColumn("us", F.unix_micros("created_at"))
    cut = ordered.split_hot(log, ["user_id"], F.col("us"), 150)
    assert {r[0] for r in cut.filter("_blk IS NOT NULL").select("user_id").distinct().collect()} == {0}
    hot = cut.filter("user_id = 0")
    assert hot.filter("us < _start").count() == 0
    sizes = [r["n"] for r in hot.groupBy("_blk").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert 8 <= len(sizes) <= 11 and max(sizes) < hot.count() / 4


def test_unzoned_times_do_not_pass_through_the_session_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-31 02:30:00.5' AS ts")
    utc = df.select(ordered.micros(df, "ts")).first()[0]
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert df.select(ordered.micros(df, "ts")).first()[0] == utc == 1_711_852_200_500_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_floor_div_rounds_down(spark):
    df = spark.createDataFrame([(-1,), (0,), (59,), (60,), (-60,), (-61,)], "x long")
    assert [r[0] for r in df.select(ordered.floor_div(F.col("x"), 60)).collect()] == [-1, 0, 0, 1, -1, -2]


def test_top_per_key_limits_before_the_shuffle(spark):
    p = plan(analytics.recent_per_key(_log(spark), ["user_id"], "created_at", "id", 3))
    assert "WindowGroupLimit" in p and "Partial" in p
