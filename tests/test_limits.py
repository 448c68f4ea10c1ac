"""Sequential rules against direct loops, whole and cut into segments."""

import datetime as dt
import random

import numpy as np
import pytest
from frames import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.operators import limits

BASE = 1_700_000_000_000_000


def _requests(spark, n=500, seed=1, span=5_000, burst=1_000_000):
    rnd = random.Random(seed)
    data = [(i, rnd.choice([0, 0, 0, 1, 2, 3, None]), BASE + rnd.randrange(span) * burst) for i in range(n)]
    df = spark.createDataFrame(data, "id long, user_id long, us long")
    return data, df.select("id", "user_id", F.timestamp_micros("us").alias("ts"))


def _ttl_loop(times, ttl):
    out, anchor = [], None
    for t in sorted(times):
        if anchor is None or t >= anchor + ttl:
            anchor = t
            out.append([t, 1, 0])
        else:
            out[-1][2] += 1
    return [tuple(x) for x in out]


def _bucket_loop(times, cap, cost):
    level, last, out = cap, None, []
    for t in times:
        level = min(cap, level + (t - last if last is not None else 0))
        last = t
        out.append(level >= cost)
        level -= cost if level >= cost else 0
    return out


@pytest.mark.parametrize("cut", [{}, {"min_rows": 1}, {"min_rows": 100}])
def test_ttl_windows(spark, cut):
    data, df = _requests(spark)
    got = limits.ttl_windows(df, "user_id", "ts", 60, **cut)
    got = rows(got.select("user_id", F.unix_micros("window_start"), "misses", "hits"))
    want = []
    for user in {u for _, u, _ in data}:
        want += [(user, *w) for w in _ttl_loop([t for _, u, t in data if u == user], 60_000_000)]
    assert got == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_access_exactly_at_expiry_is_a_miss(spark):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, at), (1, at + dt.timedelta(seconds=59)), (1, at + dt.timedelta(seconds=60))], "k int, ts timestamp")
    got = [(r["misses"], r["hits"]) for r in limits.ttl_windows(df, "k", "ts", 60).orderBy("window_start").collect()]
    assert got == [(1, 1), (1, 0)]


@pytest.mark.parametrize("span, ttl, min_rows", [(900, 7, 10), (400, 60, 50), (5000, 3, 200), (100_000, 50, 30), (60, 100, 5)])
def test_windows_of_hot_keys(spark, span, ttl, min_rows):
    """Dense and sparse keys, life times shorter and longer than blocks, long gaps."""
    rnd = random.Random(span)
    data = []
    for user, n in ((0, 400), (1, 60), (None, 300), (2, 3)):
        times = [rnd.randrange(span) for _ in range(n)]
        if user is None:
            times = [t for t in times if not span // 4 < t < span // 2]
        data += [(user, BASE + t * 1_000_000) for t in times]
    df = spark.createDataFrame(data, "user_id long, us long").select("user_id", F.timestamp_micros("us").alias("ts"))
    got = limits.ttl_windows(df, "user_id", "ts", ttl, min_rows=min_rows)
    got = rows(got.select("user_id", F.unix_micros("window_start"), "misses", "hits"))
    want = []
    for user in {u for u, _ in data}:
        want += [(user, *w) for w in _ttl_loop([t for u, t in data if u == user], ttl * 1_000_000)]
    assert got == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=60), st.integers(1, 50), st.integers(0, 400))
def test_walk_agrees_with_the_fold(times, ttl, entering):
    us = np.sort(np.array(times))
    expiry = min(entering, int(us[0]) + ttl - 1)
    anchors, counts = limits.ttl_walk(us, ttl, expiry)
    n = len(us)
    (folded,) = limits._ttl_fold(ttl)()([True] + [False] * n, [True] + [False] * n, [expiry, *us.tolist()], [0] * (n + 1))
    assert folded[1:] == [int(a) for a, c in zip(anchors, counts) for _ in range(c)]


@pytest.mark.parametrize("cut", [{}, {"min_rows": 1}, {"min_rows": 100}, {"min_rows": 8}])
def test_token_bucket(spark, cut):
    data, df = _requests(spark, seed=2)
    got = {r["id"]: r["admitted"] for r in limits.token_bucket(df, 3, 45, **cut).collect()}
    for user in {u for _, u, _ in data}:
        mine = sorted((t, i) for i, u, t in data if u == user)
        want = _bucket_loop([t for t, _ in mine], 3 * 45_000_000, 45_000_000)
        assert [got[i] for _, i in mine] == want
    assert set(got.values()) == {True, False}


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.integers(0, 99), max_size=40),
    st.integers(1, 6),
    st.integers(1, 30),
    st.data(),
)
def test_bucket_transfer_agrees_with_the_walk(times, capacity, cost, data):
    cap = capacity * cost
    us = np.sort(np.array(times, dtype="int64"))
    pieces = limits.bucket_transfer(us, 0, 100, cap, cost)
    level = data.draw(st.integers(0, cap))
    _, _, end, last = limits.bucket_walk(us, level, 0, cap, cost)
    assert limits.apply_transfer(pieces, level) == min(cap, end + 100 - last)
    assert len(pieces) <= 4 * (capacity + 2)


def test_requests_per_minute(spark):
    at = dt.datetime(2024, 1, 1, 10, 0, 59)
    df = spark.createDataFrame([(1, at), (1, at), (1, at + dt.timedelta(seconds=1)), (2, at)], "user_id int, ts timestamp")
    got = {(r["user_id"], r["minute"].minute): r["requests"] for r in limits.requests_per_minute(df).collect()}
    assert got == {(1, 0): 2, (1, 1): 1, (2, 0): 1}


def test_limits_of_the_documented_tiers(spark):
    at = dt.datetime(2024, 1, 1)
    data = [(i, u, at) for u in (1, 2) for i in range(u * 100, u * 100 + 60)]
    df = spark.createDataFrame(data, "id long, user_id long, ts timestamp")
    tiers = spark.createDataFrame([(2, "premium")], "user_id long, usage_tier string")
    got = limits.rate_limit(df, tiers).groupBy("user_id").agg(F.count_if("admitted").alias("n"))
    assert {r["user_id"]: r["n"] for r in got.collect()} == {1: 10, 2: 50}
