"""Exact rules on streams against their batch twins: late and shuffled input, restarts, state handed over."""

import datetime as dt
import os
import random

import pytest
from frames import rows
from pyspark.sql import functions as F

from parley.operators import analytics, limits
from parley.streaming import timed

SCHEMA = "id long, user_id long, ts timestamp"
START = dt.datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, timed.STATE_STORE)
    yield
    spark.conf.set(name, before)


def _requests(n=240, seed=4):
    rnd = random.Random(seed)
    times = sorted(rnd.randrange(0, 6000) for _ in range(n))
    return [(i, rnd.choice([1, 1, 2, 3]), START + dt.timedelta(seconds=s)) for i, s in enumerate(times)]


def _files(spark, folder, data, parts=3, lateness=400, seed=5):
    """The requests in files, each up to ``lateness`` seconds out of order, and a last row that moves the watermark on."""
    rnd = random.Random(seed)
    shuffled = sorted(data, key=lambda r: r[2] + dt.timedelta(seconds=rnd.randrange(lateness)))
    size = -(-len(shuffled) // parts)
    for k in range(parts):
        yield shuffled[k * size : (k + 1) * size]
    yield [(-1, 99, START + dt.timedelta(days=2))]
    yield [(-2, 99, START + dt.timedelta(days=4))]


def _write(spark, folder, number, part):
    spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    for name in os.listdir(folder):
        if name.startswith("part-"):
            os.rename(os.path.join(folder, name), os.path.join(folder, f"k{number}.parquet"))


def _drive(spark, tmp_path, build, data):
    """Each file in a run of its own from one checkpoint: every trigger is a restart."""
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for number, part in enumerate(_files(spark, folder, data)):
        _write(spark, folder, number, part)
        stream = build(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark)
        query = query.trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    return spark.read.parquet(out).filter("id >= 0")


def test_token_bucket_equals_the_batch_whatever_the_order_of_arrival(spark, store, tmp_path):
    data = _requests()
    got = _drive(spark, tmp_path, lambda s: timed.token_bucket_timed(s, 3, 200), data)
    batch = limits.token_bucket(spark.createDataFrame(data, SCHEMA), 3, 200)
    cols = ["id", "user_id", "admitted", "credit_us"]
    assert rows(got.select(cols)) == rows(batch.select(cols))


def test_windows_equal_the_batch(spark, store, tmp_path):
    data = _requests(seed=6)
    got = _drive(spark, tmp_path, lambda s: timed.ttl_windows_timed(s, "user_id", "ts", 300), data)
    counted = got.groupBy("user_id", "anchor_us").agg((F.count(F.lit(1)) - 1).alias("hits"))
    batch = limits.ttl_windows(spark.createDataFrame(data, SCHEMA), "user_id", "ts", 300)
    batch = batch.select("user_id", F.unix_micros("window_start").alias("anchor_us"), "hits")
    assert rows(counted.select("user_id", "anchor_us", "hits")) == rows(batch)


def test_buckets_are_handed_over_from_a_batch(spark, store, tmp_path):
    data = _requests(seed=7)
    whole = limits.token_bucket(spark.createDataFrame(data, SCHEMA), 3, 200)
    early, late = data[:120], data[120:]
    done = limits.token_bucket(spark.createDataFrame(early, SCHEMA), 3, 200)
    last = done.groupBy("user_id").agg(F.max_by(F.struct("credit_us", "ts"), F.struct("ts", "id")).alias("e"))
    initial = last.select("user_id", F.col("e.credit_us").alias("s0"), F.unix_micros("e.ts").alias("s1"))
    got = _drive(spark, tmp_path, lambda s: timed.token_bucket_timed(s, 3, 200, initial=initial), late)
    cols = ["id", "user_id", "admitted", "credit_us"]
    assert rows(got.select(cols)) == rows(whole.filter("id >= 120").select(cols))


def _asks_and_answers():
    return F.col("id") % 5 != 0, F.col("id") % 5 < 2


def _latencies(spark, tmp_path, data, **options):
    build = lambda s: timed.response_latency_timed(s, "user_id", "ts", "id", *_asks_and_answers(), **options)
    return rows(_drive(spark, tmp_path, build, data).selectExpr("user_id", "id", "latency_us / 1e6"))


def test_response_latency_equals_the_batch(spark, store, tmp_path):
    """Requests, responses and rows that are both, in files that arrive out of order; equal times go by number."""
    data = _requests(seed=8) + [(1000 + i, 1, START + dt.timedelta(seconds=70)) for i in range(10)]
    batch = analytics.response_latency(spark.createDataFrame(data, SCHEMA), "user_id", "ts", "id", *_asks_and_answers())
    want = rows(batch.select("user_id", "response_seq", "latency_s"))
    assert want and _latencies(spark, tmp_path, data) == want


def test_a_wait_ends_without_a_row_when_it_lasts_too_long(spark, store, tmp_path):
    data = _requests(seed=9)
    want, began = [], {}
    for i, user, ts in sorted(data, key=lambda r: (r[2], r[0])):
        if user in began and (ts - began[user]).total_seconds() > 40:
            del began[user]
        if i % 5 != 0:
            began.setdefault(user, ts)
        if i % 5 < 2 and user in began:
            want.append((user, i, (ts - began.pop(user)).total_seconds()))
    got = _latencies(spark, tmp_path, data, longest_s=40)
    assert got == sorted(want, key=lambda r: tuple(map(str, r)))
    whole = analytics.response_latency(spark.createDataFrame(data, SCHEMA), "user_id", "ts", "id", *_asks_and_answers())
    assert len(got) < whole.count()
