"""Rows that fixtures rarely hold: NULL times, bursts, outliers, duplicate keys, lost samples, odd markup."""

import datetime as dt
import random

import pytest
from frames import rows
from pyspark.sql import functions as F

from parley.operators import access, analytics, integrity, limits, ordered, series, status, text


def log(spark, times, users=None):
    data = [(i, 0 if users is None else users[i], t) for i, t in enumerate(times)]
    df = spark.createDataFrame(data, "id long, user_id long, us long")
    return df.withColumn("created_at", F.timestamp_micros("us")).drop("us")


SECOND = 1_000_000
SHAPES = {
    "nulls": [None if i % 5 == 0 else 10**15 + i * SECOND for i in range(300)],
    "outlier": [1, *[10**15 + i * SECOND for i in range(299)]],
    "burst": [10**15 if i % 3 else 10**15 + i * SECOND for i in range(300)],
    "equal": [10**15] * 300,
    "spread": [10**15 + i * i * SECOND for i in range(300)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_cut_and_whole_keys_agree(spark, shape):
    events = log(spark, SHAPES[shape], [i % 4 and 1 for i in range(300)])
    requests = events.select("id", "user_id", F.col("created_at").alias("ts"))
    tiers = spark.createDataFrame([(1, "premium")], "user_id long, usage_tier string")
    kinds = F.col("id") % 3
    steps = events.select(
        F.col("id").alias("seq"),
        F.col("user_id").alias("doc_id"),
        F.when(kinds == 0, "PENDING").when(kinds == 1, "PROCESSING").otherwise("FAILED").alias("status"),
        F.col("created_at").alias("ts"),
    )
    runs = {
        "gaps": lambda **k: analytics.interaction_gaps(events, 60, **k),
        "latency": lambda **k: analytics.response_latency(events, "user_id", "created_at", "id", kinds == 0, kinds == 1, **k),
        "transitions": lambda **k: status.status_transitions(steps, **k),
        "limit": lambda **k: limits.rate_limit(requests, tiers, 3600, **k),
        "bucket": lambda **k: limits.token_bucket(requests, 3, 20, **k),
    }
    for name, run in runs.items():
        assert rows(run(min_rows=40)) == rows(run()), name


def test_windows_of_accesses_without_time(spark):
    events = log(spark, SHAPES["nulls"])
    whole = rows(limits.ttl_windows(events, "user_id", "created_at", 30))
    assert sum(r[2] + r[3] for r in whole) == 240
    assert rows(limits.ttl_windows(events, "user_id", "created_at", 30, min_rows=100)) == whole


@pytest.mark.parametrize("shape", ["outlier", "spread", "nulls"])
def test_blocks_hold_about_equally_many_rows(spark, shape):
    events = log(spark, SHAPES[shape] * 1)
    cut = ordered.split_hot(events, ["user_id"], ordered.micros(events, "created_at"), 150)
    sizes = [r["count"] for r in cut.groupBy("_blk").count().collect()]
    # The rows without a time share one position; the others are spread.
    most = 60 + 20 if shape == "nulls" else 2 * 300 / len(sizes)
    assert len(sizes) >= 8 and max(sizes) <= most + 1


def test_message_without_time_has_no_gap(spark):
    out = analytics.interaction_gaps(log(spark, [None, 10**15, 10**15 + SECOND]), 3600).collect()
    assert {r["id"]: r["duration_s"] for r in out} == {0: None, 1: 1.0, 2: None}


def test_request_without_time_is_not_admitted(spark):
    requests = log(spark, [None, 10**15, 10**15]).withColumnRenamed("created_at", "ts")
    out = {r["id"]: (r["admitted"], r["credit_us"]) for r in limits.token_bucket(requests, 1, 10).collect()}
    assert out == {0: (False, None), 1: (True, 0), 2: (False, 0)}


def test_upsert_leaves_one_row_per_key(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    updates = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "n"), (None, "m")], "k long, v string")
    assert rows(integrity.upsert(target, updates, ["k"])) == [(1, "y"), (2, "b"), (3, "z"), (None, "m"), (None, "n")]


def test_insert_ignore_keeps_all_rows_without_a_key(spark):
    target = spark.createDataFrame([(1, "a"), (None, "t")], "k long, v string")
    new = spark.createDataFrame([(1, "x"), (2, "d"), (2, "c"), (None, "n"), (None, "m")], "k long, v string")
    out = rows(integrity.insert_ignore(target, new, ["k"]))
    assert out == [(1, "a"), (2, "c"), (None, "m"), (None, "n"), (None, "t")]


def test_cache_entries_loaded_at_the_same_time(spark):
    base = spark.createDataFrame([(1, "stored")], "user_id long, p string")
    at = F.timestamp_micros(F.lit(10**15))
    cache = spark.createDataFrame([(1, "a"), (1, "c"), (1, "b")], "user_id long, p string").withColumn("loaded_at", at)
    now = F.timestamp_micros(F.lit(10**15 + SECOND))
    assert access.overlay(base, cache, "user_id", "p", now, 60).first()["p"] == "c"


def test_samples_that_are_missing_or_no_number(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (2.0,), (-2.0,), (0.5,)], "x double")
    for mode, high in (("floor", 16384), ("split", 16383)):
        out = [r[0] for r in df.select(series.quantise(F.col("x"), mode)).collect()]
        assert out == [None, 0, 32767, -32768, high]


def test_lost_and_doubled_samples_cost_no_frame(spark):
    numbers = [n for n in range(1, 51) if n != 7] + [9, 9]
    df = spark.createDataFrame([(1, n, n) for n in numbers], "signal_id long, n long, sample long")
    out = {r["frame"]: r["samples"] for r in series.frames(df, 10).collect()}
    kept = sorted(set(numbers))
    assert out == {i: kept[10 * i : 10 * i + 10] for i in range(4)}
    # A signal without a name, samples without a number or value, and negative numbers are framed like any other.
    odd = [(None, n, n) for n in (-3, -1, 0, 2, 2, 5)] + [(2, None, 7), (2, 1, None), (2, 1, 4), (2, 2, None)]
    out = series.frames(spark.createDataFrame(odd, "signal_id long, n long, sample long"), 2).collect()
    got = {(r["signal_id"], r["frame"]): r["samples"] for r in out}
    assert got == {(None, 0): [-3, -1], (None, 1): [0, 2], (2, 0): [7, 4]}


def test_pcm_of_empty_null_and_odd_frames(spark):
    df = spark.createDataFrame([([1, -2, 32767],), ([],), (None,)], "s array<smallint>")
    coded = df.select(series.encode_pcm("s").alias("t"))
    assert [r["t"] for r in coded.collect()] == ["AQD+//9/", "", None]
    assert [r[0] for r in coded.select(series.decode_pcm(F.col("t"))).collect()] == [[1, -2, 32767], [], None]


FENCES = """intro
```
~~~
# not a header
```
# real
```x```
# also real
~~~ info `text`
# hidden
~~~
## last"""


def test_a_fence_closes_with_its_own_kind(spark):
    df = spark.createDataFrame([(1, FENCES)], "doc_id long, text string")
    out = text.split_markdown(df).orderBy("chunk_idx").collect()
    assert [(r["header_1"], r["header_2"]) for r in out] == [(None, None), ("real", None), ("also real", None), ("also real", "last")]
    assert "# not a header" in out[0]["chunk_text"] and "# hidden" in out[2]["chunk_text"]


@pytest.mark.parametrize(
    ("html", "plain"),
    [
        ("&#38;amp;", "&amp;"),
        ("&amp;#65;", "&#65;"),
        ("&#0000000065;&#x00000000041;", "AA"),
        ("caf&eacute; &lt;b&gt; &unknown; &amp &;", "café <b> &unknown; &amp &;"),
        ("&#99999999999999999999;&#xD800;", "��"),
        ("a & b", "a & b"),
    ],
)
def test_entities_are_decoded_once(spark, html, plain):
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert text.html_to_markdown(df).first()["markdown"] == plain


def _as_of_brute(calls, base, cache, ttl):
    out = []
    for call, key, at in calls:
        held = [(t, v) for k, t, v in cache if k == key and k is not None and t is not None and at is not None and t <= at]
        t, v = max(held, key=lambda e: (e[0], e[1] is not None, e[1] or ""), default=(None, None))
        live = t is not None and (at - t).total_seconds() < ttl
        out.append((call, key, v if live else base.get(key), live))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("min_rows", [8, 1_000_000])
def test_permissions_at_the_time_of_each_call(spark, min_rows):
    rnd = random.Random(min_rows)
    start = dt.datetime(2024, 1, 1)

    def when():
        # Bursts at single times, a wrong clock, and a spread of others.
        return start + dt.timedelta(seconds=rnd.choice([50, 50, 51, 10**8, *range(0, 400, 7)]))

    keys = [1] * 8 + [2, 3, 4]
    calls = [(i, rnd.choice(keys), when()) for i in range(240)]
    calls += [(900, None, when()), (901, 1, None), (902, 1, None), (903, 77, when())]
    cache = [(rnd.choice(keys), when(), rnd.choice("abc")) for _ in range(90)]
    cache += [(1, None, "z"), (None, when(), "z"), (77, start, "own")]
    base = {1: "stored", 2: "other", 3: None}
    got = access.overlay_as_of(
        spark.createDataFrame(calls, "call_id long, user_id long, ts timestamp_ntz"),
        spark.createDataFrame(list(base.items()), "user_id long, p string"),
        spark.createDataFrame(cache, "user_id long, loaded_at timestamp_ntz, p string"),
        "user_id", "p", 60, min_rows=min_rows,
    )
    assert rows(got.select("call_id", "user_id", "p", "from_cache")) == _as_of_brute(calls, base, cache, 60)
