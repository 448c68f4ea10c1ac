import base64
import math

import numpy as np
import pytest
from frames import plan, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.operators import series


def _signal(spark, *lengths):
    data = [(s, n, math.sin(s + n)) for s, length in enumerate(lengths) for n in range(1, length + 1)]
    return data, spark.createDataFrame(data, "signal_id int, n long, sample double")


@pytest.mark.parametrize("src, dst", [(48_000, 16_000), (44_100, 16_000), (16_000, 16_000), (8_000, 16_000)])
def test_decimate(spark, src, dst):
    data, df = _signal(spark, 100, 1, 47)
    out = series.decimate(df, src, dst)
    assert "Exchange" not in plan(out)
    dst = min(src, dst)
    for s, length in enumerate((100, 1, 47)):
        got = [(r["n"], r["k"]) for r in out.filter(F.col("signal_id") == s).orderBy("n").collect()]
        kept = [n for n in range(1, length + 1) if n * dst // src > (n - 1) * dst // src]
        assert got == [(n, k) for k, n in enumerate(kept, 1)]
        assert len(got) == length * dst // src


@pytest.mark.parametrize("src, dst", [(48_000, 16_000), (44_100, 16_000), (16_000, 16_000), (22_050, 16_000)])
def test_block_mean(spark, src, dst):
    lengths = (64, 1, 2, 3, 441, 100)
    data, df = _signal(spark, *lengths)
    got = {(r["signal_id"], r["block"]): r["mean"] for r in series.block_mean(df, src, dst).collect()}
    want = {}
    for s, length in enumerate(lengths):
        x = [v for i, _, v in data if i == s]
        edge = lambda j: (2 * j * src + dst) // (2 * dst)
        for j in range((2 * length * dst + src) // (2 * src)):
            part = x[edge(j) : edge(j + 1)]
            want[(s, j)] = sum(part) / len(part)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_block_mean_does_not_add_samples(spark):
    with pytest.raises(ValueError):
        series.block_mean(_signal(spark, 4)[1], 8_000, 16_000)


def test_quantise(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (1.5,), (-9.0,), (0.0,), (-0.00001,), (0.5,), (0.99999,)], "x double")
    floor = [r[0] for r in df.select(series.quantise(F.col("x"))).collect()]
    assert floor == [32767, -32768, 32767, -32768, 0, -1, 16384, 32767]
    split = [r[0] for r in df.select(series.quantise(F.col("x"), "split")).collect()]
    assert split == [32767, -32768, 32767, -32768, 0, 0, 16383, 32766]
    with pytest.raises(ValueError):
        series.quantise(F.col("x"), "other")


def test_frames_hold_back_the_tail(spark):
    data, df = _signal(spark, 1000, 479, 480)
    out = series.frames(df).orderBy("signal_id", "frame").collect()
    assert [(r["signal_id"], r["frame"], len(r["samples"])) for r in out] == [(0, 0, 480), (0, 1, 480), (2, 0, 480)]
    assert out[0]["samples"] + out[1]["samples"] == [v for s, _, v in data if s == 0][:960]


def test_decimate_then_frames(spark):
    _, df = _signal(spark, 100)
    out = series.frames(series.decimate(df, 48_000, 16_000), 10, "k")
    assert out.count() == 3


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.integers(-32768, 32767), max_size=10), min_size=1, max_size=5))
def test_pcm_round_trip(spark, frames):
    df = spark.createDataFrame([(f,) for f in frames], "samples array<smallint>")
    out = df.select("samples", series.encode_pcm("samples").alias("t")).select("*", series.decode_pcm(F.col("t")).alias("b"))
    for r in out.collect():
        assert r["t"] == base64.b64encode(np.array(r["samples"], "<i2").tobytes()).decode()
        assert r["b"] == r["samples"]


def test_bad_frames_are_null(spark):
    odd = base64.b64encode(b"abc").decode()
    df = spark.createDataFrame([(odd,), ("not base64!",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(series.decode_pcm(F.col("t"))).collect()] == [None, None, None, []]


def test_arithmetic_stays_in_the_engine(spark):
    _, df = _signal(spark, 10)
    for out in (series.decimate(df, 3, 1), series.block_mean(df, 3, 1), series.frames(df, 2)):
        assert "Python" not in plan(out)
    assert rows(df.select(series.dequantise(F.lit(-32768)))) == [(-1.0,)] * 10
