"""Jobs over many sample series, one row per sample: (signal_id, n, sample) with n from 1.

Rates and block means are stated on the sample number, frames on the position among the samples that arrived. No
operator needs to see a series as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.constants import FRAME
from parley.operators.ordered import NO_POSITION, floor_div


def _div(a: Column, b: int) -> Column:
    """Integer quotient of a non-negative number."""
    return ((a - a % b) / F.lit(b)).cast("long")


def decimate(s: DataFrame, src: int, dst: int) -> DataFrame:
    """Keep the samples at which the target clock ticks; ``k`` numbers the kept ones from 1.

    A row filter without a shuffle. It never adds samples: with ``dst >= src`` all are kept.
    """
    dst = min(dst, src)
    tick = _div(F.col("n") * dst, src)
    before = _div((F.col("n") - 1) * dst, src)
    return s.filter(tick > before).withColumn("k", tick)


def block_mean(s: DataFrame, src: int, dst: int) -> DataFrame:
    """Down-sample by means: block j covers positions [round(j*r), round((j+1)*r)), r = src/dst.

    A series of N samples has round(N/r) blocks, halves rounded up. A trailing partial block beyond that
    number is dropped. Whether a block is beyond it follows from its own last sample: any block that is
    not the last of its series is full and passes.
    """
    if dst > src:
        raise ValueError("block_mean reduces the rate; dst must not exceed src")
    position = F.col("n") - 1
    block = _div(F.lit(dst) * (2 * position + 1) - 1, 2 * src)
    means = s.groupBy("signal_id", block.alias("block")).agg(
        F.avg("sample").alias("mean"), F.max("n").alias("_last")
    )
    blocks = _div(2 * F.col("_last") * dst + src, 2 * src)
    return means.filter(F.col("block") < blocks).drop("_last")


def quantise(sample: Column, mode: str = "floor") -> Column:
    """Sample in [-1, 1] to a 16-bit integer; values outside are clamped.

    ``floor`` scales by 32768, rounds down and clips at 32767. ``split`` scales negative samples by 32768
    and others by 32767 and drops the fraction. NULL stays NULL, and what is not a number becomes silence.
    """
    sample = F.when(F.isnan(sample.cast("double")), F.lit(0.0)).otherwise(sample.cast("double"))
    x = F.when(sample.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sample)))
    if mode == "floor":
        return F.when(x.isNotNull(), F.least(F.floor(x * 32768), F.lit(32767))).cast("smallint")
    if mode == "split":
        return F.when(x < 0, x * 32768).otherwise(x * 32767).cast("smallint")
    raise ValueError(f"unknown mode {mode!r}")


def dequantise(value: Column) -> Column:
    return value.cast("double") / F.lit(32768.0)


def frames(s: DataFrame, size: int = FRAME, number: str = "n", value: str = "sample") -> DataFrame:
    """Full frames of ``size`` consecutive samples in the order of their numbers; an incomplete tail is held back.

    Samples are framed as they arrive: a lost number leaves no hole, and of a doubled number one sample counts
    (the least). Samples are gathered by ``number div size`` first, so a group has at most ``size`` of them however
    long the signal. A running count over these groups, not over samples, tells where each begins: in a signal
    without holes they are its frames, and only groups behind a hole are dealt anew.
    """
    at = F.col(number).cast("long")
    group = F.coalesce(floor_div(at - 1, size), F.lit(NO_POSITION))
    rows = s.select(F.struct("signal_id").alias("_s"), group.alias("_g"), at.alias("_i"), F.col(value).alias("_v"))
    once = rows.repartition("_s", "_g").groupBy("_s", "_g", "_i").agg(F.min("_v").alias("_v"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), F.col("_v").alias("v"))))
    parts = once.groupBy("_s", "_g").agg(ordered["v"].alias("samples"))
    earlier = Window.partitionBy("_s").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long"))
    begins = parts.select("_s", "_g", F.size("samples").cast("long").alias("_n")).withColumn("_p", begin)
    placed = parts.join(begins, ["_s", "_g"])
    whole = (F.col("_p") % size == 0) & (F.col("_n") == size)
    done = placed.filter(whole).select("_s", _div(F.col("_p"), size).alias("frame"), "samples")
    loose = placed.filter(~whole).select("_s", "_p", F.posexplode("samples").alias("_o", "v"))
    loose = loose.select("_s", (F.col("_p") + F.col("_o")).alias("i"), "v")
    again = (
        loose.groupBy("_s", _div(F.col("i"), size).alias("frame"))
        .agg(F.array_sort(F.collect_list(F.struct("i", "v")))["v"].alias("samples"))
        .filter(F.size("samples") == size)
    )
    return done.unionByName(again).select("_s.signal_id", "frame", "samples")


@F.arrow_udf(T.BinaryType())
def _pcm_bytes(samples: pa.Array) -> pa.Array:
    """The values' own buffer, cut at the lists' offsets: little-endian 16-bit integers, without a loop."""
    lists = pa.concat_arrays([samples]) if samples.offset else samples
    offsets = lists.offsets.to_numpy().astype("<i4")
    values = np.ascontiguousarray(lists.values.fill_null(0).to_numpy(zero_copy_only=False), dtype="<i2")
    mask = None if not lists.null_count else pa.array(lists.is_valid()).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(lists), [mask, pa.py_buffer(2 * offsets), pa.py_buffer(values)])


def encode_pcm(samples: Column | str) -> Column:
    """Base64 of the samples as little-endian 16-bit integers."""
    samples = F.col(samples) if isinstance(samples, str) else samples
    return F.base64(_pcm_bytes(samples.cast("array<smallint>")))


@F.arrow_udf(T.ArrayType(T.ShortType()))
def _pcm_samples(data: pa.Array) -> pa.Array:
    """The reverse: the bytes' buffer as the values of lists."""
    held = data.fill_null(b"")
    offsets = np.frombuffer(held.buffers()[1], "<i4")[held.offset : held.offset + len(held) + 1]
    values = np.frombuffer(held.buffers()[2] or b"", "<i2", (offsets[-1] - offsets[0]) // 2, int(offsets[0]))
    mask = None if not data.null_count else pa.array(data.is_null())
    return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]) // 2, pa.int32()), pa.array(values, pa.int16()), mask=mask)


def decode_pcm(text: Column) -> Column:
    """Samples of a base64 frame; NULL for text that is not base64 or has an odd number of bytes."""
    data = F.try_to_binary(text, F.lit("base64"))
    return _pcm_samples(F.when(F.octet_length(data) % 2 == 0, data))
