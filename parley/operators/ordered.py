"""Ordered operations per key that survive a key holding a large share of all rows.

A plain ``Window.partitionBy(key)`` sorts a key's rows in one task. Here a *hot* key (one with at
least ``min_rows`` rows) is cut into blocks between quantiles of its own positions, so that blocks hold
about equally many rows whatever a burst or a wrong clock does to the range, and the windows run per
``(key, block)``. Rows without a position come first, as they do under the windows' order; rows of one position
share a block. What a block must know about its neighbours is small (a few border rows, or a total) and is
computed from per-block summaries, then placed into the block as extra rows. Keys that are not hot keep
``_blk`` NULL and form a single block, so they pay nothing but the count of rows per key, which reads the key
and ordering columns only and combines map-side.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 4_000_000
BLOCKS_PER_LIMIT = 8
#: Quantiles taken of a hot key's positions: as many blocks as one key can have.
QUANTILES = 1024
NO_POSITION = -(1 << 63)

_DAY, _HOUR, _MINUTE, _SECOND = 86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since the epoch of a timestamp column, for a zoned or an unzoned type."""
    c = F.col(name)
    if df.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(c)
    # An unzoned value must not pass through the session zone, where a clock change would reorder it.
    return (
        F.unix_date(F.to_date(c)).cast("long") * F.lit(_DAY)
        + F.hour(c).cast("long") * F.lit(_HOUR)
        + F.minute(c).cast("long") * F.lit(_MINUTE)
        + (F.date_part(F.lit("SECOND"), c) * _SECOND).cast("long")
    )


def floor_div(c: Column, n: int) -> Column:
    """Integer quotient rounded down, also for negative numbers."""
    return ((c - F.pmod(c, F.lit(n))) / F.lit(n)).cast("long")


def null_safe_join(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str) -> DataFrame:
    """Join on columns of the same name where NULL equals NULL; the right copies are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in cols else F.col(c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in cols])
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in cols])


def _placed(position: Column) -> Column:
    return F.coalesce(position.cast("long"), F.lit(NO_POSITION))


def hot_keys(
    df: DataFrame, keys: Sequence[str], position: Column, min_rows: int = HOT_ROWS
) -> DataFrame:
    """(keys, _lo, _hi, _bounds) of keys with at least ``min_rows`` rows: at most count(df) / min_rows keys.

    ``_bounds`` holds the first positions of all blocks but the first. Blocks hold an eighth of ``min_rows`` rows on
    average, so all bounds together are at most 8 * count(df) / min_rows numbers.
    """
    at = df.select(*keys, _placed(position).alias("_at"))
    counts = at.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_lo"), F.max("_at").alias("_hi")
    )
    hot = counts.filter(F.col("_n") >= min_rows)
    cuts = [i / QUANTILES for i in range(1, QUANTILES)]
    found = (
        null_safe_join(at, hot, keys, "inner")
        .groupBy(*keys, "_n", "_lo", "_hi")
        .agg(F.percentile_approx("_at", cuts, 10 * QUANTILES).alias("_q"))
    )
    blocks = F.least(F.ceil(F.col("_n") * BLOCKS_PER_LIMIT / F.lit(min_rows)), F.lit(QUANTILES)).cast("int")
    picked = F.transform(
        F.sequence(F.lit(1), F.col("_blocks") - 1),
        lambda i: F.element_at("_q", F.floor(i * QUANTILES / F.col("_blocks")).cast("int")),
    )
    none = F.array().cast("array<bigint>")
    bounds = F.when(F.col("_blocks") > 1, F.array_distinct(picked)).otherwise(none)
    return found.withColumn("_blocks", blocks).select(*keys, "_lo", "_hi", bounds.alias("_bounds"))


def block_of(position: Column) -> Column:
    """Number of the block a position falls in, next to the columns of ``hot_keys``: its bounds up to it, by halving."""
    steps = [1 << i for i in reversed(range((QUANTILES - 1).bit_length()))]
    at = _placed(position)

    def step(n: Column, more: Column) -> Column:
        return F.when(F.coalesce(F.get("_bounds", n + more - 1) <= at, F.lit(False)), n + more).otherwise(n)

    return F.when(F.col("_bounds").isNotNull(), F.aggregate(F.lit(steps), F.lit(0), step).cast("long"))


def block_starts() -> Column:
    """First positions of all blocks, next to the columns of ``hot_keys``."""
    return F.concat(F.array("_lo"), "_bounds")


def cut_blocks(df: DataFrame, hot: DataFrame, keys: Sequence[str], position: Column) -> DataFrame:
    """Add ``_blk`` and ``_start``: number and first position of a row's block; NULL unless the key is hot."""
    marked = null_safe_join(df, hot.select(*keys, "_lo", "_bounds"), keys, "left").withColumn("_blk", block_of(position))
    start = F.when(F.col("_blk").isNotNull(), F.get(block_starts(), F.col("_blk").cast("int")))
    return marked.withColumn("_start", start).drop("_lo", "_bounds")


def split_hot(df: DataFrame, keys: Sequence[str], position: Column, min_rows: int = HOT_ROWS) -> DataFrame:
    """Rows with the blocks of their hot keys; the planner sees the size of that list, see ``hot_keys``."""
    return cut_blocks(df, hot_keys(df, keys, position, min_rows), keys, position)


def _border(df: DataFrame, keys: Sequence[str], order: Sequence[Column], back: Sequence[Column], n: int):
    """For each block of a hot key, copies of the ``n`` rows that stand before it under ``order``."""
    tail = (
        df.filter(F.col("_blk").isNotNull())
        .withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_blk").orderBy(*back)))
        .filter(F.col("_k") <= n)
        .drop("_k")
    )
    ahead = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, n)
    return (
        tail.withColumn("_to", F.collect_set("_blk").over(ahead))
        .withColumn("_to", F.explode("_to"))
        .filter(F.col("_to") != F.col("_blk"))
        .withColumn("_blk", F.col("_to"))
        .drop("_to")
    )


def with_borders(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], before: int = 0, after: int = 0
) -> DataFrame:
    """Add border copies (``_border`` true) so that windows per (keys, _blk) see across block edges.

    ``order`` must order the rows of a key completely and agree with ``_blk``.
    """
    up = [F.col(c).asc() for c in order]
    down = [F.col(c).desc() for c in order]
    out = df.withColumn("_border", F.lit(False))
    if before:
        out = out.unionByName(_border(df, keys, up, down, before).withColumn("_border", F.lit(True)))
    if after:
        out = out.unionByName(_border(df, keys, down, up, after).withColumn("_border", F.lit(True)))
    return out


def block_window(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, "_blk").orderBy(*order)


def without_borders(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("_border")).drop("_border", "_blk", "_start")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str
) -> DataFrame:
    """Running sum of ``value`` up to and including each row; ``df`` comes from ``split_hot``.

    Each block of a hot key starts from one extra row that carries the total of the blocks before it.
    """
    rows = df.withColumn("_v", value.cast("long")).withColumn("_border", F.lit(False))
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.filter(F.col("_blk").isNotNull())
        .groupBy(*keys, "_blk")
        .agg(F.sum("_v").alias("_v"))
        .withColumn("_v", F.coalesce(F.sum("_v").over(earlier), F.lit(0).cast("long")))
        .withColumn("_border", F.lit(True))
    )
    upto = (
        Window.partitionBy(*keys, "_blk")
        .orderBy(F.col("_border").desc(), *[F.col(c).asc() for c in order])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.unionByName(carry, allowMissingColumns=True)
        .withColumn(out, F.sum("_v").over(upto))
        .filter(~F.col("_border"))
        .drop("_v", "_border", "_blk", "_start")
    )


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"):
    """The first ``n`` rows of each key. Each task keeps ``n`` rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
