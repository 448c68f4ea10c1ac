"""Rows dealt into blocks between quantiles of an ordered key, so that order is kept without one global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks per shuffle partition, so that blocks of unequal texts even out.
BLOCKS = 4
#: The key of rows without an id: before all others.
NO_ID = -(1 << 63)


def id_key(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id), F.lit(NO_ID))


def block_bounds(keyed: DataFrame, key: str, blocks: int | None = None) -> list[int]:
    """Ascending first keys of all blocks but the first: at most ``blocks`` - 1 numbers, from one aggregation."""
    blocks = blocks or BLOCKS * int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / blocks for i in range(1, blocks)]
    found = keyed.agg(F.percentile_approx(key, cuts, 100 * blocks)).first()[0] if cuts else None
    return sorted(set(found or []))


def block_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most ``key``, by halving steps."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    edges = F.lit(bounds)

    def step(at: Column, n: Column) -> Column:
        return F.when(F.coalesce(F.get(edges, at + n - 1) <= key, F.lit(False)), at + n).otherwise(at)

    return F.aggregate(F.lit(steps), F.lit(0), step)
