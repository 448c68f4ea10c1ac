"""Expiring windows and request limits per key.

The two sequential rules (windows anchored at a miss, token bucket) fold over a key's rows in time order.
The fold streams over whole partitions. A hot key is cut into blocks that are folded in parallel, once the
state that enters each block is known. For the token bucket each block yields its *transfer function* (what
level leaves it for each level that may enter), which has few pieces, and one small fold per key chains them.
For the windows the anchors are found by doubling steps between accesses. All arithmetic is on integer
microseconds, so the cut is exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parley.constants import CACHE_TTL_S, TIER_LIMITS
from parley.operators.ordered import (
    HOT_ROWS,
    block_of,
    block_starts,
    cut_blocks,
    floor_div,
    hot_keys,
    micros,
    null_safe_join,
    running_sum,
    split_hot,
)
from parley.session import shared_dir

def _schema(df: DataFrame, key: str, text: str) -> T.StructType:
    """``key`` with its type in ``df``, then the fields of a DDL text."""
    return T.StructType([df.schema[key], *T.StructType.fromDDL(text).fields])


def _from_micros(us: Column, kind: T.DataType) -> Column:
    if kind.typeName() != "timestamp_ntz":
        return F.timestamp_micros(us)
    secs = (us.cast("decimal(18,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=secs)


def _fold_in_order(
    rows: DataFrame, carry: DataFrame | None, keys: Sequence[str], order: Sequence[str], make_fold, added: str
) -> DataFrame:
    """Run a fold over the rows of each (keys, _blk) in order and append its results to the rows.

    The window brings each group together in order; the fold then streams over whole partitions and starts
    anew where a group starts, so no group is ever held in memory and small groups cost no call of their
    own. A ``carry`` row, if a group has one, comes first and sets its state from ``us``.
    """
    all_rows = rows.withColumn("carry", F.lit(False))
    if carry is not None:
        all_rows = all_rows.unionByName(carry.withColumn("carry", F.lit(True)), allowMissingColumns=True)
    in_group = Window.partitionBy(*keys, "_blk").orderBy(F.desc("carry"), *order)
    ordered = all_rows.withColumn("first", F.row_number().over(in_group) == 1)
    extra = T.StructType.fromDDL(added).fields
    out = T.StructType([*ordered.schema.fields, *extra])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = make_fold()
        for batch in batches:
            starts = batch.column("_start").fill_null(0)
            flags = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("first", "carry"))
            results = fold(*flags, batch.column("us").to_numpy().tolist(), starts.to_numpy().tolist())
            columns = [pa.array(c, type=arrow.field(f.name).type) for c, f in zip(results, extra)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema=arrow)

    done = ordered.mapInArrow(run, out)
    return done.filter(~F.col("carry")).drop("carry", "first", "_blk", "_start")


# ---- windows with a fixed life time, anchored at a miss -----------------------------------------


def ttl_walk(us: np.ndarray, ttl: int, expiry: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, accesses) of the windows over sorted times; ``expiry`` is that of a window still open."""
    anchors, counts, i = [], [], 0
    if expiry is not None:
        i = int(np.searchsorted(us, expiry))
        if i:
            anchors.append(expiry - ttl)
            counts.append(i)
    while i < len(us):
        j = int(np.searchsorted(us, us[i] + ttl))
        anchors.append(int(us[i]))
        counts.append(j - i)
        i = j
    return np.array(anchors, dtype="int64"), np.array(counts, dtype="int64")


def _ttl_fold(ttl: int):
    """Fold that gives each access the anchor of its window."""

    def start():
        expiry = 0

        def fold(first, carry, times, _):
            nonlocal expiry
            anchors = []
            for is_first, is_carry, us in zip(first, carry, times):
                if is_carry:
                    expiry = us
                elif is_first or us >= expiry:
                    expiry = us + ttl
                anchors.append(expiry - ttl)
            return (anchors,)

        return fold

    return start


def _blocks(hot: DataFrame, key: str) -> DataFrame:
    """(key, _blk, _start) of every block of the hot keys, also of those without a row."""
    return hot.select(key, F.posexplode(block_starts()).alias("_blk", "_start")).withColumn(
        "_blk", F.col("_blk").cast("long")
    )


def _successors(times: DataFrame, hot: DataFrame, key: str, ttl: int) -> DataFrame:
    """(key, us, cell, next): the first access at or after the end of a window opened at ``us``.

    ``cell`` numbers the life times since the key's first access. A window's end is looked up in its own
    block, where an extra row stands for the first access of the blocks behind.
    """
    t = null_safe_join(times, hot, [key], "inner")
    cell = floor_div(F.col("us") - F.col("_lo"), ttl)
    end = F.col("us") + ttl
    none = F.lit(None).cast("long")
    accesses = t.select(key, block_of(F.col("us")).alias("_blk"), F.col("us").alias("at"), F.col("us").alias("access"))
    ends = t.filter(end <= F.col("_hi")).select(
        key, block_of(end).alias("_blk"), end.alias("at"), none.alias("access"), "us", cell.alias("cell")
    )
    firsts = accesses.groupBy(key, "_blk").agg(F.min("at").alias("first"))
    behind = Window.partitionBy(key).orderBy(F.desc("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    later = null_safe_join(_blocks(hot, key), firsts, [key, "_blk"], "left")
    later = later.withColumn("at", F.last("first", ignorenulls=True).over(behind)).filter(F.col("at").isNotNull())
    rows = accesses.unionByName(later.select(key, "_blk", "at", F.col("at").alias("access")))
    rows = rows.unionByName(ends, allowMissingColumns=True)
    downward = (
        Window.partitionBy(key, "_blk")
        .orderBy(F.desc("at"), F.col("us").isNotNull())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    found = rows.withColumn("next", F.last("access", ignorenulls=True).over(downward))
    rest = t.filter(end > F.col("_hi")).select(key, "us", cell.alias("cell"), none.alias("next"))
    return found.filter(F.col("us").isNotNull()).select(key, "us", "cell", "next").unionByName(rest)


def _hot_anchors(times: DataFrame, hot: DataFrame, key: str, ttl: int, folder: str) -> DataFrame:
    """(key, us) of the window anchors of hot keys, by following ``next`` from the first access.

    The steps are doubled: level i keeps the accesses in every 2^i-th cell and the first access of each
    cell, with the next one on their way that is kept too. A step that passes over a cell ends at the first
    access of a later one, so two steps of one level always reach an access of the level above. Levels
    halve in size; each is one join on (key, time), which no key can skew, and is written to ``folder``
    to cut its lineage. The anchors are then collected from the top level down.
    """
    spark = times.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    hot = stored(hot, "hot")
    cells = hot.agg(F.max(floor_div(F.col("_hi") - F.col("_lo"), ttl))).first()[0]
    table = stored(_successors(times, hot, key, ttl), "successors")
    heads = table.groupBy(key, "cell").agg(F.min("us").alias("us")).select(key, "us", F.lit(True).alias("head"))
    table = null_safe_join(table, heads, [key, "us"], "left")
    levels = [stored(table.withColumn("head", F.coalesce("head", F.lit(False))), "level0")]
    for i in range(1, int(cells).bit_length() + 1):
        table = levels[-1]
        kept = (F.col("cell") % 2**i == 0) | F.col("head")
        onward = table.select(key, F.col("us").alias("next"), kept.alias("_kept"), F.col("next").alias("_on"))
        joined = null_safe_join(table.filter(kept), onward, [key, "next"], "left")
        step = F.when(F.col("_kept"), F.col("next")).otherwise(F.col("_on"))
        levels.append(stored(joined.select(key, "us", "cell", "head", step.alias("next")), f"level{i}"))

    def follow(group, pdf):
        onward = {int(us): n for us, n in zip(pdf["us"], pdf["next"])}
        at, path = int(pdf["us"].min()), []
        while at is not None:
            path.append(at)
            at = onward[at]
            at = None if pd.isna(at) else int(at)
        return pd.DataFrame({key: [group[0]] * len(path), "us": path})

    # On the top level only first accesses of cells are left behind the start: one row per cell.
    top = levels.pop().filter("head").select(key, "us", "next")
    anchors = stored(top.groupBy(key).applyInPandas(follow, _schema(times, key, "us bigint")), "anchors")
    for i, table in reversed(list(enumerate(levels))):
        passed = null_safe_join(table.select(key, "us", "next"), anchors, [key, "us"], "left_semi")
        passed = passed.filter(F.col("next").isNotNull()).select(key, F.col("next").alias("us"))
        anchors = stored(anchors.unionByName(passed).distinct(), f"anchors{i}")
    return anchors


def _open_windows(anchors: DataFrame, hot: DataFrame, key: str, ttl: int) -> DataFrame:
    """(key, _blk, us): when the window that is open at the start of a block expires."""
    marks = anchors.select(key, F.col("us").alias("at"), F.col("us").alias("anchor"))
    blocks = _blocks(hot, key).select(key, "_blk", F.col("_start").alias("at"))
    before = (
        Window.partitionBy(key)
        .orderBy("at", F.col("anchor").isNotNull())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    open_at = blocks.unionByName(marks, allowMissingColumns=True).withColumn(
        "us", F.last("anchor", ignorenulls=True).over(before) + ttl
    )
    return open_at.filter(F.col("_blk").isNotNull() & F.col("us").isNotNull()).select(key, "_blk", "us")


def ttl_windows(
    log: DataFrame, key: str, ts: str, ttl_s: int = CACHE_TTL_S, min_rows: int = HOT_ROWS
) -> DataFrame:
    """Windows of ``ttl_s`` seconds anchored at the first access after expiry, with hits and misses.

    An access without a time belongs to no window and is left out. Whether there are hot keys is asked when the
    operator is called, since their anchors take several jobs and a folder that all executors share.
    """
    ttl = ttl_s * 1_000_000
    rows = log.select(F.col(key), micros(log, ts).alias("us")).filter(F.col("us").isNotNull())
    hot = hot_keys(rows, [key], F.col("us"), min_rows)
    if hot.isEmpty():
        none = F.lit(None).cast("long")
        cut = rows.withColumns({"_blk": none, "_start": none})
        carry = None
    else:
        folder = f"{shared_dir(log.sparkSession)}/windows-{uuid.uuid4()}"
        times = null_safe_join(rows, hot.select(key), [key], "left_semi").distinct()
        anchors = _hot_anchors(times, hot, key, ttl, folder)
        hot = log.sparkSession.read.parquet(f"{folder}/hot")
        cut = cut_blocks(rows, hot, [key], F.col("us"))
        carry = _open_windows(anchors, hot, key, ttl)
    walked = _fold_in_order(cut, carry, [key], ["us"], _ttl_fold(ttl), "anchor bigint")
    # A window of a hot key may reach over blocks; its accesses share the anchor.
    whole = walked.groupBy(key, "anchor").agg(F.count(F.lit(1)).alias("accesses"))
    return whole.select(
        key,
        _from_micros(F.col("anchor"), log.schema[ts].dataType).alias("window_start"),
        F.lit(1).cast("long").alias("misses"),
        (F.col("accesses") - 1).alias("hits"),
    )


# ---- fixed windows by tier ----------------------------------------------------------------------


def rate_limit(
    requests: DataFrame,
    tiers: DataFrame,
    width_s: int = 60,
    limits: Mapping[str, int] = TIER_LIMITS,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Requests ``(id, user_id, ts)`` marked ``admitted`` while the user's window is within the limit.

    ``tiers`` is ``(user_id, usage_tier)``. A user without a tier, or with an unknown one, is 'standard'.
    """
    t = tiers.select(F.col("user_id").alias("_uid"), F.col("usage_tier").alias("_tier"))
    limit = F.lit(limits["standard"])
    for tier, n in limits.items():
        limit = F.when(F.col("_tier") == tier, F.lit(n)).otherwise(limit)
    rows = requests.select("id", "user_id", "ts", micros(requests, "ts").alias("us"))
    rows = rows.withColumn("win", floor_div(F.col("us"), width_s * 1_000_000))
    keys = ["user_id", "win"]
    rows = split_hot(rows, keys, F.col("us"), min_rows)
    rows = running_sum(rows, keys, ["ts", "id"], F.lit(1), "nth")
    rows = rows.join(t, F.col("user_id") == F.col("_uid"), "left")
    return rows.select("id", "user_id", "ts", "nth", (F.col("nth") <= limit).alias("admitted"))


def requests_per_minute(requests: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Requests per user and minute, on a batch or a stream."""
    return (
        requests.groupBy(F.window(ts, "1 minute").alias("w"), F.col(user))
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(user, F.col("w.start").alias("minute"), "requests")
    )


# ---- token bucket -------------------------------------------------------------------------------
# A token is worth ``refill`` microseconds of credit, credit grows by one per microsecond up to
# ``capacity * refill``, and a request is admitted when it can pay one token.


def bucket_walk(us: np.ndarray, level: int, last: int, cap: int, cost: int) -> tuple[list, list, int, int]:
    """(admitted, credit left, level, time) after requests at sorted times, from ``level`` at ``last``."""
    admitted, left = [], []
    for now in us.tolist():
        level = min(cap, level + now - last)
        last = now
        ok = level >= cost
        if ok:
            level -= cost
        admitted.append(ok)
        left.append(level)
    return admitted, left, level, last


def _bucket_fold(cap: int, cost: int):
    """Fold that decides each request; a segment's carried level is that at the start of the segment."""

    def start():
        level = last = 0

        def fold(first, carry, times, starts):
            nonlocal level, last
            admitted, left = [], []
            for is_first, is_carry, us, start_us in zip(first, carry, times, starts):
                if is_carry:
                    level, last, ok = us, start_us, False
                else:
                    level = cap if is_first else min(cap, level + us - last)
                    last = us
                    ok = level >= cost
                    if ok:
                        level -= cost
                admitted.append(ok)
                left.append(level)
            return admitted, left

        return fold

    return start


def bucket_transfer(us: np.ndarray, start: int, end: int, cap: int, cost: int) -> list[tuple[int, bool, int]]:
    """Level at ``end`` for every level at ``start``, as pieces ``(from, shift, value)``.

    A piece holds from its first level up to the next piece; its result is ``level + value`` when
    ``shift`` is true and ``value`` otherwise. Two levels never get further apart, so there are only
    about as many pieces as the bucket has tokens, whatever the number of requests.
    """
    pieces = advance_transfer([(0, True, 0)], us, start, cap, cost)
    return advance_transfer(pieces, (), int(us[-1]) if len(us) else start, cap, cost, end)


def advance_transfer(
    pieces: list[tuple[int, bool, int]], us: Sequence[int], last: int, cap: int, cost: int, end: int | None = None
) -> list[tuple[int, bool, int]]:
    """The pieces after requests at the times ``us``, the first of which comes after ``last``; then refilled up to ``end``."""

    def refilled(parts, amount):
        out = []
        for i, (lo, shift, value) in enumerate(parts):
            if not shift:
                out.append((lo, False, min(cap, value + amount)))
                continue
            hi = parts[i + 1][0] - 1 if i + 1 < len(parts) else cap
            full = cap - value - amount  # levels from here on fill the bucket
            if full > hi:
                out.append((lo, True, value + amount))
            elif full <= lo:
                out.append((lo, False, cap))
            else:
                out.append((lo, True, value + amount))
                out.append((full, False, cap))
        return out

    def spent(parts):
        out = []
        for i, (lo, shift, value) in enumerate(parts):
            if not shift:
                out.append((lo, False, value - cost if value >= cost else value))
                continue
            hi = parts[i + 1][0] - 1 if i + 1 < len(parts) else cap
            enough = cost - value  # levels from here on can pay
            if enough > hi:
                out.append((lo, True, value))
            elif enough <= lo:
                out.append((lo, True, value - cost))
            else:
                out.append((lo, True, value))
                out.append((enough, True, value - cost))
        return out

    def merged(parts):
        return [p for i, p in enumerate(parts) if i == 0 or p[1:] != parts[i - 1][1:]]

    for now in us:
        now = int(now)
        pieces = merged(spent(refilled(pieces, now - last)))
        last = now
    return pieces if end is None else merged(refilled(pieces, end - last))


def apply_transfer(pieces: list[tuple[int, bool, int]], level: int) -> int:
    lo, shift, value = max((p for p in pieces if p[0] <= level), key=lambda p: p[0])
    return level + value if shift else value


def token_bucket(requests: DataFrame, capacity: int, refill_s: int, min_rows: int = HOT_ROWS) -> DataFrame:
    """Requests ``(id, user_id, ts)`` marked ``admitted`` by a bucket per user that starts full.

    ``refill_s`` is the time in which one token comes back; ``credit_us`` is what is left after the request. A
    request without a time is never admitted, has no credit and does not count for the others.
    """
    cost = refill_s * 1_000_000
    cap = capacity * cost
    key = "user_id"
    given = requests.select("id", key, "ts", micros(requests, "ts").alias("us"))
    rows = split_hot(given.filter(F.col("us").isNotNull()), [key], F.col("us"), min_rows)

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Blocks follow one another, each in order of time and over as many batches as it needs.
        held = None

        def closed():
            name, blk, start, last, pieces = held
            lo, shift, value = zip(*pieces)
            n = len(pieces)
            columns = [[name] * n, [blk] * n, [start] * n, [last] * n, lo, shift, value]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, made)], schema=made)

        for batch in batches:
            names, blks, starts = (batch.column(c).to_pylist() for c in (key, "_blk", "_start"))
            us = batch.column("us").to_pylist()
            cuts = [i for i in range(1, len(us)) if blks[i] != blks[i - 1] or names[i] != names[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(us)]):
                if a == b:
                    continue
                if held is None or held[:2] != (names[a], blks[a]):
                    if held is not None:
                        yield closed()
                    held = (names[a], blks[a], starts[a], starts[a], [(0, True, 0)])
                pieces = advance_transfer(held[4], us[a:b], held[3], cap, cost)
                held = (*held[:3], us[b - 1], pieces)
        if held is not None:
            yield closed()

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The pieces of a block follow one another by ``lo``, the blocks of a key by number.
        name = blk = at = None
        level, pieces, begun = cap, [], False
        for batch in batches:
            found = []
            for r in zip(*[c.to_pylist() for c in batch.columns]):
                if not begun or r[0] != name or r[1] != blk:
                    if begun and r[0] == name:
                        level = min(cap, apply_transfer(pieces, level) + r[2] - at)
                    else:
                        level = cap
                    name, blk, begun, pieces = r[0], r[1], True, []
                    found.append((name, blk, r[2], level))
                at = r[3]
                pieces.append(r[4:])
            columns = zip(*found) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, linked)], schema=linked)

    pieces = _schema(requests, key, "_blk bigint, _start bigint, end bigint, lo bigint, shift boolean, value bigint")
    links = _schema(requests, key, "_blk bigint, _start bigint, us bigint")
    made, linked = to_arrow_schema(pieces), to_arrow_schema(links)
    carry = (
        rows.filter(F.col("_blk").isNotNull())
        .select(key, "_blk", "_start", "us")
        .repartition(key, "_blk")
        .sortWithinPartitions(key, "_blk", "us")
        .mapInArrow(transfers, pieces)
        .repartition(key)
        .sortWithinPartitions(key, "_blk", "lo")
        .mapInArrow(chains, links)
    )
    added = "admitted boolean, credit_us bigint"
    folded = _fold_in_order(rows, carry, [key], ["us", "id"], _bucket_fold(cap, cost), added)
    timeless = given.filter(F.col("us").isNull()).select(
        "id", key, "ts", F.lit(False).alias("admitted"), F.lit(None).cast("long").alias("credit_us")
    )
    return folded.select("id", key, "ts", "admitted", "credit_us").unionByName(timeless)
