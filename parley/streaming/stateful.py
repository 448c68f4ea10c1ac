"""Keyed state on streams: token bucket and expiring windows, with the rules of the batch operators.

State per key is one or two integers and is dropped once the watermark shows that it no longer matters:
the bucket is full again, or the window has expired. Rows of one trigger are ordered by time; a row older
than the state of its key is taken at the state's time, as a server would on arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parley.operators.limits import bucket_walk, ttl_walk
from parley.operators.ordered import micros
from parley.operators.limits import requests_per_minute as _per_minute


def _until(state: GroupState, us: int) -> None:
    """Keep the state until the watermark has passed a point in microseconds."""
    state.setTimeoutTimestamp(max(us // 1000 + 1, state.getCurrentWatermarkMs() + 1))


def token_bucket_stream(requests: DataFrame, capacity: int, refill_s: int, delay: str = "10 minutes") -> DataFrame:
    """Requests ``(id, user_id, ts)`` with ``admitted``, in append mode."""
    cost = refill_s * 1_000_000
    cap = capacity * cost

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["us", "id"])
        us = pdf["us"].to_numpy()
        level, last = state.get if state.exists else (cap, int(us[0]))
        admitted, left, level, last = bucket_walk(np.maximum(us, last), level, last, cap, cost)
        state.update((level, last))
        _until(state, last + cap - level)
        yield pd.DataFrame(
            {"user_id": [key[0]] * len(us), "id": pdf["id"], "ts": pdf["ts"], "admitted": admitted, "credit_us": left}
        )

    out = T.StructType(
        [
            requests.schema["user_id"],
            requests.schema["id"],
            requests.schema["ts"],
            *T.StructType.fromDDL("admitted boolean, credit_us bigint").fields,
        ]
    )
    rows = requests.select("id", "user_id", "ts", micros(requests, "ts").alias("us"))
    return rows.withWatermark("ts", delay).groupBy("user_id").applyInPandasWithState(
        fold, out, "level bigint, last bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def ttl_windows_stream(log: DataFrame, key: str, ts: str, ttl_s: int, delay: str = "10 minutes") -> DataFrame:
    """Accesses per window and trigger: ``(key, anchor_us, accesses)``; sum the accesses of an anchor."""
    ttl = ttl_s * 1_000_000

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        us = np.sort(np.concatenate([b["us"].to_numpy() for b in batches]))
        expiry = state.get[0] if state.exists else None
        anchors, counts = ttl_walk(us, ttl, expiry)
        expiry = int(anchors[-1]) + ttl
        state.update((expiry,))
        _until(state, expiry)
        yield pd.DataFrame({key: [group[0]] * len(anchors), "anchor_us": anchors, "accesses": counts})

    out = T.StructType([log.schema[key], *T.StructType.fromDDL("anchor_us bigint, accesses bigint").fields])
    rows = log.select(F.col(key), F.col(ts).alias("ts"), micros(log, ts).alias("us"))
    return rows.withWatermark("ts", delay).groupBy(key).applyInPandasWithState(
        fold, out, "expiry bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def requests_per_minute_stream(requests: DataFrame, user: str, ts: str, delay: str = "10 minutes") -> DataFrame:
    """Requests per user and minute; a minute is final once ``delay`` has passed."""
    return _per_minute(requests.withWatermark(ts, delay), user, ts)
