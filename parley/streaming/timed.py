"""Rules per key on streams, exact in event time: requests wait in keyed state until the watermark has passed them.

A rule that depends on the order of requests is only exact once no earlier request can come. Requests are therefore kept
in map state, a slot of ``SLOT_US`` microseconds at a time, and a timer is set to the end of the earliest slot. When the
watermark has passed it, the slot's requests go through the rule in order of time, which is what the batch operators do
to the whole table. A key never has more than one slot in memory, however many of its requests one trigger brings. The
state that a rule leaves can be handed over from a batch: a table of keys with the state they ended in.

These operators need a state store with column families: set ``spark.sql.streaming.stateStore.providerClass`` to
``STATE_STORE``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.operators.ordered import micros

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLOT_US = 60_000_000
COLUMNS = ("us", "id", "kind")
#: Kinds of rows for ``Waits``; a row may be both.
REQUEST, RESPONSE = 1, 2


class InOrder(StatefulProcessor):
    """Feeds the rows (us, id, kind) of a key to ``step(state, us, id, kind) -> (state, row)`` in order of (us, id).

    ``state`` is a tuple of whole numbers, None at first and where nothing is kept; ``row`` is None where a row has no
    result. ``kind`` is a whole number that only some rules look at. Subclasses give ``step``, the number of state fields
    and how long a state matters.
    """

    fields = 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        numbers = T.StructType([T.StructField(f"s{i}", T.LongType()) for i in range(self.fields)])
        slot = T.StructType([T.StructField("slot", T.LongType())])
        rows = T.StructType([T.StructField(name, T.ArrayType(T.LongType())) for name in COLUMNS])
        self.held = handle.getValueState("held", numbers)
        self.waiting = handle.getMapState("waiting", slot, rows)
        self.timer = handle.getValueState("timer", T.StructType([T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for slot, part in pdf.groupby(pdf["us"] // SLOT_US, sort=False):
                at = (int(slot),)
                held = self.waiting.getValue(at) if self.waiting.containsKey(at) else ((),) * len(COLUMNS)
                self.waiting.updateValue(at, tuple([*old, *part[name].tolist()] for name, old in zip(COLUMNS, held)))
        yield from self.drain(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.timer.exists() and self.timer.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.timer.clear()
        yield from self.drain(key, timerValues)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.held.update(tuple(int(row[f"s{i}"]) for i in range(self.fields)))

    def drain(self, key, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        slots = sorted(k[0] for k in self.waiting.keys())
        for slot in slots:
            if (slot + 1) * SLOT_US > passed:
                break
            waiting = self.waiting.getValue((slot,))
            self.waiting.removeKey((slot,))
            state = tuple(self.held.get()) if self.held.exists() else None
            out = []
            for at, row, kind in sorted(zip(*waiting)):
                state, result = self.step(state, at, row, kind)
                if result is not None:
                    out.append((*key, row, at, *result))
            if state is None:
                self.held.clear()
            else:
                self.held.update(state)
            yield pd.DataFrame(out, columns=self.columns)
        left = [s for s in slots if (s + 1) * SLOT_US > passed]
        if left:
            self.wake((left[0] + 1) * SLOT_US // 1000)
        elif self.held.exists():
            until = self.until(tuple(self.held.get())) // 1000 + 1
            if until * 1000 <= passed:
                self.held.clear()
            else:
                self.wake(until)

    def wake(self, ms: int) -> None:
        """One timer per key, the earliest that is needed."""
        if self.timer.exists():
            old = self.timer.get()[0]
            if old <= ms:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def close(self) -> None:
        pass


class Bucket(InOrder):
    fields = 2

    def __init__(self, cap: int, cost: int, columns: list[str]):
        self.cap, self.cost, self.columns = cap, cost, columns

    def step(self, state, us, *_):
        level, last = state or (self.cap, us)
        level = min(self.cap, level + us - last)
        admitted = level >= self.cost
        level -= self.cost if admitted else 0
        return (level, us), (admitted, level)

    def until(self, state) -> int:
        """When the bucket is full again, as if it had never been used."""
        return state[1] + self.cap - state[0]


class Windows(InOrder):
    fields = 1

    def __init__(self, ttl: int, columns: list[str]):
        self.ttl, self.columns = ttl, columns

    def step(self, state, us, *_):
        anchor = state[0] if state and us < state[0] + self.ttl else us
        return (anchor,), (anchor,)

    def until(self, state) -> int:
        return state[0] + self.ttl


class Waits(InOrder):
    """The state is the time of the earliest request without a response."""

    fields = 1

    def __init__(self, longest: int, columns: list[str]):
        self.longest, self.columns = longest, columns

    def step(self, state, us, _, kind):
        if state and us - state[0] > self.longest:
            state = None
        if kind & REQUEST and state is None:
            state = (us,)
        if not kind & RESPONSE:
            return state, None
        return None, ((us - state[0],) if state else None)

    def until(self, state) -> int:
        return state[0] + self.longest


def _run(rows: DataFrame, key: str, delay: str, processor, added: str, initial: DataFrame | None) -> DataFrame:
    out = T.StructType([rows.schema[key], *T.StructType.fromDDL(f"id bigint, us bigint, {added}").fields])
    grouped = rows.withWatermark("ts", delay).groupBy(key)
    first = None if initial is None else initial.groupBy(key)
    return grouped.transformWithStateInPandas(processor, out, "Append", "EventTime", first)


def token_bucket_timed(
    requests: DataFrame, capacity: int, refill_s: int, delay: str = "10 minutes", initial: DataFrame | None = None
) -> DataFrame:
    """(user_id, id, us, admitted, credit_us) of requests ``(id, user_id, ts)``, as ``limits.token_bucket`` has them.

    A result comes when the watermark has passed its minute. ``initial`` hands over buckets: (user_id, s0, s1) with what is
    left in microseconds and the time it was left at. Rows without a user or a time are left out.
    """
    cost = refill_s * 1_000_000
    rows = requests.select("user_id", "id", "ts", micros(requests, "ts").alias("us"), F.lit(0).alias("kind"))
    rows = rows.filter("user_id IS NOT NULL AND us IS NOT NULL")
    processor = Bucket(capacity * cost, cost, ["user_id", "id", "us", "admitted", "credit_us"])
    return _run(rows, "user_id", delay, processor, "admitted boolean, credit_us bigint", initial)


def ttl_windows_timed(
    log: DataFrame, key: str, ts: str, ttl_s: int, id: str = "id", delay: str = "10 minutes", initial: DataFrame | None = None
) -> DataFrame:
    """(key, id, us, anchor_us): each access with the start of its window, as ``limits.ttl_windows`` counts them.

    ``initial`` hands over open windows: (key, s0) with the time each began. Rows without a key or a time are left out.
    """
    rows = log.select(key, F.col(id).alias("id"), F.col(ts).alias("ts"), micros(log, ts).alias("us"), F.lit(0).alias("kind"))
    rows = rows.filter(F.col(key).isNotNull() & F.col("us").isNotNull())
    processor = Windows(ttl_s * 1_000_000, [key, "id", "us", "anchor_us"])
    return _run(rows, key, delay, processor, "anchor_us bigint", initial)


def response_latency_timed(
    log: DataFrame,
    key: str,
    ts: str,
    seq: str,
    request: Column,
    response: Column,
    longest_s: int = 86_400,
    delay: str = "10 minutes",
    initial: DataFrame | None = None,
) -> DataFrame:
    """(key, id, us, latency_us): each response ``id`` that ends a wait, as ``analytics.response_latency`` has them.

    A wait begins with the first request after a response and ends with the next response, or without a row when
    ``longest_s`` have passed, so that a request nobody answers keeps no state; a later request begins a new wait. A row
    may be request and response; it ends its own wait. ``initial`` hands over open waits: (key, s0) with the time each
    began. Rows without a key or a time, and rows that are neither, are left out.
    """
    kind = F.when(request, REQUEST).otherwise(0) + F.when(response, RESPONSE).otherwise(0)
    rows = log.select(key, F.col(seq).alias("id"), F.col(ts).alias("ts"), micros(log, ts).alias("us"), kind.alias("kind"))
    rows = rows.filter(F.col(key).isNotNull() & F.col("us").isNotNull() & (F.col("kind") > 0))
    processor = Waits(longest_s * 1_000_000, [key, "id", "us", "latency_us"])
    return _run(rows, key, delay, processor, "latency_us bigint", initial)
