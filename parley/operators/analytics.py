"""Engagement tables from chat logs."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.constants import LITERAL_TOPICS
from parley.operators.ordered import (
    HOT_ROWS,
    block_window,
    micros,
    null_safe_join,
    running_sum,
    split_hot,
    top_per_key,
    with_borders,
    without_borders,
)

def interaction_counts(logs: DataFrame, loaded_at: Column | None = None) -> DataFrame:
    """Rows per user, with the fixed topic list and the load time."""
    return logs.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_interactions")).select(
        "user_id",
        "total_interactions",
        F.lit(LITERAL_TOPICS).alias("top_topics"),
        (F.current_timestamp() if loaded_at is None else loaded_at).alias("last_updated_at"),
    )


def engagement(logs: DataFrame, cap_s: int = 300) -> DataFrame:
    """Mean interaction duration and message count per user.

    Logs without a duration column use the time to the user's next message, at most ``cap_s``.
    """
    if "interaction_duration" not in logs.columns:
        logs = interaction_gaps(logs, cap_s).withColumnRenamed("duration_s", "interaction_duration")
    return logs.groupBy("user_id").agg(
        F.avg("interaction_duration").alias("avg_duration"), F.count("id").alias("total_interactions")
    )


def with_topics(logs: DataFrame, words: DataFrame, message: str = "message_text") -> DataFrame:
    """``logs`` with the ``topic`` of each message by a table of ``(word, topic)``; NULL where no word is known.

    The topic with the most of the message's words counts, then the first by name. ``id`` identifies a message.
    """
    spoken = F.explode(F.split(F.lower(F.col(message)), r"[^\p{L}\p{N}]+")).alias("word")
    known = words.select(F.lower("word").alias("word"), F.col("topic").alias("_topic")).distinct()
    counts = logs.select(F.col("id").alias("_id"), spoken).join(known, "word").groupBy("_id", "_topic").count()
    best = counts.groupBy("_id").agg(F.min(F.struct((-F.col("count")).alias("n"), "_topic")).alias("_best"))
    joined = logs.join(best, F.col("id") == F.col("_id"), "left")
    return joined.select(*logs.columns, F.col("_best._topic").alias("topic"))


def topic_counts(logs: DataFrame) -> DataFrame:
    """Rows and last time per (user, topic); combines map-side, so a hot user costs its topics only."""
    return logs.groupBy("user_id", "topic").agg(
        F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last_at")
    )


def _ranked_topics(counts: DataFrame, k: int) -> DataFrame:
    """(user_id, top_topics). A missing topic ranks last and is then left out.

    Leaving it out before, or dropping ``last_at``, would give this branch an aggregate of its own; as it
    is, the counts are shuffled once for the totals and the ranking.
    """
    order = [F.col("topic").isNull(), F.desc("n"), F.asc("topic")]
    best = top_per_key(counts, ["user_id"], order, k).filter(F.col("topic").isNotNull())
    ordered = F.array_sort(F.collect_list(F.struct("rank", "topic", "last_at")))
    return best.groupBy("user_id").agg(F.to_json(ordered["topic"]).alias("top_topics"))


def top_topics(logs: DataFrame, k: int = 2) -> DataFrame:
    """The k most frequent topics per user as a JSON array; ties go to the lower topic."""
    return _ranked_topics(topic_counts(logs), k)


def user_analytics(logs: DataFrame, k: int = 2) -> DataFrame:
    """The whole per-user table: total, top topics and time of the last interaction."""
    return analytics_of(topic_counts(logs), k)


def analytics_of(counts: DataFrame, k: int = 2) -> DataFrame:
    """The per-user table from ``topic_counts``."""
    totals = counts.groupBy("user_id").agg(
        F.sum("n").alias("total_interactions"), F.max("last_at").alias("last_updated_at")
    )
    joined = null_safe_join(totals, _ranked_topics(counts, k), ["user_id"], "left")
    return joined.select(
        "user_id",
        "total_interactions",
        F.coalesce("top_topics", F.lit("[]")).alias("top_topics"),
        "last_updated_at",
    )


def interaction_gaps(logs: DataFrame, cap_s: int, min_rows: int = HOT_ROWS) -> DataFrame:
    """Seconds to the user's next message, at most ``cap_s``; NULL after the last message and without a time."""
    keys, order = ["user_id"], ["created_at", "id"]
    rows = logs.select("id", "user_id", "created_at", micros(logs, "created_at").alias("_us"))
    rows = with_borders(split_hot(rows, keys, F.col("_us"), min_rows), keys, order, after=1)
    following = F.lead("_us").over(block_window(keys, order))
    gap = F.least((following - F.col("_us")) / F.lit(1e6), F.lit(float(cap_s)))
    # least() skips NULL, so the last message and messages without a time must be kept apart.
    rows = rows.withColumn("duration_s", F.when(following.isNotNull() & F.col("_us").isNotNull(), gap))
    return without_borders(rows).select("id", "user_id", "created_at", "duration_s")


def response_latency(
    log: DataFrame,
    key: str,
    ts: str,
    seq: str,
    request: Column,
    response: Column,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Each response that ends a wait, with the time since the earliest unanswered request.

    A response closes the group of requests before it. The group number is the count of responses
    strictly before a row, after which the rest is a plain aggregate.
    """
    rows = log.select(
        F.col(key).alias("key"),
        F.col(ts).alias("ts"),
        F.col(seq).alias("seq"),
        micros(log, ts).alias("us"),
        F.coalesce(request, F.lit(False)).alias("req"),
        F.coalesce(response, F.lit(False)).alias("resp"),
    ).filter(F.col("req") | F.col("resp"))
    rows = split_hot(rows, ["key"], F.col("us"), min_rows)
    rows = running_sum(rows, ["key"], ["ts", "seq"], F.col("resp").cast("long"), "closed")
    group = F.col("closed") - F.col("resp").cast("long")
    waits = rows.groupBy("key", group.alias("grp")).agg(
        F.min(F.when(F.col("req"), F.col("us"))).alias("asked"),
        F.max(F.when(F.col("resp"), F.col("us"))).alias("answered"),
        F.max(F.when(F.col("resp"), F.col("seq"))).alias("response_seq"),
        F.max(F.when(F.col("resp"), F.col("ts"))).alias("response_ts"),
    )
    return waits.filter(F.col("asked").isNotNull() & F.col("answered").isNotNull()).select(
        F.col("key").alias(key),
        "response_seq",
        "response_ts",
        ((F.col("answered") - F.col("asked")) / F.lit(1e6)).alias("latency_s"),
    )


def key_bounds(df: DataFrame, column: str) -> DataFrame:
    """Lowest and highest key, as needed for a partitioned read."""
    return df.agg(F.min(column).alias("lower_bound"), F.max(column).alias("upper_bound"))


def stride_bounds(lower: int, upper: int, n: int) -> list[int]:
    """The n - 1 inner bounds that a partitioned JDBC read derives from its options."""
    n = max(1, min(n, upper - lower)) if upper > lower else 1
    exact = Fraction(upper - lower, n)
    stride = exact.numerator // exact.denominator
    shift = (exact - stride) * n / 2 + Fraction(1, 2)
    start = lower + shift.numerator // shift.denominator
    return [start + i * stride for i in range(1, n)]


def stride_report(df: DataFrame, column: str, lower: int, upper: int, n: int) -> DataFrame:
    """Rows each read partition would hold; the first also takes NULL and all keys below."""
    bounds = stride_bounds(lower, upper, n)
    number = F.lit(0)
    for bound in bounds:
        number = number + F.coalesce((F.col(column) >= bound).cast("int"), F.lit(0))
    return df.groupBy(number.alias("stride")).agg(F.count(F.lit(1)).alias("rows"))


def recent(df: DataFrame, ts: str, seq: str, n: int = 100) -> DataFrame:
    """The last n rows, newest first."""
    return df.orderBy(F.desc(ts), F.desc(seq)).limit(n)


def recent_per_key(df: DataFrame, keys: Sequence[str], ts: str, seq: str, n: int) -> DataFrame:
    """The last n rows of each key; ``rank`` 1 is the newest."""
    return top_per_key(df, keys, [F.desc(ts), F.desc(seq)], n)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Rows of one key; the predicate reaches the scan."""
    return df.filter(F.col(key) == F.lit(value))
