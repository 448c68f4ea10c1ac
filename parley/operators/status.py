"""Document life cycle from an append-only log of status events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.constants import STATUS_EDGES, STATUSES
from parley.functions.values import lower_status
from parley.operators.ordered import (
    HOT_ROWS,
    block_window,
    micros,
    split_hot,
    with_borders,
    without_borders,
)


def latest_status(log: DataFrame) -> DataFrame:
    """Current status of each document; combines map-side."""
    at = F.struct("ts", "seq")
    return log.groupBy("doc_id").agg(F.max_by("status", at).alias("status"), F.max("ts").alias("since"))


def with_current_status(docs: DataFrame, log: DataFrame, key: str = "id") -> DataFrame:
    """Documents with their current status; PENDING before the first event."""
    now = latest_status(log).select(F.col("doc_id").alias("_doc"), F.col("status").alias("_status"))
    return docs.join(now, F.col(key) == F.col("_doc"), "left").select(
        *docs.columns, F.coalesce("_status", F.lit("PENDING")).alias("status")
    )


def status_transitions(log: DataFrame, min_rows: int = HOT_ROWS) -> DataFrame:
    """Events whose status is unknown or may not follow the one before it."""
    keys, order = ["doc_id"], ["ts", "seq"]
    rows = log.select("seq", "doc_id", "status", "ts", micros(log, "ts").alias("_us"))
    rows = with_borders(split_hot(rows, keys, F.col("_us"), min_rows), keys, order, before=1)
    rows = rows.withColumn("previous", F.lag("status").over(block_window(keys, order)))
    edge = F.concat_ws(">", F.coalesce("previous", F.lit("")), "status")
    allowed = edge.isin([f"{a or ''}>{b}" for a, b in STATUS_EDGES])
    rows = without_borders(rows)
    known = F.coalesce(F.col("status").isin(list(STATUSES)), F.lit(False))
    return rows.filter(~(allowed & known)).select("seq", "doc_id", "previous", "status", "ts")


def stuck_documents(log: DataFrame, as_of: Column, limit_s: int) -> DataFrame:
    """Documents that entered PENDING or PROCESSING more than ``limit_s`` before ``as_of``."""
    late = F.col("since") + F.make_dt_interval(secs=F.lit(limit_s)) < as_of
    return latest_status(log).filter(F.col("status").isin("PENDING", "PROCESSING") & late)


def list_documents(docs: DataFrame, owner=None) -> DataFrame:
    """Document list, newest first; ties by id."""
    if owner is not None:
        docs = docs.filter(F.col("user_id") == F.lit(owner))
    return docs.select("id", "file_name", "status", "created_at").orderBy(F.desc("created_at"), "id")


def display_status(docs: DataFrame) -> DataFrame:
    return docs.withColumn("status", lower_status(F.col("status")))


def status_events(batch: DataFrame, status: str, doc: str = "doc_id", at: Column | None = None) -> DataFrame:
    """Log rows that set ``status`` for each document of a batch."""
    when = F.current_timestamp() if at is None else at
    return batch.select(F.col(doc).alias("doc_id"), F.lit(status).alias("status"), when.alias("ts"))
