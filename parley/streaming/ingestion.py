"""The ingestion stream: validate, set status, convert, chunk, embed, store."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.operators.access import with_permission
from parley.operators.ordered import top_per_key
from parley.operators.text import split_markdown
from parley.operators.validate import split_valid
from parley.operators.vectors import hash_embed
from parley.session import shared_dir
from parley.sources.sinks import commit_batch, is_committed, keyed_chunks, latest_chunks, read_committed, write_batch

# Order of the status events that one batch writes for one document.
_ASKED, _FIRST, _LAST = 0, 1, 2


def _status(docs: DataFrame, status: Column, step: int, batch_id: int) -> DataFrame:
    return docs.select(
        "doc_id",
        status.alias("status"),
        F.current_timestamp().alias("ts"),
        F.lit(batch_id * 3 + step).cast("long").alias("seq"),
    )


def hashed(dims: int = 64) -> Callable[[DataFrame], DataFrame]:
    """An embedder without a model: hashed word counts."""

    return lambda chunks: hash_embed(chunks, "chunk_text", dims)


def process_batch(
    events: DataFrame,
    batch_id: int,
    load_text: Callable[[DataFrame], DataFrame],
    embedder: Callable[[DataFrame], DataFrame],
    out: str,
    stream: str = "batch",
) -> None:
    """One micro-batch of parsed events.

    ``load_text`` maps good events to ``(doc_id, text)`` with NULL text where the file cannot be read. ``embedder`` adds
    ``embedding`` to chunks, NULL where it could not make one; ``vectors.embed`` does so for models that raise. A document
    without a text, or with a chunk without a vector, becomes FAILED with none of its chunks and does not stop the rest,
    at the price of itself: nothing is run once per document. What no row answers for, such as a lost store, fails
    the batch, and the stream runs it again.

    PENDING and PROCESSING are visible at once. Chunks, final status and rejected events become visible together by one
    commit; a batch that runs again after it changes nothing.
    """
    spark = events.sparkSession
    if is_committed(spark, out, batch_id, stream):
        return
    good, bad = split_valid(events)
    # A document delivered twice in one batch is processed once.
    good = top_per_key(good, ["doc_id"], [F.col("file_path"), F.col("value")], 1, "_k").drop("_k")
    loaded = load_text(good).select("doc_id", "text")
    docs = good.select("doc_id").join(loaded, "doc_id", "left").persist()
    chunks = embedder(split_markdown(docs.filter(F.col("text").isNotNull()))).persist()
    try:
        begun = _status(docs, F.lit("PENDING"), _ASKED, batch_id)
        begun = begun.unionByName(_status(docs, F.lit("PROCESSING"), _FIRST, batch_id))
        write_batch(begun, f"{out}/status_started", batch_id, stream)
        failed = chunks.filter(F.col("embedding").isNull()).select("doc_id").distinct()
        marked = docs.join(failed.withColumn("_failed", F.lit(True)), "doc_id", "left")
        done = F.col("text").isNotNull() & F.col("_failed").isNull()
        end = F.when(done, "COMPLETE").otherwise("FAILED")
        outputs = {
            "quarantine": bad,
            "chunks": keyed_chunks(chunks.join(failed, "doc_id", "left_anti")),
            "status_ended": _status(marked, end, _LAST, batch_id),
        }
        commit_batch(outputs, out, batch_id, stream)
    finally:
        chunks.unpersist()
        docs.unpersist()


def start_ingestion(
    events: DataFrame,
    load_text: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str | None = None,
    embedder: Callable[[DataFrame], DataFrame] | None = None,
    trigger: dict | None = None,
    event_id: str | None = None,
    ts: str | None = None,
) -> StreamingQuery:
    """Start the stream over parsed events.

    Offsets are kept in ``checkpoint``, a folder all nodes share; by default one below the cluster's
    checkpoint folder that belongs to ``out``. With ``event_id`` and ``ts``, events delivered again are dropped first.
    Each run of offsets writes under its own name, so streams with one ``out`` add up.
    """
    checkpoint = checkpoint or f"{shared_dir(events.sparkSession)}/ingestion-{md5(out.encode()).hexdigest()}"
    run_embed = embedder or hashed()
    if event_id and ts:
        events = dedupe_stream(events, event_id, ts)

    def each(batch: DataFrame, batch_id: int) -> None:
        # The query's id lives in its checkpoint: it survives restarts and ends with the offsets.
        own = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        process_batch(batch, batch_id, load_text, run_embed, out, own or md5(checkpoint.encode()).hexdigest())

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def status_log(spark, out: str) -> DataFrame:
    """All status events written by the stream, as the input of the life-cycle operators."""
    started = spark.read.parquet(f"{out}/status_started")
    ended = read_committed(spark, out, "status_ended")
    return started.select("doc_id", "status", "ts", "seq").unionByName(ended.select("doc_id", "status", "ts", "seq"))


def stored_chunks(spark, out: str) -> DataFrame:
    """Chunks of committed batches, one row per key; a document delivered again replaces its earlier chunks."""
    return latest_chunks(read_committed(spark, out, "chunks"))


def quarantine(spark, out: str) -> DataFrame:
    """Rejected events of committed batches with their reasons."""
    return read_committed(spark, out, "quarantine")


def dedupe_stream(events: DataFrame, event_id: str, ts: str, delay: str = "10 minutes") -> DataFrame:
    """Drop re-deliveries that arrive within ``delay`` of the first one."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([event_id])


def enrich_stream(calls: DataFrame, perms: DataFrame, permission: str) -> DataFrame:
    """A stream of calls joined to a static permission table."""
    return with_permission(calls, perms, permission)


def interaction_counts_stream(
    logs: DataFrame, upsert_into: Callable[[DataFrame, int], None], checkpoint: str, keys: Sequence[str] = ("user_id",)
) -> StreamingQuery:
    """Running interaction counts; changed rows of each batch are handed to ``upsert_into``."""
    counts = logs.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_interactions"))
    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(upsert_into)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
