"""Writers: table overwrite, event publishing, and re-runnable appends of chunks and status events."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.constants import TOPIC
from parley.functions.values import chunk_key, encode_json
from parley.session import shared_dir

INT_MAX = 2_147_483_647


def prepare_overwrite(
    df: DataFrame, pk: str, int_columns: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(rows to write, rejected rows).

    Rejected are rows with a NULL key and rows whose count does not fit the target's 32-bit column.
    """
    fits = F.lit(True)
    for c in int_columns:
        fits = fits & F.coalesce(F.abs(F.col(c)) <= INT_MAX, F.lit(True))
    good = F.col(pk).isNotNull() & fits
    casts = {c: F.col(c).cast("int") for c in int_columns}
    return df.filter(good).withColumns(casts), df.filter(~good)


def write_overwrite(
    df: DataFrame,
    target: str,
    pk: str,
    rejected: str,
    int_columns: Sequence[str] = (),
    fmt: str = "parquet",
    options: dict[str, str] | None = None,
) -> int:
    """Replace the content of ``target``, keep rejected rows as a Parquet table in ``rejected``; returns their number.

    The job that makes the rows runs once: they are staged in the shared folder, and both tables are written from
    there, so every row is in exactly one of them even if the source changes meanwhile. Over JDBC the table is
    truncated, not dropped, so its constraints and references stay. Rejected rows are counted while they are written.
    """
    spark = df.sparkSession
    staged_at = f"{shared_dir(spark).rstrip('/')}/parley-overwrite-{uuid.uuid4().hex}"
    df.write.parquet(staged_at)
    good, bad = prepare_overwrite(spark.read.schema(df.schema).parquet(staged_at), pk, int_columns)
    lost = Observation()
    bad.observe(lost, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(rejected)
    writer = good.write.mode("overwrite").format(fmt)
    if fmt == "jdbc":
        writer.options(dbtable=target, truncate="true", **(options or {})).save()
    else:
        writer.options(**(options or {})).save(target)
    return int(lost.get["n"])


def to_event_value(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One JSON ``value`` per row."""
    return df.select(encode_json(*(cols or df.columns)).alias("value"))


def kafka_sink_options(servers: str, topic: str = TOPIC) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "topic": topic,
        "kafka.acks": "all",
        "kafka.retries": "3",
    }


def write_events(df: DataFrame, fmt: str, options: dict[str, str]) -> None:
    """Publish rows as JSON events; ``text`` writes one event per line."""
    to_event_value(df).write.mode("append").format(fmt).options(**options).save()


def write_batch(df: DataFrame, target: str, batch_id: int, stream: str = "batch") -> None:
    """Write the rows of one micro-batch into the folder of its stream and number.

    A batch that is run again after a failure replaces its own folder, so rows never double. Other streams, and
    the same one after its offsets were reset, have other names and folders of their own.
    """
    df.write.mode("overwrite").parquet(f"{target}/stream={stream}/batch_id={batch_id}")


def keyed_chunks(chunks: DataFrame) -> DataFrame:
    """``(doc_id, chunk_idx, chunk_text, embedding)`` with a key derived from the first two and the time of writing."""
    keyed = chunks.withColumn("id", chunk_key(F.col("doc_id"), F.col("chunk_idx")))
    return keyed.withColumn("written_at", F.current_timestamp())


def write_chunks(chunks: DataFrame, target: str, batch_id: int, stream: str = "batch") -> None:
    """Store chunks on their own, without a commit, see ``keyed_chunks``."""
    write_batch(keyed_chunks(chunks), target, batch_id, stream)


def read_chunks(spark: SparkSession, target: str) -> DataFrame:
    """Stored chunks, one row per key: a document delivered again replaces its earlier chunks.

    The batch written last of a document counts as a whole, since it may have fewer chunks than before. Only
    documents stored by several batches are looked up, so the chunks themselves are not shuffled as long as
    that list is small enough to be broadcast.
    """
    return latest_chunks(spark.read.parquet(target))


def latest_chunks(rows: DataFrame) -> DataFrame:
    """Of stored chunks those of the batch written last of each document, see ``read_chunks``."""
    write = F.struct("written_at", F.col("batch_id").cast("long").alias("n"), F.col("stream").cast("string").alias("s"))
    seen = rows.groupBy(F.col("doc_id").alias("_doc")).agg(F.min(write).alias("_oldest"), F.max(write).alias("_newest"))
    again = seen.filter(F.col("_oldest") < F.col("_newest")).drop("_oldest")
    joined = rows.join(again, F.col("doc_id") == F.col("_doc"), "left")
    current = F.col("_newest").isNull() | (write == F.col("_newest"))
    return joined.filter(current).drop("_doc", "_newest", "batch_id", "stream", "written_at")


def read_batches(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)


# ---- several outputs under one commit -----------------------------------------------------------

COMMITS = "_commits"


def commits(spark: SparkSession, target: str) -> DataFrame:
    """(stream, batch_id) of the batches that are visible in ``target``, each with the attempt that counts."""
    try:
        found = spark.read.schema("attempt string, stream string, batch_id long").parquet(f"{target}/{COMMITS}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "attempt string, stream string, batch_id long")
    return found.dropDuplicates(["stream", "batch_id"])


def is_committed(spark: SparkSession, target: str, batch_id: int, stream: str) -> bool:
    mine = (F.col("stream") == stream) & (F.col("batch_id") == batch_id)
    return not commits(spark, target).filter(mine).isEmpty()


def commit_batch(outputs: Mapping[str, DataFrame], target: str, batch_id: int, stream: str = "batch") -> bool:
    """Write all outputs of a batch so that readers see all of them or none; tells whether this call committed.

    Each output goes below ``target/<name>`` into a folder of this attempt. Then one row below ``target/_commits`` names
    the attempt: a single file, which appears whole or not at all, makes every output visible. A batch that was
    committed before is left alone, so running it again changes nothing; what an attempt left behind that did not get
    as far as its commit is never read.
    """
    spark = next(iter(outputs.values())).sparkSession
    if is_committed(spark, target, batch_id, stream):
        return False
    attempt = uuid.uuid4().hex
    for name, df in outputs.items():
        df.write.parquet(f"{target}/{name}/stream={stream}/batch_id={batch_id}/attempt={attempt}")
    row = spark.createDataFrame([(attempt,)], "attempt string").coalesce(1)
    row.write.mode("ignore").parquet(f"{target}/{COMMITS}/stream={stream}/batch_id={batch_id}")
    return True


def read_committed(spark: SparkSession, target: str, name: str) -> DataFrame:
    """Rows of one output from committed batches only, with ``stream`` and ``batch_id``."""
    path = f"{target}/{name}"
    # Folder names are texts, also where all of them look like numbers.
    kinds = {"stream": T.StringType(), "batch_id": T.LongType(), "attempt": T.StringType()}
    fields = [T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in spark.read.parquet(path).schema]
    rows = spark.read.schema(T.StructType(fields)).parquet(path)
    return rows.join(commits(spark, target), ["stream", "batch_id", "attempt"], "left_semi").drop("attempt")
