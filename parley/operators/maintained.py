"""The per-user analytics table kept up to date by batches of additions and retractions.

The state is a table of signed counts per (user, topic, time), which add up in any order: each batch appends its own, and
``merge`` adds up what has gathered. It is partitioned by a hash of the user, so a batch reads the partitions of the users
it changes and recomputes their rows only. Times are kept with their counts, so that retracting a user's last interaction
finds the one before. A batch writes below its own number: applied again, it replaces what it wrote, with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.analytics import analytics_of
from parley.operators.ordered import null_safe_join

BUCKETS = 64
STATE = ["user_id", "topic", "created_at", "n"]


def changes(added: DataFrame | None = None, retracted: DataFrame | None = None) -> DataFrame:
    """(user_id, topic, created_at, n) from rows that come and rows that are taken back."""
    signed = [
        rows.select("user_id", "topic", "created_at", F.lit(n).cast("long").alias("n"))
        for rows, n in ((added, 1), (retracted, -1))
        if rows is not None
    ]
    if not signed:
        raise ValueError("neither added nor retracted rows")
    return signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])


def _summed(rows: DataFrame, *more: str) -> DataFrame:
    """One row per (user, topic, time). What is taken back before it comes stays as a negative count."""
    return rows.groupBy(*more, *STATE[:3]).agg(F.sum("n").alias("n")).filter("n <> 0")


def _dealt(rows: DataFrame) -> DataFrame:
    """Each bucket over eight tasks, so that it is few files and a user with most of the rows is not one task's."""
    return rows.repartition("bucket", F.pmod(F.xxhash64(*STATE[:3]), F.lit(8)))


def _merged_upto(spark: SparkSession, path: str) -> int | None:
    try:
        return spark.read.schema("upto long").parquet(f"{path}/merges").agg(F.max("upto")).first()[0]
    except AnalysisException:
        return None


def _state(spark: SparkSession, path: str, schema, upto: int) -> DataFrame:
    """The signed counts of all batches up to one, from the merged table where that reaches no further."""
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema if f.name in STATE)
    merged = _merged_upto(spark, path)
    held = spark.read.schema(f"{types}, bucket int, batch long").parquet(f"{path}/changes").filter(F.col("batch") <= upto)
    if merged is None or merged > upto:
        return held.drop("batch")
    base = spark.read.schema(f"{types}, bucket int").parquet(f"{path}/merged/upto={merged}")
    return base.unionByName(held.filter(F.col("batch") > merged).drop("batch"))


def apply_batch(batch: DataFrame, number: int, path: str, k: int = 2, buckets: int = BUCKETS) -> None:
    """Apply changes (user_id, topic, created_at, n) as batch ``number``; numbers rise.

    ``buckets`` must stay the same for all batches of a table. A NULL user is a user, a NULL topic counts for the total
    only. Changes that cancel each other change nothing; a batch without changes writes empty tables.
    """
    spark = batch.sparkSession
    own = f"{path}/changes/batch={number}"
    signed = _summed(batch).withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int"))
    _dealt(signed).write.mode("overwrite").partitionBy("bucket").parquet(own)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in signed.schema)
    written = spark.read.schema(types).parquet(own)
    touched = written.select("user_id", "bucket").distinct()
    # At most ``buckets`` numbers: the scan is told which partitions it needs.
    wanted = [r["bucket"] for r in touched.select("bucket").distinct().collect()]
    state = _state(spark, path, signed.schema, number).filter(F.col("bucket").isin(wanted))
    users = touched.select("user_id")
    left = _summed(null_safe_join(state.drop("bucket"), users, ["user_id"], "left_semi")).filter("n > 0")
    counts = left.groupBy("user_id", "topic").agg(F.sum("n").alias("n"), F.max("created_at").alias("last_at"))
    rows = null_safe_join(users, analytics_of(counts, k), ["user_id"], "left")
    rows.write.mode("overwrite").parquet(f"{path}/table/batch={number}")


def merge(spark: SparkSession, path: str, upto: int) -> None:
    """Add up the changes of all batches up to ``upto``; readers use the sum once it is complete."""
    schema = spark.read.parquet(f"{path}/changes").schema
    whole = _summed(_state(spark, path, schema, upto), "bucket")
    target = f"{path}/merged/upto={upto}"
    _dealt(whole).write.mode("overwrite").partitionBy("bucket").parquet(target)
    spark.createDataFrame([(upto,)], "upto long").coalesce(1).write.mode("append").parquet(f"{path}/merges")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table as ``user_analytics`` has it: each user's row of the last batch that changed it; users without rows left out."""
    table = spark.read.parquet(f"{path}/table")
    names = [c for c in table.columns if c not in ("user_id", "batch")]
    last = table.groupBy("user_id").agg(F.max_by(F.struct(*names), "batch").alias("_r"))
    return last.filter("_r.total_interactions IS NOT NULL").select("user_id", "_r.*")


def on_batch(path: str, k: int = 2, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` of a stream of changes calls."""

    def each(batch: DataFrame, number: int) -> None:
        apply_batch(batch, number, path, k, buckets)

    return each
