"""Readers: partitioned database tables, event streams, uploaded files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.constants import TOPIC
from parley.operators.validate import parse_events
from parley.schemas import INGESTION_EVENT


def jdbc_options(
    url: str,
    table: str,
    column: str,
    bounds: tuple[int, int],
    num_partitions: int = 4,
    fetchsize: int = 5000,
    **extra: str,
) -> dict[str, str]:
    """Options of a partitioned JDBC read. Bounds only set the stride; rows outside are still read."""
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": column,
        "lowerBound": str(bounds[0]),
        "upperBound": str(bounds[1]),
        "numPartitions": str(num_partitions),
        "fetchsize": str(fetchsize),
        **extra,
    }


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    column: str,
    bounds: tuple[int, int] | None = None,
    num_partitions: int = 4,
    fetchsize: int = 5000,
    **extra: str,
) -> DataFrame:
    """A table read over ``num_partitions`` connections; without bounds they are asked from the database."""
    if bounds is None:
        query = f"SELECT min({column}) AS lo, max({column}) AS hi FROM {table}"
        row = spark.read.format("jdbc").options(url=url, query=query, **extra).load().first()
        bounds = (int(row["lo"] or 0), int(row["hi"] or 0) + 1)
    options = jdbc_options(url, table, column, bounds, num_partitions, fetchsize, **extra)
    return spark.read.format("jdbc").options(**options).load()


def postgres_url(host: str, port: int | str, database: str) -> str:
    """The URL lets the server cast text to UUID and JSON columns on write."""
    return f"jdbc:postgresql://{host}:{port}/{database}?stringtype=unspecified"


def kafka_source_options(servers: str, topic: str = TOPIC) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest"}


def read_event_text(spark: SparkSession, fmt: str, options: dict[str, str]) -> DataFrame:
    """A stream with the raw ``value`` of each event: ``kafka``, or ``text`` for a folder of lines."""
    reader = spark.readStream.format(fmt).options(**{k: v for k, v in options.items() if k != "path"})
    stream = reader.load(options["path"]) if "path" in options else reader.load()
    return stream.select(F.col("value").cast("string").alias("value"))


def read_events(
    spark: SparkSession, fmt: str, options: dict[str, str], schema: T.StructType = INGESTION_EVENT
) -> DataFrame:
    """A stream of parsed events, from the earliest one."""
    return parse_events(read_event_text(spark, fmt, options), "value", schema)


def read_files(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """Uploaded files as (path, modificationTime, length, content); the suffix is case-sensitive."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{suffix}")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
