"""Intermediate tables in the folder that all executors share, and small helpers for inputs.

A written table cuts the lineage: when an executor is lost, later stages read files that every other executor
reads too. ``spark.checkpoint.dir`` names the folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.session import shared_dir


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is made there yet."""
    return f"{shared_dir(spark).rstrip('/')}/parley-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder, read back with the schema it was written with."""
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_columns(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under the operator's own names, so that no other column can clash with them.

    Ids are read as whole numbers: an id that is none, such as a text without digits, counts as NULL.
    """
    return df.select(*[_cast(F.col(f"`{source}`"), own) for own, source in columns.items()])


def _cast(c: Column, own: str) -> Column:
    kind = {"doc_id": "long", "text": "string", "lang": "string"}.get(own)
    return (c.try_cast(kind) if kind else c).alias(own)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front until no column of ``df`` has it (letter case does not count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lower_ascii(c: Column) -> Column:
    """``c`` with the letters A-Z in lower case and all other characters as they are.

    A text of one byte per character is plain ASCII, where the far faster ``lower`` does the same.
    """
    mapped = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(mapped)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T.StructType.fromDDL(schema))
