"""Ingestion events: parsing, validation with reasons, defaults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.values import canonical_uuid, encode_json
from parley.operators.ordered import top_per_key
from parley.schemas import INGESTION_EVENT

_CORRUPT = "_corrupt"


def parse_events(df: DataFrame, value: str = "value", schema: T.StructType = INGESTION_EVENT) -> DataFrame:
    """Event fields from JSON text; ``_corrupt`` holds the text of what is not a JSON object."""
    full = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    kept = [c for c in df.columns if c != value]
    text = F.col(value).cast("string")
    parsed = df.select(*kept, text.alias(value), F.from_json(text, full, options).alias("_e"))
    # Blank text parses to no object at all, without a complaint.
    corrupt = F.when(F.col("_e").isNull(), F.col(value)).otherwise(F.col(f"_e.{_CORRUPT}"))
    fields = [F.col(f"_e.{name}") for name in schema.names]
    return parsed.select(*kept, value, *fields, corrupt.alias(_CORRUPT))


def encode_events(df: DataFrame, cols: Sequence[str] = ("doc_id", "user_id", "file_path", "file_name")):
    """One JSON object per row, as written to the event stream."""
    return df.withColumn("value", encode_json(*cols))


def event_reason(required: Sequence[str] = ("doc_id", "user_id", "file_path")) -> Column:
    """Why a parsed event cannot be processed; NULL for a good one."""
    missing = F.lit(False)
    for c in required:
        missing = missing | (F.coalesce(F.col(c), F.lit("")) == "")
    return (
        F.when(F.col(_CORRUPT).isNotNull() | F.col("value").isNull(), "BAD_JSON")
        .when(missing, "MISSING_FIELD")
        .when(canonical_uuid(F.col("doc_id")).isNull(), "BAD_UUID")
    )


def classify_events(df: DataFrame, required: Sequence[str] = ("doc_id", "user_id", "file_path")) -> DataFrame:
    """Parsed events with a ``reason`` column; ``doc_id`` of good events is in canonical form."""
    marked = df.withColumn("reason", event_reason(required)).drop(_CORRUPT)
    good_id = F.when(F.col("reason").isNull(), canonical_uuid(F.col("doc_id"))).otherwise(F.col("doc_id"))
    return marked.withColumn("doc_id", good_id)


def split_valid(df: DataFrame, required: Sequence[str] = ("doc_id", "user_id", "file_path")):
    """(good, bad); bad rows carry their reason and go to quarantine."""
    marked = classify_events(df, required)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def apply_defaults(df: DataFrame, spec: Mapping[str, object], replace_null: bool = False) -> DataFrame:
    """Add omitted columns with their default.

    An explicit NULL stays, as in SQL; ``replace_null`` fills those as well.
    """
    out = df
    for name, value in spec.items():
        default = value if isinstance(value, Column) else F.lit(value)
        if name not in df.columns:
            out = out.withColumn(name, default)
        elif replace_null:
            out = out.withColumn(name, F.coalesce(F.col(name), default))
    return out


def in_domain(c: Column, values: Sequence[str]) -> Column:
    return F.coalesce(c.isin(list(values)), F.lit(False))


def dedupe_events(df: DataFrame, event_id: str, order: Sequence[str]) -> DataFrame:
    """The first delivery of each event."""
    return top_per_key(df, [event_id], [F.col(c) for c in order], 1, "_k").drop("_k")
