"""Fixed schemas. JSON is never read with an inferred schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from parley.constants import ROLE_ROWS


def _table(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_S, _I, _TS = T.StringType(), T.IntegerType(), T.TimestampType()

ROLES = _table(("id", _I, False), ("role_name", _S, False), ("permissions", _S, False))
USERS = _table(
    ("id", _S, False),
    ("email", _S, False),
    ("password_hash", _S, False),
    ("role_id", _I, True),
    ("created_at", _TS, True),
)
USER_PROFILES = _table(("user_id", _S, False), ("preferences", _S, False), ("usage_tier", _S, False))
USER_ANALYTICS = _table(
    ("user_id", _S, False),
    ("total_interactions", _I, False),
    ("top_topics", _S, False),
    ("last_updated_at", _TS, True),
)
DOCUMENTS = _table(
    ("id", _S, False),
    ("user_id", _S, True),
    ("file_name", _S, False),
    ("status", _S, False),
    ("created_at", _TS, True),
)
VECTOR_KNOWLEDGE = _table(
    ("id", _S, False),
    ("doc_id", _S, True),
    ("chunk_text", _S, False),
    ("embedding", T.ArrayType(T.FloatType()), False),
)
CHAT_LOGS = _table(
    ("id", _I, False), ("user_id", _S, True), ("message_text", _S, False), ("created_at", _TS, True)
)

INGESTION_EVENT = T.StructType(
    [T.StructField(name, _S) for name in ("doc_id", "user_id", "file_path", "file_name")]
)
# The longer event form, with an id for de-duplication and parser settings.
INGESTION_EVENT_FULL = T.StructType(
    [
        T.StructField("event_id", _S),
        T.StructField("timestamp", _S),
        *INGESTION_EVENT.fields,
        T.StructField(
            "parser_config",
            T.StructType(
                [
                    T.StructField("chunk_token_num", _I),
                    T.StructField("layout_recognize", T.BooleanType()),
                    T.StructField("chunk_method", _S),
                ]
            ),
        ),
    ]
)


def role_seeds(spark: SparkSession) -> DataFrame:
    """The seeded roles as an inline table, whose size the planner knows."""
    values = ", ".join(f"({n}, '{name}', '{permissions}')" for n, name, permissions in ROLE_ROWS)
    return spark.sql(f"SELECT * FROM VALUES {values} AS roles({', '.join(ROLES.names)})")
