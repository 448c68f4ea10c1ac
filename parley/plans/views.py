"""Input tables of the registered queries, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.vectors import hash_embed
from parley.schemas import role_seeds

#: Dimensions of the fixtures' vectors and of hashed embeddings.
DIMS = 64


class Inputs:
    """The derived tables of one data folder; each attribute access builds a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def chat_logs(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id AS id",
            "user_id",
            "event_type AS topic",
            "value AS interaction_duration",
            "ts AS created_at",
            "props AS message_text",
        )

    @property
    def roles(self) -> DataFrame:
        return role_seeds(self.spark)

    @property
    def users(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS id",
            "concat(lower(replace(c_name, '#', '.')), '@example.com') AS email",
            "CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'AUTOMOBILE' THEN 2"
            " WHEN 'MACHINERY' THEN 2 ELSE 3 END AS role_id",
        )

    @property
    def profiles(self) -> DataFrame:
        customers = self.table("customer").filter("c_acctbal >= 0")
        return customers.selectExpr(
            "c_custkey AS user_id",
            "CASE WHEN c_acctbal > 5000 THEN 'premium' ELSE 'standard' END AS usage_tier",
        )

    @property
    def docs(self) -> DataFrame:
        d, e = self.table("documents").select("doc_id"), self.table("events").select("event_id", "ts")
        return d.join(e, F.col("event_id") == F.col("doc_id"), "left").selectExpr(
            "doc_id AS id",
            "doc_id % 15 AS user_id",
            "concat('f', doc_id, CASE WHEN doc_id % 7 = 0 THEN '.PDF'"
            " WHEN doc_id % 5 = 0 THEN '.txt' ELSE '.pdf' END) AS file_name",
            "ts AS created_at",
        )

    @property
    def owners(self) -> DataFrame:
        """Documents with their owner, without the columns that need the events table."""
        return self.table("documents").selectExpr("doc_id AS id", "doc_id % 15 AS user_id")

    @property
    def chunks(self) -> DataFrame:
        """Every document as one chunk, embedded by the embedder that the search tool uses for its queries."""
        texts = self.table("documents").selectExpr("doc_id AS id", "doc_id", "text AS chunk_text")
        return hash_embed(texts, "chunk_text", DIMS)

    @property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").selectExpr("vec_id AS id", "vec_id AS doc_id", "embedding")

    @property
    def status_log(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id AS seq",
            "user_id AS doc_id",
            "CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'purchase' THEN 'COMPLETE'"
            " WHEN 'error' THEN 'FAILED' ELSE 'PROCESSING' END AS status",
            "ts",
        )

    @property
    def tool_calls(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id AS call_id",
            "user_id",
            "CASE event_type WHEN 'click' THEN 'rag_knowledge_search'"
            " WHEN 'view' THEN 'query_user_analytics' ELSE concat('tool_', event_type) END AS tool",
            """CASE WHEN event_id % 3 = 0 THEN '{"query": "alpha"}'"""
            """ WHEN event_id % 3 = 1 THEN '{"query": "", "search_query": "beta"}' ELSE '{}' END AS args""",
            "ts",
        )

    @property
    def requests(self) -> DataFrame:
        return self.table("events").selectExpr("event_id AS id", "user_id", "ts")

    @property
    def raw_events(self) -> DataFrame:
        d = "CAST(doc_id AS STRING)"
        return self.table("documents").selectExpr(
            "doc_id AS offset_id",
            f"""CASE WHEN doc_id % 11 = 0 THEN '{{bad'
 WHEN doc_id % 7 = 0 THEN concat('{{"doc_id":"', md5({d}), '","file_path":"/u/a.pdf","file_name":"a.pdf"}}')
 WHEN doc_id % 5 = 0 THEN concat('{{"doc_id":"not-a-uuid","user_id":"', md5('u'),
  '","file_path":"/u/a.pdf","file_name":"a.pdf"}}')
 WHEN doc_id % 13 = 0 THEN concat('{{"doc_id":"', md5({d}), '","user_id":"', md5('u'),
  '","file_path":"","file_name":"a.pdf"}}')
 ELSE concat('{{"doc_id":"', md5({d}), '","user_id":"', md5('u'), '","file_path":"/u/', {d},
  '.pdf","file_name":"a.pdf"}}') END AS value""",
        )

    @property
    def signal(self) -> DataFrame:
        return self.table("embeddings").selectExpr("vec_id AS signal_id", "posexplode(embedding) AS (p, s)").selectExpr(
            "signal_id", "CAST(p + 1 AS BIGINT) AS n", "CAST(s AS DOUBLE) AS sample"
        )

    @property
    def markdown(self) -> DataFrame:
        return self.table("documents").selectExpr(
            "doc_id",
            "array_join(transform(split(text, chr(10)), (l, i) -> CASE WHEN i % 3 = 0"
            " THEN concat(repeat('#', CAST(1 + (i div 3) % 5 AS INT)), ' ', l) ELSE l END), chr(10)) AS text",
        )

    @property
    def tokens(self) -> DataFrame:
        """Unsigned tokens of the users: header.payload.signature."""
        payload = (
            """CASE WHEN role_id = 3 THEN concat('{"user_id":"', md5(CAST(id AS STRING)), '"}')"""
            """ ELSE concat('{"user_id":"', md5(CAST(id AS STRING)), '","role_id":', role_id, '}') END"""
        )
        return self.users.selectExpr(
            "id",
            "concat('h.', translate(replace(base64(encode("
            + payload
            + ", 'UTF-8')), '=', ''), '+/', '-_'), '.s') AS token",
        )
