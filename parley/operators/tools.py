"""Tool calls as rows: routing, argument checks, the two query tools, SQL registration."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.constants import (
    DEFAULT_PRIORITY,
    NO_ANALYTICS,
    NO_USER,
    NOTHING_FOUND,
    TOOL_ARGS,
    TOOL_PRIORITY,
    TOP_K,
    UNSUPPORTED,
)
from parley.functions.values import analytics_text, filled, first_non_empty, map_with_default
from parley.operators.access import (
    chunk_owner,
    denial,
    permission_flags,
    user_permissions,
    with_permission,
)
from parley.operators.vectors import hash_embed, hits_with_text, knn_join, report_texts


def tool_priority(calls: DataFrame) -> DataFrame:
    return calls.withColumn("mode", map_with_default(F.col("tool"), TOOL_PRIORITY, DEFAULT_PRIORITY))


def query_argument(args: str = "args"):
    """The search text of a call, under either of its two names."""
    return first_non_empty(
        F.get_json_object(F.col(args), "$.query"), F.get_json_object(F.col(args), "$.search_query")
    )


def validate_args(calls: DataFrame, registry: Mapping[str, Sequence[str]] = TOOL_ARGS) -> DataFrame:
    """Calls with ``missing``: the required arguments that are absent, joined by commas."""
    given = F.coalesce(F.from_json("args", "map<string,string>"), F.create_map().cast("map<string,string>"))
    missing = F.lit("")
    for tool, required in registry.items():
        absent = [F.when(F.try_element_at(given, F.lit(a)).isNull(), F.lit(a)) for a in required]
        if absent:
            missing = F.when(F.col("tool") == tool, F.concat_ws(",", *absent)).otherwise(missing)
    return calls.withColumn("missing", missing)


def dispatch(calls: DataFrame, registry: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Run each call through its tool; a call of an unknown tool gets an error row.

    A tool maps calls ``(call_id, user_id, tool, args)`` to ``(call_id, status, result)``.
    """
    cols = ["call_id", "tool", "mode", "status", "result"]
    known = F.coalesce(F.col("tool").isin(list(registry)), F.lit(False))
    unknown = (
        tool_priority(calls.filter(~known))
        .withColumn("status", F.lit("UNSUPPORTED"))
        .withColumn("result", filled(UNSUPPORTED, F.coalesce("tool", F.lit(""))))
        .select(*cols)
    )
    out = unknown
    for tool, run in registry.items():
        done = run(calls.filter(F.col("tool") == tool)).withColumn("tool", F.lit(tool))
        out = out.unionByName(tool_priority(done).select(*cols))
    return out


def _first_case(cases: Sequence[tuple[Column, str, Column]], status: str, result: Column) -> list[Column]:
    """(status, result) of the first case that holds, else the given ones."""
    state, text = F.lit(status), result
    for condition, name, message in reversed(cases):
        state = F.when(condition, F.lit(name)).otherwise(state)
        text = F.when(condition, message).otherwise(text)
    return [state.alias("status"), text.alias("result")]


def analytics_for(
    calls: DataFrame, perms: DataFrame, analytics: DataFrame, permission: str = "can_query_analytics"
) -> DataFrame:
    """Answer each call with its user's analytics: DENIED, NO_CONTEXT, NOT_FOUND or OK."""

    zoned = analytics.schema["last_updated_at"].dataType.typeName() != "timestamp_ntz"
    table = analytics.select(
        F.col("user_id").alias("_aid"), "total_interactions", "top_topics", "last_updated_at"
    )
    held = permission_flags(perms, permission)
    # The two tables with one row per user are joined first, so that the calls, in which one user may hold
    # a large share, are joined only once and a hot user can be split there.
    known = held.join(table, F.col("_uid") == F.col("_aid"), "full").withColumn(
        "_any", F.coalesce("_uid", "_aid")
    )
    found = calls.join(known, F.col("user_id") == F.col("_any"), "left")
    found = found.withColumn("allowed", F.coalesce("_held", F.lit(False)))
    absent = filled(NO_ANALYTICS, F.col("user_id").cast("string"))
    summary = analytics_text(
        F.col("total_interactions"), F.col("top_topics"), F.col("last_updated_at"), zoned
    )
    cases = [
        (~F.col("allowed"), "DENIED", F.lit(denial(permission))),
        (F.col("user_id").isNull(), "NO_CONTEXT", F.lit(NO_USER)),
        (F.col("_aid").isNull(), "NOT_FOUND", absent),
    ]
    return found.select(*calls.columns, *_first_case(cases, "OK", summary))


def search_for(
    calls: DataFrame,
    perms: DataFrame,
    chunks: DataFrame,
    docs: DataFrame,
    dims: int = 64,
    k: int = TOP_K,
    permission: str = "can_write_knowledge",
    embedder: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Answer each search call with a report on the caller's own chunks.

    Equal searches of one user are run once. ``embedder`` maps ``(query)`` to ``(query, embedding)`` and gets
    each text once; without one, hashed word counts are used.
    """

    query_id = F.sha2(F.concat_ws("\0", "user_id", "query"), 256)
    asked = with_permission(calls, perms, permission).withColumn("query", query_argument())
    asked = asked.withColumn("query_id", query_id)
    wanted = asked.filter(F.col("allowed") & F.col("user_id").isNotNull())
    searches = wanted.select("query_id", F.col("user_id").alias("owner"), "query").distinct()
    if embedder is None:
        asking = hash_embed(searches, "query", dims)
    else:
        asking = searches.join(embedder(searches.select("query").distinct()), "query")
    hits = knn_join(asking, chunk_owner(chunks, docs), dims, k)
    reports = report_texts(hits_with_text(hits, chunks))
    joined = asked.join(reports, "query_id", "left")
    cases = [
        (~F.col("allowed"), "DENIED", F.lit(denial(permission))),
        (F.col("user_id").isNull(), "NO_CONTEXT", F.lit(NO_USER)),
    ]
    found = F.coalesce("report", F.lit(NOTHING_FOUND))
    return joined.select(*calls.columns, *_first_case(cases, "OK", found))


def register(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    """Make the tables and the public lookups available to SQL.

    ``tables`` holds users, roles, documents, chunks and analytics. Lookups by caller are SQL table
    functions, so ``SELECT * FROM analytics_of(7)`` prunes like the query it stands for.
    """
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    user_permissions(tables["users"], tables["roles"]).createOrReplaceTempView("permissions")
    chunk_owner(tables["chunks"], tables["documents"]).createOrReplaceTempView("owned_chunks")
    user = tables["analytics"].schema["user_id"].dataType.simpleString()
    owner = tables["documents"].schema["user_id"].dataType.simpleString()

    def columns(df: DataFrame, names: Sequence[str]) -> str:
        return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)

    a_cols = ["user_id", "total_interactions", "top_topics", "last_updated_at"]
    c_cols = ["id", "doc_id", "chunk_text"]
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION analytics_of(caller {user})"
        f" RETURNS TABLE({columns(tables['analytics'], a_cols)})"
        f" RETURN SELECT {', '.join(a_cols)} FROM analytics WHERE user_id = analytics_of.caller"
    )
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION chunks_of(caller {owner})"
        f" RETURNS TABLE({columns(tables['chunks'], c_cols)})"
        f" RETURN SELECT {', '.join(c_cols)} FROM owned_chunks WHERE owner = chunks_of.caller"
    )
