"""One registered query per operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.constants import ROLE_ROWS, SYSTEM_USER
from parley.functions import values as V
from parley.functions import vectors as VF
from parley.operators import (
    access,
    analytics,
    integrity,
    key_graph,
    limits,
    maintained,
    series,
    status,
    text,
    tools,
    validate,
    vector_index,
    vector_prune,
    vectors,
)
from parley.plans.views import DIMS, Inputs
from parley.session import shared_dir, staged
from parley.sources import sinks

QUERY_VECTOR = tuple(((37 * i) % DIMS - 31.5) / 32 for i in range(DIMS))
OWNER = 3
LOADED_AT = "2024-02-01 00:00:00"
AS_OF = "2024-01-31 00:00:00"

# Rows from which a key is cut into blocks in the queries named _cut.
CUT = 64
MESSAGE_WORDS = (("the", "english"), ("and", "english"), ("der", "german"), ("und", "german"), ("les", "french"), ("que", "romance"))

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _ntz(text_: str):
    return F.expr(f"TIMESTAMP_NTZ'{text_}'")


def _register(build: Callable[[Inputs], DataFrame]):
    _QUERIES[build.__name__] = lambda spark, folder: build(Inputs(spark, folder))
    return build


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# ---- analytics ----------------------------------------------------------------------------------


@_register
def interaction_counts(i: Inputs) -> DataFrame:
    return analytics.interaction_counts(i.chat_logs, _ntz(LOADED_AT))


@_register
def engagement(i: Inputs) -> DataFrame:
    return analytics.engagement(i.chat_logs).withColumn("avg_duration", F.round("avg_duration", 6))


@_register
def top_topics(i: Inputs) -> DataFrame:
    return analytics.top_topics(i.chat_logs, 2)


@_register
def user_analytics(i: Inputs) -> DataFrame:
    return analytics.user_analytics(i.chat_logs, 2)


@_register
def maintained_analytics(i: Inputs) -> DataFrame:
    """All logs in two batches; the second takes back topics that the first had wrong."""
    path = f"{shared_dir(i.spark)}/maintained-{uuid.uuid4().hex}"
    logs = i.chat_logs
    right, wrong = logs.filter("id % 2 = 1"), logs.filter("id % 2 = 0")
    mistaken = wrong.withColumn("topic", F.lit("unknown"))
    maintained.apply_batch(maintained.changes(right.unionByName(mistaken)), 0, path)
    maintained.apply_batch(maintained.changes(wrong, mistaken), 1, path)
    return maintained.current(i.spark, path)


@_register
def interaction_gaps(i: Inputs) -> DataFrame:
    return analytics.interaction_gaps(i.chat_logs, 3600).withColumn("duration_s", F.round("duration_s", 6))


@_register
def response_latency(i: Inputs) -> DataFrame:
    kind = F.col("event_type")
    waits = analytics.response_latency(
        i.table("events"), "user_id", "ts", "event_id", kind == "click", kind == "view"
    )
    return waits.withColumn("latency_s", F.round("latency_s", 6))


@_register
def key_bounds(i: Inputs) -> DataFrame:
    return analytics.key_bounds(i.chat_logs, "id")


@_register
def stride_report(i: Inputs) -> DataFrame:
    logs = i.chat_logs
    bounds = analytics.key_bounds(logs, "id").first()
    return analytics.stride_report(logs, "id", bounds["lower_bound"], bounds["upper_bound"], 4)


@_register
def recent_events(i: Inputs) -> DataFrame:
    return analytics.recent(i.table("events"), "ts", "event_id", 100)


@_register
def recent_per_user(i: Inputs) -> DataFrame:
    return analytics.recent_per_key(i.table("events"), ["user_id"], "ts", "event_id", 3)


@_register
def analytics_lookup(i: Inputs) -> DataFrame:
    return analytics.lookup(analytics.user_analytics(i.chat_logs, 2), "user_id", 7)


@_register
def analytics_text(i: Inputs) -> DataFrame:
    table = analytics.user_analytics(i.chat_logs, 2)
    summary = V.analytics_text(
        F.col("total_interactions"), F.col("top_topics"), F.col("last_updated_at"), zoned=False
    )
    return table.select("user_id", summary.alias("summary"))


# ---- access -------------------------------------------------------------------------------------


@_register
def role_seeds(i: Inputs) -> DataFrame:
    held = access.user_permissions(i.users, i.roles)
    return held.groupBy("role_name").agg(F.count(F.lit(1)).alias("users"))


@_register
def user_permissions(i: Inputs) -> DataFrame:
    return access.user_permissions(i.users, i.roles)


@_register
def permission_matrix(i: Inputs) -> DataFrame:
    matrix = access.permission_matrix(i.roles)
    held = access.user_permissions(i.users, i.roles).groupBy("role_name").agg(F.count(F.lit(1)).alias("users"))
    return matrix.join(held, "role_name").select("role_name", "permission", "allowed", "users")


@_register
def permission_gate(i: Inputs) -> DataFrame:
    perms = access.user_permissions(i.users, i.roles)
    return access.with_permission(i.tool_calls, perms, "can_write_knowledge").select(
        "call_id", "user_id", "tool", "allowed"
    )


@_register
def profile_enrich(i: Inputs) -> DataFrame:
    return access.with_profile(i.users, i.profiles)


@_register
def cache_overlay(i: Inputs) -> DataFrame:
    base = access.user_permissions(i.users, i.roles).select("user_id", "permissions")
    cache = i.table("events").filter("event_type = 'signup'").selectExpr(
        "user_id", "props AS permissions", "ts AS loaded_at"
    )
    return access.overlay(base, cache, "user_id", "permissions", _ntz(AS_OF), 5 * 86_400)


@_register
def cache_as_of(i: Inputs) -> DataFrame:
    """The permissions of each tool call at its own time: a live entry of the cache log, else the stored ones."""
    base = access.user_permissions(i.users, i.roles).select("user_id", "permissions")
    cache = i.table("events").filter("event_type = 'signup'").selectExpr(
        "user_id", "props AS permissions", "ts AS loaded_at"
    )
    calls = i.tool_calls.select("call_id", "user_id", "ts")
    return access.overlay_as_of(calls, base, cache, "user_id", "permissions", 2 * 86_400, min_rows=CUT)


@_register
def owned_chunks(i: Inputs) -> DataFrame:
    premium = i.users.filter("role_id = 2")
    return access.owned_by_callers(i.chunks, i.owners, premium).select("id", "doc_id", "owner", "chunk_text")


@_register
def token_claims(i: Inputs) -> DataFrame:
    return i.tokens.select("id", V.token_claims(F.col("token")).alias("c")).select("id", "c.*")


# ---- integrity ----------------------------------------------------------------------------------


@_register
def unique_violations(i: Inputs) -> DataFrame:
    return integrity.unique_violations(i.table("lineitem"), ["l_orderkey", "l_linenumber"])


@_register
def not_null_report(i: Inputs) -> DataFrame:
    parsed = validate.parse_events(i.raw_events)
    return integrity.not_null_report(parsed, ["doc_id", "user_id", "file_path", "file_name"])


@_register
def length_violations(i: Inputs) -> DataFrame:
    return integrity.length_violations(i.table("pages"), "page_id", {"url": 40, "html": 5000})


@_register
def fk_orphans(i: Inputs) -> DataFrame:
    orders = i.table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return integrity.fk_orphans(orders, i.profiles, ("o_custkey", "user_id"))


@_register
def cascade_delete(i: Inputs) -> DataFrame:
    tables = {
        "customer": i.table("customer").select("c_custkey"),
        "orders": i.table("orders").select("o_orderkey", "o_custkey"),
        "lineitem": i.table("lineitem").select("l_orderkey", "l_linenumber"),
    }
    edges = [
        ("orders", "o_custkey", "customer", "c_custkey"),
        ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ]
    deleted = i.table("customer").filter("c_acctbal < 0").select("c_custkey")
    left = integrity.cascade_delete(tables, edges, "customer", "c_custkey", deleted)
    parts = [
        left[name].agg(F.count(F.lit(1)).alias("rows"), F.sum(key).alias("keys")).withColumn("table", F.lit(name))
        for name, key in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("lineitem", "l_orderkey"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_register
def delete_closure(i: Inputs) -> DataFrame:
    """Customers asked to go with those they referred, their orders and lines, unless a claim holds one of the orders."""
    key = F.col("c_custkey")
    orders, lines = i.table("orders"), i.table("lineitem")
    tables = {
        "customer": i.table("customer").select(key, F.when(key % 5 != 1, F.floor(key / 8)).alias("referrer")),
        "orders": orders.select("o_orderkey", "o_custkey"),
        "lineitem": lines.select("l_orderkey", "l_linenumber"),
        "claims": lines.filter("l_returnflag = 'R' AND l_quantity >= 49").select("l_orderkey"),
    }
    references = [
        key_graph.Reference("customer", "referrer", "customer", "c_custkey"),
        key_graph.Reference("orders", "o_custkey", "customer", "c_custkey"),
        key_graph.Reference("lineitem", "l_orderkey", "orders", "o_orderkey"),
        key_graph.Reference("claims", "l_orderkey", "orders", "o_orderkey", restrict=True),
    ]
    asked = {"customer": ("c_custkey", i.table("customer").filter("c_acctbal < 0"))}
    done = key_graph.delete_rows(tables, references, asked)
    outcome = F.when(F.col("blocked"), "blocked").otherwise("deleted").alias("outcome")
    parts = [done.verdicts.select("table", "key", F.lit(0).alias("line"), outcome)]
    for name, own, line in (("customer", "c_custkey", "0"), ("orders", "o_orderkey", "0"), ("lineitem", "l_orderkey", "l_linenumber")):
        number = F.expr(f"CAST({line} AS INT)").alias("line")
        rest = done.left[name].select(F.lit(name).alias("table"), F.col(own).cast("string").alias("key"), number, F.lit("left").alias("outcome"))
        parts.append(rest)
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@_register
def restrict_delete(i: Inputs) -> DataFrame:
    asked = i.table("customer").filter("c_acctbal < 0").select("c_custkey", "c_name")
    return integrity.restrict_delete(asked, "c_custkey", i.table("orders"), "o_custkey")


@_register
def insert_ignore(i: Inputs) -> DataFrame:
    orders = i.table("orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    target = orders.filter("o_orderpriority <> '1-URGENT'")
    new = orders.withColumn("o_orderpriority", F.lit("NEW"))
    return integrity.insert_ignore(target, new, ["o_orderkey"])


@_register
def upsert(i: Inputs) -> DataFrame:
    target = i.table("orders").select("o_orderkey", "o_totalprice")
    updates = (
        i.table("lineitem")
        .filter("l_returnflag = 'R'")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.max("l_extendedprice").alias("o_totalprice"))
    )
    return integrity.upsert(target, updates, ["o_orderkey"])


# ---- validation ---------------------------------------------------------------------------------


@_register
def parse_events(i: Inputs) -> DataFrame:
    return validate.parse_events(i.raw_events).select(
        "offset_id", "doc_id", "user_id", "file_path", "file_name", F.col("_corrupt").isNotNull().alias("corrupt")
    )


@_register
def event_validation(i: Inputs) -> DataFrame:
    marked = validate.classify_events(validate.parse_events(i.raw_events))
    return marked.select("offset_id", "doc_id", F.coalesce("reason", F.lit("OK")).alias("reason"))


@_register
def encode_events(i: Inputs) -> DataFrame:
    good, _ = validate.split_valid(validate.parse_events(i.raw_events))
    return validate.encode_events(good).select("offset_id", "value")


@_register
def uuid_canonical(i: Inputs) -> DataFrame:
    digits = F.md5(F.col("doc_id").cast("string"))
    form = F.col("doc_id") % 5
    raw = (
        F.when(form == 0, F.upper(digits))
        .when(form == 1, F.concat(F.lit("{"), digits, F.lit("}")))
        .when(form == 2, F.concat(F.lit("urn:uuid:"), digits))
        .when(form == 3, F.concat_ws("-", F.substring(digits, 1, 16), F.substring(digits, 17, 16)))
        .otherwise(F.substring(digits, 1, 31))
    )
    return i.table("documents").select("doc_id", raw.alias("raw")).withColumn(
        "canonical", V.canonical_uuid(F.col("raw"))
    )


@_register
def apply_defaults(i: Inputs) -> DataFrame:
    parsed = validate.parse_events(i.raw_events).select("offset_id", "user_id", "file_name")
    spec = {"user_id": SYSTEM_USER, "status": "PENDING"}
    return validate.apply_defaults(parsed, spec, replace_null=True)


@_register
def first_non_empty(i: Inputs) -> DataFrame:
    return i.tool_calls.select("call_id", tools.query_argument().alias("query"))


@_register
def pdf_filter(i: Inputs) -> DataFrame:
    return i.docs.filter(V.is_pdf(F.col("file_name"))).select(
        "id", "file_name", V.stored_name(F.col("id"), F.col("file_name")).alias("stored_name")
    )


@_register
def iso_timestamps(i: Inputs) -> DataFrame:
    return i.docs.select("id", V.iso_ts(F.col("created_at"), zoned=False).alias("created"))


@_register
def dedupe_events(i: Inputs) -> DataFrame:
    events = i.table("events").withColumn("delivery", F.lit(1))
    again = i.table("events").filter("event_type = 'error'").withColumn("delivery", F.lit(2))
    return validate.dedupe_events(events.unionByName(again), "event_id", ["delivery"]).select(
        "event_id", "user_id", "ts", "delivery"
    )


# ---- status -------------------------------------------------------------------------------------


@_register
def latest_status(i: Inputs) -> DataFrame:
    return status.latest_status(i.status_log)


@_register
def status_transitions(i: Inputs) -> DataFrame:
    return status.status_transitions(i.status_log)


@_register
def stuck_documents(i: Inputs) -> DataFrame:
    return status.stuck_documents(i.status_log, _ntz(AS_OF), 6 * 3600)


@_register
def list_documents(i: Inputs) -> DataFrame:
    docs = status.with_current_status(i.docs, i.status_log)
    return status.list_documents(docs)


# ---- limits -------------------------------------------------------------------------------------


@_register
def ttl_windows(i: Inputs) -> DataFrame:
    return limits.ttl_windows(i.table("events"), "user_id", "ts", 86_400)


@_register
def rate_limit(i: Inputs) -> DataFrame:
    return limits.rate_limit(i.requests, i.profiles, 86_400, {"standard": 2, "premium": 4})


@_register
def token_bucket(i: Inputs) -> DataFrame:
    return limits.token_bucket(i.requests, 3, 12 * 3600)


@_register
def requests_per_minute(i: Inputs) -> DataFrame:
    return limits.requests_per_minute(i.requests)


# ---- text ---------------------------------------------------------------------------------------


@_register
def html_to_markdown(i: Inputs) -> DataFrame:
    return text.html_to_markdown(i.table("pages"))


@_register
def split_markdown(i: Inputs) -> DataFrame:
    return text.split_markdown(i.markdown)


@_register
def token_windows(i: Inputs) -> DataFrame:
    return text.token_windows(i.table("documents"), 64)


@_register
def chunk_tokens(i: Inputs) -> DataFrame:
    return text.chunk_tokens(i.table("documents"), 64)


@_register
def rolling_history(i: Inputs) -> DataFrame:
    return text.rolling_history(i.table("conversations"), 4)


# ---- vectors ------------------------------------------------------------------------------------


def _numbers(vector):
    """A vector as text in units of 1/10000, for comparison."""
    units = F.transform(vector, lambda x: F.floor(x.cast("double") * 10000 + 0.5).cast("string"))
    return F.array_join(units, ",")


@_register
def cosine_pairs(i: Inputs) -> DataFrame:
    following = i.vectors.select((F.col("id") - 1).alias("id"), "embedding")
    pairs = vectors.cosine_pairs(i.vectors, following, "id")
    return pairs.select(
        "id", F.round("similarity", 6).alias("similarity"), F.round("distance", 6).alias("distance")
    )


@_register
def vector_dim_check(i: Inputs) -> DataFrame:
    return i.vectors.select(
        "id", F.size("embedding").alias("dims"), VF.has_dim(F.col("embedding"), DIMS).alias("ok")
    )


@_register
def vector_text_roundtrip(i: Inputs) -> DataFrame:
    back = VF.text_to_vector(VF.vector_to_text(F.col("embedding")))
    total = F.aggregate("back", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return i.vectors.withColumn("back", back).select(
        "id", F.round(total, 6).alias("total"), (F.col("back") == F.col("embedding")).alias("same")
    )


@_register
def hash_embed(i: Inputs) -> DataFrame:
    texts = i.table("documents").select("doc_id", "text")
    return vectors.hash_embed(texts, "text", DIMS).select(
        "doc_id", _numbers(F.col("embedding")).alias("embedding")
    )


@_register
def knn_exact(i: Inputs) -> DataFrame:
    hits = vectors.knn_exact(i.chunks, i.owners, QUERY_VECTOR, OWNER)
    return hits.withColumn("similarity", F.round("similarity", 6))


def _searches(i: Inputs) -> tuple[DataFrame, DataFrame]:
    """Every vector asks for its neighbours among the chunks of its own owner."""
    owned = access.chunk_owner(i.vectors, i.owners)
    return owned.withColumnRenamed("id", "query_id"), owned


@_register
def knn_join(i: Inputs) -> DataFrame:
    asked, owned = _searches(i)
    return vectors.knn_join(asked, owned, DIMS).withColumn("similarity", F.round("similarity", 6))


@_register
def knn_pruned(i: Inputs) -> DataFrame:
    """Every document asks for its neighbours among all documents of its owner."""
    owned = staged(access.chunk_owner(i.chunks, i.owners).select("id", "owner", "embedding"), "owned")
    found = vector_prune.knn_pruned(owned.withColumnRenamed("id", "query_id"), owned, DIMS)
    return found.hits.withColumn("similarity", F.round("similarity", 6))


@_register
def knn_approx(i: Inputs) -> DataFrame:
    asked, owned = _searches(i)
    return vectors.knn_approx(asked, owned, DIMS).withColumn("similarity", F.round("similarity", 6))


@_register
def knn_index(i: Inputs) -> DataFrame:
    """All given vectors in a stored index, built from half of them and appended to; every vector asks."""
    asked, owned = _searches(i)
    path = f"{shared_dir(i.spark)}/vector-index-{uuid.uuid4().hex}"
    vector_index.build_index(owned.filter("id % 2 = 0"), path, DIMS, lists=16, parts=16)
    vector_index.append(owned.filter("id % 2 = 1"), path)
    hits = vector_index.search(asked, path, probes=12)
    return hits.withColumn("similarity", F.round("similarity", 6))


@_register
def index_recall(i: Inputs) -> DataFrame:
    """Share of the exact neighbours that the stored index finds."""
    asked, owned = _searches(i)
    return vectors.ann_recall(knn_index(i), vectors.knn_join(asked, owned, DIMS))


@_register
def search_report(i: Inputs) -> DataFrame:
    owned = staged(access.chunk_owner(i.chunks, i.owners).select("id", "owner", "embedding"), "owned")
    asked = owned.withColumnRenamed("id", "query_id")
    near = vector_index.neighbourhoods(asked, DIMS, vectors.part_rows(i.chunks))
    hits = vectors.hits_with_text(vectors.knn_join(asked, owned, DIMS), i.chunks, near)
    return vectors.search_report(hits, asked.select("query_id", "owner"), near=near)


@_register
def ingest_batch(i: Inputs) -> DataFrame:
    return vectors.ingest_batch(i.markdown, DIMS).select(
        "id", "doc_id", "chunk_idx", "chunk_text", _numbers(F.col("embedding")).alias("embedding")
    )


# ---- series -------------------------------------------------------------------------------------


@_register
def decimate(i: Inputs) -> DataFrame:
    return series.decimate(i.signal, 48_000, 16_000)


@_register
def block_mean(i: Inputs) -> DataFrame:
    return series.block_mean(i.signal, 44_100, 16_000).withColumn("mean", F.round("mean", 6))


@_register
def quantise(i: Inputs) -> DataFrame:
    sample = F.col("sample") * 4
    return i.signal.select(
        "signal_id",
        "n",
        series.quantise(sample).cast("int").alias("value"),
        series.quantise(sample, "split").cast("int").alias("value_split"),
    )


@_register
def frames(i: Inputs) -> DataFrame:
    values = i.signal.select("signal_id", "n", series.quantise(F.col("sample")).alias("sample"))
    framed = series.frames(values, 20)
    return framed.select("signal_id", "frame", F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples"))


@_register
def pcm_roundtrip(i: Inputs) -> DataFrame:
    values = i.signal.select("signal_id", "n", series.quantise(F.col("sample")).alias("sample"))
    coded = series.frames(values, 20).withColumn("data", series.encode_pcm("samples"))
    back = F.transform(series.decode_pcm(F.col("data")), series.dequantise)
    total = F.aggregate("back", F.lit(0.0), lambda a, x: a + x)
    return coded.withColumn("back", back).select("signal_id", "frame", "data", F.round(total, 6).alias("total"))


# ---- tools --------------------------------------------------------------------------------------


@_register
def tool_priority(i: Inputs) -> DataFrame:
    return tools.tool_priority(i.tool_calls).select("call_id", "tool", "mode")


def _perms(i: Inputs) -> DataFrame:
    return access.user_permissions(i.users, i.roles)


def _analytics_tool(i: Inputs, calls: DataFrame) -> DataFrame:
    return tools.analytics_for(calls, _perms(i), analytics.user_analytics(i.chat_logs, 2))


def _search_tool(i: Inputs, calls: DataFrame) -> DataFrame:
    return tools.search_for(calls, _perms(i), i.chunks, i.owners, DIMS)


@_register
def tool_analytics(i: Inputs) -> DataFrame:
    return _analytics_tool(i, i.tool_calls).select("call_id", "user_id", "status", "result")


@_register
def tool_search(i: Inputs) -> DataFrame:
    return _search_tool(i, i.tool_calls).select("call_id", "user_id", "status", "result")


@_register
def tool_dispatch(i: Inputs) -> DataFrame:
    registry = {
        "query_user_analytics": lambda calls: _analytics_tool(i, calls),
        "rag_knowledge_search": lambda calls: _search_tool(i, calls),
    }
    answered = tools.dispatch(i.tool_calls, registry)
    checked = tools.validate_args(i.tool_calls).select("call_id", "missing")
    return answered.join(checked, "call_id").select("call_id", "tool", "mode", "missing", "status", "result")


ROLE_SQL = ", ".join(f"({n}, '{name}', '{perms}')" for n, name, perms in ROLE_ROWS)


# ---- hot keys in blocks: the same answers as the queries without _cut -------------------------------


@_register
def interaction_gaps_cut(i: Inputs) -> DataFrame:
    gaps = analytics.interaction_gaps(i.chat_logs, 3600, CUT)
    return gaps.withColumn("duration_s", F.round("duration_s", 6))


@_register
def response_latency_cut(i: Inputs) -> DataFrame:
    kind = F.col("event_type")
    events = i.table("events")
    waits = analytics.response_latency(events, "user_id", "ts", "event_id", kind == "click", kind == "view", CUT)
    return waits.withColumn("latency_s", F.round("latency_s", 6))


@_register
def status_transitions_cut(i: Inputs) -> DataFrame:
    return status.status_transitions(i.status_log, CUT)


@_register
def token_bucket_cut(i: Inputs) -> DataFrame:
    return limits.token_bucket(i.requests, 3, 12 * 3600, CUT)


@_register
def rolling_history_cut(i: Inputs) -> DataFrame:
    return text.rolling_history(i.table("conversations"), 4, 3)


# ---- plain logs, rows as written, gates -----------------------------------------------------------


@_register
def message_topics(i: Inputs) -> DataFrame:
    words = i.spark.createDataFrame(MESSAGE_WORDS, "word string, topic string")
    turns = i.table("conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("id"), "text")
    return analytics.with_topics(turns, words, "text").select("id", "topic")


@_register
def engagement_gaps(i: Inputs) -> DataFrame:
    plain = i.chat_logs.drop("interaction_duration")
    return analytics.engagement(plain, 3600).withColumn("avg_duration", F.round("avg_duration", 6))


@_register
def cascade_survivors(i: Inputs) -> DataFrame:
    tables = {
        "customer": i.table("customer").select("c_custkey"),
        "orders": i.table("orders").select("o_orderkey", "o_custkey"),
        "lineitem": i.table("lineitem").select("l_orderkey", "l_linenumber"),
    }
    edges = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")]
    deleted = i.table("customer").filter("c_acctbal < 0").select("c_custkey")
    left = integrity.cascade_delete(tables, edges, "customer", "c_custkey", deleted)
    keys = (("customer", "c_custkey", F.lit(0)), ("orders", "o_orderkey", F.lit(0)), ("lineitem", "l_orderkey", F.col("l_linenumber")))
    parts = [
        left[name].select(F.lit(name).alias("table"), F.col(key).cast("long").alias("key"), line.cast("int").alias("line"))
        for name, key, line in keys
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_register
def display_status(i: Inputs) -> DataFrame:
    return status.display_status(status.with_current_status(i.owners, i.status_log)).select("id", "user_id", "status")


@_register
def topics_as_text(i: Inputs) -> DataFrame:
    parsed = analytics.user_analytics(i.chat_logs, 2).withColumn("top_topics", F.from_json("top_topics", "array<string>"))
    text_ = V.json_text(F.col("top_topics"), parsed.schema["top_topics"].dataType)
    return parsed.select("user_id", text_.alias("top_topics"))


@_register
def analytics_rows(i: Inputs) -> DataFrame:
    table = analytics.user_analytics(i.chat_logs, 2)
    good, _ = sinks.prepare_overwrite(table, "user_id", ["total_interactions"])
    return good


@_register
def analytics_rejected(i: Inputs) -> DataFrame:
    """What the telemetry job sets aside: here every 97th log has lost its user."""
    user = F.when(F.col("id") % 97 != 0, F.col("user_id"))
    table = analytics.user_analytics(i.chat_logs.withColumn("user_id", user), 2)
    return sinks.prepare_overwrite(table, "user_id", ["total_interactions"])[1]


@_register
def secured_calls(i: Inputs) -> DataFrame:
    done = access.secured("can_query_analytics")(
        lambda calls: calls.select("call_id", "user_id", F.lit("OK").alias("status"), F.col("tool").alias("result"))
    )
    return done(i.tool_calls, access.user_permissions(i.users, i.roles))
