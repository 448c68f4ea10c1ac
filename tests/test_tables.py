"""Analytics, access, integrity, validation, status and tools on hand-made rows."""

import datetime as dt

import pytest
from frames import plan, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.operators import access, analytics, integrity, status, tools, validate
from parley.schemas import role_seeds

T0 = dt.datetime(2024, 1, 1)
UID = "00000000-0000-0000-0000-000000000000"


def at(s):
    return T0 + dt.timedelta(seconds=s)


# ---- analytics


def test_the_three_seeded_messages(spark):
    logs = spark.createDataFrame([(i, UID, "m") for i in (1, 2, 3)], "id int, user_id string, message_text string")
    got = analytics.interaction_counts(logs).first()
    assert (got["user_id"], got["total_interactions"]) == (UID, 3)
    assert got["top_topics"] == '["general", "ai_architecture"]' and got["last_updated_at"] is not None


def _logs(spark):
    data = [
        (1, 1, "b", 2.0, at(0)),
        (2, 1, "a", 4.0, at(5)),
        (3, 1, "c", None, at(9)),
        (4, 1, "c", 1.0, at(1)),
        (5, None, "a", 1.0, at(1)),
        (6, 2, None, 1.0, at(1)),
    ]
    return spark.createDataFrame(data, "id int, user_id int, topic string, interaction_duration double, created_at timestamp")


def test_user_analytics_keeps_the_null_user_and_topicless_users(spark):
    got = {r["user_id"]: tuple(r)[1:] for r in analytics.user_analytics(_logs(spark), 2).collect()}
    assert got[1] == (4, '["c","a"]', at(9))
    assert got[None] == (1, '["a"]', at(1))
    assert got[2] == (1, "[]", at(1))


def test_engagement_ignores_missing_durations(spark):
    got = {r["user_id"]: tuple(r)[1:] for r in analytics.engagement(_logs(spark)).collect()}
    assert got[1] == (7.0 / 3, 4)


def test_latency_of_the_earliest_unanswered_request(spark):
    kinds = [(1, "resp"), (2, "req"), (3, "req"), (7, "resp"), (8, "resp"), (9, "req")]
    log = spark.createDataFrame([(i, 1, at(i), k) for i, k in kinds], "seq int, u int, ts timestamp, k string")
    got = analytics.response_latency(log, "u", "ts", "seq", F.col("k") == "req", F.col("k") == "resp")
    assert rows(got.select("response_seq", "latency_s")) == [(7, 5.0)]


@pytest.mark.parametrize("lower, upper, n", [(0, 9999, 4), (1, 100_000, 4), (5, 8, 10), (7, 7, 3), (-10, 1000, 7)])
def test_stride_bounds_are_even(lower, upper, n):
    bounds = analytics.stride_bounds(lower, upper, n)
    assert bounds == sorted(bounds) and len(bounds) == max(0, min(n, upper - lower) - 1 if upper > lower else 0)
    assert all(lower < b <= upper + 1 for b in bounds)
    if bounds:
        widths = {b - a for a, b in zip(bounds, bounds[1:])}
        assert len(widths) <= 1


def test_stride_report_takes_null_and_outer_keys(spark):
    df = spark.createDataFrame([(None,), (-5,), (0,), (50,), (99,), (1000,)], "id int")
    got = rows(analytics.stride_report(df, "id", 0, 100, 4))
    assert got == [(0, 3), (2, 1), (3, 2)]


def test_recent(spark):
    df = spark.createDataFrame([(i, at(i // 2)) for i in range(10)], "id int, ts timestamp")
    assert [r["id"] for r in analytics.recent(df, "ts", "id", 3).collect()] == [9, 8, 7]
    assert analytics.lookup(df, "id", 4).count() == 1


# ---- access


def _users(spark):
    return spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 9), (5, None)], "id int, role_id int")


def test_permissions(spark):
    perms = access.user_permissions(_users(spark), role_seeds(spark))
    assert sorted(r["user_id"] for r in perms.collect()) == [1, 2, 3]
    calls = spark.createDataFrame([(1, 1), (2, 3), (3, 4), (4, None)], "call_id int, user_id int")
    got = access.with_permission(calls, perms, "can_query_analytics")
    assert rows(got.select("call_id", "allowed")) == [(1, True), (2, False), (3, False), (4, False)]
    matrix = access.permission_matrix(role_seeds(spark))
    assert matrix.count() == 12 and matrix.filter("allowed").count() == 8


def test_small_roles_are_broadcast_by_size(spark):
    assert "BroadcastHashJoin" in plan(access.user_permissions(_users(spark), role_seeds(spark)))


def test_cache_wins_while_live(spark):
    base = spark.createDataFrame([(1, "db"), (2, "db"), (3, "db"), (4, "db")], "user_id int, permissions string")
    cache = spark.createDataFrame(
        [(1, "old", at(0)), (1, "new", at(50)), (2, "expired", at(0)), (3, "later", at(200))],
        "user_id int, permissions string, loaded_at timestamp",
    )
    got = access.overlay(base, cache, "user_id", "permissions", F.lit(at(100)), 100)
    assert rows(got) == [(1, "new", True), (2, "db", False), (3, "db", False), (4, "db", False)]
    us = int(dt.datetime(2024, 1, 1, 0, 1, 40, tzinfo=dt.timezone.utc).timestamp() * 1e6)
    assert rows(access.live_entries(cache, us, 100).select("permissions")) == [("new",)]


def test_profiles_and_ownership(spark):
    profiles = spark.createDataFrame([(1, "premium")], "user_id int, usage_tier string")
    got = access.with_profile(_users(spark), profiles)
    assert {r["id"]: r["usage_tier"] for r in got.collect()}[1] == "premium"
    assert got.filter("usage_tier = 'standard'").count() == 4
    docs = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id int, user_id int")
    chunks = spark.createDataFrame([(100, 10), (101, 11), (102, 12), (103, 99)], "id int, doc_id int")
    assert rows(access.owned_chunks(chunks, docs, 1).select("id")) == [(100,)]
    assert rows(access.owned_by(access.chunk_owner(chunks, docs), 2).select("id")) == [(101,)]
    assert rows(access.owned_by_callers(chunks, docs, _users(spark)).select("id", "owner")) == [(100, 1), (101, 2)]


# ---- integrity


def test_uniqueness_ignores_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "a"), (2, "b")], "x int, y string")
    assert rows(integrity.unique_violations(df, ["x", "y"])) == [(1, "a", 2)]


def test_null_and_length_reports(spark):
    df = spark.createDataFrame([(1, None, "abc"), (2, "x" * 6, None)], "id int, a string, b string")
    assert rows(integrity.not_null_report(df, ["id", "a", "b"])) == [("a", 1), ("b", 1), ("id", 0)]
    assert rows(integrity.length_violations(df, "id", {"a": 5, "b": 2})) == [(1, "b", 3, 2), (2, "a", 6, 5)]


def test_foreign_keys_and_deletes(spark):
    users = spark.createDataFrame([(1,), (2,)], "id int")
    docs = spark.createDataFrame([(10, 1), (20, 2), (30, 3), (40, None)], "id int, user_id int")
    chunks = spark.createDataFrame([(100, 10), (200, 20), (300, 30)], "id int, doc_id int")
    assert rows(integrity.fk_orphans(docs, users, ("user_id", "id"))) == [(30, 3)]
    left = integrity.cascade_delete(
        {"users": users, "docs": docs, "chunks": chunks},
        [("docs", "user_id", "users", "id"), ("chunks", "doc_id", "docs", "id")],
        "users",
        "id",
        users.filter("id = 1"),
    )
    assert rows(left["users"]) == [(2,)]
    assert rows(left["docs"].select("id")) == [(20,), (30,), (40,)]
    assert rows(left["chunks"].select("id")) == [(200,), (300,)]
    blocked = integrity.restrict_delete(users, "id", docs, "user_id")
    assert rows(blocked) == [(1, True), (2, True)]
    assert rows(integrity.restrict_delete(users, "id", docs.filter("user_id = 2"), "user_id")) == [(1, False), (2, True)]


_TABLE = st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9)), max_size=8)


@settings(max_examples=10, deadline=None)
@given(_TABLE, _TABLE)
def test_upsert_and_insert_ignore_are_idempotent(spark, old, new):
    schema = "k int, v int"
    target = spark.createDataFrame(list(dict(old).items()), schema)
    updates = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(new)], schema + ", i int")
    once = integrity.upsert(target, updates, ["k"], ["i"])
    assert dict(once.collect()) == {**dict(old), **dict(new)}
    assert rows(integrity.upsert(once, updates, ["k"], ["i"])) == rows(once)
    kept = integrity.insert_ignore(target, updates, ["k"], ["i"])
    first = {}
    for k, v in new:
        first.setdefault(k, v)
    assert dict(kept.collect()) == {**first, **dict(old)}
    assert rows(integrity.insert_ignore(kept, updates, ["k"], ["i"])) == rows(kept)


# ---- validation


GOOD = '{"doc_id":"A98CC8B4-023A-4A6C-9C09-CDAB900A892B","user_id":"u","file_path":"/f.pdf","file_name":"f"}'


def test_events_are_sorted_out_by_reason(spark):
    bad = {
        "{bad": "BAD_JSON",
        "[1]": "BAD_JSON",
        "7": "BAD_JSON",
        "": "BAD_JSON",
        "{}": "MISSING_FIELD",
        GOOD.replace("/f.pdf", ""): "MISSING_FIELD",
        GOOD.replace('"u"', "null"): "MISSING_FIELD",
        GOOD.replace("A98C", "X98C"): "BAD_UUID",
    }
    df = spark.createDataFrame([(v,) for v in [GOOD, *bad]] + [(None,)], "value string")
    good, rest = validate.split_valid(validate.parse_events(df))
    assert [r["doc_id"] for r in good.collect()] == ["a98cc8b4-023a-4a6c-9c09-cdab900a892b"]
    got = {r["value"]: r["reason"] for r in rest.collect()}
    assert got.pop(None) == "BAD_JSON" and got == bad


def test_encode_is_the_inverse_of_parse(spark):
    parsed = validate.parse_events(spark.createDataFrame([(GOOD,)], "value string")).drop("value")
    assert validate.encode_events(parsed).first()["value"] == GOOD


def test_defaults(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, a string")
    assert rows(validate.apply_defaults(df, {"a": "d", "b": 0})) == [(1, None, 0), (2, "x", 0)]
    assert rows(validate.apply_defaults(df, {"a": "d"}, replace_null=True)) == [(1, "d"), (2, "x")]


def test_first_delivery_wins(spark):
    df = spark.createDataFrame([("e", 2, "b"), ("e", 1, "a"), ("f", 1, "c")], "event_id string, n int, v string")
    assert rows(validate.dedupe_events(df, "event_id", ["n"]).select("event_id", "v")) == [("e", "a"), ("f", "c")]
    assert df.filter(validate.in_domain(F.col("v"), ["a", "c"])).count() == 2


# ---- status


def _status(spark, *events):
    return spark.createDataFrame([(i, d, s, at(t)) for i, (d, s, t) in enumerate(events)], "seq int, doc_id int, status string, ts timestamp")


def test_life_cycle(spark):
    log = _status(
        spark,
        (1, "PENDING", 0),
        (1, "PROCESSING", 1),
        (1, "COMPLETE", 1),
        (2, "PENDING", 0),
        (2, "COMPLETE", 5),
        (3, "PROCESSING", 0),
        (4, "PENDING", 0),
        (4, "LOST", 2),
    )
    got = {r["doc_id"]: r["status"] for r in status.latest_status(log).collect()}
    assert got == {1: "COMPLETE", 2: "COMPLETE", 3: "PROCESSING", 4: "LOST"}
    bad = status.status_transitions(log).select("doc_id", "previous", "status")
    assert rows(bad) == [(2, "PENDING", "COMPLETE"), (3, None, "PROCESSING"), (4, "PENDING", "LOST")]
    stuck = status.stuck_documents(log, F.lit(at(61)), 60)
    assert rows(stuck.select("doc_id")) == [(3,)]
    assert rows(status.stuck_documents(log, F.lit(at(60)), 60)) == []


def test_document_list(spark):
    docs = spark.createDataFrame([(1, 7, "a", at(0)), (2, 8, "b", at(9)), (3, 7, "c", None)], "id int, user_id int, file_name string, created_at timestamp")
    full = status.with_current_status(docs, _status(spark, (1, "PROCESSING", 0)))
    got = status.list_documents(full).collect()
    assert [(r["id"], r["status"]) for r in got] == [(2, "PENDING"), (1, "PROCESSING"), (3, "PENDING")]
    assert [r["id"] for r in status.list_documents(full, 7).collect()] == [1, 3]
    assert {r["status"] for r in status.display_status(full).collect()} == {"pending", "processing"}


# ---- tools


def _world(spark):
    calls = spark.createDataFrame(
        [
            (1, 1, "query_user_analytics", "{}"),
            (2, 3, "query_user_analytics", "{}"),
            (3, 2, "query_user_analytics", None),
            (4, None, "query_user_analytics", "{}"),
            (5, 1, "rag_knowledge_search", '{"query": "alpha beta"}'),
            (6, 1, "rag_knowledge_search", '{"query": "", "search_query": "alpha beta"}'),
            (7, 1, "rag_knowledge_search", "{}"),
            (8, 2, "rag_knowledge_search", '{"query": "alpha"}'),
            (9, 3, "rag_knowledge_search", '{"query": "alpha"}'),
            (10, 1, "other", "{}"),
            (11, 1, None, "{}"),
        ],
        "call_id int, user_id int, tool string, args string",
    )
    perms = access.user_permissions(_users(spark), role_seeds(spark))
    table = spark.createDataFrame([(1, 5, '["a"]', at(0)), (3, 5, "[]", at(0))], "user_id int, total_interactions int, top_topics string, last_updated_at timestamp")
    docs = spark.createDataFrame([(10, 1), (20, 3)], "id int, user_id int")
    from parley.operators.vectors import hash_embed

    texts = spark.createDataFrame([(100, 10, "alpha beta"), (101, 10, "gamma"), (200, 20, "alpha")], "id int, doc_id int, chunk_text string")
    chunks = hash_embed(texts, dims=64)
    return calls, perms, table, docs, chunks


def test_dispatch(spark):
    calls, perms, table, docs, chunks = _world(spark)
    out = tools.dispatch(
        calls,
        {
            "query_user_analytics": lambda c: tools.analytics_for(c, perms, table),
            "rag_knowledge_search": lambda c: tools.search_for(c, perms, chunks, docs, 64),
        },
    )
    got = {r["call_id"]: r for r in out.collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        1: "OK", 2: "DENIED", 3: "NOT_FOUND", 4: "DENIED", 5: "OK", 6: "OK", 7: "OK", 8: "OK", 9: "DENIED",
        10: "UNSUPPORTED", 11: "UNSUPPORTED",
    }
    assert got[2]["result"] == "Authorization Failure: User lacks required permission 'can_query_analytics'."
    assert got[3]["result"] == "No user analytics data found for user ID: 2."
    assert got[5]["result"] == got[6]["result"]
    assert got[5]["result"].startswith("Result 1 (Similarity: 1.0000):\nalpha beta\n\nResult 2 (Similarity: 0.0000):\ngamma")
    assert got[7]["result"] == got[8]["result"] == "No matching knowledge base documents found."
    assert got[10]["result"] == "Error: Tool 'other' is not supported."
    assert (got[5]["mode"], got[1]["mode"], got[10]["mode"]) == ("INTERRUPT", "WHEN_IDLE", "WHEN_IDLE")


def test_missing_user_comes_after_the_permission_check(spark):
    perms = spark.createDataFrame([(1, '{"p": true}')], "user_id int, permissions string")
    calls = spark.createDataFrame([(1, None)], "call_id int, user_id int")
    answered = []

    @access.secured("p")
    def op(allowed):
        answered.append(True)
        return allowed.withColumn("status", F.lit("OK")).withColumn("result", F.lit(""))

    assert op(calls, perms).first()["status"] == "DENIED" and answered


def test_required_arguments(spark):
    calls, *_ = _world(spark)
    got = {r["call_id"]: r["missing"] for r in tools.validate_args(calls).collect()}
    assert {k for k, v in got.items() if v} == {7} and got[7] == "query"


def test_sql_registration(spark):
    _, _, table, docs, chunks = _world(spark)
    tools.register(
        spark,
        {"users": _users(spark), "roles": role_seeds(spark), "documents": docs, "chunks": chunks, "analytics": table},
    )
    assert spark.sql("SELECT total_interactions FROM analytics_of(1)").first()[0] == 5
    assert rows(spark.sql("SELECT id FROM chunks_of(1)")) == [(100,), (101,)]
    assert spark.sql("SELECT count(*) FROM permissions").first()[0] == 3
