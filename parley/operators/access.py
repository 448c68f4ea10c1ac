"""Who may do what: roles, permissions, cached permissions, ownership, caller profiles.

No join here carries a broadcast hint. Roles and profiles are small in most deployments, and then the
planner broadcasts them after checking their size; when they are not, it shuffles and splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.constants import DENIED
from parley.functions.values import has_permission, permission_map
from parley.operators.ordered import HOT_ROWS, micros, split_hot


def user_permissions(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Role and permissions of each user; users whose role does not exist are left out."""
    r = roles.select(F.col("id").alias("_role"), "role_name", "permissions")
    return users.join(r, F.col("role_id") == F.col("_role"), "inner").select(
        F.col("id").alias("user_id"), "role_id", "role_name", "permissions"
    )


def permission_matrix(roles: DataFrame) -> DataFrame:
    """One row per (role, permission)."""
    perms = permission_map(F.col("permissions"), roles.schema["permissions"].dataType)
    return roles.select("role_name", F.explode(perms).alias("permission", "allowed"))


def with_profile(users: DataFrame, profiles: DataFrame, key: str = "id") -> DataFrame:
    """Users with their usage tier; a user without a profile has the tier 'standard'."""
    p = profiles.select(F.col("user_id").alias("_pid"), F.col("usage_tier").alias("_tier"))
    return users.join(p, F.col(key) == F.col("_pid"), "left").select(
        *users.columns, F.coalesce("_tier", F.lit("standard")).alias("usage_tier")
    )


def overlay(
    base: DataFrame, cache: DataFrame, key: str, value: str, as_of: Column, ttl_s: int, loaded: str = "loaded_at"
) -> DataFrame:
    """``base`` with ``value`` taken from the cache where an entry is live at ``as_of``.

    Of several entries under one key the latest loaded one counts, as in a key-value store, and of those loaded
    at the same time the one with the greatest value. ``from_cache`` tells which source was used.
    """
    at = F.struct(F.col(loaded).alias("_at"), F.col(value).alias("_cv"))
    entry = cache.filter(F.col(loaded) <= as_of).groupBy(F.col(key).alias("_ck")).agg(F.max(at).alias("_e"))
    live = entry.filter(as_of < F.col("_e._at") + F.make_dt_interval(secs=F.lit(ttl_s))).select("_ck", "_e._cv")
    joined = base.join(live, F.col(key) == F.col("_ck"), "left")
    others = [c for c in base.columns if c != value]
    return joined.select(
        *others, F.coalesce("_cv", value).alias(value), F.col("_cv").isNotNull().alias("from_cache")
    )


def overlay_as_of(
    calls: DataFrame,
    base: DataFrame,
    cache: DataFrame,
    key: str,
    value: str,
    ttl_s: int,
    ts: str = "ts",
    loaded: str = "loaded_at",
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """``calls`` with the ``value`` that held for their ``key`` at their own time, and ``from_cache``.

    ``cache`` is a log of entries. At a call's time the entry loaded last counts, if it is younger than ``ttl_s``; of
    entries loaded at one time the one with the greatest value; an entry loaded at the time of a call counts for it.
    Otherwise the value of ``base`` holds, NULL where it has none. A call without a time or a key finds no entry, and
    an entry without a time is none. Entries and calls of a key pass one window in order of time; keys with at least
    ``min_rows`` of them are cut into blocks, each of which starts from the entry that was last before it.
    """
    asked = calls.select(
        F.col(key).alias("_k"), micros(calls, ts).alias("_at"), F.struct(*calls.columns).alias("_call"),
    )
    entry = F.struct(F.col("_at").alias("at"), F.col(value).alias("held"))
    known = cache.withColumn("_at", micros(cache, loaded)).filter(F.col("_at").isNotNull() & F.col(key).isNotNull())
    known = known.select(F.col(key).alias("_k"), "_at", entry.alias("_entry"))
    rows = split_hot(asked.unionByName(known, allowMissingColumns=True), ["_k"], F.col("_at"), min_rows)
    earlier = Window.partitionBy("_k").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.filter(F.col("_blk").isNotNull())
        .groupBy("_k", "_blk")
        .agg(F.max("_entry").alias("_entry"))
        .withColumn("_entry", F.max("_entry").over(earlier))
        .withColumn("_first", F.lit(True))
    )
    every = rows.withColumn("_first", F.lit(False)).unionByName(carry, allowMissingColumns=True)
    upto = (
        Window.partitionBy("_k", "_blk")
        .orderBy(F.desc("_first"), F.asc_nulls_first("_at"), F.col("_call").isNotNull())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    # Entries come in order of time, so the greatest so far is the last.
    met = every.withColumn("_e", F.max("_entry").over(upto)).filter(F.col("_call").isNotNull())
    live = F.coalesce(F.col("_at") - F.col("_e.at") < F.lit(ttl_s * 1_000_000), F.lit(False))
    found = met.select("_call.*", F.col("_k"), live.alias("from_cache"), F.when(live, F.col("_e.held")).alias("_held"))
    stored = base.select(F.col(key).alias("_b"), F.col(value).alias("_stored"))
    joined = found.join(stored, F.col("_k") == F.col("_b"), "left")
    return joined.select(
        *calls.columns, F.when(F.col("from_cache"), F.col("_held")).otherwise(F.col("_stored")).alias(value), "from_cache"
    )


def chunk_owner(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with the owner of their document, as ``owner``."""
    d = docs.select(F.col("id").alias("_doc"), F.col("user_id").alias("owner"))
    return chunks.join(d, F.col("doc_id") == F.col("_doc"), "inner").drop("_doc")


def owned_by(df: DataFrame, user_id, column: str = "owner") -> DataFrame:
    """Only the rows one caller owns."""
    return df.filter(F.col(column) == F.lit(user_id))


def owned_chunks(chunks: DataFrame, docs: DataFrame, user_id) -> DataFrame:
    """Chunks of one caller. The owner filter is applied to the documents before the join."""
    return chunk_owner(chunks, docs.filter(F.col("user_id") == F.lit(user_id)))


def owned_by_callers(chunks: DataFrame, docs: DataFrame, callers: DataFrame, key: str = "id") -> DataFrame:
    """For many callers at once: every chunk whose document belongs to one of them."""
    wanted = callers.select(F.col(key).alias("_caller"))
    mine = docs.join(wanted, F.col("user_id") == F.col("_caller"), "left_semi")
    return chunk_owner(chunks, mine)


def permission_flags(perms: DataFrame, permission: str | Column) -> DataFrame:
    """``(_uid, _held)`` per user: the flag of a fixed permission, or the parsed map where it varies.

    Parsing happens here, once per user, and not after the join with the calls.
    """
    parsed = permission_map(F.col("permissions"), perms.schema["permissions"].dataType)
    held = parsed if isinstance(permission, Column) else has_permission(parsed, permission)
    return perms.select(F.col("user_id").alias("_uid"), held.alias("_held"))


def with_permission(calls: DataFrame, perms: DataFrame, permission: str | Column, out: str = "allowed") -> DataFrame:
    """Calls with a flag telling whether their user holds a permission; unknown users hold none."""
    joined = calls.join(permission_flags(perms, permission), F.col("user_id") == F.col("_uid"), "left")
    if isinstance(permission, Column):
        flag = has_permission(F.col("_held"), permission)
    else:
        flag = F.coalesce("_held", F.lit(False))
    return joined.withColumn(out, flag).drop("_uid", "_held")


def denial(permission: str) -> str:
    """The answer to a call without the permission it needs."""
    return DENIED.format(permission)


def secured(permission: str):
    """Decorator for an operator over calls: only allowed calls reach it, the others get a denial row.

    The wrapped function maps calls to calls with ``status`` and ``result``; the result is called as
    ``f(calls, perms, ...)``.
    """

    def decorate(operator):
        def run(calls: DataFrame, perms: DataFrame, *args, **kwargs) -> DataFrame:
            gated = with_permission(calls, perms, permission)
            denied = gated.filter(~F.col("allowed")).drop("allowed")
            denied = denied.withColumn("status", F.lit("DENIED")).withColumn("result", F.lit(denial(permission)))
            done = operator(gated.filter("allowed").drop("allowed"), *args, **kwargs)
            return done.unionByName(denied.select(*done.columns))

        return run

    return decorate


def live_entries(cache: DataFrame, as_of_us: int, ttl_s: int, loaded: str = "loaded_at") -> DataFrame:
    """Cache rows that have not expired at a point given in microseconds."""
    age = F.lit(as_of_us) - micros(cache, loaded)
    return cache.filter((age >= 0) & (age < F.lit(ttl_s * 1_000_000)))
