"""Declared table rules checked as data-quality jobs, and row sets that obey them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.ordered import top_per_key


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once. A key with a NULL part never conflicts."""
    return (
        df.dropna("any", subset=list(keys))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") > 1)
    )


def not_null_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULLs per column, from one pass over the table."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in cols]
    return counts.select(F.inline(F.array(*pairs)))


def length_violations(df: DataFrame, id_col: str, limits: Mapping[str, int]) -> DataFrame:
    """One row per text value longer than its column allows."""
    pairs = [
        F.struct(F.lit(c).alias("column"), F.length(c).alias("length"), F.lit(n).alias("allowed"))
        for c, n in limits.items()
    ]
    return df.select(F.col(id_col), F.inline(F.array(*pairs))).filter(F.col("length") > F.col("allowed"))


def fk_orphans(child: DataFrame, parent: DataFrame, on: tuple[str, str]) -> DataFrame:
    """Child rows whose reference has no parent row; a NULL reference is allowed."""
    child_key, parent_key = on
    parents = parent.select(F.col(parent_key).alias("_parent"))
    return child.filter(F.col(child_key).isNotNull()).join(
        parents, F.col(child_key) == F.col("_parent"), "left_anti"
    )


def delete_referencing(child: DataFrame, key: str, removed: DataFrame, removed_key: str) -> DataFrame:
    """What is left of a child table once the rows that reference ``removed`` are gone."""
    gone = removed.select(F.col(removed_key).alias("_gone"))
    return child.join(gone, F.col(key) == F.col("_gone"), "left_anti")


def cascade_delete(
    tables: Mapping[str, DataFrame],
    edges: Sequence[tuple[str, str, str, str]],
    root: str,
    root_key: str,
    deleted: DataFrame,
) -> dict[str, DataFrame]:
    """Remove ``deleted`` (a table of root keys) and all that references it, level by level.

    ``edges`` holds (child, child_key, parent, parent_key), parents before their children.
    """
    doomed = {root: tables[root].join(deleted, root_key, "left_semi")}
    left = dict(tables)
    left[root] = delete_referencing(tables[root], root_key, deleted, root_key)
    for child, child_key, parent, parent_key in edges:
        if parent not in doomed:
            continue
        keys = doomed[parent].select(F.col(parent_key).alias("_gone"))
        hit = tables[child].join(keys, F.col(child_key) == F.col("_gone"), "left_semi")
        doomed[child] = doomed[child].unionByName(hit) if child in doomed else hit
        left[child] = delete_referencing(left[child], child_key, doomed[parent], parent_key)
    return left


def restrict_delete(parent: DataFrame, key: str, child: DataFrame, child_key: str) -> DataFrame:
    """Rows asked to be deleted, each marked ``blocked`` when a child row still references it."""
    used = child.select(F.col(child_key).alias("_used"), F.lit(True).alias("_hit")).distinct()
    return parent.join(used, F.col(key) == F.col("_used"), "left").select(
        *parent.columns, F.coalesce("_hit", F.lit(False)).alias("blocked")
    )


def _one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool) -> DataFrame:
    """One row per key: by ``order``, then by all columns, so that the choice never depends on the run."""
    every = [*order, *[c for c in df.columns if c not in order]]
    by = [F.col(c).desc() if last else F.col(c).asc() for c in every]
    return top_per_key(df, keys, by, 1, "_k").drop("_k")


def insert_ignore(
    target: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """``target`` plus the rows of ``new`` whose key it lacks; among equal new keys the first stays.

    A key with a NULL part conflicts with no other, so all such rows are inserted.
    """
    whole = new.dropna("any", subset=list(keys))
    fresh = _one_per_key(whole, keys, order, last=False).join(target.select(*keys), list(keys), "left_anti")
    partial = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    rows = fresh.select(*target.columns).unionByName(new.filter(partial).select(*target.columns))
    return target.unionByName(rows)


def upsert(
    target: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Rows of ``updates`` replace rows of equal key; of several updates of a key the last one counts.

    Last is by ``order`` and then by all columns. An update with a NULL key part equals no row and is added.
    """
    whole = _one_per_key(updates.dropna("any", subset=list(keys)), keys, order, last=True)
    kept = target.join(whole.select(*keys), list(keys), "left_anti")
    partial = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    rows = whole.select(*target.columns).unionByName(updates.filter(partial).select(*target.columns))
    return kept.unionByName(rows)
