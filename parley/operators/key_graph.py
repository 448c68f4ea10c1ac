"""Deletions through a graph of references between tables: cascades, self references, cycles, and rows that restrict.

The tables and their references form a small graph that the caller declares. Its order is found from the references: tables
that depend on each other in a cycle (or a table on itself) form one component, and components are visited parents first. A
component without a cycle costs one semi-join per reference. One with a cycle is followed from the rows found last until no
new rows turn up, so the number of rounds is the longest chain of its rows.

A row is known by its *key columns*: those its table refers by, is referred to by, or is asked for by. Rows that agree in all
of them share their fate, so only distinct key columns are kept, written to the shared folder once per table and round. NULL
refers to nothing. Every join has an equality key; the rows of a hot key stay on the streamed side, where adaptive execution
splits them, while the looked-up side holds distinct keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.session import shared_dir


class Reference(NamedTuple):
    """``child.child_key`` refers to ``parent.parent_key``; a restricting reference forbids to delete the parent row."""

    child: str
    child_key: str
    parent: str
    parent_key: str
    restrict: bool = False


class Link(NamedTuple):
    """From rows of ``source`` to the rows of ``target`` whose ``target_key`` equals their ``source_key``."""

    source: str
    source_key: str
    target: str
    target_key: str


class Deletion(NamedTuple):
    """``left``: each table without the deleted rows. ``verdicts``: (table, key, blocked) per key asked for."""

    left: dict[str, DataFrame]
    verdicts: DataFrame


def components(tables: Iterable[str], links: Sequence[Link]) -> list[list[str]]:
    """Tables in the order of the links; tables that reach each other come together, sorted by name."""
    reach = {t: {x.target for x in links if x.source == t} for t in sorted(tables)}
    for via in reach:
        for found in reach.values():
            if via in found:
                found |= reach[via]
    # A table that reaches another, but not the reverse, has fewer tables before it.
    before = {t: {u for u in reach if t in reach[u]} | {t} for t in reach}
    groups = {tuple(u for u in reach if u == t or (u in reach[t] and t in reach[u])) for t in reach}
    return [list(g) for g in sorted(groups, key=lambda g: (len(before[g[0]]), g))]


def _keys(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).select(F.col(column).alias("_key")).distinct()


def _matching(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    return rows.join(keys, F.col(column) == F.col("_key"), "left_semi")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class _Store:
    """Tables of one run, written below the shared folder."""

    def __init__(self, spark):
        self.spark = spark
        self.folder = f"{shared_dir(spark).rstrip('/')}/parley-deletion-{uuid.uuid4().hex}"
        self.written = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.written += 1
        path = f"{self.folder}/{self.written}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def _reach(
    store: _Store, nodes: Mapping[str, DataFrame], links: Sequence[Link], seeds: Mapping[str, DataFrame]
) -> dict[str, DataFrame]:
    """The rows of ``nodes`` that are ``seeds`` or that links lead to from them, distinct; tables without any are left out."""
    found: dict[str, DataFrame] = {}
    for group in components(nodes, links):
        inner = [x for x in links if x.source in group and x.target in group]
        fresh: dict[str, DataFrame] = {}
        for table in group:
            parts = [seeds[table]] if table in seeds else []
            for x in links:
                if x.target == table and x.source not in group and x.source in found:
                    parts.append(_matching(nodes[table], x.target_key, _keys(found[x.source], x.source_key)))
            if parts:
                fresh[table] = store.keep(_union(parts).distinct())
        found |= fresh
        while inner and fresh:
            reached: dict[str, list[DataFrame]] = {}
            for x in inner:
                if x.source in fresh:
                    hits = _matching(nodes[x.target], x.target_key, _keys(fresh[x.source], x.source_key))
                    reached.setdefault(x.target, []).append(hits)
            fresh = {}
            for table, parts in reached.items():
                # Set difference takes NULL for equal to NULL and leaves distinct rows.
                new = _union(parts)
                new = store.keep(new.subtract(found[table]) if table in found else new.distinct())
                if not new.isEmpty():
                    fresh[table] = new
            for table, new in fresh.items():
                found[table] = found[table].unionByName(new) if table in found else new
    return found


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose key columns are not in ``gone``; NULL equals NULL."""
    names = [(c, f"_gone_{i}") for i, c in enumerate(gone.columns)]
    renamed = gone.select(*[F.col(c).alias(n) for c, n in names])
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(renamed[n]) for c, n in names])
    return rows.join(renamed, same, "left_anti")


def delete_rows(
    tables: Mapping[str, DataFrame],
    references: Sequence[Reference],
    asked: Mapping[str, tuple[str, DataFrame]],
) -> Deletion:
    """Delete the rows asked for, with all rows that refer to them, unless a restricting reference forbids it.

    ``asked`` maps a table to (key column, a table with that column). Deleting a row deletes the rows whose plain references
    lead to it, in any number of steps. A row that a restricting reference leads to cannot go, whether or not the referring
    row would go as well; nor can any row that would take it along. A key asked for is blocked when one of its rows cannot
    go; it then deletes nothing, while the other keys asked for take their rows as if it had not been asked. A row that is
    reached from a blocked key and from another one therefore goes.

    NULL keys refer to nothing and cannot be asked for. Repeated keys count once, a key without a row is not blocked, and
    no keys delete nothing. Tables that are not given, or none asked for, raise a ValueError. Keys in ``verdicts`` are
    texts, as tables may differ in their types. Column names are free except for names that start with ``_gone_`` or
    equal ``_key``.
    """
    named = {t for x in references for t in (x.child, x.parent)} | set(asked)
    if not named <= set(tables):
        raise ValueError(f"unknown tables: {sorted(named - set(tables))}")
    if not asked:
        raise ValueError("no table is asked for")
    columns: dict[str, set[str]] = {t: set() for t in named}
    for x in references:
        columns[x.child].add(x.child_key)
        columns[x.parent].add(x.parent_key)
    for table, (column, _) in asked.items():
        columns[table].add(column)

    store = _Store(next(iter(tables.values())).sparkSession)
    nodes = {t: tables[t].select(*sorted(c)) for t, c in columns.items()}
    wanted = {t: store.keep(_keys(df, column)) for t, (column, df) in asked.items()}
    seeds = {t: _matching(nodes[t], asked[t][0], wanted[t]).distinct() for t in asked}
    cascades = [x for x in references if not x.restrict]
    down = [Link(x.parent, x.parent_key, x.child, x.child_key) for x in cascades]
    up = [Link(x.child, x.child_key, x.parent, x.parent_key) for x in cascades]

    doomed = _reach(store, nodes, down, seeds)
    held: dict[str, list[DataFrame]] = {}
    for x in references:
        if x.restrict and x.parent in doomed:
            users = _keys(tables[x.child], x.child_key)
            held.setdefault(x.parent, []).append(_matching(doomed[x.parent], x.parent_key, users))
    stuck = _reach(store, doomed, [x for x in up if x.source in doomed and x.target in doomed], {
        t: _union(parts).distinct() for t, parts in held.items()
    })

    free, verdicts = {}, []
    for table, (column, _) in asked.items():
        keys = wanted[table].withColumn("blocked", F.lit(False))
        if table in stuck:
            mine = _keys(stuck[table], column).select(F.col("_key").alias("_stuck"))
            joined = wanted[table].join(mine, F.col("_key") == F.col("_stuck"), "left")
            keys = joined.select("_key", F.col("_stuck").isNotNull().alias("blocked"))
        free[table] = _matching(doomed[table], column, keys.filter("NOT blocked").select("_key"))
        verdicts.append(keys.select(F.lit(table).alias("table"), F.col("_key").cast("string").alias("key"), "blocked"))
    # What goes is part of what was doomed, so the large tables are not searched again.
    going = _reach(store, doomed, [x for x in down if x.source in doomed and x.target in doomed], free)
    left = {t: _without(df, going[t]) if t in going else df for t, df in tables.items()}
    return Deletion(left, _union(verdicts))
