"""Exact nearest neighbours that leave out what cannot be among them.

Chunks of an owner fall into cells, one per centroid of a bounded sample. A cell knows the smallest and the largest angle
between its centroid and its chunks, so by the triangle inequality it tells how close to a query any of them can be.
Cells are gathered into parts of about ``c_rows`` chunks, neighbouring cells together. Where an owner has several parts,
a query first searches its nearest cells that hold ``k`` chunks together; what it finds there is a floor for its
neighbours, and it goes only to the parts with a cell that can reach the floor, once to each. There, products along the sample's principal axes and
the lengths of what these axes leave over (Cauchy-Schwarz) bound each similarity; whole vectors are compared only where
the bound reaches the floor, which the chunks with the highest bounds raise first. Centroids and axes shape the work, never the result.

How much is left out depends on the data: much of texts, nothing of vectors that point evenly in all directions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.constants import TOP_K
from parley.operators.ordered import null_safe_join
from parley.operators.vector_index import TRAIN_ROWS, means, sample_vectors
from parley.operators.vectors import AT_ONCE, block_sizes, block_topk, final_rank, shared_blocks, unit_rows, usable
from parley.session import shared_dir

#: Room for rounding: of angles and bounds, and of similarities, which are ranked at 9 decimals.
ANGLE_ROOM, FLOOR_ROOM = 1e-6, 1e-8
CELL, PART = ["owner", "list"], ["owner", "part"]
WORK = ["possible", "bounded", "compared"]


@dataclass
class Pruned:
    """``hits`` as ``knn_join`` has them, and ``work``: one row of pair counts.

    ``possible`` are all pairs of an owner, ``bounded`` those bounded along the axes, ``compared`` those compared whole,
    those of the first search included.
    """

    hits: DataFrame
    work: DataFrame


def _angles(v: pd.Series, centroids: np.ndarray) -> np.ndarray:
    rows = np.stack(v.to_numpy()).astype("float64")
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    return np.arccos(np.clip(rows @ centroids.T, -1, 1))


def _dense(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def _place(centroids: np.ndarray):
    """The nearest centroid and the angle to it."""

    @F.pandas_udf("list int, angle double")
    def run(v: pd.Series) -> pd.DataFrame:
        angles = _angles(v, centroids)
        near = angles.argmin(axis=1)
        return pd.DataFrame({"list": near.astype("int32"), "angle": angles[np.arange(len(near)), near]})

    return run


def _first(centroids: np.ndarray, k: int):
    """The cells nearest to a query, as many as hold ``k`` chunks together; none for an owner of one part."""

    @F.pandas_udf("array<int>")
    def run(v: pd.Series, sizes: pd.Series, part: pd.Series) -> pd.Series:
        held = np.where(_dense(part).max(axis=1, keepdims=True) > 0, _dense(sizes), 0)
        order = np.argsort(np.where(held > 0, _angles(v, centroids), np.inf), axis=1, kind="stable")
        ordered = np.take_along_axis(held, order, axis=1)
        wanted = (ordered > 0) & (ordered.cumsum(axis=1) - ordered < k)
        return pd.Series([o[w].astype("int32") for o, w in zip(order, wanted)])

    return run


def _reachable(centroids: np.ndarray):
    """Parts with a cell in which a chunk could reach the floor."""

    @F.pandas_udf("array<int>")
    def run(v: pd.Series, low: pd.Series, high: pd.Series, part: pd.Series, floor: pd.Series) -> pd.Series:
        angles, lowest, highest = _angles(v, centroids), _dense(low), _dense(high)
        gap = np.maximum(np.maximum(angles - highest, lowest - angles) - ANGLE_ROOM, 0)
        open_ = (highest >= 0) & (np.cos(gap) >= floor.to_numpy()[:, None] - FLOOR_ROOM)
        return pd.Series([np.unique(parts[row]).astype("int32") for row, parts in zip(open_, _dense(part))])

    return run


def _search_above(axes: np.ndarray) -> Callable:
    """Cells whose queries carry their floor as last number: bounds first, whole products where they reach it.

    A last row without a query holds the number of pairs compared.
    """

    def cell(k: int, schema: pa.Schema):
        def parts(units: np.ndarray) -> np.ndarray:
            """What lies along the axes and the length of what they leave over: products of these bound products."""
            along = units @ axes.T
            rest = np.sqrt(np.maximum(0, 1 - (along * along).sum(axis=1, keepdims=True)))
            return np.concatenate([along, rest], axis=1)

        def run(queries: pa.Table, chunks: pa.Table) -> pa.Table:
            found_q, found_c, found_s, compared = [], [], [], 0
            if queries.num_rows and chunks.num_rows:
                chunks = chunks.sort_by("id")
                asked = queries["_v"].combine_chunks()
                flat = asked.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(asked), -1)
                q, floors = flat[:, :-1], flat[:, -1]
                q = q / np.linalg.norm(q, axis=1, keepdims=True)
                c = unit_rows(chunks["_v"])
                q_parts, c_parts = parts(q), parts(c)
                for mine, theirs in shared_blocks(queries, chunks):
                    block, block_parts = c[theirs], c_parts[theirs]
                    at_once = min(64, 1 + AT_ONCE // len(theirs))
                    for lo in range(0, len(mine), at_once):
                        part = mine[lo : lo + at_once]
                        bounds = q_parts[part] @ block_parts.T
                        for row, bound in zip(part, bounds):
                            floor = floors[row]
                            near = np.flatnonzero(bound >= floor - ANGLE_ROOM)
                            if len(near) > 2 * k:
                                # The most promising chunks raise the floor for all others.
                                bound = bound[near]
                                top = np.argpartition(bound, -2 * k)[-2 * k :]
                                floor = max(floor, np.partition(block[near[top]] @ q[row], -k)[-k])
                                compared += int((bound[top] < floor - ANGLE_ROOM).sum())
                                near = near[bound >= floor - ANGLE_ROOM]
                            compared += len(near)
                            sims = block[near] @ q[row]
                            kept = np.flatnonzero(sims >= floor - FLOOR_ROOM)
                            kept = kept[np.argsort(-sims[kept].round(9), kind="stable")][:k]
                            found_q.append(np.repeat(row, len(kept)))
                            found_c.append(theirs[near[kept]])
                            found_s.append(sims[kept])
            hits = sum(map(len, found_q))
            join = lambda lists, kind: np.concatenate(lists) if lists else np.zeros(0, dtype=kind)
            columns = [
                pa.array([*join(found_q, "int64"), None], pa.int64()),
                pa.array([*join(found_c, "int64"), None], pa.int64()),
            ]
            return pa.table(
                [
                    queries["query_id"].take(columns[0]),
                    chunks["id"].take(columns[1]),
                    pa.array([*join(found_s, "float64"), None], pa.float64()),
                    pa.array([0] * hits + [compared], pa.int64()),
                ],
                schema=schema,
            )

        return run

    return cell


def _by_list(entries: Column, lists: int, field: str, missing: float) -> Column:
    """One number per list, in order of lists."""
    held = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["list"], e[field].cast("double"))))
    return F.transform(F.sequence(F.lit(0), F.lit(lists - 1)), lambda i: F.coalesce(held[i], F.lit(missing)))


def _pairs(q_sizes: DataFrame, c_sizes: DataFrame, by: list[str], **kinds: int) -> DataFrame:
    """Pairs of a query and a chunk of equal key, counted under the names that have a 1."""
    both = q_sizes.withColumnRenamed("_n", "_q").join(c_sizes, by)
    return both.select(*[(F.col("_q") * F.col("_n") * kinds.get(name, 0)).alias(name) for name in WORK])


def knn_pruned(
    queries: DataFrame,
    chunks: DataFrame,
    dims: int,
    k: int = TOP_K,
    lists: int = 64,
    axes: int | None = None,
    train_rows: int = TRAIN_ROWS,
    seed: int = 7,
    q_rows: int = 20_000,
    c_rows: int = 50_000,
) -> Pruned:
    """The rows of ``knn_join``: the ``k`` nearest chunks of the same owner for every query, exactly.

    Inputs are ``(query_id, owner, embedding)`` and ``(id, owner, embedding)``; rows without an owner and vectors of
    another length or of length zero are left out. ``lists`` bounds the cells of an owner, ``axes`` (three quarters
    of the dimensions) the axes of the bounds, ``train_rows`` the sample. Placed rows and first hits are written once to the
    shared folder, so that both searches see the same rows.
    """
    spark = chunks.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/knn-{uuid.uuid4().hex}"

    def staged(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    good = staged(usable(chunks, dims, "id", "owner"), "vectors")
    sample = sample_vectors(good, train_rows)
    if not len(sample):
        sample = np.eye(dims)
    units = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    # Eigenvectors of the small matrix of products, the largest first.
    main = np.linalg.eigh(units.T @ units)[1][:, ::-1].T[: axes or max(1, 3 * dims // 4)]
    centroids = means(units, lists, np.random.default_rng(seed), unit=True)
    # Along the second axis, as the first is about the mean: lists with close numbers lie close together.
    centroids = centroids[np.argsort(centroids @ main[min(1, len(main) - 1)], kind="stable")]

    placed = good.select("id", "owner", "_v", _place(centroids)("_v").alias("_p"))
    c = staged(placed.select("id", "owner", "_v", "_p.list", "_p.angle"), "chunks")
    cells = c.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    # At most one row per list and owner meets in this window and in this list.
    before = Window.partitionBy("owner").orderBy("list").rowsBetween(Window.unboundedPreceding, -1)
    number = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / c_rows).cast("int")
    parted = staged(cells.withColumn("part", number), "cells")
    shapes = parted.groupBy("owner").agg(F.collect_list(F.struct("list", "n", "low", "high", "part")).alias("_e"))
    missing = {"n": 0.0, "low": 0.0, "high": -1.0, "part": -1.0}
    shapes = shapes.select("owner", *[_by_list(F.col("_e"), lists, f, x).alias(f"_{f}") for f, x in missing.items()])
    nearby = _first(centroids, k)("_v", "_n", "_part").alias("_first")
    asked = usable(queries, dims, "query_id", "owner").join(shapes.select("owner", "_n", "_part"), "owner")
    q = staged(asked.select("query_id", "owner", "_v", nearby), "queries")

    near = q.select("query_id", "owner", "_v", F.explode("_first").alias("list"))
    near_sizes, c_sizes = block_sizes(near, CELL), parted.select(*CELL, F.col("n").alias("_n"))
    first = block_topk(near, c, near_sizes, c_sizes, CELL, k, q_rows, c_rows)
    # Without k hits there is no floor.
    floors = final_rank(first, k).groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("similarity")).otherwise(F.lit(-2.0)).alias("_floor")
    )
    aimed = null_safe_join(q, floors, ["query_id"], "left").fillna(-2.0, ["_floor"]).join(shapes, "owner")
    reached = _reachable(centroids)("_v", "_low", "_high", "_part", "_floor")
    vector = F.concat(F.col("_v").cast("array<double>"), F.array("_floor")).alias("_v")
    far = staged(aimed.select("query_id", "owner", vector, F.explode(reached).alias("part")), "aimed")
    dealt = c.join(parted.select(*CELL, "part"), CELL).select("id", "owner", "part", "_v")
    far_sizes, part_sizes = block_sizes(far, PART), parted.groupBy(*PART).agg(F.sum("n").alias("_n"))
    found = block_topk(
        far, dealt, far_sizes, part_sizes, PART, k, q_rows, c_rows, cell=_search_above(main), counted=["compared"]
    )
    found = staged(found, "hits")
    counts = [
        _pairs(block_sizes(q, ["owner"]), block_sizes(c, ["owner"]), ["owner"], possible=1),
        _pairs(near_sizes, c_sizes, CELL, compared=1),
        _pairs(far_sizes, part_sizes, PART, bounded=1),
        found.select(F.lit(0).alias("possible"), F.lit(0).alias("bounded"), "compared"),
    ]
    work = reduce(DataFrame.unionByName, counts).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in WORK])
    hits = found.filter("similarity IS NOT NULL").drop("compared")
    return Pruned(final_rank(hits, k), work)
