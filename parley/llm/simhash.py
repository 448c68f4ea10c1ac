"""Near-duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint has one bit per column of the majority vote of its shingles' hashes. Two fingerprints within
``max_distance`` bits agree, in at least one of ``segments`` parts, up to ``max_distance // segments`` bits. So a table
of segment values is probed with the small Hamming ball around each segment, and the pairs it returns are kept
when their whole distance is small enough.

- Equal fingerprints are one node, however many documents have them: all work below is on distinct fingerprints.
- A ball is probed from one side only: of two different values, the one that has the highest differing bit set
  probes for the other. Each pair is met once per matching segment instead of twice.
- The distance is part of the join condition, so unverified pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.components import components
from parley.llm.store import own_columns, written

BITS = 64
SEED = 42
#: Hashes that are voted on at a time: bounds the memory of a very long text.
VOTES = 1 << 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text; 0 when it has no word.

    Words end at ASCII white space only and every shingle counts, also repeated ones.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[-n:].tolist()
    votes = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, VOTES):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + VOTES], stops[at : at + VOTES], strict=True)]
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints_of(text: Column, shingle: int = 3) -> Column:
    """Fingerprints as signed longs (the same 64 bits), computed in Arrow batches."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            prints = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
            yield pd.Series(prints.view(np.int64))

    return run.asNondeterministic()(text)


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each part of a fingerprint."""
    edges = [round(i * BITS / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def ball_masks(width: int, radius: int) -> np.ndarray:
    """All differences of at most ``radius`` bits in a part of ``width`` bits."""
    flips = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]
    return np.array(flips, dtype=np.uint64)


def _probes(radius: int, bounds: list[tuple[int, int]]):
    """Arrow batches of fingerprints to the values that each of their segments looks for."""
    plans = []
    for first, width in bounds:
        masks = ball_masks(width, min(radius, width))
        top = np.array([1 << (int(m).bit_length() - 1) if m else 0 for m in masks], dtype=np.uint64)
        plans.append((first, width, masks, top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(whole), 4096):
                prints = whole[at : at + 4096]
                for k, (first, width, masks, top) in enumerate(plans):
                    values = (prints >> np.uint64(first)) & np.uint64((1 << width) - 1)
                    row, mask = np.nonzero((values[:, None] & top[None, :]) == top[None, :])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(prints[row].view(np.int64)),
                            pa.array(np.full(len(row), k, dtype=np.int32)),
                            pa.array((values[row] ^ masks[mask]).view(np.int64)),
                        ],
                        names=["a", "segment", "value"],
                    )

    return run


def near_links(prints: DataFrame, max_distance: int = 3, segments: int = 2) -> DataFrame:
    """(a, b): all pairs of different fingerprints within ``max_distance`` bits, each at least once.

    ``prints`` has one long column ``print`` with distinct values.
    """
    bounds = segment_bounds(segments)
    probes = prints.mapInArrow(_probes(max_distance // segments, bounds), "a long, segment int, value long")
    values = F.array(
        *[
            F.struct(
                F.lit(k).alias("segment"),
                F.shiftrightunsigned("print", first).bitwiseAND(F.lit((1 << width) - 1 if width < BITS else -1)).alias("value"),
            )
            for k, (first, width) in enumerate(bounds)
        ]
    )
    table = prints.select(F.col("print").alias("b"), F.inline(values))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    met = (probes["segment"] == table["segment"]) & (probes["value"] == table["value"])
    return probes.join(table, met & close & (F.col("a") != F.col("b"))).select("a", "b")


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_distance: int = 3,
    segments: int = 2,
) -> DataFrame:
    """(doc_id, print, component_id, root, text_key): one row per row of ``df``.

    ``component_id`` is the smallest id that a document reaches over links of at most ``max_distance`` bits; copies and
    documents of equal fingerprints are linked at distance 0. NULL and empty texts, and those of white space, have
    fingerprint 0 and are linked like any other. NULL ids are members and never name a component while a member
    has an id; repeated rows are repeated in the result. An empty table gives an empty result. Other columns of
    ``df`` are not read. ``root`` is the least fingerprint of the component, ``text_key`` the MD5 of the text.
    """
    docs = own_columns(df, doc_id=id_col, text=text_col)
    prints = written(
        docs.select(
            "doc_id", fingerprints_of(F.col("text"), shingle).alias("print"), text_key(F.col("text")).alias("text_key")
        ),
        "prints",
    )
    classes = prints.groupBy("print").agg(F.min("doc_id").alias("least_id"))
    roots = components(near_links(classes.select("print"), max_distance, segments))
    rooted = classes.join(roots, F.col("print") == F.col("node"), "left").select(
        "print", "least_id", F.coalesce("root", "print").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_print = rooted.join(named, "root").select("print", "component_id", "root")
    return prints.join(of_print, "print").select("doc_id", "print", "component_id", "root", "text_key")


def text_key(c: Column) -> Column:
    return F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def hex16(c: Column) -> Column:
    """A long's 64 bits as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df``, with all their columns, of which one per group of near-duplicates stays.

    The row with the group's smallest id stays. Where several rows have that id, or no row has an id, the one with
    the least text key stays, and of rows with equal texts any one.
    """
    id_key = F.coalesce(F.col(f"`{id_col}`").cast("long").cast("string"), F.lit(""))
    stay = (
        near_duplicates(df, id_col, text_col, **options)
        .filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root")
        .agg(F.min("text_key").alias("text_key"), F.min("doc_id").alias("doc_id"))
        .select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_key"), "text_key")
    )
    keyed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        id_key.alias("id_key"),
        text_key(F.col(f"`{text_col}`")).alias("text_key"),
    )
    return keyed.join(stay, ["id_key", "text_key"], "left_semi").dropDuplicates(["id_key", "text_key"]).select("row.*")
