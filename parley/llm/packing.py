"""Best-fit packing of token sequences, planned on the histogram of lengths.

Documents are tokenised and cut into pieces row by row. The plan needs only how many pieces there are of each
length, at most ``capacity`` numbers whatever the corpus: best-fit decreasing runs over those counts, a length at a
time, and treats equal sequences as one group with a count. Then pieces are numbered within their length and take
the planned slots of that length by joining on the number. The numbering is cut into chunks whose sizes are
summed first, so that a length that a third of all pieces share is not one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.store import own_columns, written
from parley.llm.token_files import END
from parley.llm.words import encoder

CAPACITY = 2048
#: Pieces per chunk, roughly, over which the numbering of a length's pieces is spread.
CHUNK_PIECES = 1 << 16


def _cut(path: str, capacity: int):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = words.encode(text) + END
                    for k, b in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[b : b + 4 * capacity]
                        rows.append((doc, k, b // 4, len(piece) // 4, zlib.crc32(piece), piece))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pieces(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): each text's ids and the end id 0, cut at ``capacity``."""
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    return own_columns(df, doc_id=id_col, text=text_col).mapInArrow(_cut(tokenizer, capacity), kind)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram: (length, first, last, sequence, per_sequence, offset) per slot range.

    Pieces of ``length`` with numbers ``first`` to ``last`` (exclusive) go, ``per_sequence`` at a time, into sequences from
    number ``sequence`` on, side by side from ``offset``. Each length goes to the group of sequences with the least
    room that still holds it, until that group is full of it; a group splits in at most three parts, so the plan
    has a few rows per length.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    #: Groups of equal sequences with room left: (room, first sequence, sequences), sorted.
    groups: list[tuple[int, int, int]] = []
    used = 0

    def keep(room: int, first: int, n: int) -> None:
        if n and room:
            insort(groups, (room, first, n))

    for length in sorted(counts, reverse=True):
        left, number = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit into {capacity}")
        while left:
            at = bisect_left(groups, (length, -1, -1))
            if at < len(groups):
                room, first, n = groups.pop(at)
            else:
                room, first, n = capacity, used, -(-left // (capacity // length))
                used += n
            each = room // length
            full = min(n, left // each)
            if full:
                slots.append((length, number, number + full * each, first, each, capacity - room))
                number, left = number + full * each, left - full * each
                keep(room - each * length, first, full)
            if left and full < n:
                # The rest goes into one more sequence of this group.
                slots.append((length, number, number + left, first + full, left, capacity - room))
                keep(room - left * length, first + full, 1)
                keep(room, first + full + 1, n - full - 1)
                number, left = number + left, 0
            else:
                keep(room, first + full, n - full)
    return slots


def pack(cut: DataFrame, capacity: int = CAPACITY, chunk_pieces: int = CHUNK_PIECES) -> DataFrame:
    """The rows of ``cut`` with ``sequence_id`` and ``offset``; ``cut`` is a stable table with doc_id, piece, length.

    A piece that fills a sequence needs no plan: it is a sequence of its own, with a negative number from its place in
    the table. The others have numbers from 0.
    """
    spark = cut.sparkSession
    full = F.col("length") == capacity
    alone = cut.filter(full).select(
        *cut.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    cut = cut.filter(~full)
    chunks = max(1, cut.count() // chunk_pieces)
    keyed = cut.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)).cast("int"))
    sizes = keyed.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("length", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(
        plan(counts, capacity), "length long, first long, last long, sequence long, each long, place long"
    )
    within = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
    # The slots are a few per length, bounded by the capacity.
    numbered = (
        keyed.withColumn("rank", F.row_number().over(within) - 1)
        .join(begins, ["length", "chunk"])
        .withColumn("rank", F.col("rank") + F.col("begin"))
    )
    met = (numbered["length"] == slots["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    index = F.col("rank") - F.col("first")
    shared = numbered.join(F.broadcast(slots), met).select(
        *[numbered[c] for c in cut.columns],
        (F.col("sequence") + F.expr("(rank - first) div each")).alias("sequence_id"),
        (F.col("place") + (index % F.col("each")) * numbered["length"]).alias("offset"),
    )
    return shared.unionByName(alone)


def best_fit_packing(
    df: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    keep_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): one row per piece.

    Only documents longer than ``capacity`` are cut. Sequences are filled without gaps from offset 0. A NULL or empty
    text is one piece with the end id; NULL ids and repeated rows are packed like any other row; an empty table
    gives an empty result. Other columns of ``df`` are not read. With ``keep_ids`` the pieces' ids come along.
    """
    cut = pieces(df, tokenizer, id_col, text_col, capacity)
    return pack(written(cut if keep_ids else cut.drop("ids"), "pieces"), capacity)
