"""Embeddings, exact and approximate nearest neighbours, search reports.

Searches for many queries compare blocks of queries with blocks of chunks as matrix products inside
Arrow tasks and hand back only the best k per query and block, so pairs are never materialised. Blocks
are cut by row count: a group (an owner, or a hash bucket) with many rows becomes a grid of cells.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parley.constants import NOTHING_FOUND, RESULT, TOP_K
from parley.functions.values import chunk_key, filled, fixed4, let
from parley.functions.vectors import cosine_distance, cosine_similarity, has_dim, norm
from parley.operators.access import owned_chunks
from parley.operators.ordered import top_per_key
from parley.operators.text import split_markdown
from parley.session import staged

#: Words whose buckets a task remembers.
WORDS = 1_000_000
#: Similarities that a task holds at a time, and best pairs of a cell.
AT_ONCE, HITS = 2_000_000, 250_000
#: Partitions of a search; beyond it a task has several cells.
MOST_TASKS = 20_000
#: Parts of an owner's chunks that a round of ``knn_join`` searches at most.
ROUND_PARTS = 2
#: Queries of a part of ``search_report`` at most, and bytes of their own texts on average.
PART_ROWS, PART_BYTES = 20_000, 128_000_000
#: Reports, and bytes of their texts, that a task unpacks at a time.
REPORTS, REPORT_BYTES = 256, 2_000_000
#: More than the rounding to 9 decimals moves a similarity.
ROUNDING = 2e-9

# ---- embedding ----------------------------------------------------------------------------------


def embed(
    df: DataFrame, model_factory: Callable, text: str = "chunk_text", out: str = "embedding", batch: int = 64
) -> DataFrame:
    """Vectors from a model that is loaded once per task; NULL where the model raises.

    ``model_factory()`` returns a function from an array of texts to an array (texts x dimensions). When it raises on a
    batch, the texts of that batch are tried one by one inside the task, so one bad text costs one batch.
    """

    def one_by_one(predict: Callable, texts: np.ndarray) -> list:
        found = []
        for i in range(len(texts)):
            try:
                found.append(np.asarray(predict(texts[i : i + 1]))[0])
            except Exception:  # noqa: BLE001  any error of a model
                found.append(None)
        return found

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = model_factory()
        for texts in batches:
            found: list = []
            for at in range(0, len(texts), batch):
                part = texts.iloc[at : at + batch].to_numpy()
                try:
                    found.extend(np.asarray(predict(part)))
                except Exception:  # noqa: BLE001  any error of a model
                    found.extend(one_by_one(predict, part))
            yield pd.Series([None if v is None else np.asarray(v, dtype="float32") for v in found], dtype=object)

    return df.withColumn(out, run(F.col(text)))


def hash_bucket(word: bytes, dims: int) -> int:
    """The first 8 hexadecimal digits of the word's MD5, as a number modulo ``dims``."""
    return int(md5(word).hexdigest()[:8], 16) % dims


def _hash_vectors(dims: int):
    """Vectors of a column of texts; each distinct word is hashed once per task, with at most ``WORDS`` remembered."""
    word = re.compile(rb"[^ \t\r\n\f]+")

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[bytes, int] = {}
        for texts in batches:
            flat = np.zeros((len(texts), dims))
            for row, text in enumerate(texts.fill_null("").cast(pa.binary()).to_pylist()):
                found = word.findall(text)
                try:
                    buckets = [known[w] for w in found]
                except KeyError:
                    if len(known) > WORDS:
                        known.clear()
                    known.update((w, hash_bucket(w, dims)) for w in set(found).difference(known))
                    buckets = [known[w] for w in found]
                flat[row] = np.bincount(buckets, minlength=dims) if buckets else 0
            length = np.sqrt((flat * flat).sum(axis=1, keepdims=True))
            unit = np.divide(flat, length, out=np.zeros_like(flat), where=length > 0).astype("float32")
            offsets = pa.array(np.arange(len(texts) + 1, dtype="int32") * dims)
            yield pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))

    return run


def hash_embed(df: DataFrame, text: str = "chunk_text", dims: int = 64, out: str = "embedding") -> DataFrame:
    """Hashed word counts scaled to length one; a text without words, a NULL one too, gives a zero vector.

    Works row by row in Arrow batches: hashing each distinct word once costs far less than hashing every occurrence
    in built-in expressions.
    """
    return df.withColumn(out, _hash_vectors(dims)(F.col(text)))


# ---- one query ----------------------------------------------------------------------------------


def nearest(chunks: DataFrame, query: Sequence[float], k: int = TOP_K) -> DataFrame:
    """The k chunks closest to one vector with similarity and rank; ties by id. Zero vectors are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = chunks.withColumn("_d", cosine_distance(F.col("embedding"), q))
    # Undefined distances go last and are dropped from the k rows: a filter before would compute them twice.
    best = scored.orderBy(F.asc_nulls_last("_d"), "id").limit(k).filter(F.col("_d").isNotNull())
    # Only the k rows left after the limit meet in this window.
    rank = F.row_number().over(Window.orderBy("_d", "id"))
    return best.select("id", "doc_id", "chunk_text", (1 - F.col("_d")).alias("similarity"), rank.alias("rank"))


def knn_exact(chunks: DataFrame, docs: DataFrame, query: Sequence[float], owner, k: int = TOP_K) -> DataFrame:
    """The caller's own chunks closest to a query vector."""
    return nearest(owned_chunks(chunks, docs, owner), query, k)


# ---- many queries -------------------------------------------------------------------------------


def unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    m = flat.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(flat), -1)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _nearest(q: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and similarities of the best k rows of ``c`` for each row of ``q``.

    Similarities are compared at 9 decimals; among equal ones the first row of ``c`` is better. Where there are many
    rows, only those that reach the k-th largest of the best of 4k runs of rows are put in order.
    """
    sims = q @ c.T
    width = len(c) // (4 * k)
    if width > 1:
        runs = sims[:, : 4 * k * width].reshape(len(q), 4 * k, width).max(axis=2)
        floor = np.partition(runs, -k, axis=1)[:, -k] - ROUNDING
        row, at = np.nonzero(sims >= floor[:, None])
        # A vector that holds no numbers reaches nothing.
        if (np.bincount(row, minlength=len(q)) >= k).all():
            order = np.lexsort((at, -sims[row, at].round(9), row))
            begins = np.searchsorted(row, np.arange(len(q)))
            best = at[order[begins[:, None] + np.arange(k)]]
            return best, np.take_along_axis(sims, best, axis=1)
    best = np.argsort(-sims.round(9), axis=1, kind="stable")[:, :k]
    return best, np.take_along_axis(sims, best, axis=1)


def shared_blocks(queries: pa.Table, chunks: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the queries and of the chunks of each block that one cell has of both."""
    names = pa.chunked_array([*queries["_b"].chunks, *chunks["_b"].chunks])
    codes = names.combine_chunks().dictionary_encode().indices.to_numpy()
    q_codes, c_codes = codes[: queries.num_rows], codes[queries.num_rows :]
    q_order, c_order = (np.argsort(x, kind="stable") for x in (q_codes, c_codes))
    q_sorted, c_sorted = q_codes[q_order], c_codes[c_order]
    for code in np.intersect1d(q_sorted, c_sorted):
        yield tuple(
            order[slice(*np.searchsorted(held, [code, code + 1]))]
            for order, held in ((q_order, q_sorted), (c_order, c_sorted))
        )


def _cell_topk(k: int, schema: pa.Schema, decode: Callable | None = None):
    """Best k chunks per query for one cell, which may hold several blocks; ``decode`` gives the chunks' unit vectors."""

    def run(queries: pa.Table, chunks: pa.Table) -> pa.Table:
        found_q, found_c, found_s = [], [], []
        if queries.num_rows and chunks.num_rows:
            chunks = chunks.sort_by("id")
            q, c = unit_rows(queries["_v"]), (decode or unit_rows)(chunks["_v"])
            for mine, theirs in shared_blocks(queries, chunks):
                block, take = c[theirs], min(k, len(theirs))
                at_once = min(256, 1 + AT_ONCE // len(theirs))
                for lo in range(0, len(mine), at_once):
                    part = mine[lo : lo + at_once]
                    best, sims = _nearest(q[part], block, take)
                    found_q.append(np.repeat(part, take))
                    found_c.append(theirs[best].ravel())
                    found_s.append(sims.ravel())
        if not found_q:
            return schema.empty_table()
        columns = [
            queries["query_id"].take(pa.array(np.concatenate(found_q))),
            chunks["id"].take(pa.array(np.concatenate(found_c))),
            pa.array(np.concatenate(found_s)),
        ]
        return pa.table(columns, schema=schema)

    return run


def block_sizes(df: DataFrame, block: Sequence[str]) -> DataFrame:
    return df.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"))


def _parts(sizes: DataFrame, block: Sequence[str], rows: int, out: str) -> DataFrame:
    """Blocks with more than ``rows`` rows and the number of parts they need: at most (all rows) / rows."""
    large = sizes.filter(F.col("_n") > rows)
    return large.select(*block, F.ceil(F.col("_n") / rows).cast("int").alias(out))


def _kept(sizes: DataFrame, block: Sequence[str]) -> DataFrame:
    """Sizes that are computed once, stored under names of their own."""
    held = staged(sizes.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(block)], "_n"), "sizes")
    return held.select(*[F.col(f"_k{i}").alias(b) for i, b in enumerate(block)], "_n")


def block_topk(
    queries: DataFrame,
    chunks: DataFrame,
    q_sizes: DataFrame,
    c_sizes: DataFrame,
    block: Sequence[str],
    k: int,
    q_rows: int,
    c_rows: int,
    decode: Callable | None = None,
    cell: Callable | None = None,
    counted: Sequence[str] = (),
) -> DataFrame:
    """(query_id, id, similarity): top k per query and cell. Inputs hold ``block`` columns and ``_v``.

    ``cell(k, schema)`` may give another search of a cell, which adds the numbers named in ``counted``.

    Small blocks share a group, so that many small owners do not mean as many calls into Python; a large
    block is cut into a grid of cells, each query part meeting each chunk part once. A cell has at most about ``q_rows``
    queries, fewer where ``k`` is large, and ``c_rows`` chunks, and there are more partitions than cells: cells are
    few bytes and much work, so they are not gathered by their size. The sizes only shape the groups; they are computed
    once. The broadcast sides are bounded, see ``_parts``.
    """
    q_rows = max(1, min(q_rows, HITS // k))
    q_sizes, c_sizes = (_kept(sizes, block) for sizes in (q_sizes, c_sizes))
    q_parts = F.broadcast(_parts(q_sizes, block, q_rows, "_qn"))
    c_parts = F.broadcast(_parts(c_sizes, block, c_rows, "_cn"))
    slots = 0
    for sizes, rows in ((q_sizes, q_rows), (c_sizes, c_rows)):
        slots += -(-4 * (sizes.agg(F.sum("_n")).first()[0] or 0) // rows)
    slots = max(1, slots)
    grids = q_parts.join(c_parts, list(block), "full").select(F.coalesce("_qn", F.lit(1)) * F.coalesce("_cn", F.lit(1)))
    tasks = min(MOST_TASKS, 2 * (slots + (grids.agg(F.sum(grids[0])).first()[0] or 0)))

    def cells(df: DataFrame, own: str, other: str, n_own: str, n_other: str, row_id: str) -> DataFrame:
        sized = df.join(q_parts, list(block), "left").join(c_parts, list(block), "left")
        parts = F.coalesce(F.col(n_own), F.lit(1))
        copies = F.sequence(F.lit(0), F.coalesce(F.col(n_other), F.lit(1)) - 1)
        large = F.coalesce(n_own, n_other).isNotNull()
        return sized.select(
            row_id,
            "_v",
            F.concat_ws("|", *[F.col(b).cast("string") for b in block]).alias("_b"),
            F.when(large, F.xxhash64(*block)).otherwise(F.pmod(F.xxhash64(*block), F.lit(slots))).alias("_slot"),
            F.pmod(F.xxhash64(row_id), parts).cast("int").alias(own),
            F.explode(copies).alias(other),
        ).repartition(tasks, *grid)

    grid = ["_slot", "_q", "_c"]
    left = cells(queries, "_q", "_c", "_qn", "_cn", "query_id").groupBy(*grid)
    right = cells(chunks, "_c", "_q", "_cn", "_qn", "id").groupBy(*grid)
    out = T.StructType(
        [
            queries.schema["query_id"],
            chunks.schema["id"],
            T.StructField("similarity", T.DoubleType()),
            *[T.StructField(name, T.LongType()) for name in counted],
        ]
    )
    schema = to_arrow_schema(out)
    run = cell(k, schema) if cell else _cell_topk(k, schema, decode)
    return left.cogroup(right).applyInArrow(run, out)


def usable(df: DataFrame, dims: int, *cols: str) -> DataFrame:
    """Rows with an owner and a vector of the right length that is not zero, the vector as ``_v``.

    The choice is made by an explode of zero or one vector: a filter would be pushed below the embedding
    and compute it once more for each use.
    """
    one = let(
        F.col("embedding"),
        lambda v: F.when(has_dim(v, dims) & (norm(v) > 0), F.array(v)),
    )
    # New column identities, so that queries and chunks may come from the same table.
    named = [F.col(c).alias(c) for c in cols]
    return df.filter(F.col("owner").isNotNull()).select(*named, F.explode(one).alias("_v"))


def final_rank(hits: DataFrame, k: int) -> DataFrame:
    return top_per_key(hits, ["query_id"], [F.desc(F.round("similarity", 9)), F.asc("id")], k)


def knn_join(
    queries: DataFrame,
    chunks: DataFrame,
    dims: int,
    k: int = TOP_K,
    q_rows: int = 20_000,
    c_rows: int = 50_000,
) -> DataFrame:
    """(query_id, id, similarity, rank): the k nearest chunks of the same owner for every query, exactly.

    Inputs are ``(query_id, owner, embedding)`` and ``(id, owner, embedding)``. Each query part of an owner meets each of
    its chunk parts, so the copies that are shuffled grow with the square of an owner's rows. Where an owner has more than
    ``ROUND_PARTS`` chunk parts, its chunks are searched in rounds, each with the files of its own shuffle only; the best k of a
    round are staged. The inputs are then read once a round.
    """
    q = usable(queries, dims, "query_id", "owner")
    c = usable(chunks, dims, "id", "owner")
    by = ["owner"]
    # Counted before unusable vectors are left out, so that the count need not read the vectors.
    sizes = [block_sizes(df.select(F.col("owner").alias("owner")), by) for df in (queries, chunks)]
    largest = sizes[1].agg(F.max("_n")).first()[0] or 0
    rounds = -(-largest // (ROUND_PARTS * c_rows))
    if rounds <= 1:
        return final_rank(block_topk(q, c, *sizes, by, k, q_rows, c_rows), k)
    q_sizes, c_sizes = (_kept(x, by) for x in sizes)
    # A hash of its own: the parts of a round are cut by the hash of the id.
    own = F.pmod(F.xxhash64(F.lit("round"), "id"), F.lit(rounds))
    share = c_sizes.withColumn("_n", F.ceil(F.col("_n") / rounds))
    found = None
    for number in range(rounds):
        best = final_rank(block_topk(q, c.filter(own == number), q_sizes, share, by, k, q_rows, c_rows), k).drop("rank")
        best = staged(best, "round")
        found = best if found is None else found.unionByName(best)
    return final_rank(found, k)


def signatures(df: DataFrame, dims: int, tables: int, bits: int, seed: int) -> DataFrame:
    """One row per table with the bucket of ``_v``: the signs of its projections on random directions."""
    planes = np.random.RandomState(seed).normal(size=(dims, tables * bits))
    weights = (1 << np.arange(bits)).astype("int64")

    @F.pandas_udf("array<long>")
    def buckets(v: pd.Series) -> pd.Series:
        signs = (np.stack(v.to_numpy()).astype("float64") @ planes > 0).reshape(len(v), tables, bits)
        return pd.Series(list((signs * weights).sum(axis=2)))

    return df.select("*", F.posexplode(buckets("_v")).alias("_table", "_bucket"))


def knn_approx(
    queries: DataFrame,
    chunks: DataFrame,
    dims: int,
    k: int = TOP_K,
    tables: int = 12,
    bits: int = 3,
    seed: int = 7,
    q_rows: int = 20_000,
    c_rows: int = 50_000,
) -> DataFrame:
    """As ``knn_join``, comparing only vectors that share a hash bucket in one of the tables.

    More tables raise recall, more bits cut the work. Candidates are ranked by their exact similarity, and
    every candidate of a bucket is compared. Owners of every size are searched in the same way.
    """
    q = signatures(usable(queries, dims, "query_id", "owner"), dims, tables, bits, seed)
    c = signatures(usable(chunks, dims, "id", "owner"), dims, tables, bits, seed)
    by = ["owner", "_table", "_bucket"]
    hits = block_topk(q, c, block_sizes(q, by), block_sizes(c, by), by, k, q_rows, c_rows)
    # The same pair may be found in several tables.
    return final_rank(hits.groupBy("query_id", "id").agg(F.max("similarity").alias("similarity")), k)


def ann_recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that the approximate search found."""
    found = approx.select("query_id", "id", F.lit(1.0).alias("_hit"))
    return exact.join(found, ["query_id", "id"], "left").agg(
        F.avg(F.coalesce("_hit", F.lit(0.0))).alias("recall"), F.count(F.lit(1)).alias("neighbours")
    )


# ---- reports ------------------------------------------------------------------------------------


def report_texts(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, report) for each query with hits ``(by, rank, similarity, chunk_text)``, in rank order."""
    line = filled(RESULT, F.col("rank").cast("string"), fixed4(F.col("similarity")), F.col("chunk_text"))
    ranked = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return hits.groupBy(by).agg(F.array_join(ranked["line"], "\n\n").alias("report"))


def search_report(hits: DataFrame, queries: DataFrame, by: str = "query_id", near: DataFrame | None = None) -> DataFrame:
    """Every query with its report; a fixed text where nothing was found.

    With ``near`` the hits are those that ``hits_with_text`` gives with it. Queries and texts of a part meet in one
    task, where the texts are held packed, unpacked for some reports at a time and put in order, so that no report and no
    copy of a text moves or is sorted.
    """
    if near is None:
        return queries.join(report_texts(hits, by), by, "left").select(
            *queries.columns, F.coalesce("report", F.lit(NOTHING_FOUND)).alias("report")
        )
    spread = near.select(F.countDistinct("part")).first()[0]
    tasks = max(1, 2 * spread)
    # Queries without a place, which have no hits, go anywhere.
    part = F.coalesce("part", F.pmod(F.xxhash64(*queries.columns), F.lit(tasks))).alias("part")
    asked = queries.join(near, by, "left").select(part, F.struct(*queries.columns).alias("_query"))
    dealt = hits.unionByName(asked, allowMissingColumns=True).repartition(tasks, "part")
    asks = hits.schema["_asks"].dataType.elementType
    found = T.StructType([asks["rank"], asks["similarity"], T.StructField("text", T.BinaryType())])
    out = T.StructType(
        [
            T.StructField("_queries", T.ArrayType(asked.schema["_query"].dataType)),
            T.StructField("_found", T.ArrayType(found)),
        ]
    )
    reports = dealt.groupBy("part").applyInArrow(_gathered(by, to_arrow_schema(out)), out)

    def line(hit: Column) -> Column:
        text = filled(RESULT, hit["rank"].cast("string"), fixed4(hit["similarity"]), hit["text"].cast("string"))
        return F.struct(hit["rank"].alias("rank"), text.alias("line"))

    ordered = F.array_sort(F.transform("_found", line))["line"]
    report = F.when(F.size("_found") > 0, F.array_join(ordered, "\n\n")).otherwise(F.lit(NOTHING_FOUND))
    return reports.select("_queries", report.alias("report")).select(F.explode("_queries").alias("_query"), "report").select(
        "_query.*", "report"
    )


@F.arrow_udf(T.BinaryType())
def _packed(texts: pa.Array) -> pa.Array:
    """Compressed texts behind their length in bytes."""
    zstd = pa.Codec("zstd")

    def pack(text: bytes) -> bytes:
        return len(text).to_bytes(4, "little") + zstd.compress(text, asbytes=True)

    # One text at a time: a list of all would be a second copy of the batch.
    return pa.array([pack(x.as_py()) if x.is_valid else None for x in texts.cast(pa.binary())], pa.binary())


def _gathered(by: str, schema: pa.Schema):
    """For one part: its queries and, as lists of (rank, similarity, text), all that was found for them, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = pa.Codec("zstd")
        held = pa.Table.from_batches(list(batches))
        packed, queries = held["_packed"], held["_query"].drop_null().combine_chunks()
        asks = held["_asks"].combine_chunks()
        source = np.repeat(np.arange(len(asks)), pc.list_value_length(asks).fill_null(0).to_numpy())
        asks = asks.flatten()
        # One number for each key, NULL too; keys that no query has are left out.
        keys = pa.chunked_array([queries.field(by), asks.field(by)]).combine_chunks()
        codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
        q_codes, a_codes = codes[: len(queries)], codes[len(queries) :]
        wanted = np.unique(q_codes)
        q_order, a_order = (np.argsort(x, kind="stable") for x in (q_codes, a_codes))
        q_at, a_at = (
            [np.searchsorted(x[order], wanted, side) for side in ("left", "right")]
            for x, order in ((q_codes, q_order), (a_codes, a_order))
        )
        # The length that stands before a packed text.
        length = np.array([int.from_bytes(x.as_buffer()[:4], "little") if x.is_valid else 0 for x in packed], dtype="int64")
        upto = np.concatenate([[0], np.cumsum(length[source[a_order]])])
        size = np.cumsum(upto[a_at[1]] - upto[a_at[0]])

        def unpack(row: int) -> bytes | None:
            whole = packed[row].as_buffer() if packed[row].is_valid else None
            return None if whole is None else zstd.decompress(whole[4:], int(length[row]), asbytes=True)

        def several(order: np.ndarray, at: list[np.ndarray], lo: int, hi: int) -> tuple[np.ndarray, pa.Array]:
            # Positions in the order of the keys and where each key's begin.
            begins, counts = at[0][lo:hi], at[1][lo:hi] - at[0][lo:hi]
            ends = np.concatenate([[0], np.cumsum(counts)])
            return order[np.arange(ends[-1]) + np.repeat(begins - ends[:-1], counts)], pa.array(ends, pa.int32())

        lo = 0
        while lo < len(wanted):
            full = np.searchsorted(size, REPORT_BYTES + (size[lo - 1] if lo else 0), "right")
            hi = min(lo + REPORTS, max(lo + 1, int(full)))
            mine, q_ends = several(q_order, q_at, lo, hi)
            found, a_ends = several(a_order, a_at, lo, hi)
            texts = pa.array([unpack(row) for row in source[found]], pa.binary())
            some = asks.take(pa.array(found))
            hits = pa.StructArray.from_arrays(
                [some.field("rank"), some.field("similarity"), texts], names=["rank", "similarity", "text"]
            )
            columns = [
                pa.ListArray.from_arrays(q_ends, queries.take(pa.array(mine))),
                pa.ListArray.from_arrays(a_ends, hits),
            ]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, schema)], schema=schema)
            lo = hi

    return run


def part_rows(chunks: DataFrame) -> int:
    """Queries of a part, fewer where texts are long: a task holds the packed texts that a part asks for."""
    mean = chunks.agg(F.avg(F.octet_length("chunk_text"))).first()[0] or 0
    return max(1, min(PART_ROWS, int(PART_BYTES // max(1, mean))))


def hits_with_text(hits: DataFrame, chunks: DataFrame, near: DataFrame | None = None, by: str = "query_id") -> DataFrame:
    """Hits with their ``chunk_text``.

    ``near`` (by, part) names a part for each query, see ``vector_index.neighbourhoods``. With it the result is for
    ``search_report``: one row per chunk and part with the compressed text and all that the part's queries ask of it.
    A text then moves once to each part, not once for each of its hits. What is asked is staged before any text moves, so
    that the files of the search are gone by then.
    """
    if near is None:
        return hits.join(chunks.select("id", "chunk_text"), "id", "inner")
    ask = F.struct(by, "rank", "similarity")
    asks = hits.join(near, by).groupBy("part", "id").agg(F.collect_list(ask).alias("_asks"))
    texts = chunks.filter(F.col("id").isNotNull()).select("id", _packed(F.col("chunk_text")).alias("_packed"))
    return texts.join(staged(asks, "asks"), "id").select("part", "_asks", "_packed")


def ingest_batch(docs: DataFrame, dims: int = 64) -> DataFrame:
    """Documents to stored chunks: split by headers, key, embed."""
    chunks = split_markdown(docs).withColumn("id", chunk_key(F.col("doc_id"), F.col("chunk_idx")))
    return hash_embed(chunks, dims=dims)


def cosine_pairs(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Similarity and distance of vectors paired by a key."""
    a = left.select(on, F.col("embedding").alias("_a"))
    b = right.select(on, F.col("embedding").alias("_b"))
    sim = cosine_similarity(F.col("_a"), F.col("_b"))
    return a.join(b, on).select(on, sim.alias("similarity"), (1 - sim).alias("distance"))
