"""Ranked lexical search over an index of K2-treaps.

The grid has a row per term and a column per document; a point holds the impact of the term in the document. A
K2-treap is a quadtree over the grid whose cells store the greatest impact below them. Cells with one child are
left out (compressed paths), so a shard has fewer than two cells per point.

1. Documents with terms and their terms are counted in one pass. Both totals enter the impacts.
2. Each task gathers its documents into *shards* of a bounded number of points. A shard's columns go by length, so
   that a range of columns has like impacts, and its rows by falling document frequency. Every row and every
   document of the table is indexed; shards are rows of a Parquet table.
3. An item descends each shard jointly along the row paths of its terms: a state is a range of columns with the
   cell that each term's row path has reached there, and its bound is the sum of weight times cell maximum. States
   are split best-first, a batch of the best per item at a time; ranges below the item's tenth score are dropped.
   A range of one column has its exact score. Nothing else is dropped, so the result is exact, ties included.
4. Each task returns the best of each item over its shards; a window ranks them.

Items come to the driver a block at a time, each block bounded by its number of (item, term) pairs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.store import folder, own_columns, written

#: Points and documents after which a shard is closed; only a single larger document makes a larger one.
SHARD_POINTS, SHARD_DOCS = 1 << 18, 1024
#: (item, term) pairs of a block of items that is sent to the tasks at once.
BLOCK_TERMS = 1 << 18
#: Cell paths that a task follows at a time: items are taken in groups of so many terms times columns at most.
GROUP_PATHS = 1 << 20
#: States that an item splits at a time at least; beyond them a quarter of its states.
BATCH = 16

#: Bytes of terms for themselves, A-Z in lower case, all others as spaces. Non-ASCII characters are terms whole.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_SHARD = "doc_ids binary, known binary, terms binary, dfs binary, cells binary"
_CELL = np.dtype([("row", "<i4"), ("col", "<i4"), ("first", "<i4"), ("top", "<i4"), ("level", "u1"), ("n", "u1")])


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order, with repeats."""
    return text.translate(_TERM_BYTES).split()


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2**31, each followed by a zero bit."""
    x = x.astype(np.uint64)
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF),
        (8, 0x00FF00FF00FF00FF),
        (4, 0x0F0F0F0F0F0F0F0F),
        (2, 0x3333333333333333),
        (1, 0x5555555555555555),
    ):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def treap(row: np.ndarray, col: np.ndarray, impact: np.ndarray) -> np.ndarray:
    """Cells of the compressed K2-treap of distinct points; the children of a cell stand together, the root is last.

    A cell of ``level`` j covers a square of 2**j rows and columns, named by any row and column in it. ``top`` is the
    greatest impact below it, ``first`` and ``n`` tell its children (none: a point).
    """
    code = (_spread(row) << np.uint64(1)) | _spread(col)
    order = np.argsort(code, kind="stable")
    code = code[order]
    live = np.zeros(len(order), dtype=_CELL)
    live["row"], live["col"], live["top"] = row[order], col[order], impact[order]
    done: list[np.ndarray] = []
    used, level = 0, 0
    while len(live) > 1:
        level += 1
        key = code >> np.uint64(2 * level)
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(begin, len(key)))
        joined = size > 1
        if not joined.any():
            continue
        inner = np.repeat(joined, size)
        done.append(live[inner])
        kept = live[begin]
        kept["level"][joined] = level
        kept["top"] = np.maximum.reduceat(live["top"], begin)
        sizes = size[joined]
        kept["first"][joined] = used + np.cumsum(sizes) - sizes
        kept["n"][joined] = sizes
        used += int(sizes.sum())
        live, code = kept, code[begin]
    return np.concatenate([*done, live])


class _Shard:
    """Documents of a shard that is being gathered."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.points = 0

    def add(self, doc: int | None, found: list[bytes]) -> None:
        counted = Counter(found)
        vocabulary = self.vocabulary
        size = len(counted)
        numbers = (vocabulary.setdefault(t, len(vocabulary)) for t in counted)
        self.terms.append(np.fromiter(numbers, np.int64, size))
        self.counts.append(np.fromiter(counted.values(), np.int64, size))
        self.ids.append(doc)
        self.lengths.append(len(found))
        self.points += size

    def row(self, docs: int, total: int) -> list[bytes]:
        """Values of the shard's row, given the number of documents with terms and of all their terms."""
        words = np.array(list(self.vocabulary), dtype=object)
        sizes = np.array([len(t) for t in self.terms])
        term, tf = np.concatenate(self.terms), np.concatenate(self.counts)
        dfs = np.bincount(term, minlength=len(words))
        by_df = np.argsort(-dfs, kind="stable")
        rank = np.empty(len(words), dtype=np.int64)
        rank[by_df] = np.arange(len(words))
        by_length = np.argsort(np.array(self.lengths), kind="stable")
        place = np.empty(len(by_length), dtype=np.int64)
        place[by_length] = np.arange(len(by_length))
        m = np.array([100 - 90 + (90 * n * docs) // total for n in self.lengths], dtype=np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, sizes))
        cells = treap(rank[term], np.repeat(place, sizes), impact)
        ids = np.array([i or 0 for i in self.ids], dtype="<i8")[by_length]
        known = np.array([i is not None for i in self.ids], dtype="u1")[by_length]
        # Compressed here, not by the file format: a batch of shards is small on its way, and one is opened at a time.
        packed = zstandard.ZstdCompressor(level=1).compress
        fields = packed(b"".join(cells[name].tobytes() for name in _CELL.names))
        terms, dfs = packed(b" ".join(words[by_df])), dfs[by_df].astype("<i4").tobytes()
        return [ids.tobytes(), known.tobytes(), terms, packed(dfs), fields]


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, total = 0, 0
    for batch in batches:
        for text in batch.column(0):
            n = len(terms_of(text.as_py()))
            docs, total = docs + (n > 0), total + n
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([total], pa.int64())], names=["docs", "total"])


def _gather(docs: int, total: int, points: int, columns: int):
    names = [c.split()[0] for c in _SHARD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(shard: _Shard) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in shard.row(docs, total)], names=names)

        held = _Shard()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                found = terms_of(text.as_py())
                if not found:
                    continue
                held.add(doc.as_py(), found)
                if held.points >= points or len(held.ids) >= columns:
                    yield closed(held)
                    held = _Shard()
        if held.ids:
            yield closed(held)

    return run


def build_index(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_points: int = SHARD_POINTS,
    shard_docs: int = SHARD_DOCS,
) -> None:
    """Index all rows of ``df`` below ``path``: ``path/totals`` and ``path/shards``.

    Texts without a term, NULL ones included, match nothing and count for nothing. Rows without an id and repeated
    rows are indexed like any other. An empty table makes an empty index. Other columns of ``df`` are not read.
    """
    spark = df.sparkSession
    docs = own_columns(df, doc_id=id_col, text=text_col).filter("text IS NOT NULL")
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    found = docs.select("text").mapInArrow(_totals, "docs long, total long")
    summed = found.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    summed.write.parquet(f"{path}/totals")
    totals = spark.read.parquet(f"{path}/totals").first()
    (
        docs.mapInArrow(_gather(totals["docs"], totals["total"], shard_points, shard_docs), _SHARD)
        .write.option("compression", "uncompressed")
        .parquet(f"{path}/shards")
    )


def _unpacked(data: pa.Buffer) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class _Index:
    """A shard opened for search."""

    def __init__(self, ids: pa.Buffer, known: pa.Buffer, terms: pa.Buffer, cells: pa.Buffer, wanted: dict[bytes, int]):
        self.ids = np.frombuffer(ids, "<i8")
        self.known = np.frombuffer(known, "u1")
        words = _unpacked(terms).split(b" ")
        #: Row of each wanted term, -1 where the shard has none.
        self.rows = np.full(len(wanted), -1, dtype=np.int32)
        for row, word in enumerate(words):
            if word in wanted:
                self.rows[wanted[word]] = row
        cells = _unpacked(cells)
        n, at = len(cells) // _CELL.itemsize, 0
        for name in _CELL.names:
            kind = _CELL[name]
            setattr(self, name, np.frombuffer(cells, kind, n, at))
            at += n * kind.itemsize
        side = max(len(words), len(self.ids))
        self.height = max(side - 1, 1).bit_length()

    def meets(self, cell: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Whether the squares of the cells hold the rows."""
        level = self.level[cell]
        return (self.row[cell] >> level) == (row >> level)


class Best:
    """The ``k`` best (score, document) of each item so far; equal scores go by the smaller id, no id last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item, self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.known = np.zeros(0, "u1")
        #: Scores below it cannot enter; scores of zero never do.
        self.least = np.ones(items, dtype=np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, score])
        doc, known = np.concatenate([self.doc, doc]), np.concatenate([self.known, known])
        order = np.lexsort((doc, -known.astype(np.int8), -score, item))
        order = order[_rank(item[order]) < self.k]
        self.item, self.score, self.doc, self.known = item[order], score[order], doc[order], known[order]
        full = _rank(self.item) == self.k - 1
        self.least[self.item[full]] = np.maximum(self.score[full], 1)


def _rank(group: np.ndarray) -> np.ndarray:
    """Number of each row within its run of equal groups, from 0."""
    if not len(group):
        return np.zeros(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return np.arange(len(group)) - np.repeat(begin, np.diff(np.append(begin, len(group))))


def search_shard(index: _Index, item: np.ndarray, row: np.ndarray, weight: np.ndarray, best: Best) -> None:
    """Descend one shard for (item, row, weight) entries sorted by item, adding to ``best``.

    Ranges (``r_*``) hold the item, level, column and bound; paths (``p_*``) the cell that a term's row path has
    reached in a range, sorted by range.
    """
    root = np.full(len(row), len(index.level) - 1, dtype=np.int32)
    on = index.meets(root, row)
    p_cell, p_row, p_weight, item = root[on], row[on], weight[on], item[on]
    if not len(item):
        return
    new = np.concatenate([[True], item[1:] != item[:-1]])
    p_range = np.cumsum(new) - 1
    r_item = item[new]
    r_level = np.full(len(r_item), index.height, dtype=np.int64)
    r_col = np.zeros(len(r_item), dtype=np.int64)
    r_bound = np.add.reduceat(p_weight * index.top[p_cell].astype(np.int64), np.flatnonzero(new))

    while len(r_item):
        # The best ranges of each item are split, the others wait.
        order = np.lexsort((-r_bound, r_item))
        states = np.bincount(r_item)[r_item]
        chosen = np.zeros(len(r_item), dtype=bool)
        chosen[order] = _rank(r_item[order]) < np.maximum(BATCH, states[order] // 4)

        split = chosen[p_range]
        cell, prow, pweight, parent = p_cell[split], p_row[split], p_weight[split], p_range[split]
        half = r_level[parent] - 1
        branch = index.level[cell] > half
        # A cell smaller than the range stays whole in one half; another one is left for its children.
        got = [(parent[~branch], cell[~branch], prow[~branch], pweight[~branch])]
        inner, irow, iweight, iparent = cell[branch], prow[branch], pweight[branch], parent[branch]
        first, count = index.first[inner], index.n[inner]
        for k in range(4):
            has = np.flatnonzero(count > k)
            child = first[has] + np.int32(k)
            met = index.meets(child, irow[has])
            has, child = has[met], child[met]
            got.append((iparent[has], child, irow[has], iweight[has]))
        parent, cell, prow, pweight = (np.concatenate(x) for x in zip(*got, strict=True))
        half = r_level[parent] - 1
        col = index.col[cell] >> half
        side = col & 1

        order = np.argsort(parent * 2 + side, kind="stable")
        parent, cell, prow, pweight, col = parent[order], cell[order], prow[order], pweight[order], col[order]
        where = parent * 2 + side[order]
        new = np.concatenate([[True], where[1:] != where[:-1]]) if len(where) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        bound = np.add.reduceat(pweight * index.top[cell].astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
        n_item, n_level, n_col = r_item[parent[begin]], r_level[parent[begin]] - 1, col[begin]
        n_range = np.cumsum(new) - 1

        exact = (n_level == 0) & (bound >= best.least[n_item])
        if exact.any():
            at = n_col[exact]
            best.add(n_item[exact], bound[exact], index.ids[at], index.known[at])

        # What waited and the new ranges go on, if they can still reach the item's least score.
        stay = ~chosen & (r_bound >= best.least[r_item])
        grown = (n_level > 0) & (bound >= best.least[n_item])
        wait = stay[p_range]
        number = np.cumsum(stay) - 1
        grow = grown[n_range] if len(n_range) else np.zeros(0, bool)
        n_number = np.cumsum(grown) - 1 + int(stay.sum())
        p_range = np.concatenate([number[p_range[wait]], n_number[n_range[grow]]])
        p_cell = np.concatenate([p_cell[wait], cell[grow]])
        p_row = np.concatenate([p_row[wait], prow[grow]])
        p_weight = np.concatenate([p_weight[wait], pweight[grow]])
        r_item = np.concatenate([r_item[stay], n_item[grown]])
        r_level = np.concatenate([r_level[stay], n_level[grown]])
        r_col = np.concatenate([r_col[stay], n_col[grown]])
        r_bound = np.concatenate([r_bound[stay], bound[grown]])


def _search(item: np.ndarray, term: np.ndarray, terms: list[bytes], weights: np.ndarray, ids: list[int | None], k: int):
    """Search of a block of items: pairs (item, term), sorted by item, with numbers into ``ids`` and ``terms``."""

    wanted = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        for batch in batches:
            for at in range(batch.num_rows):
                index = _Index(*[batch.column(c)[at].as_buffer() for c in range(4)], wanted)
                rows = index.rows
                here = (rows[term] >= 0) & (weights[term] > 0)
                items, pairs = item[here], term[here]
                group = np.cumsum(np.full(len(items), len(index.ids))) // GROUP_PATHS
                # An item stays whole, in the group of its first pair.
                group = group[np.searchsorted(items, items)] if len(items) else group
                for g in np.unique(group):
                    own = group == g
                    search_shard(index, items[own], rows[pairs[own]], weights[pairs[own]], best)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([ids[i] for i in best.item.tolist()], pa.int64()),
                pa.array(best.doc, pa.int64(), mask=best.known == 0),
                pa.array(best.score, pa.int64()),
            ],
            names=["item_id", "doc_id", "score"],
        )

    return run


def _frequencies(terms: list[bytes]):
    wanted = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            for words, dfs in zip(batch.column(0), batch.column(1), strict=True):
                df = np.frombuffer(_unpacked(dfs.as_buffer()), "<i4")
                for i, word in enumerate(_unpacked(words.as_buffer()).split(b" ")):
                    number = wanted.get(word)
                    if number is not None:
                        total[number] += df[i]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(set(terms_of(t))) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"]
        )


def term_weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def search_index(
    spark: SparkSession,
    path: str,
    items: DataFrame,
    k: int = 10,
    id_col: str = "item_id",
    text_col: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, scores above 0 only.

    Equal scores rank by the smaller doc_id, rows without an id last; repeated documents take a rank each. Rows of one
    item_id are one item with the terms of all of them, NULL ids too; items without a term have no result.
    """
    totals = spark.read.parquet(f"{path}/totals").first()
    shards = spark.read.schema(_SHARD).parquet(f"{path}/shards")
    texts = items.select(
        F.col(f"`{id_col}`").cast("long").alias("item_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    pairs = texts.mapInArrow(_item_terms, "item_id long, terms array<binary>")
    pairs = written(pairs.select("item_id", F.explode("terms").alias("term")).distinct(), "item-terms")
    blocks = max(1, -(-pairs.count() // block_terms))
    found = None
    for block in range(blocks):
        mine = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toPandas()
        ids = sorted(mine["item_id"].dropna().astype("int64").unique().tolist())
        numbers: dict[int | None, int] = {i: n for n, i in enumerate(ids)}
        if mine["item_id"].isna().any():
            numbers[None], ids = len(ids), [*ids, None]
        words = sorted({bytes(t) for t in mine["term"]})
        term_of = {t: i for i, t in enumerate(words)}
        entries = sorted(
            (numbers[None if i != i else int(i)], term_of[bytes(t)])
            for i, t in zip(mine["item_id"], mine["term"], strict=True)
        )
        df = dict.fromkeys(range(len(words)), 0)
        counted = shards.select("terms", "dfs").mapInArrow(_frequencies(words), "term long, df long")
        df |= {r["term"]: r["df"] for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        weights = np.array([term_weight(totals["docs"], df[i]) for i in range(len(words))], dtype=np.int32)
        item, term = np.array(entries, dtype=np.int64).reshape(-1, 2).T.copy()
        part = shards.select("doc_ids", "known", "terms", "cells").mapInArrow(
            _search(item, term, words, weights, ids, k), "item_id long, doc_id long, score long"
        )
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def ranked_search(
    df: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    **options,
) -> DataFrame:
    """Index ``df`` in a new folder of the shared place and search it, see the two functions above."""
    path = folder(df.sparkSession, "lexical-index")
    build_index(df, path, id_col, text_col, **options)
    return search_index(df.sparkSession, path, items, k, item_col, item_text_col)
