"""Trie of conversation prefixes, from sorted sequences and range minima over their common prefixes.

1. Turns become 128-bit hashes of (role, text); a conversation is the string of its hashes, so texts are shuffled
   nowhere. Shared openings are put in front by a join on the conversation they come from.
2. Conversations are dealt into blocks by ranges of (sequence, conv_id) and sorted. In a block, the lengths of the
   common prefixes of neighbours (LCPs) fill a sparse table of range minima. Every prefix that a row adds to
   its predecessor is a candidate: by halving steps over the table it finds the last row that shares it, and the first
   row that shares its parent, each on its own, without a stack. The interval of rows gives members, the smallest
   conversation (a second table of minima), and, since nodes stand in the order of (first row, depth), its subtree
   as a range of a running sum.
3. A node whose interval reaches neither the first nor the last row of its block is whole. The others are prefixes of
   those two rows; their parts are merged by a hash of the prefix. Only sums, minima and chunks of member ids meet
   there, so a prefix that a third of all conversations share is one row per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.store import written

#: Turns per block, roughly: what a task holds at a time, if no single conversation is longer.
BLOCK_TURNS = 1 << 17
#: Member ids that are joined into one chunk.
CHUNK = 512
#: Characters of a turn's hash.
UNIT = 32
NO_MEMBERS = hashlib.sha256(b"").hexdigest()

_NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_BORDER = "digest binary, parent binary, block int, chain int, chars long, first_end long, ends array<string>"


def opening_of(conv_id: F.Column, kinds: int = 6) -> F.Column:
    """How many turns a conversation shares with the head of its hundred."""
    return F.crc32(conv_id.cast("string").cast("binary")) % kinds


def rebuilt(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_id, sequence, chars): conversations that open with the first turns of the head of their hundred.

    ``sequence`` joins the hashes of the turns, ``chars`` holds their lengths in code points. Turns without a number
    come first, turns of one number go by hash; NULL roles and texts are empty; repeated rows are turns of their
    own. Rows without a conversation id are left out.
    """
    role = F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(""))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    turn = F.col(f"`{turn_col}`").cast("long")
    rows = df.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.struct(
            turn.isNotNull().alias("known"),
            turn.alias("turn"),
            F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("hash"),
            F.char_length(text).alias("chars"),
        ).alias("turn"),
    ).filter("conv_id IS NOT NULL")
    own = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    own = written(own.withColumn("turns", F.transform("turns", lambda t: F.struct(t["hash"], t["chars"]))), "turns")
    head = F.col("conv_id") % 100
    heads = own.filter(head == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, 5).alias("head"))
    shared = opening_of(F.col("conv_id")).cast("int")
    turns = F.concat(
        F.coalesce(F.slice("head", F.lit(1), shared), F.slice("turns", 1, 0)),
        F.slice("turns", shared + 1, F.greatest(F.size("turns") - shared, F.lit(0))),
    )
    joined = own.withColumn("head_id", F.col("conv_id") - head).join(heads, "head_id", "left")
    return joined.select("conv_id", turns.alias("turns")).select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["hash"]), "").alias("sequence"),
        F.transform("turns", lambda t: t["chars"].cast("long")).alias("chars"),
    )


class Minima:
    """Sparse table of range minima: entry i of level k covers the values from i to i + 2**k - 1."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima of the ranges from ``first`` to ``last``, both included."""
        level = np.log2(last - first + 1).astype(np.int64)
        out = np.empty(len(first), dtype=self.levels[0].dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][first[at]], self.levels[k][last[at] + 1 - (1 << int(k))])
        return out

    def right(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last row down to which all values after ``row`` are at least ``depth``."""
        at, n = row.copy(), len(self.levels[0])
        for k in reversed(range(len(self.levels))):
            fits = np.flatnonzero(at + (1 << k) < n)
            fits = fits[self.levels[k][at[fits] + 1] >= depth[fits]]
            at[fits] += 1 << k
        return at

    def left(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first row from which on all values up to ``row``'s own are at least ``depth``."""
        at = row.copy()
        for k in reversed(range(len(self.levels))):
            fits = np.flatnonzero(at >= 1 << k)
            fits = fits[self.levels[k][at[fits] - (1 << k) + 1] >= depth[fits]]
            at[fits] -= 1 << k
        return at


def common_turns(a: str, b: str) -> int:
    """How many whole turns two sequences begin with alike."""
    low, high = 0, min(len(a), len(b)) // UNIT
    if a[: high * UNIT] == b[: high * UNIT]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low * UNIT : middle * UNIT] == b[low * UNIT : middle * UNIT]:
            low = middle
        else:
            high = middle
    return low


def _digests(sequence: str) -> list[bytes]:
    """A hash of each prefix of whole turns, from the empty one on."""
    out = [b"\0" * 16]
    for at in range(0, len(sequence), UNIT):
        out.append(hashlib.md5(out[-1] + sequence[at : at + UNIT].encode()).digest())
    return out


def _chunks(ids: np.ndarray) -> list[str]:
    return [",".join(map(str, ids[at : at + CHUNK].tolist())) for at in range(0, len(ids), CHUNK)]


def nodes_of(ids: np.ndarray, sequences: list[str], chars: np.ndarray, block: int) -> tuple[list[tuple], list[tuple]]:
    """(whole nodes, border parts) of one sorted block, as rows of ``_NODE`` and of both schemas.

    ``chars`` are the lengths of all turns, row after row.
    """
    n = len(ids)
    length = np.array([len(s) // UNIT for s in sequences], dtype=np.int64)
    lcp = np.array([0, *map(common_turns, sequences[:-1], sequences[1:])], dtype=np.int64)
    shared, smallest = Minima(lcp), Minima(ids)

    # Candidates: the prefixes that a row does not share with the row before, by (row, depth).
    added = length - lcp
    begin = np.concatenate([[0], np.cumsum(added)])
    row = np.repeat(np.arange(n), added)
    depth = np.arange(len(row)) - begin[row] + lcp[row] + 1
    last = shared.right(row, depth)
    up = shared.left(row, depth - 1)
    parent = np.where(depth > 1, begin[up] + depth - 2 - lcp[up], -1)
    conv = smallest.least(row, last)
    convs = last - row + 1
    text = chars[(np.cumsum(length) - length)[row] + depth - 1]
    whole = (row > 0) & (last < n - 1)

    # Rows of one sequence stand together; the run of a row's equals begins at the row that adds its whole length.
    new = np.concatenate([[True], (lcp[1:] < length[1:]) | (length[:-1] != length[1:])])
    run_end = np.append(np.flatnonzero(new), n)[np.cumsum(new)]

    counted = np.bincount(parent[whole & (depth > 1)], minlength=len(row)) if len(row) else np.zeros(0, np.int64)
    leaf = whole & (counted == 0)
    saved = np.where(whole, (convs - 1) * text, 0)
    leaves, saving = (np.concatenate([[0], np.cumsum(x)]) for x in (leaf, saved))
    over = begin[last + 1]
    n_leaves, n_saved = leaves[over] - leaves[:-1], saving[over] - saving[:-1]

    chains = [_digests(sequences[0]), _digests(sequences[-1])]
    out: list[tuple] = []
    for i in np.flatnonzero(whole).tolist():
        r, d, p = int(row[i]), int(depth[i]), int(parent[i])
        ends = ids[r : run_end[r]] if d == length[r] else ids[:0]
        digest = hashlib.sha256(",".join(map(str, ends.tolist())).encode()).hexdigest()
        above = int(conv[p]) if d > 1 and whole[p] else None
        border = None if above is not None else chains[0 if up[i] == 0 else 1][d - 1]
        out.append((int(conv[i]), d, above, int(convs[i]), int(counted[i]), int(n_leaves[i]), int(n_saved[i]), digest, border))

    # The prefixes of the first and of the last row; those of both belong to the first.
    both = common_turns(sequences[0], sequences[-1])
    tops = int((whole & (depth == 1)).sum())
    empty = ids[: run_end[0]] if length[0] == 0 else ids[:0]
    parts: list[tuple] = []
    for chain, (at, digests) in enumerate(zip((0, n - 1), chains, strict=True)):
        depths = np.arange(1, len(digests))
        firsts = shared.left(np.full(len(depths), at), depths)
        for d, digest in enumerate(digests):
            above = digests[d - 1] if d else None
            if chain and d <= both:
                parts.append((None, d, None, 0, 0, 0, 0, None, digest, above, block, chain, None, None, None))
                continue
            if d == 0:
                values, ends, size = (int(ids.min()), n, tops, int(leaves[-1]), int(saving[-1])), empty, 0
            else:
                r = int(firsts[d - 1])
                i = int(begin[r] + d - 1 - lcp[r])
                values = (int(conv[i]), int(convs[i]), int(counted[i]), int(n_leaves[i]), int(n_saved[i]))
                ends, size = ids[r : run_end[r]] if d == length[r] else ids[:0], int(text[i])
            held = _chunks(ends) or None
            first = int(ends[0]) if held else None
            parts.append((values[0], d, None, *values[1:], None, digest, above, block, chain, size, first, held))
    return out, parts


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    ids = table.column(0).to_numpy()
    chars = pa.concat_arrays([c.flatten() for c in table.column(2).chunks]).to_numpy(zero_copy_only=False)
    whole, parts = nodes_of(ids, table.column(1).to_pylist(), chars, TaskContext.get().partitionId())
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    kinds += [pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string())]
    names = [c.split()[0] for c in f"{_NODE}, {_BORDER}".split(", ")]
    rows = [(*r, None, None, None, None, None, None) for r in whole] + parts
    for at in range(0, len(rows), 4096):
        columns = zip(*rows[at : at + 4096], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 per digest of its chunks in order, joined with commas, one chunk in memory at a time."""
    now, state = None, None

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["digest", "ends_sha256"]
        )

    for batch in batches:
        for digest, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest != now:
                if state is not None:
                    yield closed()
                now, state = digest, hashlib.sha256(chunk.encode())
            else:
                state.update(b"," + chunk.encode())
    if state is not None:
        yield closed()


def _merged(parts: DataFrame) -> DataFrame:
    """Border nodes from their parts: ``_NODE`` without the parent's conversation, and (digest, parent)."""
    total = lambda c: F.sum(c).alias(c)
    met = written(
        parts.groupBy("digest").agg(
            F.min("conv_id").alias("conv_id"),
            F.min("depth").alias("depth"),
            F.min("parent").alias("parent"),
            F.max("chars").alias("chars"),
            F.min(F.struct("block", "chain")).alias("home"),
            *[total(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        ),
        "trie-border",
    )
    inner = met.groupBy(F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("inner"))
    met = met.join(inner.filter("digest IS NOT NULL"), "digest", "left")
    met = met.withColumn("n_children", F.col("n_children") + F.coalesce("inner", F.lit(0))).drop("inner")
    own = met.select(
        "digest",
        "home",
        (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    # Each border node counts once, in one chain that holds it; that chain holds all nodes above it as well.
    below = Window.partitionBy("block", "chain").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    mine = F.col("home") == F.struct("block", "chain")
    sums = (
        parts.select("digest", "block", "chain", "depth")
        .join(own, "digest")
        .select(
            "digest",
            F.sum(F.when(mine, F.col("leaf")).otherwise(0)).over(below).alias("more_leaves"),
            F.sum(F.when(mine, F.col("saved")).otherwise(0)).over(below).alias("more_saved"),
        )
        .groupBy("digest")
        .agg(total("more_leaves"), total("more_saved"))
    )
    chunks = parts.filter("ends IS NOT NULL").select("digest", "first_end", F.posexplode("ends").alias("number", "chunk"))
    ends = (
        chunks.repartition("digest")
        .sortWithinPartitions("digest", "first_end", "number")
        .select("digest", "chunk")
        .mapInArrow(_joined, "digest binary, ends_sha256 string")
    )
    return met.join(sums, "digest").join(ends, "digest", "left").select(
        "digest",
        "parent",
        "conv_id",
        "depth",
        "n_convs",
        "n_children",
        (F.col("n_leaves") + F.col("more_leaves")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("more_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256"),
    )


def prefix_trie(sequences: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The nodes of ``sequences`` (conv_id, sequence, chars), one row each.

    A node is a distinct beginning of a sequence, the empty one (the root) included: (conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256). ``conv_id`` must be unique and not NULL. An empty table
    has no node. Conversations without turns are members of the root only.
    """
    spark = sequences.sparkSession
    kept = written(sequences.select("conv_id", "sequence", "chars"), "rebuilt")
    size = kept.agg(F.min("conv_id").alias("root"), F.sum(F.size("chars") + 1).alias("turns")).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(least, -(-(size["turns"] or 0) // block_turns))
    found = (
        kept.repartitionByRange(blocks, "sequence", "conv_id")
        .sortWithinPartitions("sequence", "conv_id")
        .mapInArrow(_block, f"{_NODE}, {_BORDER}")
    )
    found = written(found, "trie")
    border = written(_merged(found.filter("chain IS NOT NULL")), "trie-merged")
    above = border.select("digest", F.col("conv_id").alias("above"))
    columns = [c.split()[0] for c in _NODE.split(", ")]
    nodes = found.filter("chain IS NULL").select(*columns, "digest")
    # The root is above most nodes; its conversation is one number.
    root = F.lit(size["root"]).cast("long")
    inside = nodes.filter("parent_conv_id IS NOT NULL OR depth = 1")
    inside = inside.withColumn("parent_conv_id", F.coalesce("parent_conv_id", root))
    outside = nodes.filter("parent_conv_id IS NULL AND depth > 1").join(above, "digest")
    outside = outside.withColumn("parent_conv_id", F.col("above"))
    tops = border.withColumnRenamed("digest", "own").join(above, border["parent"] == above["digest"], "left")
    tops = tops.withColumn("parent_conv_id", F.col("above"))
    return inside.select(*columns).unionByName(outside.select(*columns)).unionByName(tops.select(*columns))


def conversation_trie(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    **options,
) -> DataFrame:
    """The trie of the rebuilt conversations of ``df``, see the two functions above. Other columns are not read."""
    return prefix_trie(rebuilt(df, conv_col, turn_col, role_col, text_col), **options)
