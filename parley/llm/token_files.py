"""Token ids in binary files: ids ranked by frequency, in byte-aligned variable length with separate control bytes.

Writing: texts are tokenised once, row by row, into a table of the shared folder; token counts over all of it rank
the vocabulary, so that the frequent tokens get the small numbers; each document's ranks are coded; the coded
documents are dealt into blocks between quantiles of their ids and gathered into shards. The only shuffle moves
coded bytes.

The code of a document with n numbers is ceil(n / 4) control bytes, two bits per number (its length in bytes less
one, first number lowest), then the numbers' bytes, lowest first. A shard is a header (magic, number of
documents), a table (id, whether it has one, numbers, coded bytes per document), all control bytes, all data bytes.
Each document starts at a byte, so a reader can take one without decoding the rest. Shards are rows of a Parquet
table next to the ranks, since Spark's committer then makes a lost task's files appear once or not at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.blocks import block_bounds, block_of, id_key
from parley.llm.store import folder, own_columns, written
from parley.llm.words import encoder, text_slices

MAGIC = b"PTK1"
#: Numbers after which a shard is closed; only a single longer document makes a larger one.
SHARD_TOKENS = 1 << 20
#: Rows that a task works on at a time, and bytes of text that it tokenises at a time (a longer text alone).
STEP = 256
TEXT_BYTES = 4 << 20
END = np.zeros(1, dtype="<u4").tobytes()

_TABLE = np.dtype([("id", "<i8"), ("known", "u1"), ("n", "<u4"), ("data", "<u4")])
#: Lengths of the four numbers of each control byte.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)


def encode_numbers(values: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray, bytes, np.ndarray]:
    """(control, control sizes, data, data sizes) of documents of ``counts`` unsigned 32-bit numbers each."""
    values = np.ascontiguousarray(values, dtype="<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    controls = -(-counts // 4)
    codes = np.zeros(int(controls.sum()) * 4, dtype=np.uint8)
    codes[_places(counts, controls)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8)[None, :] < size[:, None]]
    ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    last = np.cumsum(counts)
    return control.tobytes(), controls, data.tobytes(), ends[last] - ends[last - counts]


def _places(counts: np.ndarray, controls: np.ndarray) -> np.ndarray:
    """Where the numbers of each document stand if each document begins at a multiple of four."""
    skipped = np.cumsum(controls * 4) - controls * 4 - (np.cumsum(counts) - counts)
    return np.arange(int(counts.sum())) + np.repeat(skipped, counts)


def decode_numbers(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of documents of ``counts`` numbers each; lengths come from a table lookup per control byte."""
    size = LENGTHS[control].reshape(-1)[_places(counts, -(-counts // 4))]
    at = np.cumsum(size, dtype=np.int64) - size
    out = np.zeros(len(size), dtype=np.uint32)
    for byte in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > byte)
        out[has] |= data[at[has] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return out


def shard_bytes(rows: list[tuple[int | None, int, bytes, bytes]]) -> bytes:
    """A shard of (id, n, control, data) rows."""
    table = np.array([(i or 0, i is not None, n, len(d)) for i, n, _, d in rows], dtype=_TABLE)
    head = MAGIC + np.array([len(rows)], dtype="<u4").tobytes()
    return b"".join([head, table.tobytes(), *[r[2] for r in rows], *[r[3] for r in rows]])


def read_shard(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(table, numbers) of a shard: the rows of its documents and all their numbers, in order."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token shard")
    n_docs = int(np.frombuffer(payload, "<u4", 1, 4)[0])
    table = np.frombuffer(payload, _TABLE, n_docs, 8)
    raw = np.frombuffer(payload, np.uint8, offset=8 + table.nbytes)
    counts = table["n"].astype(np.int64)
    controls = int((-(-counts // 4)).sum())
    return table, decode_numbers(raw[:controls], raw[controls:], counts)


def _flat(ids: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of a column of little-endian unsigned 32-bit integers, without copying."""
    offsets = np.frombuffer(ids.buffers()[1], "<i4")[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
    if len(ids) == 0:
        return np.zeros(0, "<u4"), np.zeros(0, np.int64)
    flat = np.frombuffer(ids.buffers()[2], "<u4", (offsets[-1] - offsets[0]) // 4, int(offsets[0]))
    return flat, np.diff(offsets) // 4


def _binary(data: bytes, sizes: np.ndarray) -> pa.BinaryArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``STEP`` rows, so that work arrays stay small."""
    for at in range(0, batch.num_rows, STEP):
        yield batch.slice(at, STEP)


def _text_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return text_slices(batch, TEXT_BYTES)


def _tokenise(path: str):
    names = ["doc_id", "crc", "ids", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        total = np.zeros(words.vocabulary, dtype=np.int64)
        for batch in batches:
            for part in _text_slices(batch):
                coded = words.encode_all(part.column(1), END)
                crc = pa.array([zlib.crc32(x.as_buffer()) for x in coded], pa.int64())
                found = np.bincount(_flat(coded)[0])
                if len(found) > len(total):
                    total = np.concatenate([total, np.zeros(len(found) - len(total), dtype=np.int64)])
                total[: len(found)] += found
                columns = [part.column(0), crc, coded, pa.nulls(len(coded), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        if total.any():
            token = np.flatnonzero(total)
            counts = np.stack([token, total[token]]).astype("<i8").tobytes()
            columns = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, crc, ids, counts): ids of each whole text and the end id 0, as little-endian unsigned 32-bit integers.

    After its documents each task adds one row without ids, whose ``counts`` are its tokens and how often they occur.
    """
    return docs.select("doc_id", "text").mapInArrow(_tokenise(path), "doc_id long, crc long, ids binary, counts binary")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for counts in batch.column(0):
            token, n = np.frombuffer(counts.as_buffer(), "<i8").reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n)], names=["token", "n"])


def token_ranks(tokens: DataFrame) -> np.ndarray:
    """Tokens by falling frequency over all rows, ties by the smaller token: at most as many as the vocabulary."""
    counts = tokens.filter("counts IS NOT NULL").select("counts").mapInArrow(_count, "token long, n long")
    counts = counts.groupBy("token").agg(F.sum("n").alias("n"))
    ranked = counts.toPandas().sort_values(["n", "token"], ascending=[False, True], kind="stable")
    return ranked["token"].to_numpy(dtype=np.int64)


def _code(order: np.ndarray):
    rank = np.zeros(int(order.max(initial=0)) + 1, dtype=np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                flat, counts = _flat(part.column(2))
                control, controls, data, sizes = encode_numbers(rank[flat], counts)
                columns = [part.column(0), part.column(1), pa.array(counts)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, _binary(control, controls), _binary(data, sizes)],
                    names=["doc_id", "crc", "n", "control", "data"],
                )

    return run


def _gather(shard_tokens: int):
    names = ["part", "shard", "n_docs", "n_tokens", "payload"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, rows, held = None, 0, [], 0

        def close():
            values = [part, shard, len(rows), held, shard_bytes(rows)]
            columns = [pa.array([v], k) for v, k in zip(values, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for piece in _slices(batch):
                for block, *row in zip(*[c.to_pylist() for c in piece.columns], strict=True):
                    if rows and (block != part or held + row[1] > shard_tokens):
                        yield close()
                        shard, rows, held = (shard + 1 if block == part else 0), [], 0
                    part = block
                    rows.append(row)
                    held += row[1]
        if rows:
            yield close()

    return run


def write_token_files(
    df: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Write the ids of all texts of ``df`` below ``path``: ``path/shards`` and ``path/ranks``.

    Documents stand in ascending order of their id, NULL ids first; of equal ids the order follows the ids' crc32,
    so repeated rows stand together. A NULL text is empty and has the end id only. An empty table makes an empty set of
    shards. Other columns of ``df`` are not read.
    """
    spark = df.sparkSession
    tokens = written(tokenised(own_columns(df, doc_id=id_col, text=text_col), tokenizer), "tokens")
    order = token_ranks(tokens)
    tokens = tokens.filter("ids IS NOT NULL").select("doc_id", "crc", "ids")
    ranks = spark.createDataFrame([(i, int(t)) for i, t in enumerate(order)], "rank long, token long")
    ranks.write.parquet(f"{path}/ranks")
    block = block_of(id_key(), block_bounds(tokens.select(id_key().alias("key")), "key"))
    (
        tokens.mapInArrow(_code(order), "doc_id long, crc long, n long, control binary, data binary")
        .withColumn("block", block)
        .repartition("block")
        .sortWithinPartitions("block", F.col("doc_id").asc_nulls_first(), "crc")
        .select("block", "doc_id", "n", "control", "data")
        .mapInArrow(_gather(shard_tokens), "part int, shard int, n_docs long, n_tokens long, payload binary")
        .write.option("compression", "uncompressed")
        .parquet(f"{path}/shards")
    )


def _open(order: np.ndarray, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, payload in zip(*[batch.column(i) for i in range(3)], strict=True):
                table, numbers = read_shard(payload.as_buffer().to_pybytes())
                ids, n = order[numbers].astype("<u4"), table["n"].astype(np.int64)
                ends = np.cumsum(n)
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array([part.as_py()] * len(n), pa.int32()),
                    pa.array([shard.as_py()] * len(n), pa.int32()),
                    pa.array(table["id"], pa.int64(), mask=table["known"] == 0),
                    pa.array(ends - n),
                    pa.array(n),
                    pa.array(crc, pa.int64()),
                ]
                names = ["part", "shard", "doc_id", "before", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns.append(_binary(raw, 4 * n))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read_token_files(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of all documents of the files, read from their shards.

    ``start`` is the number of ids of all documents before. Totals per part are summed first, then shards within a
    part, so that the windows hold one row per part or the shards of one part.
    """
    shards = spark.read.parquet(f"{path}/shards")
    ranked = spark.read.parquet(f"{path}/ranks").toPandas().sort_values("rank")
    order = ranked["token"].to_numpy(dtype=np.int64)
    sizes = shards.select("part", "shard", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    parts = parts.select("part", before(Window.orderBy("part")).alias("part_start"))
    starts = sizes.select("part", "shard", before(Window.partitionBy("part").orderBy("shard")).alias("shard_start"))
    kind = "part int, shard int, doc_id long, before long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    docs = shards.select("part", "shard", "payload").mapInArrow(_open(order, keep_ids), kind)
    start = (F.col("part_start") + F.col("shard_start") + F.col("before")).alias("start")
    kept = ["ids"] if keep_ids else []
    return (
        docs.join(starts.join(parts, "part"), ["part", "shard"]).select("doc_id", start, "n_tokens", "ids_crc32", *kept)
    )


def token_files(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write the files into a new folder of the shared place and read them back, see the two functions above."""
    path = folder(df.sparkSession, "token-files")
    write_token_files(df, path, tokenizer, id_col, text_col, **options)
    return read_token_files(df.sparkSession, path)
