"""SentencePiece ids of texts by suffix-array matching, and texts of ids; for BPE models with byte fallback.

Texts of about 4 MB are split at their spaces as one column, so that each distinct part is looked up once and the ids
are put together by position. The words that the worker has not met are concatenated in groups, a suffix array
of each group is sorted by its first characters (as many as the longest piece has), and every piece of the
vocabulary is found by binary search as a range of suffixes. The occurrences, sorted by position, are edges from
character to character. All words of a group are then relaxed side by side from left to right, the few longest one by
one. In a BPE vocabulary exactly one edge that ends at a character is the last piece of the segmentation up to it: the
one that stays apart from the piece before it when both are merged alone. So each position keeps one edge, and
the edges kept from the end of a word backwards are its pieces.

Words end before the space mark and, after a letter or digit, before those signs that no piece of the vocabulary has
there. No piece reaches over such a place, so words are segmented independently of each other. The signs are
found, and the mark is checked, when the model is loaded.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice
from struct import pack
from sys import intern
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.store import own_columns
from parley.llm.words import KEPT_CHARS, Memo, text_slices

MARK = "▁"
#: Words and pairs of pieces that a worker remembers, per generation.
WORDS, PAIRS = 200_000, 150_000
#: Bytes of texts that are split together, and characters of new words that are matched together (a longer one alone).
TEXT_BYTES, CHARS = 4 << 20, 1 << 17
#: Words of a length that are relaxed side by side, at least.
LANES = 64
_ALNUM = "A-Za-z0-9À-ÖØ-öø-ÿ"
#: Stands between words and after the end in the concatenated text; no character has this number.
_GAP = 0x110000
_UNKNOWN, _START, _NONE = -1, -2, -3
_NEVER = float("-inf")


def _rows(offsets: np.ndarray, data: pa.Buffer) -> pa.BinaryArray:
    """Bytes cut at the offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype("<i4")), data])


def _flat(column: pa.Array) -> tuple[np.ndarray, bytes]:
    """Offsets from 0 of a column of texts or bytes, and its bytes."""
    offsets = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1]
    return offsets - offsets[0], bytes((column.buffers()[2] or b"")[offsets[0] : offsets[-1]])


class PieceModel:
    """The vocabulary of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.plain = np.array([i for i in plain if self.texts[i]], dtype=np.int32)
        self.ids = {self.texts[i]: i for i in self.plain.tolist()}
        self.score = {t: model.get_score(i) for t, i in self.ids.items()}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = [t.replace(MARK, " ").encode() for t in self.texts]
        for i in range(n):
            if model.is_control(i) or model.is_unknown(i):
                self.raw[i] = b""
        for b, i in enumerate(self.bytes):
            self.raw[i] = bytes([b])
        self.raw_column = pa.array(self.raw, pa.binary())
        if any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError("a piece has the space mark behind another character: words depend on each other")
        joined = set("".join(re.findall(f"(?<=[{_ALNUM}])[!-/:-@\\[-`{{-~]", "\n".join(self.ids))))
        signs = re.escape("".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c not in joined))
        inside = f"[^{MARK}{signs}]+|(?<![{_ALNUM}])[{signs}]" if signs else f"[^{MARK}]+"
        self.word = re.compile(f"{MARK}*[^{MARK}](?:{inside})*|{MARK}+")
        self.longest = max(map(len, self.ids))
        table = np.full((len(self.plain), self.longest), 0, dtype=np.int64)
        self.lengths = np.array([len(self.texts[i]) for i in self.plain], dtype=np.int32)
        for row, i in enumerate(self.plain.tolist()):
            table[row, : self.lengths[row]] = [ord(c) for c in self.texts[i]]
        self.table = table
        self.words, self.pairs, self.traces = Memo(WORDS), Memo(PAIRS), {}

    def merges(self, piece: int) -> tuple[list[str], list[str], list[float]] | None:
        """BPE of a piece alone: first part, last part and next score after each merge; None if others than it come out.

        The best-scored neighbours merge first, the leftmost of equals.
        """
        if piece not in self.traces:
            parts = list(self.texts[piece])
            firsts, lasts, scores = [parts[0]], [parts[-1]], []
            while len(parts) > 1:
                found = [self.score.get(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
                best = max(found)
                if best == _NEVER:
                    break
                at = found.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                firsts.append(intern(parts[0]))
                lasts.append(intern(parts[-1]))
                scores.append(best)
            self.traces[piece] = (firsts, lasts, [*scores, _NEVER]) if len(parts) == 1 else None
        return self.traces[piece]

    def apart(self, first: int, second: int) -> bool:
        """Whether two neighbouring pieces stay as they are when merged alone; ``_START`` stands before a word."""
        key = (first + 2) * len(self.texts) + second + 2
        found = self.pairs.get(key)
        if found is None:
            found = self._apart(first, second)
            self.pairs.put(key, found)
        return found

    def _apart(self, first: int, second: int) -> bool:
        """Whether no merge over the border comes before the merges that are left on its two sides."""
        if first == _START or self.merges(second) is None or self.merges(first) is None:
            return first == _START and self.merges(second) is not None
        (_, lasts, left), (firsts, _, right) = self.merges(first), self.merges(second)
        over, i, j = self.score.get, 0, 0
        while True:
            score = over(lasts[i] + firsts[j], _NEVER)
            # Of equal scores the one on the left merges first.
            if score > left[i] and score >= right[j]:
                return False
            if left[i] == right[j] == _NEVER:
                return True
            if left[i] >= right[j]:
                i += 1
            else:
                j += 1

    def occurrences(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, rows of the table): all pieces in a concatenated text, sorted by position, short ones first."""
        n, longest = len(points), self.longest
        seen = np.zeros(_GAP + 1, dtype=bool)
        seen[points] = True
        alphabet = np.flatnonzero(seen)
        code = np.zeros(_GAP + 1, dtype=np.int32)
        code[alphabet] = np.arange(1, len(alphabet) + 1)
        # Behind the end stands 0, as in the places of pieces with characters that the text has not.
        text = np.concatenate([code[points], np.zeros(longest, dtype=np.int32)])
        inside = np.arange(longest) < self.lengths[:, None]
        coded = np.where(inside, code[self.table], 0)
        open_ = np.flatnonzero(((coded > 0) | ~inside).all(axis=1))
        del seen, code, inside
        bits = max(1, int(len(alphabet)).bit_length())
        # Ranks of suffixes, and of pieces, by the characters so far; then by as many more as fit into a number with them.
        rank, piece_rank, done = np.zeros(n, dtype=np.int64), np.zeros(len(open_), dtype=np.int64), 0
        first, last = np.zeros(len(self.plain), dtype=np.int64), np.zeros(len(self.plain), dtype=np.int64)
        while True:
            width = min(longest - done, max(1, (62 - n.bit_length()) // bits))
            for k in range(done, done + width):
                rank = (rank << bits) | text[k : k + n]
                piece_rank = (piece_rank << bits) | coded[open_, k]
            done += width
            suffixes = np.argsort(rank)
            rank = rank[suffixes]
            # Binary search: a piece that ends here is the range of suffixes that have any characters behind it.
            ending = self.lengths[open_] <= done
            low, free = piece_rank[ending], bits * (done - self.lengths[open_[ending]].astype(np.int64))
            first[open_[ending]] = np.searchsorted(rank, low)
            last[open_[ending]] = np.searchsorted(rank, low + (np.int64(1) << free))
            if done == longest:
                break
            begins = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]])[:n])
            distinct = rank[begins]
            at = np.searchsorted(distinct, piece_rank)
            going = ~ending & (at < len(distinct))
            going[going] = distinct[at[going]] == piece_rank[going]
            open_, piece_rank = open_[going], at[going]
            rank = np.empty(n, dtype=np.int64)
            rank[suffixes] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, n)))
        counts = last - first
        rows = np.repeat(np.arange(len(self.plain), dtype=np.int32), counts)
        positions = suffixes[np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]
        # At most one piece of each length begins at a position.
        places = np.full((n, longest), -1, dtype=np.int32)
        places[positions, self.lengths[rows] - 1] = rows
        flat = np.flatnonzero(places.ravel() >= 0)
        return flat // longest, places.ravel()[flat]

    def segment(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        ends = np.cumsum([len(w) for w in words])
        while at < len(words):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHARS, side="right")))
            out += self._segment(words[at:stop])
            at = stop
        return out

    def _segment(self, words: list[str]) -> list[bytes]:
        flat = "".join(words)
        points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        # One gap behind each word, so that no piece reaches into the next.
        spaced = np.full(len(points) + len(words), _GAP, dtype=np.int64)
        begins = np.cumsum(sizes + 1) - (sizes + 1)
        spaced[np.arange(len(points)) + np.repeat(np.arange(len(words)), sizes)] = points
        positions, rows = self.occurrences(spaced)
        pieces, lengths = self.plain[rows], self.lengths[rows]
        alone = spaced != _GAP
        alone[positions[lengths == 1]] = False
        strange = np.flatnonzero(alone)
        if len(strange):
            positions = np.concatenate([positions, strange])
            pieces = np.concatenate([pieces, np.full(len(strange), _UNKNOWN, dtype=np.int32)])
            lengths = np.concatenate([lengths, np.ones(len(strange), dtype=np.int32)])
            order = np.argsort(positions, kind="stable")
            positions, pieces, lengths = positions[order], pieces[order], lengths[order]
        from_word = np.searchsorted(positions, np.append(begins, len(spaced)))
        # The few longest words are relaxed one by one, all others side by side.
        limit = int(np.partition(sizes, -LANES)[-LANES]) if len(words) >= LANES else 0
        beside = sizes <= limit
        inside = positions - np.repeat(begins, np.diff(from_word))
        out = np.empty(len(words), dtype=object)
        if limit:
            of_beside = np.repeat(beside, np.diff(from_word))
            edges = positions[of_beside], inside[of_beside], lengths[of_beside], pieces[of_beside]
            out[beside] = self._relax_all(spaced, begins[beside], sizes[beside], *edges)
        for k in np.flatnonzero(~beside).tolist():
            part = slice(from_word[k], from_word[k + 1])
            ends = inside[part] + lengths[part]
            out[k] = self._relax(words[k], zip(inside[part].tolist(), ends.tolist(), pieces[part].tolist(), strict=True))
        return out.tolist()

    def _relax_all(self, spaced, begins, sizes, positions, inside, lengths, pieces) -> list[bytes]:
        """As ``_relax`` for many words: in each step the edges that start at one place of all words."""
        order = np.argsort(inside.astype(np.min_scalar_type(int(sizes.max()))), kind="stable")
        steps = np.searchsorted(inside[order], np.arange(int(sizes.max()) + 1))
        positions, pieces = positions[order], pieces[order]
        ends = positions + lengths[order]
        start, kept = np.zeros(len(spaced), dtype=np.int64), np.full(len(spaced), _NONE, dtype=np.int32)
        kept[begins] = _START
        for lo, hi in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
            at, end, piece = positions[lo:hi], ends[lo:hi], pieces[lo:hi]
            before = kept[at]
            open_ = np.flatnonzero((before != _NONE) & (kept[end] == _NONE))
            at, end, piece, before = at[open_], end[open_], piece[open_], before[open_]
            # A character outside the vocabulary stands alone, and no piece reaches over it.
            whole = piece == _UNKNOWN
            asked = np.flatnonzero(~whole)
            first = np.where(before[asked] == _UNKNOWN, _START, before[asked]).astype(np.int64)
            whole[asked] = self._apart_all((first + 2) * len(self.texts) + piece[asked] + 2)
            kept[end[whole]], start[end[whole]] = piece[whole], at[whole]
        # Backwards from the ends of the words, all ends of their pieces.
        taken = np.zeros(len(spaced), dtype=bool)
        place, first = begins + sizes, begins
        while len(place):
            taken[place] = True
            place = start[place]
            more = place > first
            place, first = place[more], first[more]
        taken = np.flatnonzero(taken)
        ids = kept[taken]
        counts = np.ones(len(ids), dtype=np.int64)
        strange = ids == _UNKNOWN
        if strange.any():
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in spaced[start[taken[strange]]].tolist()]
            counts[strange] = [len(x) for x in raw]
            ids = np.repeat(ids, counts)
            ids[np.repeat(strange, counts)] = np.array(self.bytes)[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        if len(ids) and ids.min() < 0:
            raise ValueError("a word has no segmentation")
        offsets = np.concatenate([[0], np.cumsum(counts)])[np.append(np.searchsorted(taken, begins), len(taken))]
        return _rows(offsets * 4, pa.py_buffer(ids.astype("<u4"))).to_pylist()

    def _apart_all(self, keys: np.ndarray) -> np.ndarray:
        """As ``apart`` for the keys of many pairs."""
        distinct, at = np.unique(keys, return_inverse=True)
        distinct = distinct.tolist()
        found = list(map(self.pairs.young.get, distinct))
        if None in found:
            for n, key in enumerate(distinct):
                if found[n] is None:
                    first, second = divmod(key - 2, len(self.texts))
                    found[n] = self.apart(first - 2, second)
        return np.array(found, dtype=bool)[at]

    def _relax(self, word: str, edges: Iterable[tuple[int, int, int]]) -> bytes:
        """Keep one edge per character where it ends; edges come sorted by where they start."""
        n = len(word)
        start, kept = [0] * (n + 1), [_NONE] * (n + 1)
        kept[0] = _START
        size, known, apart = len(self.texts), self.pairs.young.get, self.apart
        for at, end, piece in edges:
            if kept[end] == _NONE and kept[at] != _NONE:
                # A character outside the vocabulary stands alone, and no piece reaches over it.
                if piece == _UNKNOWN or kept[at] == _UNKNOWN:
                    whole = piece == _UNKNOWN or apart(_START, piece)
                else:
                    whole = known((kept[at] + 2) * size + piece + 2)
                    if whole is None:
                        whole = apart(kept[at], piece)
                if whole:
                    start[end], kept[end] = at, piece
        out: list[int] = []
        while n:
            if kept[n] == _UNKNOWN:
                out += [self.bytes[b] for b in reversed(word[start[n] : n].encode("utf-8", "surrogatepass"))]
            else:
                out.append(kept[n])
            n = start[n]
        out.reverse()
        return pack(f"<{len(out)}I", *out)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts; NULL and empty texts have none."""
        split = [self.word.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        ids = iter(self._word_ids([w for words in split for w in words]))
        return [b"".join(islice(ids, len(words))) for words in split]

    def encode_all(self, texts: pa.Array) -> pa.BinaryArray:
        """As ``encode`` for a column, whose texts share the look-up of their distinct parts between spaces.

        Texts with a space at an end or next to another one, or with the mark, are split one by one.
        """
        texts = pc.fill_null(texts, "").cast(pa.string())
        uneven = pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " "))
        for sign in ("  ", MARK):
            uneven = pc.or_(uneven, pc.match_substring(texts, sign))
        uneven_rows = np.flatnonzero(uneven.to_numpy(zero_copy_only=False))
        alone = self.encode(texts.take(pa.array(uneven_rows)).to_pylist())
        split = pc.split_pattern(pc.if_else(uneven, "", texts), " ")
        bounds, coded = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        del split
        at, parts = coded.indices.to_numpy().copy(), coded.dictionary
        # The only part without characters is that of an empty text, or in the place of an uneven one.
        empty = np.flatnonzero(pc.equal(parts, "").to_numpy(zero_copy_only=False))
        marked = pc.binary_join_element_wise(pc.if_else(pc.equal(parts, ""), "", MARK), parts, "")
        words = self.word.findall(_flat(marked)[1].decode())
        begins = np.append(np.flatnonzero([w[0] == MARK for w in words]), len(words))
        begins = np.insert(begins, empty, begins[empty])
        ids = pa.array(self._word_ids(words), pa.binary())
        known = _rows(np.frombuffer(ids.buffers()[1], "<i4", len(words) + 1)[begins], ids.buffers()[2])
        at[bounds[uneven_rows]] = len(known) + np.arange(len(alone))
        ids = pa.concat_arrays([known, pa.array(alone, pa.binary())]).take(pa.array(at))
        return _rows(np.frombuffer(ids.buffers()[1], "<i4", len(at) + 1)[bounds], ids.buffers()[2])

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word; those not remembered are matched together."""
        found = list(map(self.words.young.get, words))
        if None not in found:
            return found
        missing = dict.fromkeys(w for w, x in zip(words, found, strict=True) if x is None)
        made = {w: x for w in missing if (x := self.words.old.get(w)) is not None}
        fresh = [w for w in missing if w not in made]
        made.update(zip(fresh, self.segment(fresh), strict=True))
        for word, ids in made.items():
            if len(word) <= KEPT_CHARS:
                self.words.put(word, ids)
        return [made[w] if x is None else x for w, x in zip(words, found, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, bytes as UTF-8, marks as spaces, without the one put in front."""
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(" ")

    def decode_all(self, ids: pa.BinaryArray) -> pa.StringArray:
        """As ``decode`` for a column without NULL."""
        offsets, data = _flat(ids)
        if (offsets % 4).any():
            raise ValueError("ids have four bytes each")
        raw = self.raw_column.take(pa.array(np.frombuffer(data, "<u4")))
        texts = _rows(_flat(raw)[0][offsets // 4], raw.buffers()[2])
        try:
            texts = texts.cast(pa.string())
        except pa.ArrowInvalid:
            texts = pa.array([x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.string())
        return pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts)


def piece_model(path: str) -> PieceModel:
    """The worker's model for a file, kept in a module entry of the process as functions travel by value."""
    held = sys.modules.setdefault("_parley_pieces", ModuleType("_parley_pieces"))
    if path not in held.__dict__:
        held.__dict__[path] = PieceModel(path)
    return held.__dict__[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            for part in text_slices(batch, TEXT_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), model.encode_all(part.column(1))], names=["doc_id", "ids"])

    return run


def encode(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids of each whole text, as little-endian unsigned 32-bit integers, one row per row of ``df``.

    NULL and empty texts have no ids. An empty table gives an empty result. Other columns of ``df`` are not read.
    """
    return own_columns(df, doc_id=id_col, text=text_col).mapInArrow(_encode(model_file), "doc_id long, ids binary")


def _decoded(model: PieceModel, doc_ids: pa.Array, ids: pa.BinaryArray) -> pa.RecordBatch:
    columns = [
        doc_ids,
        pa.array(np.diff(_flat(ids)[0]) // 4, pa.int64()),
        pa.array([zlib.crc32(x.as_buffer()) for x in ids], pa.int64()),
        model.decode_all(ids),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_crc32", "text"])


_DECODED = "doc_id long, n_tokens long, ids_crc32 long, text string"


def _decode(path: str, encoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            for part in text_slices(batch, TEXT_BYTES):
                given = part.column(1)
                ids = pc.fill_null(given, b"").cast(pa.binary()) if encoded else model.encode_all(given)
                yield _decoded(model, part.column(0), ids)

    return run


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, text) of the result of ``encode``; NULL ids are an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(model_file, True), _DECODED)


def round_trip(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, text_sha256): ids of each text, and the digest of the text decoded from them.

    Both steps run in one worker per task, so that the model and its memos are held once.
    """
    found = own_columns(df, doc_id=id_col, text=text_col).mapInArrow(_decode(model_file, False), _DECODED)
    return found.select("doc_id", "n_tokens", "ids_crc32", F.sha2(F.col("text"), 256).alias("text_sha256"))
