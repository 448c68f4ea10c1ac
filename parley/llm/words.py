"""Token ids of whole texts by the tokenizers library, word by word with a bounded memo.

For the two public BPE layouts below, the library splits a text into words before it merges, and a word's ids do
not depend on its neighbours. Invented or natural prose repeats its words, so each distinct word goes through
the library's model once per worker and the ids of a text are joined from the memo. The split is done here
only for texts of Latin-1 characters without special tokens, where the letter, digit and space classes are the
short lists below; every other text, and every other layout, goes through the library whole. The ids are the
same in both ways. Many texts can share one split and one look-up of their distinct words (``encode_all``).
"""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Iterator
from struct import Struct, pack
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of one generation of a memo; a memo holds two, which bounds a worker's memory.
WORDS, CHUNKS = 50_000, 600_000
#: Longer words are not kept in the memo.
KEPT_CHARS = 64
#: Words of letters that a column's encoder remembers, and how many new ones go through the library at a time.
LETTERS, BULK = 500_000, 2_000

# The character classes of the layouts' patterns within Latin-1.
SPACE = "\t-\r \x85\xa0"
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
DIGIT = "0-9²³¹¼½¾"
SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"

_SPACES = "\t\n\v\f\r\x85\xa0"
_CHUNKS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_BYTE_WORDS = re.compile(
    f"{SUFFIXES}| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^{SPACE}{LETTER}{DIGIT}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
_LOWER_WORDS = re.compile(f"{SUFFIXES}|[{LETTER}]+|[{DIGIT}]|[^{SPACE}{LETTER}{DIGIT}]+")


def byte_alphabet() -> dict[int, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


def _layout(spec: dict) -> str | None:
    """"byte" for plain byte-level BPE, "lower" for lower-cased words with an end mark, None for others."""
    before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if (spec.get("model") or {}).get("type") != "BPE" or spec.get("post_processor"):
        return None
    if norm is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before["add_prefix_space"]:
        return "byte"
    steps = [s.get("type") for s in (norm or {}).get("normalizers", [])]
    parts = before.get("pretokenizers", [])
    if steps == ["NFC", "Replace", "Lowercase"] and [p.get("type") for p in parts] == ["Split", "ByteLevel"]:
        pattern = parts[0].get("pattern", {}).get("Regex", "")
        if parts[0].get("invert") and pattern == SUFFIXES + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
            return "lower"
    return None


def _uneven(text: str) -> bool:
    """Whether a space stands at an end of the text or next to other white space."""
    if text[0] == " " or text[-1] == " " or "  " in text:
        return True
    return any(c in text and (f" {c}" in text or f"{c} " in text) for c in _SPACES)


def text_slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of about ``size`` bytes of the second column, so that many texts share the look-up of their words."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), dtype=np.int64)
    at = done = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield batch.slice(at, stop - at)
        at, done = stop, ends[stop - 1]


class Memo:
    """A bounded table of what was computed before: entries not used for a whole generation go."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class WordEncoder:
    """Ids of texts under one tokenizer file; keeps its memo as long as the worker lives."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.layout = _layout(spec)
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self._model = self.tokenizer.model
        self._bytes = byte_alphabet()
        self._packs = [Struct(f"<{n}I").pack for n in range(17)]
        self._words = Memo(WORDS)
        # Under the byte layout words of letters are remembered apart, and only uneven texts come to the second.
        self._spaced = Memo(CHUNKS // 4)
        self._chunks = Memo(CHUNKS // 4 if self.layout == "byte" else CHUNKS)
        self._signs = {s: self._ids(s) for s in ".,"} if self.layout else {}
        self._known, self._known_ids = pa.array([], pa.string()), pa.array([], pa.binary())
        if self.layout == "byte":
            # The same model over lines, one word each; a word's first token, and no other, begins with the space.
            self._lines = Tokenizer(self._model)
            self._lines.pre_tokenizer = CharDelimiterSplit("\n")
            self._line_bytes = {b: c for b, c in self._bytes.items() if b != ord("\n")}
            vocabulary = self.tokenizer.get_vocab()
            self._begins = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
            self._begins[[i for t, i in vocabulary.items() if t[:1] == "Ġ"]] = True

    def whole(self, text: str) -> bytes:
        """Ids by the library's own encode, as little-endian unsigned 32-bit integers."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _ids(self, word: str) -> bytes:
        """Ids of a word of the layout's pattern, by the library's model."""
        if word.isascii() and word[word[0] == " " :].isalnum():
            mapped = word.replace(" ", "Ġ")
        else:
            mapped = word.encode("utf-8").decode("latin-1").translate(self._bytes)
        ids = [t.id for t in self._model.tokenize(mapped)]
        return self._packs[len(ids)](*ids) if len(ids) < len(self._packs) else pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        found = self._words.get(word)
        if found is None:
            found = self._ids(word)
            if len(word) <= KEPT_CHARS:
                self._words.put(word, found)
        return found

    def _chunk(self, memo: Memo, key: str, before: str) -> bytes:
        """Ids of a part between spaces; ``before`` is the space that belongs to it, if any."""
        if key[-1:] in (".", ","):
            bare = key.rstrip(".,")
            if bare.isalpha():
                # Letters, then full stops or commas: two words, the first of which is remembered without the signs.
                return (memo.young.get(bare) or self._chunk(memo, bare, before)) + self._word(key[len(bare) :])
        found = memo.old.get(key)
        if found is None:
            if key.isalpha():
                found = self._ids(before + key)
            else:
                pattern = _BYTE_WORDS if self.layout == "byte" else _LOWER_WORDS
                found = b"".join(map(self._word, pattern.findall(before + key)))
        if len(key) <= KEPT_CHARS:
            memo.put(key, found)
        return found

    def _by_words(self, text: str) -> bool:
        """Whether the split into words is known for a text."""
        if self.layout is None or any(s in text for s in self.specials):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; NULL is the empty text."""
        if not text:
            return b""
        if not self._by_words(text):
            return self.whole(text)
        if self.layout == "lower":
            return self._joined(self._chunks, text.lower().split(" "), "")
        if _uneven(text):
            return self._joined(self._chunks, _CHUNKS.findall(text), "")
        first, *rest = text.split(" ")
        return self._chunk(self._chunks, first, "") + self._joined(self._spaced, rest, " ")

    def _joined(self, memo: Memo, parts: list[str], before: str) -> bytes:
        return b"".join(self._each(memo, parts, before))

    def _each(self, memo: Memo, parts: list[str], before: str) -> list[bytes]:
        """Ids of each part."""
        get = memo.young.get
        ids = list(map(get, parts))
        if None not in ids:
            return ids
        signs, whole = self._signs, self._chunk
        out = []
        for x, p in zip(ids, parts, strict=True):
            if x is None:
                # A known part that ends with a letter, then a full stop or comma: the sign is a word of its own.
                sign = signs.get(p[-1:])
                bare = get(p[:-1]) if sign is not None and p[-2:-1].isalpha() else None
                x = whole(memo, p, before) if bare is None else bare + sign
            out.append(x)
        return out

    def encode_all(self, texts: pa.Array, end: bytes = b"") -> pa.BinaryArray:
        """As ``encode`` for each text, with ``end`` after its ids.

        Under the byte layout even texts are split at their spaces as one column, so that each of its distinct words
        is looked up once and the ids of all its words are put together by position.
        """
        held = texts.to_pylist()
        if self.layout != "byte":
            return pa.array([self.encode(t) + end for t in held], pa.binary())
        alone, firsts, rests = {}, [], []
        for row, text in enumerate(held):
            if text and (not self._by_words(text) or _uneven(text)):
                alone[row], text = self.encode(text), None
            first = text.split(" ", 1)[0] if text else ""
            firsts.append(first)
            # The spaces at the two ends make places for the first word and for the end.
            rests.append(f"{text[len(first) :]} " if text else " ")
        own = [x if first else b"" for x, first in zip(self._each(self._chunks, firsts, ""), firsts, strict=True)]
        for row, ids in alone.items():
            own[row] = ids
        words = pc.split_pattern(pa.array(rests, pa.string()), " ")
        del held, firsts, rests
        bounds, coded = words.offsets.to_numpy(), words.flatten().dictionary_encode()
        known, at = self._spaced_ids(coded.dictionary), coded.indices.to_numpy().copy()
        at[bounds[:-1]] = len(known) + np.arange(len(own))
        at[bounds[1:] - 1] = len(known) + len(own)
        ids = pa.concat_arrays([known, pa.array([*own, end], pa.binary())]).take(pa.array(at))
        offsets = np.frombuffer(ids.buffers()[1], "<i4")[bounds]
        return pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets), ids.buffers()[2]])

    def _spaced_ids(self, parts: pa.StringArray) -> pa.BinaryArray:
        """Ids of parts with a space before each; words of letters, also before one sign, are looked up as a column."""
        bare = pc.utf8_rtrim(parts, ".,")
        size = pc.binary_length(bare).to_numpy()
        signs = pc.binary_length(parts).to_numpy() - size
        letters = pc.utf8_is_alpha(bare).to_numpy(zero_copy_only=False) & (signs < 2) & (size <= KEPT_CHARS)
        plain, others = np.flatnonzero(letters), np.flatnonzero(~letters)
        named = bare.take(pa.array(plain)).dictionary_encode()
        sign = np.where(signs == 0, 0, np.where(pc.ends_with(parts, ".").to_numpy(zero_copy_only=False), 1, 2))
        found = pc.binary_join_element_wise(
            self._letter_ids(named.dictionary).take(named.indices),
            pa.array([b"", self._signs["."], self._signs[","]], pa.binary()).take(pa.array(sign[plain])),
            pa.scalar(b"", pa.binary()),
        )
        rest = self._each(self._spaced, parts.take(pa.array(others)).to_pylist(), " ")
        place = np.argsort(np.concatenate([plain, others]), kind="stable")
        return pa.concat_arrays([found, pa.array(rest, pa.binary())]).take(pa.array(place))

    def _letter_ids(self, words: pa.StringArray) -> pa.BinaryArray:
        """Ids of distinct words of letters with a space before each. Of too many, those not in ``words`` are forgotten."""
        at = pc.fill_null(pc.index_in(words, value_set=self._known), -1).to_numpy().copy()
        new = at < 0
        if new.any():
            if len(self._known) + new.sum() > LETTERS:
                kept = pa.array(at[~new])
                self._known, self._known_ids = self._known.take(kept), self._known_ids.take(kept)
                at[~new] = np.arange(len(kept))
            at[new] = len(self._known) + np.arange(new.sum())
            fresh = words.filter(pa.array(new))
            coded = [self._bulk(fresh.slice(lo, BULK).to_pylist()) for lo in range(0, len(fresh), BULK)]
            self._known = pa.concat_arrays([self._known, fresh])
            self._known_ids = pa.concat_arrays([self._known_ids, *coded])
        return self._known_ids.take(pa.array(at))

    def _bulk(self, words: list[str]) -> pa.BinaryArray:
        """Ids of words of letters with a space before each, by one call of the library's model."""
        lines = " " + "\n ".join(words)
        if lines.isascii():
            lines = lines.replace(" ", "Ġ")
        else:
            lines = lines.encode("utf-8").decode("latin-1").translate(self._line_bytes)
        ids = np.array(self._lines.encode_batch_fast([lines], add_special_tokens=False)[0].ids, dtype="<u4")
        begins = np.flatnonzero(self._begins[ids])
        if len(begins) != len(words):
            return pa.array([self._ids(" " + w) for w in words], pa.binary())
        offsets = np.append(begins, len(ids)).astype("<i4") * 4
        return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file.

    Functions travel to the workers by value, so the globals of this module live for one task only; a module entry
    of the process keeps the memo for the tasks that follow.
    """
    held = sys.modules.setdefault("_parley_encoders", ModuleType("_parley_encoders"))
    if path not in held.__dict__:
        held.__dict__[path] = WordEncoder(path)
    return held.__dict__[path]
