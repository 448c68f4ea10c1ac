import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_tables import of, tokenizer
from tokenizers import Tokenizer

from parley.llm import packing, token_files
from parley.llm.words import WordEncoder

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.mark.parametrize("name", NAMES)
def test_words_and_whole_texts_give_the_same_ids(name, texts):
    encoder = WordEncoder(tokenizer(name))
    assert encoder.layout
    rng = random.Random(4)
    signs = [chr(i) for i in range(1, 256)] + list("  \n't's'll abcde  ") * 30
    mixed = ["".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(4000)]
    fixed = ["", " ", "  two  spaces ", "don't<|endoftext|>do", "日本 語", "á e", "ſ İ ǅ", "x" * 500]
    for text in [*mixed, *fixed, *list(texts.values())[:40]]:
        assert encoder.encode(text) == encoder.whole(text), repr(text)
    assert encoder.encode(None) == b""


def test_memo_forgets_and_stays_right(monkeypatch, texts):
    from parley.llm import words

    monkeypatch.setattr(words, "WORDS", 50)
    monkeypatch.setattr(words, "CHUNKS", 20)
    encoder = WordEncoder(tokenizer(NAMES[0]))
    for text in list(texts.values())[:10]:
        assert encoder.encode(text) == encoder.whole(text)
    assert len(encoder._words.young) <= 50


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("letters", [3, 1_000_000])
def test_columns_and_whole_texts_give_the_same_ids(monkeypatch, name, letters, texts):
    from parley.llm import words

    monkeypatch.setattr(words, "LETTERS", letters)
    monkeypatch.setattr(words, "BULK", 2)
    encoder = WordEncoder(tokenizer(name))
    rng = random.Random(5)
    signs = [chr(i) for i in range(1, 256)] + list("  \n't's'll abcdeé.., ") * 40
    mixed = ["".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(1500)]
    letter_words = [f"a {chr(i)} {chr(i)}b. {chr(i)}{chr(i)}, c.." for i in range(33, 256)]
    fixed = [None, "", " ", ".", "a .", "a ..", "a b.", "a  b", "a <|endoftext|> b", "日本 語", "á é, ß.", "a " + "x" * 500 + "."]
    rows = [*fixed, *mixed, *letter_words, *list(texts.values())[:30], *fixed]
    column = pa.array(["before", *rows], pa.string())
    for at in (0, 700, len(rows) - 5):
        part = column.slice(1 + at, 900)
        wanted = [encoder.whole(t or "") + b"end!" for t in rows[at : at + 900]]
        assert encoder.encode_all(part, b"end!").to_pylist() == wanted
    assert encoder.encode_all(column.slice(0, 0), b"end!").to_pylist() == []


def test_letters_are_the_same_in_columns():
    import pyarrow.compute as pc

    signs = [chr(i) for i in range(256)]
    assert pc.utf8_is_alpha(pa.array(signs)).to_pylist() == [s.isalpha() for s in signs]


def test_tokenising_looks_up_a_repeated_word_once(monkeypatch):
    """Texts of a batch share the look-up of their words; each was looked up where it stood before."""
    asked = []
    bulk = getattr(WordEncoder, "_bulk", None)
    monkeypatch.setattr(WordEncoder, "_bulk", lambda self, words: asked.extend(words) or bulk(self, words), raising=False)
    monkeypatch.setattr(WordEncoder, "encode", lambda self, text: pytest.fail("a text for itself"))
    texts = ["so many words. Words, words and words"] * 300
    batch = pa.record_batch([pa.array(range(300), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    monkeypatch.setattr(token_files, "encoder", WordEncoder)
    first, *_ = token_files._tokenise(tokenizer(NAMES[0]))(iter([batch]))
    assert sorted(asked) == ["Words", "and", "many", "words"]
    assert set(first.column(2).to_pylist()) == {WordEncoder(tokenizer(NAMES[0])).whole(texts[0]) + token_files.END}


def test_texts_are_cut_by_their_bytes(monkeypatch):
    monkeypatch.setattr(token_files, "TEXT_BYTES", 10)
    texts = ["x" * 4, None, "x" * 6, "x" * 30, "", "x" * 8, "x" * 3]
    batch = pa.record_batch([pa.array(range(7), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    assert [p.column(0).to_pylist() for p in token_files._text_slices(batch)] == [[0, 1, 2], [3], [4, 5], [6]]
    assert [p.column(0).to_pylist() for p in token_files._text_slices(batch.slice(3, 3))] == [[3], [4, 5]]


def test_numbers_of_every_width_come_back():
    rng = np.random.default_rng(0)
    counts = np.array([0, 1, 3, 4, 5, 1000, 0, 2])
    n = int(counts.sum())
    values = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 33, n, dtype=np.uint64)).astype(np.uint32)
    control, controls, data, sizes = token_files.encode_numbers(values, counts)
    assert controls.sum() == len(control) and sizes.sum() == len(data)
    back = token_files.decode_numbers(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), counts)
    assert (back == values).all()


def test_a_shard_keeps_ids_and_order():
    rows, numbers = [], [np.array(x, dtype="<u4") for x in ([], [1], [2, 300, 70_000], [2**32 - 1] * 5)]
    for doc, x in zip([None, 5, -7, 5], numbers, strict=True):
        control, _, data, _ = token_files.encode_numbers(x, np.array([len(x)]))
        rows.append((doc, len(x), control, data))
    table, flat = token_files.read_shard(token_files.shard_bytes(rows))
    assert [None if not k else i for i, k in zip(table["id"].tolist(), table["known"].tolist(), strict=True)] == [None, 5, -7, 5]
    assert flat.tolist() == np.concatenate(numbers).tolist()
    with pytest.raises(ValueError):
        token_files.read_shard(b"none of it")


def slow_ids(name, text):
    ids = Tokenizer.from_file(tokenizer(name)).encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, 0], dtype="<u4")


@pytest.mark.parametrize("shard_tokens", [1 << 20, 300])
def test_files_against_brute_force(docs, texts, shard_tokens):
    found = of(token_files.token_files(docs, tokenizer(NAMES[0]), shard_tokens=shard_tokens))
    start, wanted = 0, []
    whole = Tokenizer.from_file(tokenizer(NAMES[0]))
    for doc in sorted(texts):
        ids = np.array([*whole.encode(texts[doc] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        wanted.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(found) == wanted


def test_files_of_edge_rows(spark, edge, none):
    path = token_files.folder(spark, "test-files")
    token_files.write_token_files(edge, path, tokenizer(NAMES[0]), shard_tokens=100)
    found = token_files.read_token_files(spark, path, keep_ids=True).collect()
    rows = sorted(found, key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in edge.collect()), key=lambda i: (i is not None, i))
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows]])[:-1].tolist()
    assert sorted(bytes(r["ids"]) for r in rows) == sorted(slow_ids(NAMES[0], r["text"]).tobytes() for r in edge.collect())
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in rows)
    assert token_files.token_files(none, tokenizer(NAMES[0])).count() == 0


def check_packing(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def greedy(lengths, capacity):
    """Best-fit decreasing, one piece at a time."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [i for i, room in enumerate(rooms) if room >= length]
        if fitting:
            rooms[min(fitting, key=lambda i: rooms[i])] -= length
        else:
            rooms.append(capacity - length)
    return len(rooms)


@pytest.mark.parametrize("capacity", [10, 64, 257])
def test_plan_uses_as_many_sequences_as_best_fit(capacity):
    rng = np.random.default_rng(capacity)
    for _ in range(30):
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 200))).tolist()
        counts = {x: lengths.count(x) for x in set(lengths)}
        slots = packing.plan(counts, capacity)
        rows, filled = [], {x: 0 for x in counts}
        for length, first, last, sequence, each, place in slots:
            assert first == filled[length]
            filled[length] = last
            for i in range(last - first):
                rows.append({"sequence_id": sequence + i // each, "offset": place + i % each * length, "length": length})
        assert filled == counts
        assert check_packing(rows, capacity) == greedy(lengths, capacity)


def test_plan_work_does_not_grow_with_counts():
    small = packing.plan({x: 3 for x in range(1, 2049)})
    large = packing.plan({x: 10**9 + x for x in range(1, 2049)})
    assert len(large) < 8 * len(small)
    with pytest.raises(ValueError):
        packing.plan({2049: 1})


def test_packing_against_brute_force(docs, texts, edge, none):
    path = tokenizer(NAMES[1])
    for df in (docs, edge):
        found = packing.best_fit_packing(df, path, capacity=512, keep_ids=True).collect()
        lengths = []
        pairs = [tuple(r) for r in df.select("doc_id", "text").collect()]
        wanted = []
        whole = Tokenizer.from_file(path)
        for doc, text in pairs:
            ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
            for k in range(0, len(ids), 512):
                piece = ids[k : k + 512].tobytes()
                wanted.append((doc, k // 512, k, len(piece) // 4, zlib.crc32(piece)))
                lengths.append(len(piece) // 4)
        got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found]
        by = lambda r: tuple((x is not None, x) for x in r)
        assert sorted(got, key=by) == sorted(wanted, key=by)
        assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in found)
        assert check_packing(found, 512) == greedy(lengths, 512)
    assert packing.best_fit_packing(none, path).count() == 0


def test_binary_columns_from_buffers():
    data = token_files._binary(b"abcdef", np.array([2, 0, 4]))
    assert data.to_pylist() == [b"ab", b"", b"cdef"] and data.type == pa.binary()
