import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from llm_tables import of, tokenizer

from parley.llm import pieces

NAME = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(tokenizer(NAME))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer(NAME))


def test_ids_equal_the_library(model, library, texts):
    rng = random.Random(2)
    signs = [chr(i) for i in range(1, 300)] + list("abcdethionrs  ,.") * 40 + ["日", "本", "▁", "😀", "\n", "\x00"] * 4
    mixed = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(3000)]
    given = [*mixed, "", " ", "   ", " a", "<s> </s> <unk> <0x41>", "x" * 300, *list(texts.values())[:60]]
    for text, ids in zip(given, model.encode(given), strict=True):
        wanted = library.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == wanted, repr(text)
        assert model.decode(np.array(wanted, dtype="<u4")) == library.decode(wanted), repr(text)


def test_occurrences_are_all_places_of_all_pieces(model):
    text = "the theme of the other"
    points = np.array([ord(c) for c in text], dtype=np.int64)
    positions, rows = model.occurrences(points)
    found = [(p, model.texts[model.plain[r]]) for p, r in zip(positions.tolist(), rows.tolist(), strict=True)]
    wanted = [(i, text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1) if text[i:j] in model.ids]
    assert found == wanted


def test_memo_does_not_change_ids(model, texts, monkeypatch):
    given = list(texts.values())[:30]
    small = pieces.PieceModel(tokenizer(NAME))
    small.words, small.pairs = pieces.Memo(20), pieces.Memo(10)
    assert [small.encode([t])[0] for t in given] == model.encode(given)


def test_query_against_brute_force(docs, edge, none, library):
    for df in (docs, edge):
        wanted = []
        for doc, text in (tuple(r) for r in df.select("doc_id", "text").collect()):
            ids = np.array(library.encode(text or ""), dtype="<u4")
            digest = hashlib.sha256((text or "").encode()).hexdigest()
            wanted.append((doc, len(ids), zlib.crc32(ids.tobytes()), digest))
        by = lambda r: tuple((x is not None, str(x)) for x in r)
        assert of(pieces.round_trip(df, tokenizer(NAME))) == sorted(wanted, key=by)
        apart = pieces.decode(pieces.encode(df, tokenizer(NAME)), tokenizer(NAME))
        assert of(apart, "doc_id", "n_tokens", "ids_crc32") == sorted((w[:3] for w in wanted), key=by)
    assert pieces.round_trip(none, tokenizer(NAME)).count() == 0


def test_columns_equal_the_library(model, library, texts):
    rng = random.Random(3)
    signs = [*list("abcdethionrs  ,.") * 8, "日", "▁", "😀", "\n", "\x00", "é"]
    mixed = ["".join(rng.choices(signs, k=rng.randrange(80))) for _ in range(2000)]
    even = [" ".join(t.replace("▁", "").split(" ")).strip() for t in mixed]
    groups = [[*mixed, *even, None, "", *list(texts.values())[:30]], [None], [""], [" "], ["▁"], [" a", "b  c", ""], ["a b", None]]
    for given in groups:
        wanted = [library.encode(t or "") for t in given]
        for column in (pa.array(given, pa.string()), pa.array(["x y", *given, "z"]).slice(1, len(given))):
            ids = model.encode_all(column)
            assert [np.frombuffer(x, "<u4").tolist() for x in ids.to_pylist()] == wanted
            behind = pa.concat_arrays([pa.array([b"\0\0\0\0"], pa.binary()), ids]).slice(1)
            assert model.decode_all(behind).to_pylist() == [library.decode(x) for x in wanted]
    broken = np.array([model.bytes[0xC3], model.bytes[0x41]], dtype="<u4")
    assert model.decode_all(pa.array([broken.tobytes(), b""], pa.binary())).to_pylist() == [model.decode(broken), ""]


def test_repeated_parts_are_split_once(monkeypatch, texts):
    class Counted:
        def __init__(self, pattern):
            self.pattern, self.chars = pattern, 0

        def findall(self, text):
            self.chars += len(text)
            return self.pattern.findall(text)

    small = pieces.PieceModel(tokenizer(NAME))
    small.word = Counted(small.word)
    monkeypatch.setattr(pieces, "piece_model", lambda path: small)
    given = [" ".join(t.split()) for t in list(texts.values())[:20]] * 50
    batch = pa.record_batch([pa.array(range(len(given))), pa.array(given)], names=["doc_id", "text"])
    rows = sum(part.num_rows for part in pieces._decode(tokenizer(NAME), False)(iter([batch])))
    assert rows == len(given)
    assert small.word.chars <= sum(len(t) + 1 for t in given[:20])


def test_words_side_by_side_as_one_by_one(model, texts, monkeypatch):
    words = sorted({w for t in list(texts.values())[:40] for w in model.word.findall("▁" + t.replace(" ", "▁"))})
    words += ["日本", "▁é日", "▁", "x" * 200]
    given = []
    for lanes, chars in ((1, 1 << 19), (64, 1 << 19), (len(words) + 1, 1 << 19), (8, 300)):
        monkeypatch.setattr(pieces, "LANES", lanes)
        monkeypatch.setattr(pieces, "CHARS", chars)
        given.append(model.segment(words))
    assert given[0] == given[1] == given[2] == given[3]


def test_apart_is_what_merging_both_gives(model):
    def merged(text):
        parts = list(text)
        while len(parts) > 1:
            scores = [model.score.get(a + b, float("-inf")) for a, b in zip(parts, parts[1:], strict=False)]
            if max(scores) == float("-inf"):
                break
            at = scores.index(max(scores))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    rng = random.Random(4)
    plain = model.plain.tolist()
    pairs = [(rng.choice(plain), rng.choice(plain)) for _ in range(5000)]
    for text in rng.sample(sorted(model.ids), 3000):
        pairs += [(model.ids[text[:k]], model.ids[text[k:]]) for k in range(1, len(text)) if {text[:k], text[k:]} <= model.ids.keys()]
    for a, b in pairs:
        assert model.apart(a, b) == (merged(model.texts[a] + model.texts[b]) == [model.texts[a], model.texts[b]])
    for a in plain[::10]:
        assert model.apart(pieces._START, a) == (merged(model.texts[a]) == [model.texts[a]])


def test_all_pairs_of_the_last_pieces(model, library, monkeypatch):
    ends = [*model.plain[-4:].tolist(), *model.plain[:40].tolist()]
    pairs = [(a, b) for a in [pieces._START, *ends] for b in ends]
    wanted = [model._apart(a, b) for a, b in pairs]
    monkeypatch.setattr(model, "pairs", pieces.Memo(10_000))
    keys = np.array([(a + 2) * len(model.texts) + b + 2 for a, b in pairs])
    assert model._apart_all(keys).tolist() == wanted
    given = [model.texts[a].replace("▁", " ") + model.texts[b].replace("▁", " ") for a in ends for b in ends]
    monkeypatch.setattr(model, "pairs", pieces.Memo(10_000))
    found = [np.frombuffer(x, "<u4").tolist() for x in model.encode_all(pa.array(given)).to_pylist()]
    assert found == [library.encode(t) for t in given]
