import hashlib
import random
import zlib

import numpy as np
import pytest
from llm_tables import of

from parley.llm import prefix_trie, queries

COLUMNS = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
)
SCHEMA = "conv_id long, turn long, role string, text string, depth int, sequence string, digest string"


def key(turn):
    role, text = turn
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def brute(rows):
    """A trie of nested dictionaries, walked from the root."""
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, key((role or "", text or "")), role or "", text or ""))
    for turns in own.values():
        turns.sort()
    full = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        full[conv] = [t[3:] for t in own.get(conv - conv % 100, [])[:h] + turns[h:]]

    def node():
        return {"members": [], "ends": [], "below": {}}

    root = node()
    for conv in sorted(full):
        at = root
        at["members"].append(conv)
        for turn in full[conv]:
            at = at["below"].setdefault(turn, node())
            at["members"].append(conv)
        at["ends"].append(conv)
    out = []

    def walk(at, depth, above, chars):
        leaves, saved = (0, (len(at["members"]) - 1) * chars) if at["below"] else (1, (len(at["members"]) - 1) * chars)
        for turn, child in at["below"].items():
            more = walk(child, depth + 1, at["members"][0], len(turn[1]))
            leaves, saved = leaves + more[0], saved + more[1]
        ends = hashlib.sha256(",".join(map(str, at["ends"])).encode()).hexdigest()
        out.append((at["members"][0], depth, above, len(at["members"]), len(at["below"]), leaves, saved, ends))
        return leaves, saved

    if full:
        walk(root, 0, None, 0)
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def conversations(seed, convs=260, words=2, longest=7):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(convs * 2), convs):
        for turn in range(rng.randint(1, longest)):
            rows.append((conv, turn, rng.choice(["user", "bot"]), "word " * rng.randint(1, words)))
    return rows


EDGE = [
    (None, 0, "user", "no conversation"),
    (100, None, "user", "first"),
    (100, 0, None, "second"),
    (100, 0, None, "second"),
    (100, 2, "user", None),
    (101, 5, "bot", ""),
    (101, 1, "", "bot"),
    (103, 1, "user", "ü日本 \x00 x"),
    (205, 1, "a", "b"),
    (200, 1, "ab", ""),
    (207, 1, "a", "b"),
    (307, 1, "u", "lost head"),
    (-5, 1, "u", "t"),
    *[(400, i, "user", f"turn {i % 3}") for i in range(300)],
    *[(401, i, "user", f"turn {i % 3}") for i in range(299)],
]


def table(spark, rows):
    return spark.createDataFrame([(*r, 9, "x", "y") for r in rows], SCHEMA)


def test_edge_rows_against_brute_force(spark):
    assert of(prefix_trie.conversation_trie(table(spark, EDGE)), *COLUMNS) == brute(EDGE)


@pytest.mark.parametrize("block_turns", [20, 1 << 17])
@pytest.mark.parametrize("words", [1, 3])
def test_many_equal_beginnings_in_many_blocks(spark, block_turns, words):
    rows = conversations(words, words=words)
    found = prefix_trie.conversation_trie(table(spark, rows), block_turns=block_turns)
    assert of(found, *COLUMNS) == brute(rows)


def test_one_sequence_in_many_blocks(spark):
    rows = [(c * 100, t, "user", "same") for c in range(150) for t in range(4)]
    rows += [(c * 100, t, "user", f"other {c}" if t == 2 else "same") for c in range(150, 180) for t in range(4)]
    found = prefix_trie.conversation_trie(table(spark, rows), block_turns=30)
    assert of(found, *COLUMNS) == brute(rows)


def test_empty_tables(spark):
    assert prefix_trie.conversation_trie(table(spark, EDGE).limit(0)).count() == 0
    assert prefix_trie.conversation_trie(table(spark, EDGE).filter("conv_id IS NULL")).count() == 0


def test_query_columns(spark):
    kinds = dict(queries.op12_prefix_trie(spark, "/root/testdata/sf0.001").dtypes)
    assert kinds == {c: "string" if c == "ends_sha256" else "bigint" for c in COLUMNS}


def test_minima_search_each_side_on_its_own():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 6, 77)
    minima = prefix_trie.Minima(values)
    row, depth = rng.integers(0, 77, 300), rng.integers(0, 7, 300)
    for i, d, right, left in zip(row, depth, minima.right(row, depth), minima.left(row, depth), strict=True):
        want = i
        while want + 1 < 77 and values[want + 1] >= d:
            want += 1
        assert right == want
        want = i
        while want > 0 and values[want] >= d:
            want -= 1
        assert left == want
    first = np.minimum(row, row[::-1])
    last = np.maximum(row, row[::-1])
    assert minima.least(first, last).tolist() == [values[a : b + 1].min() for a, b in zip(first, last, strict=True)]
