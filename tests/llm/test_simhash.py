import numpy as np
import pytest
import xxhash
from llm_tables import of

from parley.llm import components, simhash


def slow_print(text):
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def brute(rows, distance=3):
    prints = [slow_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            root = find(i)
            least[root] = min(doc, least.get(root, doc))
    return [(doc, f"{p:016x}", least.get(find(i))) for i, ((doc, _), p) in enumerate(zip(rows, prints, strict=True))]


def result(df, **options):
    found = simhash.near_duplicates(df, **options)
    return of(found.select("doc_id", simhash.hex16(found["print"]).alias("f"), "component_id"))


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_against_brute_force(edge, docs):
    for df in (edge, docs):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        assert result(df) == ordered(brute(rows))


@pytest.mark.parametrize(("distance", "segments"), [(3, 2), (3, 4), (5, 2), (2, 1), (0, 1)])
def test_links_within_every_distance(spark, distance, segments):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = {int(b) for b in base}
    for b in base:
        for _ in range(15):
            flips = rng.choice(64, size=int(rng.integers(1, 7)), replace=False)
            prints.add(int(b) ^ sum(1 << int(f) for f in flips))
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    if segments == 1 and distance:
        signed = signed[:40]  # balls over whole fingerprints are large
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    found = {frozenset(r) for r in simhash.near_links(df, distance, segments).collect()}
    mask = (1 << 64) - 1
    wanted = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= distance}
    assert found == wanted


def test_long_texts_are_voted_on_in_parts(monkeypatch):
    text = " ".join(f"w{i * i % 811}" for i in range(3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "VOTES", 100)
    assert simhash.fingerprint(text) == whole == slow_print(text)


def test_one_of_each_group_stays(edge, docs):
    for df in (edge, docs):
        kept = simhash.one_of_each(df)
        assert kept.columns == df.columns
        found = simhash.near_duplicates(df).collect()
        # Rows of one id can be in several groups, so that groups are told apart by their root.
        least = {r["root"]: r["component_id"] for r in found}
        ids = [r["doc_id"] for r in kept.collect()]
        by = lambda i: (i is not None, i or 0)
        assert sorted(ids, key=by) == sorted(least.values(), key=by)


def test_empty_tables(spark, none):
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.one_of_each(none).count() == 0
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 140)]
    odd = [(200, 200), (None, 5), (300, 301), (301, 300), (300, 301)]
    found = dict(of(components.components(spark.createDataFrame([*path, *star, *odd], "a long, b long"))))
    assert found == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)} | {301: 300}
