import hashlib
import struct

import pytest
import xxhash
from llm_tables import of
from pyspark.sql import functions as F

from parley.llm import sketches

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def chained(numbers):
    seed = 42
    for n in numbers:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", n), seed)
    return signed(seed)


def shingles(text):
    words = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in (text or "").lower().split()]
    if len(words) < 5:
        return {chained(words)} if words else set()
    return {chained(words[i : i + 5]) for i in range(len(words) - 4)}


def printed(text, k):
    return "".join(f"{h & MASK:016x}" for h in sorted(shingles(text))[:k])


def like(a, b, k):
    a, b = sorted(shingles(a))[:k], sorted(shingles(b))[:k]
    union = sorted({*a, *b})
    if not (len(a) < k and len(b) < k):
        union = union[:k]
    return sum(h in a and h in b for h in union) / len(union) if union else 1.0


def brute(rows, k):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        near = round(like(text, edited, k), 9), round(like(text, after, k), 9)
        out.append((doc, len(text), digest, printed(text, k), printed(edited, k), *near))
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def result(df, k, blocks=None):
    near = [F.round(c, 9).alias(c) for c in ("near_edited", "near_next")]
    found = sketches.edited_fingerprints(df, k=k, blocks=blocks)
    return of(found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near))


@pytest.mark.parametrize(("k", "blocks"), [(16, 1), (16, 7), (128, None)])
def test_against_brute_force(docs, edge, k, blocks):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert result(docs, k, blocks) == brute(rows, k)
    plain = edge.filter("doc_id IS NULL OR doc_id <> 7")  # white space beyond ASCII is a letter to the operator
    rows = [tuple(r) for r in plain.select("doc_id", "text").collect()]
    assert result(plain, k, blocks) == brute(rows, k)


def test_single_document_and_empty_table(edge, none):
    one = edge.filter("doc_id = 1")
    assert result(one, 16) == brute([tuple(r) for r in one.select("doc_id", "text").collect()], 16)
    assert sketches.edited_fingerprints(none).count() == 0


def test_parts_merge_to_the_whole(spark):
    a, b = " ".join(f"a{i}" for i in range(400)), " ".join(f"b{i % 50}" for i in range(400))
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, "")], "key long, text string")
    parts = sketches.with_sketch(df, F.col("text"), "sketch", k=32)
    merged = {r["key"]: r["sketch"] for r in sketches.merged_by(parts, ["key"], "sketch", k=32).collect()}
    assert merged == {1: sorted(shingles(a) | shingles(b))[:32], 2: sorted(shingles(a))[:32]}
    both = parts.filter("key < 3").agg(F.collect_list("sketch").alias("s"))
    two = both.select(sketches.merged(F.col("s")[0], F.col("s")[1], 32)).first()[0]
    assert two == merged[1] or two == merged[2] or len(two) == 32


def test_estimates_are_near_the_truth(spark):
    whole = " ".join(f"w{i}" for i in range(4000))
    part = " ".join(f"w{i}" for i in range(2000))
    df = spark.createDataFrame([(whole, part)], "a string, b string")
    df = sketches.with_sketch(sketches.with_sketch(df, F.col("a"), "x", 512), F.col("b"), "y", 512)
    x, y = F.col("x"), F.col("y")
    r = df.select(
        sketches.resemblance(x, y, 512),
        sketches.containment(y, x, 512),
        sketches.containment(x, y, 512),
        sketches.distinct_shingles(x, 512),
    ).first()
    assert abs(r[0] - 0.5) < 0.08 and r[1] > 0.85 and abs(r[2] - 0.5) < 0.1 and abs(r[3] / 3996 - 1) < 0.15


def test_no_python_and_one_shuffle_of_texts(docs):
    plan = sketches.edited_fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan
