import hashlib
import re
import time

import pytest
from llm_tables import of
from pyspark.sql import functions as F

from parley.llm import personal, queries

# The plain patterns, matched here by Python.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
COLUMNS = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def keeps(kind, match):
    digits = re.sub(r"\D", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute_base(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in PLAIN.items()
        for m in re.finditer(pattern, text or "", re.ASCII)
        if keeps(kind, m[0])
    ]


def brute_row(doc, text):
    spans = brute_base(text)
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    counts = [sum(s[0] == k for s in spans) for k in PLAIN]
    return (doc, *counts, hashlib.sha256(joined.encode()).hexdigest())


def brute(rows):
    return sorted((brute_row(*r) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


TEXTS = [
    "a@b.c@d.e and x%y@d.e.f. end@of",
    "a@b.c%x@d.e ..@..a @a.b a@b a@b. a@-.- é@b.ü a.é@b.de",
    "1.2.3.4.5.6.7.8 256.1.1.1 0255.000.01.9 1.2.3 .1.2.3.4. 99999999999999999999.1.1.1 1..2.3.4",
    "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111112 4111  111111111111 41111111111111110 4111 1111 1111 1111 1",
    "+1 (425) 555-0137 +49-30-1234567. ++12 34 56 78 90 +1 2 +12345678901234567890 + 1234567890 +1() .-5 +1 22\t3333333",
    "日本 +1 (425) 555-0137 ü@x.de é1.2.3.4é 12 4111 1111 1111 1111 𝄞 a@b.cd",
    "4735320085237796 4735320085237796 +4735320085237796 1.1.1.1@b.co 5 5- 5 - 5",
    "",
    None,
    " \n\t ",
    "1" * 5000 + "." + "1" * 4000 + " " + "a" * 9000 + "@" + "b." * 3000 + " " + "+1" * 500 + " 1" * 3000,
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")


def test_base_spans_against_plain_patterns(spark):
    found = personal.digests(personal.personal_data(frame(spark, TEXTS)))
    assert of(found, *COLUMNS) == brute(enumerate(TEXTS))


def test_edge_rows(edge):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert of(personal.digests(personal.personal_data(edge)), *COLUMNS) == brute(rows)


def test_whole_table(spark, docs, texts):
    found = queries.op11_personal_data(spark, "/root/testdata/sf0.001")
    assert of(found, *COLUMNS) == brute(texts.items())
    spans = {r["doc_id"]: r["spans"] for r in found.select("doc_id", "spans").collect()}
    for doc, text in texts.items():
        base = [f"{k}:{a}:{b}" for k, a, b in brute_base(text)]
        assert set(base) <= set(filter(None, spans[doc].split(",")))


def calls(n=12):
    """Texts in which one phrase always stands before phone numbers, and others before numbers of all kinds."""
    out = [f"text {i} please call me at +1 (425) 555-01{i:02d} soon" for i in range(n)]
    out += [f"the order was +1 (425) 556-01{i:02d} here" for i in range(4)]
    out += [f"the order was {1000 + i} here" for i in range(9)]
    return out


def test_contexts_find_what_patterns_miss(spark):
    unseen = ["you may call me at (425) 555-7777 today", "we call me at 425-555-8888 today"]
    other = ["the order was (425) 555-9999 here", "call me at room12 please", "no context 425-555-1212 at all", ""]
    texts = [*calls(), *unseen, *other]
    found = {r["doc_id"]: r["spans"] for r in personal.personal_data(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        base = [(s["kind"], s["start"], s["end"]) for s in found[i] if s["base"]]
        assert base == brute_base(text)
        added = [(s["kind"], text[s["start"] : s["end"]]) for s in found[i] if not s["base"]]
        number = {unseen[0]: "(425) 555-7777", unseen[1]: "425-555-8888"}.get(text)
        assert added == ([("phone", number)] if number else [])


def test_found_values_support_further_patterns(spark):
    first = [f"text {i} please call me at +1 (425) 555-01{i:02d} soon" for i in range(12)]
    shared = [f"please call me at 425-555-70{i:02d} soon" for i in range(8)]
    second = [f"my number is 425-555-70{i:02d} indeed" for i in range(8)]
    unseen = ["my number is 425-555-9000 indeed"]
    texts = [*first, *shared, *second, *unseen]
    last = len(texts) - 1
    for rounds, wanted in ((1, 0), (4, 1)):
        rows = personal.personal_data(frame(spark, texts), rounds=rounds).filter(F.col("doc_id") == last).collect()
        assert len(rows[0]["spans"]) == wanted


def test_copies_are_one_witness(spark):
    texts = ["please call me at +1 (425) 555-0100 soon"] * 50 + ["please call me at 425-555-9000 soon"]
    rows = personal.personal_data(frame(spark, texts)).collect()
    assert sorted(len(r["spans"]) for r in rows) == [0] + [1] * 50


def test_scores_against_loops(spark):
    mentions = personal.mentions_of(personal.matched(frame(spark, calls())).filter("text_key IS NOT NULL"))
    rows = mentions.collect()
    edges = {(bytes(r["value"]), p): r for r in rows for p in r["patterns"]}
    wanted = set()
    for pattern in {p for _, p in edges}:
        own = [r for (_, p), r in edges.items() if p == pattern]
        for kind in range(4):
            good = sum(1000 for r in own if r["label"] == kind)
            bad = sum(
                0 if r["label"] == kind else 250 if r["label"] is None and r["fits"][kind] else 1000 for r in own
            )
            confidence = 1000 * good // (good + bad + 1000)
            if good >= 3000 and confidence >= 700:
                wanted.add((pattern, kind, confidence))
    made = mentions.select("value", "label", "fits", F.explode("patterns").alias("pattern")).distinct()
    assert set(map(tuple, personal.pattern_scores(made, None).collect())) == wanted
    assert wanted


def test_no_python_on_the_way(spark, docs):
    plan = personal.matched(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(none):
    assert personal.digests(personal.personal_data(none)).count() == 0


@pytest.mark.parametrize("text", ["1" * 400_000, "a" * 400_000 + "@", "1." * 200_000, "a@b" + ".c" * 200_000, "+1" + " " * 400_000])
def test_long_runs_take_linear_time(spark, text):
    began = time.time()
    found = personal.digests(personal.personal_data(frame(spark, [text]))).drop("spans").collect()
    assert len(found) == 1 and time.time() - began < 60
