import zlib

import numpy as np
import pytest
from llm_tables import of
from pyspark.sql import functions as F

from parley.llm import language, quality, toxicity


def held(doc, parts, part):
    return zlib.crc32(str(doc if doc is not None else "").encode()) % parts == part


# ---- language -----------------------------------------------------------------------------------


def test_language_of_held_out_documents(docs):
    rows = language.identify(docs).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) for r in rows) and len(rows) == len(truth)
    out = [r for r in rows if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in out]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_edge_rows(edge, none):
    rows = language.identify(edge).collect()
    assert len(rows) == edge.count()
    told = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert told[3] == told[4] == told[5] == told[9] == "und"
    assert all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert {r["lang_pred"] for r in rows} <= {"en", "de", "ja", "und"}
    assert language.identify(none).count() == 0
    assert set(of(language.identify(edge.withColumn("lang", F.lit(None))), "lang_pred")) == {("und",)}


def test_repeated_rows_are_one_example(docs):
    row = docs.filter("lang = 'en' AND text IS NOT NULL").orderBy("doc_id")
    row = row.filter(~language.held_out_of(row["doc_id"], 4, 2)).limit(1)
    repeated = docs.unionByName(row.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(1500)))).drop("n"))
    model = language.train(repeated.filter(~language.held_out_of(F.col("doc_id"), 4, 2)), per_class=40)
    found = docs.filter(language.held_out_of(F.col("doc_id"), 4, 2)).filter("text IS NOT NULL")
    found = found.select("lang", language.predictions(model, F.col("text"))["lang_pred"].alias("p"))
    assert found.filter("lang = p").count() >= 0.9 * found.count()


def test_number_signs_are_no_letters(spark, docs):
    texts = [(1, "½ ½ 12"), (2, "② ³"), (3, "12 a")]
    model = language.train(docs)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = df.select("doc_id", language.predictions(model, F.col("text"))["lang_pred"].alias("p")).collect()
    assert [r["p"] == "und" for r in found] == [True, True, False]


@pytest.mark.parametrize("n", [199, 200, 201])
def test_one_more_label_hardly_moves_scores(spark, n):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    every = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").orderBy("doc_id").select("doc_id", "quality")
    scores = [
        {r["doc_id"]: r["score"] for r in quality.rate(frame, every.limit(k)).collect()} for k in (n, n + 1)
    ]
    moved = [abs(scores[0][d] - scores[1][d]) for d in scores[0]]
    assert sum(moved) / len(moved) < 0.01


def test_labels_of_held_out_documents_teach_nothing(docs):
    swapped = docs.withColumn("lang", F.when(language.held_out_of(F.col("doc_id"), 4, 2), "xx").otherwise(F.col("lang")))
    assert of(language.identify(swapped)) == of(language.identify(docs))


def test_grams_of_long_texts_do_not_depend_on_spans(monkeypatch):
    text = "".join(chr(97 + i * i % 26) for i in range(5000)) + "ÄÖ日本"
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "SPAN", 100)
    assert (language.gram_counts(text) == whole).all() and whole.sum() == 3 * len(text) - 3
    assert language.gram_counts("").sum() == 0


def test_ftrl_learns_and_is_sparse(monkeypatch):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(400):
        label = int(rng.integers(3))
        at = np.unique(np.append(rng.integers(10, 500, 20), label))
        rows.append((at, np.ones(len(at)) / len(at) ** 0.5, label))
    w = language.ftrl(rows, 3, 500)
    right = np.mean([(v @ w[at]).argmax() == label for at, v, label in rows])
    assert right > 0.95
    monkeypatch.setattr(language, "L1", 1.0)
    assert (language.ftrl(rows, 3, 500) == 0).mean() > max(0.5, (w == 0).mean())


def test_temperature_makes_scores_honest():
    rng = np.random.default_rng(0)
    logits = rng.normal(0, 2, (4000, 3))
    p = language._softmax(logits)
    labels = np.array([rng.choice(3, p=x) for x in p])
    assert abs(language.temperature_of(logits * 5, labels) - 5) < 0.5
    assert language.temperature_of(np.zeros((0, 3)), np.zeros(0, dtype=int)) == 1.0


def test_rows_without_a_language_go(edge, none):
    kept = language.keep_identified(edge)
    assert kept.columns == edge.columns
    assert {3, 4, 5, 9}.isdisjoint({r["doc_id"] for r in kept.collect()})
    assert {1, 2, 6} <= {r["doc_id"] for r in kept.collect()}
    assert language.keep_identified(none).count() == 0


# ---- quality ------------------------------------------------------------------------------------


def auc(positive, negative):
    return np.mean([(p > n) + 0.5 * (p == n) for p in positive for n in negative])


@pytest.mark.parametrize(("operator", "label", "parts", "part", "least"), [
    (quality, "quality", 4, 2, 0.85),
    (toxicity, "toxic", 3, 1, 0.6),
])
def test_scores_of_held_out_documents(spark, operator, label, parts, part, least):
    folder = "/root/testdata/sf0.01"
    documents, marks = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    rows = operator.rate(documents, marks).collect()
    assert len(rows) == documents.count()
    assert all(r["held_out"] == held(r["doc_id"], parts, part) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    truth = {r["doc_id"]: r[label] for r in marks.collect()}
    out = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert auc([s for s, y in out if y], [s for s, y in out if not y]) > least


@pytest.mark.parametrize(("operator", "label", "parts", "part"), [(quality, "quality", 4, 2), (toxicity, "toxic", 3, 1)])
def test_held_out_labels_teach_nothing(docs, labels, operator, label, parts, part):
    out = language.held_out_of(F.col("doc_id"), parts, part)
    turned = labels.withColumn(label, F.when(out, 1 - F.col(label)).otherwise(F.col(label)))
    assert of(operator.rate(docs, turned), "doc_id", "score") == of(operator.rate(docs, labels), "doc_id", "score")


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_scores_of_edge_rows(spark, edge, labels, none, no_labels, operator):
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (6, None, None), (None, 1, 1)], no_labels.schema)
    for given in (marks, no_labels):
        rows = operator.rate(edge, given).collect()
        assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert operator.rate(none, marks).count() == 0
    assert operator.rate(none, no_labels).count() == 0


def test_low_quality_goes(docs, labels, edge, no_labels):
    scored = {r["doc_id"]: r["predicted"] for r in quality.rate(docs, labels).collect()}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, p in scored.items() if p}
    assert quality.keep_good(edge, no_labels).columns == edge.columns


def test_isotonic_steps_rise():
    at, value = quality.isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 0.5, 1]), np.ones(6))
    assert (np.diff(value) >= 0).all() and abs(np.interp(1.5, at, value) - 0.5) < 1e-9


def test_statistics_of_odd_texts():
    for text in (None, "", " ", "\n\n", "日本", "a" * 100_000, "!!! ###"):
        assert np.isfinite(quality.statistics(text)).all()
    assert not quality.statistics(None).any()


def test_parts_of_the_normal_equations_add_up(spark, docs, labels):
    marks = quality.labelled(labels, "quality")
    one = quality.train(docs.coalesce(1), marks)
    many = quality.train(docs.repartition(7), marks)
    assert np.allclose(one.weights, many.weights, atol=1e-6)


# ---- toxicity -----------------------------------------------------------------------------------


def test_windows_hold_every_word():
    text = " ".join(f"W{i}" for i in range(100))
    assert b" ".join(toxicity.windows(text)).decode() == text.lower()
    assert toxicity.windows(None) == toxicity.windows(" \n") == []


def test_runs_are_what_marked_grams_cover():
    marked = toxicity.word_grams("idiot")
    assert toxicity.marked_runs("You idiot! idiotic IDIOT fool", marked) == [" idiot", " idiot", " idiot "]


def test_toxic_dictionary_shortens_toxic_windows():
    rng = np.random.default_rng(0)
    syllables = ["the", "ing", "er", "on", "tion", "st", "re", "an", "ed", "or", "al", "un"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    plain = [" ".join(word() for _ in range(12)).encode() for _ in range(12_000)]
    bad = ["villain", "scoundrel", "knave"]
    runs = [[f" {w} " for w in rng.choice(bad, 4)] for _ in range(300)]
    ordinary, toxic = toxicity.dictionaries(plain, runs)
    assert len(ordinary) == len(toxic) and ordinary != toxic
    model = toxicity.ToxicityModel(ordinary, toxic, np.zeros(17), np.zeros(1), np.zeros(1))
    histogram = model.scorer()
    spread = np.arange(toxicity.LOW, toxicity.HIGH + 1)
    clean = [histogram(" ".join(word() for _ in range(60))) @ spread for _ in range(50)]
    marked = [histogram(" ".join([*[word() for _ in range(50)], *bad])) @ spread for _ in range(50)]
    assert np.mean(marked) > np.mean(clean) + 1
    assert toxicity.dictionaries([b"too little"], runs) is None


def test_clean_text_around_a_toxic_passage_does_not_hide_it(spark):
    rng = np.random.default_rng(1)
    syllables = ["the", "ing", "er", "on", "tion", "st", "re", "an", "ed", "or", "al", "un"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    clean = lambda n: " ".join(word() for _ in range(n))
    bad = lambda: " ".join(f"{word()} {w}" for w in rng.choice(["villainous", "scoundrel", "blackguard"], 12))
    rows = [(i, f"{clean(60)} {bad()}" if i % 4 == 0 else clean(100), int(i % 4 == 0)) for i in range(2400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = toxicity.train(table.select("doc_id", "text"), table.select("doc_id", "y"))
    texts = [*(f"{clean(n)} {bad()} {clean(n)}" for n in (0, 250, 2500)), clean(5000)]
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = dict(given.select("doc_id", toxicity.scores(model, F.col("text"))).collect())
    assert [scores[i] >= toxicity.THRESHOLD for i in range(4)] == [True, True, True, False]
