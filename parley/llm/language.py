"""Language of texts: sparse multinomial logistic regression on TF-IDF character n-grams.

1. Document frequencies of the hashed n-grams are counted over all training rows, one vector per task.
2. A bounded sample of labelled rows, ``per_class`` per language by the smallest hash of their id, becomes sparse vectors
   in the tasks. FTRL-proximal (follow the regularised leader) with an elastic net learns from four fifths of it; the
   rest fits one temperature by which the scores are divided.
3. Prediction is row by row: the model has (buckets + 1) x languages numbers, whatever the corpus, and travels with
   the plan. No row leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.store import free_name, own_columns

BUCKETS_LOG2 = 14
ORDERS = (1, 2, 3)
#: Labelled rows per language that the model learns from.
PER_CLASS = 1000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.05
UNKNOWN = "und"
#: Characters that are hashed at a time, so that a very long text needs little memory.
SPAN = 1 << 20
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed character n-grams of a whole text, in lower case."""
    size = 1 << BUCKETS_LOG2
    counts = np.zeros(size, dtype=np.int64)
    low = text.lower()
    longest = max(ORDERS)
    for at in range(0, len(low), SPAN):
        # Each span sees the first characters of the next one; grams that begin there are the next span's.
        part = low[at : at + SPAN + longest - 1]
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        begins = min(SPAN, len(low) - at)
        for order in ORDERS:
            n = min(begins, len(points) - order + 1)
            if n <= 0:
                continue
            mixed = np.full(n, order, dtype=np.uint32)
            for k in range(order):
                mixed = (mixed ^ points[k : k + n]) * _MIX[k % 3]
                mixed ^= mixed >> np.uint32(15)
            counts += np.bincount((mixed * _MIX[0]) >> np.uint32(32 - BUCKETS_LOG2), minlength=size)
    return counts


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of a text; the weights have length 1."""
    counts = gram_counts(text)
    at = np.flatnonzero(counts)
    weights = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt((weights**2).sum())
    return at, weights / norm if norm else weights


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(1 << BUCKETS_LOG2, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            total += gram_counts(text.as_py()) > 0
            rows += 1
    at = np.flatnonzero(total)
    # The number of rows stands at bucket -1.
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], names=["bucket", "n"]
    )


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """IDF of each bucket over all rows of ``texts`` (text, not NULL)."""
    counted = texts.mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    df = np.zeros(1 << BUCKETS_LOG2)
    known = found["bucket"] >= 0
    df[found.loc[known, "bucket"]] = found.loc[known, "n"]
    rows = found.loc[~known, "n"].sum()
    return np.log((1 + rows) / (1 + df)) + 1


@dataclass
class LanguageModel:
    """Languages in order, IDF, weights (buckets + 1 for the bias, languages) and the temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        at, value = vector(text, self.idf)
        p = _softmax((value @ self.weights[at] + self.weights[-1]) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, size: int, epochs: int = EPOCHS, seed: int = 7
) -> np.ndarray:
    """Weights of (indices, values, class) rows by FTRL-proximal with an L1 and an L2 penalty per coordinate."""
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(ns)) / ALPHA + L2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, value, label = rows[i]
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            error = _softmax(value @ w)
            error[label] -= 1
            g = value[:, None] * error[None, :]
            more = ns + g * g
            z[at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / ALPHA * w
            n[at] = more
    return weights(z, n)


def temperature_of(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = _softmax(logits / np.exp(t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    low, high, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _vectors(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vector(t, idf) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()),
                    pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary()),
                ],
                names=["doc_id", "lang", "buckets", "weights"],
            )

    return run


def train(docs: DataFrame, per_class: int = PER_CLASS) -> LanguageModel:
    """A model from ``docs`` (doc_id, text, lang). Rows without text, label or id teach nothing.

    Repeated rows are one example. Four of five examples teach the weights, the fifth the temperature; a single
    example teaches both. Without any such row the model knows no language and predicts ``und``.
    """
    usable = docs.filter("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    idf = inverse_frequencies(usable.select("text"))
    # A repeated row is one example. Only ids whose hash lies below twice the share that is wanted are ranked, so no
    # task gets more than some 2 * per_class of a language.
    examples = usable.select("doc_id", "lang").distinct().withColumn("hash", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    sizes = examples.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    near = examples.join(sizes, "lang").filter(F.col("hash") / (1 << 30) * F.col("n") <= 2 * per_class + 20)
    w = Window.partitionBy("lang").orderBy("hash", "doc_id")
    chosen = near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_class).select("doc_id", "lang")
    # per_class ids per language are sent to the tasks, and as many rows come back.
    sample = (
        usable.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
        .select("doc_id", "lang", "text")
        .mapInArrow(_vectors(idf), "doc_id long, lang string, buckets binary, weights binary")
        .dropDuplicates(["doc_id", "lang"])
        .toPandas()
        .sort_values(["doc_id", "lang"])
    )
    languages = sorted(sample["lang"].unique())
    size = 1 << BUCKETS_LOG2
    rows = []
    for lang, at, value in zip(sample["lang"], sample["buckets"], sample["weights"], strict=True):
        at = np.append(np.frombuffer(at, "<i4"), size).astype(np.int64)
        rows.append((at, np.append(np.frombuffer(value, "<f4"), 1).astype(np.float64), languages.index(lang)))
    if not languages:
        return LanguageModel([], idf, np.zeros((size + 1, 0)), 1.0)
    learn = [r for i, r in enumerate(rows) if i % 5] or rows
    kept = [r for i, r in enumerate(rows) if i % 5 == 0]
    weights = ftrl(learn, len(languages), size + 1)
    logits = np.array([value @ weights[at] for at, value, _ in kept])
    temperature = temperature_of(logits, np.array([label for _, _, label in kept]))
    return LanguageModel(languages, idf, weights, temperature)


def predictions(model: LanguageModel, text: Column) -> Column:
    """struct(lang_pred, score) of a text column, row by row."""

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [model.predict(t) for t in texts]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return run.asNondeterministic()(text)


def held_out_of(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of an id as text falls into ``part`` of ``parts``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def identify(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_class: int = PER_CLASS,
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row per row of ``df``, by a model of the rows that are not held out.

    ``und`` with score 0 is predicted for NULL texts and those without a letter. The language column is read from
    training rows only. Repeated rows get equal predictions; an empty table gives an empty result.
    """
    docs = own_columns(df, doc_id=id_col, text=text_col, lang=lang_col)
    held_out = held_out_of(F.col("doc_id"), 4, 2)
    model = train(docs.filter(~held_out), per_class)
    found = docs.select("doc_id", held_out.alias("held_out"), predictions(model, F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    least_score: float = 0.5,
    per_class: int = PER_CLASS,
) -> DataFrame:
    """The rows of ``df``, with all their columns, whose language is told with at least ``least_score``.

    Texts without a letter and NULL texts are rejected. The model learns from the same rows as in ``identify``.
    """
    docs = own_columns(df, doc_id=id_col, text=text_col, lang=lang_col)
    model = train(docs.filter(~held_out_of(F.col("doc_id"), 4, 2)), per_class)
    name = free_name(df, "language")
    found = df.withColumn(name, predictions(model, F.col(f"`{text_col}`").cast("string")))
    told = (F.col(name)["lang_pred"] != UNKNOWN) & (F.col(name)["score"] >= least_score)
    return found.filter(told).drop(name)
