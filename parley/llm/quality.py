"""Quality of texts: ridge regression on random Fourier features of document statistics, calibrated by steps.

1. Statistics of a text (sizes, shares of character classes, repetition, word shapes) are taken row by row.
2. The statistics of labelled rows are scaled by their mean and spread over all of them, and mapped to cosines whose
   products approximate a Gaussian kernel. Each task adds up its part of the normal equations; the parts are
   summed row by row of the matrix. What reaches the driver has (features + 1) squared numbers.
3. Rows set apart for it give, per narrow band of raw scores, the share of label 1; pooling adjacent violators makes
   the shares rise with the score (isotonic calibration). Bands are a fixed number too.
4. Scoring is row by row with the small model. Neither labels nor ids or sources are inputs of it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.language import held_out_of
from parley.llm.store import free_name, own_columns, written

FEATURES = 256
RIDGE = 1e-3
BANDS = 2000
THRESHOLD = 0.7
#: Every so-many-th labelled row is kept from the regression, for the calibration.
CALIBRATION_PART = 4
#: Groups in which the tasks' parts of the normal equations are added up first.
SUM_NODES = 64

_CLASSES = np.zeros(256, dtype=np.uint8)
for _code in range(256):
    _char = chr(_code)
    _CLASSES[_code] = (
        1
        if _char.islower()
        else 2
        if _char.isupper()
        else 3
        if _char.isdigit()
        else 4
        if _char in "\n\r"
        else 5
        if _char.isspace()
        else 6
        if _char in ".,;:?'\"()-"
        else 7
        if _char == "!"
        else 8
        if _char in "#$%&*|@^~<>{}[]\\/_+="
        else 0
    )
N_STATS = 26


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a whole text; all zero for NULL and empty texts."""
    out = np.zeros(N_STATS)
    if not text:
        return out
    n = len(text)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    low = points[points < 256]
    classes = np.bincount(_CLASSES[low], minlength=9) / n
    shares = np.bincount(low, minlength=256)
    shares = shares[shares > 0] / n
    words = text.split()
    lines = [line for line in text.split("\n") if line]
    out[0] = math.log1p(n)
    out[1:10] = classes
    out[10] = -(shares * np.log2(shares)).sum()
    out[11] = 1 - len(low) / n
    if words:
        m = len(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=m)
        seen = Counter(words)
        out[12] = math.log1p(m)
        out[13] = math.log1p(sizes.mean())
        out[14] = math.log1p(sizes.std())
        out[15] = math.log1p(sizes.max())
        out[16] = len(seen) / m
        out[17] = math.log1p(len(seen)) / math.log1p(m)
        out[18] = max(seen.values()) / m
        out[19] = (sizes <= 3).mean()
        out[20] = sum(c for w, c in seen.items() if w.isupper() and len(w) > 1) / m
        out[21] = sum(c for w, c in seen.items() if not w[-1].isalnum()) / m
        out[22] = sum(c for w, c in seen.items() if not w[0].isalnum()) / m
        out[23] = sum(c for w, c in seen.items() if c > 1 and len(w) > 5) / m
    if lines:
        out[24] = len(set(lines)) / len(lines)
        out[25] = math.log1p(n / len(lines))
    return out


@dataclass
class QualityModel:
    """Scaling, random directions, ridge weights and the calibration's steps."""

    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    step_at: np.ndarray
    step_value: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Cosine features and a constant, one row per row of ``stats``."""
        scaled = np.clip((stats - self.mean) / self.spread, -6, 6)
        cosines = np.cos(scaled @ self.directions + self.phases) * math.sqrt(2 / len(self.phases))
        return np.hstack([cosines, np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.step_at, self.step_value), 0, 1)


def isotonic(at: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: positions and rising values, one per block, weighted."""
    blocks: list[list[float]] = []
    for x, y, w in zip(at, value, weight, strict=True):
        blocks.append([x * w, y * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    sums = np.array(blocks, dtype=float).reshape(-1, 3)
    return sums[:, 0] / sums[:, 2], sums[:, 1] / sums[:, 2]


def stats_of(text: Column) -> Column:
    """The statistics of a text column as an array, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(t) for t in texts])

    return run.asNondeterministic()(text)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _normal_parts(model: QualityModel):
    from pyspark import TaskContext

    size = len(model.phases) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                z = model.features(_matrix(batch.column(0)))
                y = batch.column(1).to_numpy(zero_copy_only=False)
                total += np.hstack([z.T @ z, (z.T @ y)[:, None]])
        if total.any():
            node = TaskContext.get().partitionId() % SUM_NODES
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(size, dtype=np.int32)),
                    pa.array(np.full(size, node, dtype=np.int32)),
                    pa.array([r.tobytes() for r in total], pa.binary()),
                ],
                names=["line", "node", "part"],
            )

    return run


def _sum_parts(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(p, dtype=np.float64) for p in pdf["part"])
    return pd.DataFrame({"line": pdf["line"].iloc[:1], "node": pdf["node"].iloc[:1], "part": [total.tobytes()]})


def _bands(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = np.clip(model.raw(_matrix(batch.column(0))), -0.5, 1.5)
                band = ((raw + 0.5) / 2 * BANDS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(raw), batch.column(1)], names=["band", "raw", "y"])

    return run


def train(docs: DataFrame, labels: DataFrame, features: int = FEATURES, seed: int = 11) -> QualityModel:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, y). Rows without label or id teach nothing.

    The label of a document is the mean of its labels. Documents whose hashed id is a multiple of ``CALIBRATION_PART``
    calibrate, the others teach the weights; where one of these parts is empty, it takes all rows. Without labelled
    rows every score is 0.5.
    """
    labels = labels.filter("y IS NOT NULL AND doc_id IS NOT NULL")
    labels = labels.groupBy("doc_id").agg(F.avg(F.col("y").cast("double")).alias("y"))
    # The join moves ids, statistics and labels, not texts.
    rows = docs.select("doc_id", stats_of(F.col("text")).alias("stats")).join(labels, "doc_id")
    rows = written(rows.select("doc_id", "stats", "y"), "quality-stats")
    moments = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(N_STATS)],
        *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(N_STATS)],
    ).first()
    random = np.random.default_rng(seed)
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(N_STATS)])
    spread = np.array([moments[f"s{i}"] or 1.0 for i in range(N_STATS)])
    width = math.sqrt(N_STATS) * 0.6
    model = QualityModel(
        mean,
        np.where(spread > 1e-9, spread, 1.0),
        random.normal(0, 1 / width, (N_STATS, features)),
        random.uniform(0, 2 * math.pi, features),
        np.zeros(features + 1),
        np.array([0.0]),
        np.array([0.5]),
    )
    if not moments["n"]:
        return model
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION_PART)) == 0
    held = rows.agg(F.count_if(apart)).first()[0]
    parts = rows.filter(F.lit(True) if held == moments["n"] else ~apart).select("stats", "y")
    summed = (
        parts.mapInArrow(_normal_parts(model), "line int, node int, part binary")
        .groupBy("line", "node")
        .applyInPandas(_sum_parts, "line int, node int, part binary")
        .groupBy("line")
        .applyInPandas(_sum_parts, "line int, node int, part binary")
        .toPandas()
        .sort_values("line")
    )
    total = np.array([np.frombuffer(p, dtype=np.float64) for p in summed["part"]])
    gram, right = total[:, :-1], total[:, -1]
    model.weights = np.linalg.solve(gram + RIDGE * gram[-1, -1] * np.eye(len(gram)) / features, right)
    counted = (
        rows.filter(apart if held else F.lit(True))
        .select("stats", "y")
        .mapInArrow(_bands(model), "band long, raw double, y double")
        .groupBy("band")
        .agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))
        .toPandas()
        .sort_values("band")
    )
    if len(counted):
        model.step_at, model.step_value = isotonic(counted["raw"], counted["y"], counted["n"])
    return model


def scores(model: QualityModel, text: Column) -> Column:
    """The calibrated score of a text column, row by row."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if len(texts):
                yield pd.Series(model.score(np.array([statistics(t) for t in texts])))
            else:
                yield pd.Series([], dtype="float64")

    return run.asNondeterministic()(text)


def labelled(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    return labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y"))


def rate(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality"
) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of ``df``, by a model of the rows that are not held out.

    NULL and empty texts have all statistics zero and are scored like any other; repeated rows get equal scores;
    an empty table gives an empty result. Other columns of both tables are not read.
    """
    docs = own_columns(df, doc_id=id_col, text=text_col)
    held_out = held_out_of(F.col("doc_id"), 4, 2)
    model = train(docs.filter(~held_out), labelled(labels, label))
    found = docs.select("doc_id", held_out.alias("held_out"), scores(model, F.col("text")).alias("score"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality"
) -> DataFrame:
    """The rows of ``df``, with all their columns, that ``rate`` predicts to be of label 1."""
    docs = own_columns(df, doc_id=id_col, text=text_col)
    model = train(docs.filter(~held_out_of(F.col("doc_id"), 4, 2)), labelled(labels, label))
    name = free_name(df, "quality_score")
    rated = df.withColumn(name, scores(model, F.col(f"`{text_col}`").cast("string")))
    return rated.filter(F.col(name) >= THRESHOLD).drop(name)
