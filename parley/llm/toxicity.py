"""Toxicity of texts by compression distance, with two zstandard dictionaries.

An *ordinary* dictionary is trained on windows of ordinary text. The *toxic* dictionary is trained on what sets toxic
text apart: of its words only the runs of characters whose grams are far more frequent in toxic documents. It
takes the place of the least valued part of the ordinary content, while header and entropy tables stay, so that
both dictionaries cost the same on ordinary prose and a shorter result under the toxic one means toxic content.

A text is cut into windows of whole words. Each window is compressed with both dictionaries; the difference of the
lengths has log odds, counted on documents that neither dictionary was trained on. A text has two distances: the sum of
them over the root of its windows, and their largest sum over a run of neighbouring windows, which clean text around a
passage does not lower. Each is turned into a probability by isotonic calibration, and the larger one once more.

Labels are learned from a bounded sample of labelled rows (``TOXIC_ROWS``, ``ORDINARY_ROWS``, by the smallest hash of the
id), weighted back to the share of the label among all training rows. Every text is scored whole, row by row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.language import held_out_of
from parley.llm.quality import isotonic, labelled
from parley.llm.store import own_columns, written

#: Bounds of the labelled sample, per label.
TOXIC_ROWS, ORDINARY_ROWS = 3000, 6000
#: Ordinary windows that the dictionary is trained on, about.
TRAINING_WINDOWS = 40_000
WINDOW_WORDS = 12
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 1_024
GRAMS = (5, 6)
#: A gram counts as toxic if this share of toxic documents has it, and at this many times the ordinary share.
SUPPORT, LIFT = 0.006, 20.0
#: Range of differences in bytes that are told apart.
LOW, HIGH = -5, 11
THRESHOLD = 0.7
#: End of a dictionary's header in the zstandard format: the three offsets to repeat first.
_REPEATS = bytes([1, 0, 0, 0, 4, 0, 0, 0, 8, 0, 0, 0])


def windows(text: str | None) -> list[bytes]:
    """The words of a whole text in lower case, ``WINDOW_WORDS`` at a time."""
    words = (text or "").lower().split()
    return [
        " ".join(words[i : i + WINDOW_WORDS]).encode("utf-8", "surrogatepass")
        for i in range(0, len(words), WINDOW_WORDS)
    ]


def word_grams(word: str) -> set[str]:
    padded = f" {word} "
    return {padded[i : i + n] for n in GRAMS for i in range(len(padded) - n + 1)}


def text_grams(text: str | None) -> set[str]:
    return set().union(*map(word_grams, set((text or "").lower().split())))


def marked_runs(text: str, marked: set[str]) -> list[str]:
    """The runs of characters of a text's words that marked grams cover."""
    runs = []
    for word in text.lower().split():
        if marked.isdisjoint(word_grams(word)):
            continue
        padded, hit = f" {word} ", [False] * (len(word) + 2)
        for n in GRAMS:
            for i in range(len(padded) - n + 1):
                if padded[i : i + n] in marked:
                    hit[i : i + n] = [True] * n
        start = None
        for i, on in enumerate([*hit, False]):
            if on and start is None:
                start = i
            elif not on and start is not None:
                runs.append(padded[start:i])
                start = None
    return runs


def _trained(samples: list[bytes], size: int) -> bytes | None:
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return None  # too few samples for the trainer


def _content(dictionary: bytes) -> int:
    return dictionary.index(_REPEATS) + len(_REPEATS)


def dictionaries(ordinary: list[bytes], toxic: list[list[str]]) -> tuple[bytes, bytes] | None:
    """(ordinary, toxic) dictionaries of equal size, or None where there is too little to train on."""
    base = _trained(ordinary, ORDINARY_BYTES)
    counted = Counter(run for runs in toxic for run in runs)
    if base is None or not counted:
        return None
    at = _content(base)
    # A line break, which no window holds, keeps two runs from matching as one.
    trained = _trained(["\n".join(runs).encode() for runs in toxic if runs], TOXIC_BYTES)
    if trained is not None:
        own = trained[_content(trained) :]
    else:
        own = "\n".join(r for r, _ in sorted(counted.items(), key=lambda x: (-x[1], x[0]))).encode()[:TOXIC_BYTES]
    own = own[: len(base) - at]
    return base, base[:at] + own + base[at + len(own) :]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    # A greedy search for matches of five bytes and more; dictionaries travel as bytes and are loaded per task.
    how = zstandard.ZstdCompressionParameters(
        compression_level=3,
        window_log=17,
        hash_log=17,
        chain_log=17,
        search_log=4,
        min_match=5,
        target_length=0,
        strategy=zstandard.STRATEGY_GREEDY,
        write_content_size=0,
        write_checksum=0,
        write_dict_id=0,
    )
    own = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=how)


@dataclass
class ToxicityModel:
    """The two dictionaries, the log odds per difference and the calibration's steps, last those of each distance."""

    ordinary: bytes
    toxic: bytes
    log_odds: np.ndarray
    step_at: np.ndarray
    step_value: np.ndarray
    steps: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def differences(self):
        """A function from a text to the differences of its windows, from ``LOW`` to ``HIGH``; made once per task."""
        if not self.ordinary:
            return lambda text: np.zeros(0, dtype=np.int64)
        plain, toxic = _compressor(self.ordinary).compress, _compressor(self.toxic).compress
        return lambda text: np.clip(
            np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)], dtype=np.int64), LOW, HIGH
        )

    def scorer(self):
        """A function from a text to the histogram of its windows' differences; made once per task."""
        found = self.differences()
        return lambda text: np.bincount(found(text) - LOW, minlength=HIGH - LOW + 1)

    def measurer(self):
        """A function from a text to its distances, whole and largest run; made once per task."""
        found = self.differences()

        def distances(text: str | None) -> tuple[float, float]:
            odds = self.log_odds[found(text) - LOW]
            return float(odds.sum() / np.sqrt(max(len(odds), 1))), largest_run(odds)

        return distances

    def larger(self, distances: np.ndarray) -> np.ndarray:
        """The larger probability of each row of distances; 0 where none is calibrated."""
        each = [np.interp(d, *steps) for d, steps in zip(distances.T, self.steps, strict=False)]
        return np.max([np.zeros(len(distances)), *each], axis=0)

    def score(self, distances: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.larger(distances), self.step_at, self.step_value), 0, 1)


def largest_run(values: np.ndarray) -> float:
    """The largest sum of one or more neighbouring values; 0 without any."""
    if not len(values):
        return 0.0
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return float((sums[1:] - np.minimum.accumulate(sums[:-1])).max())


def calibrated(at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic steps of labels over positions, rows of one position taken together."""
    places, which = np.unique(at, return_inverse=True)
    total = np.bincount(which, weight)
    return isotonic(places, np.bincount(which, weight * y) / total, total)


def _grams_of(kept: set[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                found = text_grams(text.as_py())
                total.update(found if kept is None else found & kept)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"]
        )

    return run


def marked_grams(toxic: DataFrame, ordinary: DataFrame, n_toxic: int, n_ordinary: int) -> set[str]:
    """Grams that are far more frequent in the toxic than in the ordinary texts (text), by documents."""
    count = lambda df, kept: (
        df.select("text").mapInArrow(_grams_of(kept), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    )
    often = count(toxic, None).filter(F.col("n") >= max(3, SUPPORT * n_toxic)).toPandas()
    here = dict(zip(often["gram"], often["n"], strict=True))
    found = count(ordinary, set(here)).toPandas()
    there = dict(zip(found["gram"], found["n"], strict=True))
    share = lambda n, rows: (n + 0.5) / (rows + 1)
    return {g for g, n in here.items() if share(n, n_toxic) > LIFT * share(there.get(g, 0), n_ordinary)}


def _runs(marked: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [marked_runs(t, marked) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "runs"]
            )

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(windows(text.as_py()), pa.binary())], names=["window"])


def _histograms(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        histogram = model.scorer()
        for batch in batches:
            found = [histogram(t).astype(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["y", "histogram"]
            )

    return run


def _distances(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = model.measurer()
        for batch in batches:
            found = np.array([distances(t) for t in batch.column(1).to_pylist()], dtype=np.float64).reshape(-1, 2)
            columns = [batch.column(0), pa.array(found[:, 0]), pa.array(found[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=["y", "whole", "run"])

    return run


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, y). Rows without label, text or id teach nothing.

    Where there is too little to train dictionaries on, every score is the share of label 1 (0.5 without labels).
    """
    usable = labels.filter("y IN (0, 1) AND doc_id IS NOT NULL").distinct()
    share = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = share.get(1, 0) / sum(share.values()) if share else 0.5
    nothing = ToxicityModel(b"", b"", np.zeros(HIGH - LOW + 1), np.array([0.0]), np.array([prior]))
    if not share.get(0) or not share.get(1):
        return nothing
    by_hash = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")
    most = F.when(F.col("y") == 1, TOXIC_ROWS).otherwise(ORDINARY_ROWS)
    chosen = (
        usable.withColumn("rank", F.row_number().over(by_hash))
        .filter(F.col("rank") <= max(TOXIC_ROWS, ORDINARY_ROWS))
        .filter(F.col("rank") <= most)
        .select("doc_id", "y")
    )
    # At most TOXIC_ROWS + ORDINARY_ROWS ids of 16 bytes. A repeated row is one example.
    known = docs.filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    sample = written(known.select("doc_id", "y", "text").dropDuplicates(["doc_id", "y"]), "toxicity-sample")
    apart = F.pmod(F.xxhash64("doc_id", F.lit("apart")), F.lit(3)) == 0
    learn, rest = sample.filter(~apart), sample.filter(apart)
    toxic, ordinary = learn.filter("y = 1"), learn.filter("y = 0")
    n = {r["y"]: r["n"] for r in learn.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    marked = marked_grams(toxic, ordinary, n.get(1, 0), n.get(0, 0))
    runs = toxic.select("doc_id", "text").mapInArrow(_runs(marked), "doc_id long, runs array<string>").toPandas()
    cut = ordinary.select("text").mapInArrow(_windows, "window binary")
    every = max(1, cut.count() // TRAINING_WINDOWS)
    drawn = cut.filter(F.pmod(F.xxhash64("window"), F.lit(every)) == 0).toPandas()["window"]
    made = dictionaries(sorted(map(bytes, drawn)), [list(r) for r in runs.sort_values("doc_id")["runs"]])
    if made is None:
        return nothing
    model = ToxicityModel(*made, nothing.log_odds, nothing.step_at, nothing.step_value)
    counted = rest.select("y", "text").mapInArrow(_histograms(model), "y int, histogram array<long>").toPandas()
    y = counted["y"].to_numpy()
    if not (y == 1).any() or not (y == 0).any():
        return nothing
    histograms = np.array(counted["histogram"].tolist(), dtype=np.float64).reshape(len(y), -1)
    odds = [histograms[y == k].sum(axis=0) + 1 for k in (0, 1)]
    model.log_odds = np.log(odds[1] / odds[1].sum()) - np.log(odds[0] / odds[0].sum())
    measured = rest.select("y", "text").mapInArrow(_distances(model), "y int, whole double, run double").toPandas()
    y, distances = measured["y"].to_numpy(), measured[["whole", "run"]].to_numpy()
    weight = np.where(y == 1, share[1] / (y == 1).sum(), share[0] / (y == 0).sum())
    model.steps = [calibrated(d, y, weight) for d in distances.T]
    model.step_at, model.step_value = calibrated(model.larger(distances), y, weight)
    return model


def scores(model: ToxicityModel, text: Column) -> Column:
    """The calibrated score of a text column, row by row."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        distances = model.measurer()
        for texts in batches:
            found = np.array([distances(t) for t in texts], dtype=np.float64).reshape(-1, 2)
            yield pd.Series(model.score(found), dtype="float64")

    return run.asNondeterministic()(text)


def rate(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic"
) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of ``df``, by a model of the rows that are not held out.

    NULL and empty texts have no window and get the score of distances 0; repeated rows get equal scores; an empty
    table gives an empty result. Other columns of both tables are not read.
    """
    docs = own_columns(df, doc_id=id_col, text=text_col)
    held_out = held_out_of(F.col("doc_id"), 3, 1)
    usable = labelled(labels, label).filter(~held_out)
    model = train(docs, usable)
    found = docs.select("doc_id", held_out.alias("held_out"), scores(model, F.col("text")).alias("score"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
