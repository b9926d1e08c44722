"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are the distinct words of a text (runs of letters, A-Z as a-z), hashed. The log odds of a grade of at most k are a threshold for k less
a weighted sum of the features: all thresholds share the weights, and they are in order by construction. Weights are kept sparse by an L1 penalty.
The penalty is for the sum of all rows, so it weighs less the larger the sample is. A document gets the odds of every grade, its expected severity, and whether a grade above 0 is likelier than not.

Labels say toxic or not. Grades above 0 come from them: a toxic document's grade follows from how many different words it holds that toxic
documents of the sample have much oftener than others. The fit takes a bounded sample of labelled documents.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgertally.llm.tables import slices, stored
from ledgertally.llm.words import words

BITS = 18


@dataclass(frozen=True)
class Fit:
    """`sample`: labelled documents that the fit takes, half of them toxic if there are as many. `steps_at`: a toxic document of so many telling words or more
    has a higher grade. `least`: documents of the sample that a word must be in."""

    sample: int = 8000
    steps: int = 300
    rate: float = 0.3
    l1: float = 0.5
    telling: float = 1.5
    least: int = 3
    steps_at: tuple[int, ...] = (2, 4)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def odds(self, sums: np.ndarray) -> np.ndarray:
        """The probability of each grade, for sums of weights."""
        upto = 1 / (1 + np.exp(np.clip(sums[:, None] - self.thresholds, -500, 500)))
        return np.diff(np.column_stack([np.zeros(len(sums)), upto, np.ones(len(sums))]), axis=1)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each text, and where each text's begin (one more at the end)."""
    found = words(column, lower=True, letters=True)
    key = (found.text_of.astype(np.int64) << BITS) | (found.fingerprints() >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.unique(key)
    return key & ((1 << BITS) - 1), np.searchsorted(key, np.arange(len(column) + 1, dtype=np.int64) << BITS)


def _sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    upto = np.append(0.0, np.cumsum(values, dtype=np.float64))
    return upto[begins[1:]] - upto[begins[:-1]]


def grades(at: np.ndarray, begins: np.ndarray, toxic: np.ndarray, fit: Fit) -> np.ndarray:
    """0 for documents that aren't toxic, else 1 and more by the number of telling words."""
    row = np.repeat(np.arange(len(toxic)), np.diff(begins))
    size = 1 << BITS
    of_toxic, of_all = np.bincount(at[toxic[row]], minlength=size), np.bincount(at, minlength=size)
    n_toxic, n_clean = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    log_odds = np.log((of_toxic + 0.5) / n_toxic) - np.log((of_all - of_toxic + 0.5) / n_clean)
    telling = (log_odds > fit.telling) & (of_toxic >= max(3, 0.01 * n_toxic))
    found = _sums(telling[at].astype(float), begins)
    return np.where(toxic, 1 + (found[:, None] >= np.array(fit.steps_at)).sum(axis=1), 0)


def fitted(at: np.ndarray, begins: np.ndarray, grade: np.ndarray, fit: Fit) -> Model:
    """Weights and thresholds by proximal adaptive gradients on all rows."""
    kinds, row = int(grade.max(initial=0)) + 1, np.repeat(np.arange(len(grade)), np.diff(begins))
    weights, squares = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
    rare = np.bincount(at, minlength=1 << BITS) < fit.least  # words of so few documents would only be learned by heart
    shares = np.cumsum(np.bincount(grade, minlength=kinds) + 0.5)[:-1] / (len(grade) + 0.5 * kinds)
    start = np.log(shares / (1 - shares))
    first, gaps = float(start[0]) if kinds > 1 else 0.0, np.log(np.maximum(np.diff(start), 1e-3))
    free = np.append(first, gaps) if kinds > 1 else np.zeros(0)
    free_squares = np.full(len(free), 1e-8)
    for _ in range(fit.steps if kinds > 1 else 0):
        thresholds = free[0] + np.append(0.0, np.cumsum(np.exp(free[1:])))
        sums = _sums(weights[at], begins)
        upto = 1 / (1 + np.exp(np.clip(sums[:, None] - thresholds, -500, 500)))
        slope = upto * (1 - upto)
        edge = np.column_stack([np.zeros(len(grade)), upto, np.ones(len(grade))])
        slopes = np.column_stack([np.zeros(len(grade)), slope, np.zeros(len(grade))])
        rows = np.arange(len(grade))
        p = np.maximum(edge[rows, grade + 1] - edge[rows, grade], 1e-12)
        of_sum = (slopes[rows, grade + 1] - slopes[rows, grade]) / p / len(grade)  # of the loss, for a larger sum
        gradient = np.bincount(at, of_sum[row], 1 << BITS)
        gradient[rare] = 0
        squares += gradient**2
        step = fit.rate / np.sqrt(squares)
        weights -= step * gradient
        weights = np.sign(weights) * np.maximum(np.abs(weights) - step * fit.l1 / len(grade), 0)
        of_threshold = np.zeros((len(grade), kinds - 1))
        for k in range(kinds - 1):
            of_threshold[:, k] = (-(grade == k).astype(float) + (grade == k + 1)) * slope[:, k] / p / len(grade)
        g = of_threshold.sum(axis=0)
        g_free = np.append(g.sum(), [g[k:].sum() * np.exp(free[k]) for k in range(1, kinds - 1)])
        free_squares += g_free**2
        free -= 0.1 * g_free / np.sqrt(free_squares)
    thresholds = free[0] + np.append(0.0, np.cumsum(np.exp(free[1:]))) if kinds > 1 else np.zeros(0)
    return Model(weights.astype(np.float32), thresholds)


def _learn(fit: Fit):
    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, begins, toxic = [], [np.zeros(1, np.int64)], []
        for batch in slices(batches):
            found, own = features(batch.column("text"))
            begins.append(own[1:] + begins[-1][-1])
            at.append(found)
            toxic += batch.column("toxic").to_pylist()
        out = io.BytesIO()
        if toxic:
            joined, starts, marks = np.concatenate(at), np.concatenate(begins), np.array(toxic, bool)
            model = fitted(joined, starts, grades(joined, starts, marks, fit), fit)
            np.savez_compressed(out, weights=model.weights, thresholds=model.thresholds)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    return learn


def train(documents: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model:
    """A model from labels (doc_id, toxic: 0 is not toxic; null is no label) and their documents' texts. Without any, nothing is toxic."""
    known = stored(labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")), "known")
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 30)) / float(1 << 30)
    rate = [min(1.0, fit.sample / 2 / counts.get(k, 1)) for k in (False, True)]
    asked = stored(known.filter(draw < F.when(F.col("toxic"), rate[1]).otherwise(rate[0])), "asked")
    sample = documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(asked), "doc_id")  # the sample's size bounds it
    sample = stored(sample, "sample").repartition(1).sortWithinPartitions(F.xxhash64("text", "doc_id"), "doc_id")
    blobs = [r[0] for r in sample.select("text", "toxic").mapInArrow(_learn(fit), "model binary").collect() if r[0]]
    if not blobs:
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(0))
    with np.load(io.BytesIO(bytes(blobs[0]))) as arrays:
        return Model(arrays["weights"], arrays["thresholds"])


def graded(documents: DataFrame, model: Model, columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The given columns of each row, then severity (expected grade), grade (the likeliest), p_toxic (of a grade above 0), toxic (p_toxic at least a half).

    A null text is as one without words: it is never toxic, with severity 0. Only `columns` and text are read.
    """
    shared, names = documents.sparkSession.sparkContext.broadcast(model), list(columns)

    def grade(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, begins = features(batch.column("text"))
            odds = shared.value.odds(_sums(shared.value.weights[at], begins))
            odds[np.diff(begins) == 0] = np.eye(odds.shape[1])[0]
            above = 1 - odds[:, 0]
            values = [pa.array(odds @ np.arange(odds.shape[1])), pa.array(odds.argmax(axis=1).astype(np.int32)), pa.array(above), pa.array(above >= 0.5)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *values], [*names, "severity", "grade", "p_toxic", "toxic"])

    read = documents.select(*names, *([] if "text" in names else ["text"]))
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in documents.select(*names).dtypes)
    return read.mapInArrow(grade, f"{kinds}, severity double, grade int, p_toxic double, toxic boolean")


def toxicity(documents: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    return graded(documents, train(documents, labels, fit))
