"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Letters of one to three places, everything else as a blank, are hashed into a fixed number of features. Document frequencies are counted over
all training documents. The model is fitted with follow-the-regularised-leader under an elastic net on a bounded sample with
equal shares for all languages, and a temperature, fitted on the part of the sample that the fit didn't see, calibrates its probabilities.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgertally.llm.tables import SLICE_BYTES, slices, stored

BITS = 16
ORDERS = 3
UNKNOWN = "und"
_SCALE = 10.0
#: Some 80 bytes are held for each byte of a slice.
_SLICE = SLICE_BYTES >> 2


@dataclass(frozen=True)
class Fit:
    """`sample`: documents that the regression is fitted on, over all languages; a language gets an equal share of it. `languages`: so many values of lang, the most
    frequent ones (ties to the smaller), are learned; weights and the memory of the fit grow with their number."""

    sample: int = 8000
    languages: int = 256
    epochs: int = 3
    rate: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.001


@dataclass(frozen=True)
class Model:
    """weights: (features, languages), with document frequencies and temperature worked in."""

    languages: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(texts: Sequence[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order the features along all texts and where each text's begin (one more at the end), and which texts have letters."""
    texts = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    codes = np.where(letter, codes, 32).astype(np.uint64)
    begins = np.append(0, np.cumsum(sizes))
    upto = np.append(0, np.cumsum(letter))
    has = upto[begins[1:]] > upto[begins[:-1]]
    found, starts = [], []
    value = np.zeros(len(codes), np.uint64)
    ends = np.repeat(begins[1:], sizes)
    with np.errstate(over="ignore"):
        for order in range(1, ORDERS + 1):
            shifted = np.zeros(len(codes), np.uint64)
            shifted[: len(codes) - order + 1] = codes[order - 1 :]
            value = value * np.uint64(0x100000001B3) + shifted + np.uint64(order)
            whole = np.arange(len(codes)) + order <= ends
            key = value[whole] * np.uint64(0x9E3779B97F4A7C15)
            found.append((key >> np.uint64(64 - BITS)).astype(np.int64))
            starts.append(np.append(0, np.cumsum(np.maximum(sizes - order + 1, 0))))
    return found, starts, has


def scores(model: Model, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities (texts, languages), and which texts have letters."""
    found, starts, has = grams(texts)
    logits = np.zeros((len(texts), len(model.languages)))
    for features, at in zip(found, starts, strict=True):
        full = np.flatnonzero(np.diff(at))
        if len(full):
            sums = np.stack([np.add.reduceat(w[features], at[full], dtype=np.float64) for w in model.weights.T], axis=1)
            logits[full] += sums / np.diff(at)[full, None]
    logits += model.bias
    p = np.exp(logits - logits.max(axis=1, keepdims=True)) if logits.size else logits
    return p / p.sum(axis=1, keepdims=True) if p.size else p, has


def remainder(doc_id: Column, of: int) -> Column:
    """The unsigned CRC-32 of the doc_id as text (a null one: the empty text), modulo `of`."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, texts = np.zeros(1 << BITS, np.int64), 0
    for batch in slices(batches, limit=_SLICE):
        found, starts, has = grams([t or "" for t in batch.column("text").to_pylist()])
        for row in np.flatnonzero(has):
            seen = np.zeros(1 << BITS, bool)
            for features, at in zip(found, starts, strict=True):
                seen[features[at[row] : at[row + 1]]] = True
            counts += seen
        texts += int(has.sum())
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(counts[at], texts), pa.int64())], ["feature", "documents"])


def _sparse(texts: Sequence[str], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    found, starts, _ = grams(texts)
    rows = []
    for row in range(len(texts)):
        parts = [(f[a[row] : a[row + 1]]) for f, a in zip(found, starts, strict=True)]
        features, at = np.unique(np.concatenate(parts), return_inverse=True)  # a text without letters has its blanks
        weights = np.bincount(at, np.concatenate([np.full(len(p), 1 / max(len(p), 1)) for p in parts]), len(features))
        rows.append((features.astype(np.int32), (_SCALE * weights * idf[features]).astype(np.float32)))
    return rows


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def fitted(rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: Sequence[str], languages: Sequence[str], idf: np.ndarray, fit: Fit) -> Model:
    """The regression on every row but each fifth, and the temperature on those. The order of rows is the order of learning."""
    known = {name: k for k, name in enumerate(languages)}
    answers = [known[name] for name in labels]
    z, n = np.zeros((2, (1 << BITS) + 1, len(languages)))  # the last row is the bias, which no penalty holds

    def weights(features: np.ndarray) -> np.ndarray:
        kept = np.where(np.abs(z[features]) > fit.l1, z[features] - np.sign(z[features]) * fit.l1, 0)
        return -kept / ((fit.beta + np.sqrt(n[features])) / fit.rate + fit.l2)

    free = 1 << BITS
    learn = [k for k in range(len(rows)) if k % 5] or list(range(len(rows)))
    for _ in range(fit.epochs):
        for k in learn:
            features, x = np.append(rows[k][0], free), np.append(rows[k][1], np.float32(1))
            w = weights(features)
            p = _softmax(x @ w)
            p[answers[k]] -= 1
            g = x[:, None] * p
            s = (np.sqrt(n[features] + g * g) - np.sqrt(n[features])) / fit.rate
            z[features] += g - s * w
            n[features] += g * g
    w = weights(np.arange(free + 1))
    check = [k for k in range(len(rows)) if k % 5 == 0]
    logits = np.array([rows[k][1] @ w[rows[k][0]] + w[free] for k in check]).reshape(len(check), len(languages))
    truth = np.array([answers[k] for k in check], np.int64)
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    doubt = 1 / (len(check) + 2)  # smoothed targets, so that a sample without errors doesn't claim certainty
    loss = []
    for t in grid:
        log_p = np.log(np.maximum(_softmax(logits / t), 1e-300))
        loss.append(-((1 - doubt) * log_p[np.arange(len(check)), truth] + doubt * log_p.mean(axis=1)).sum())
    heat = float(grid[int(np.argmin(loss))])
    return Model(tuple(languages), (_SCALE * idf[:, None] * w[:free] / heat).astype(np.float32), w[free] / heat)


def train(documents: DataFrame, fit: Fit = Fit()) -> Model | None:
    """A model from the text and lang of all given rows; None without a row that has a letter and a lang.

    To the driver come one row per learned language, at most one count per feature, and the model.
    """
    rows = documents.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(fit.languages).collect()}
    totals = rows.select("text").mapInArrow(_frequencies, "feature bigint, documents bigint").groupBy("feature").agg(F.sum("documents").alias("documents")).toPandas()
    frequencies, n = np.zeros(1 << BITS), 0
    for feature, documents_with in zip(totals.feature, totals.documents, strict=True):
        if feature < 0:
            n = documents_with
        else:
            frequencies[feature] = documents_with
    if not n:
        return None
    idf = np.where(frequencies > 0, np.log((1 + n) / (1 + frequencies)) + 0.1, 0)
    languages = sorted(counts)
    share = fit.sample / len(languages)
    # A row for each learned value, which Fit.languages bounds.
    rates = documents.sparkSession.createDataFrame([(name, min(1.0, share / counts[name])) for name in languages], "lang string, rate double")
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(rates), "lang").filter(draw < F.col("rate")).select("doc_id", "text", "lang")
    sample = stored(sample, "sample").repartition(1).sortWithinPartitions(F.xxhash64("text", "doc_id"), "doc_id")

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in slices(batches, limit=_SLICE):
            rows += _sparse(batch.column("text").to_pylist(), idf)
            labels += batch.column("lang").to_pylist()
        out = io.BytesIO()
        if rows:
            model = fitted(rows, labels, languages, idf, fit)
            np.savez_compressed(out, weights=model.weights, bias=model.bias)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    blobs = [r[0] for r in sample.select("text", "lang").mapInArrow(learn, "model binary").collect() if r[0]]
    if not blobs:
        return None
    with np.load(io.BytesIO(bytes(blobs[0]))) as arrays:
        return Model(tuple(languages), arrays["weights"], arrays["bias"])


def identified(documents: DataFrame, model: Model | None, columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The given columns of each row, then lang_pred and score, its calibrated probability.

    A text that is null or has no letter is `und` with score 0, as is everything without a model. Only `columns` and text are read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = list(columns)

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, limit=_SLICE):
            pred, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if model is not None:
                p, has = scores(model, [t or "" for t in batch.column("text").to_pylist()])
                best = p.argmax(axis=1)
                pred = [model.languages[k] if h else UNKNOWN for k, h in zip(best, has, strict=True)]
                score = np.where(has, p[np.arange(len(best)), best], 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    read = documents.select(*names, *([] if "text" in names else ["text"]))
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in documents.select(*names).dtypes)
    return read.mapInArrow(predict, f"{kinds}, lang_pred string, score double")


def identify(documents: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. Rows that are held out, by a checksum of the doc_id, and rows without a lang teach nothing."""
    held = remainder(F.col("doc_id"), 4) == 2
    model = train(documents.filter(~held), fit)
    return identified(documents, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
