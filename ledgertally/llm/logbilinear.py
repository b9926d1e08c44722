"""Scores of documents by a log-bilinear language model, trained with noise-contrastive estimation, beside a unigram base.

The model predicts the class of each token from that of the one before: the most frequent words are classes of their own, the others
share classes by their last two bytes, and the end is one. A context vector, turned by a shared matrix, meets an output vector and a bias;
training tells observed pairs from pairs with noise words, in numpy, data-parallel over shards of contexts with averaging after each round. Its
data are the counts of all pairs in all training documents. The number of classes grows with the root of the number of different words, and so do the contexts; the number of shards grows
with that of different pairs, of which each shard draws about as many in a round as it has. To score, products of whole matrices give each context's normaliser, and those of a slice's contexts
and classes the log probabilities of its tokens. A word within a shared class has its smoothed share of the class's count.

Words are told apart by fingerprints. Counts of the `head` most frequent ones go to every task; the others' are joined, one row for each document and word.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgertally.llm.langid import remainder
from ledgertally.llm.tables import passing, slices, stored
from ledgertally.llm.words import words

_SUFFIXES = 255
#: Contexts whose normalisers are worked out together, and tokens that are scored together.
_BLOCK = 512
_TOKENS = 1 << 15


@dataclass(frozen=True)
class Sizes:
    """`classes`: of tokens, with 255 shared ones and the end among them, at least; `per_root`: classes for each unit of the root of the number of different words. `head`: words
    whose counts are broadcast, 16 bytes each. `noise`: words drawn for each pair; `batch`: pairs of one gradient; `steps`: gradients of each shard in a round. `shards`: at least; a shard
    has no more than about `batch` times `steps` different pairs."""

    classes: int = 2048
    per_root: float = 4.0
    head: int = 1 << 17
    places: int = 48
    noise: int = 12
    batch: int = 4096
    steps: int = 150
    rounds: int = 4
    shards: int = 4
    rate: float = 0.3


@dataclass(frozen=True)
class Head:
    """Sorted fingerprints of frequent words, their counts, and their classes (-1: a shared one)."""

    prints: np.ndarray
    counts: np.ndarray
    classes: np.ndarray

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (-1: not here) and class of each word."""
        if not len(self.prints) or not len(prints):
            return np.full(len(prints), -1), np.full(len(prints), -1)
        at = np.minimum(np.searchsorted(self.prints, prints), len(self.prints) - 1)
        hit = self.prints[at] == prints
        return np.where(hit, self.counts[at], -1), np.where(hit, self.classes[at], -1)


def _suffix(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The shared class of each word: by its last two bytes."""
    last = data[ends - 1].astype(np.int64)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    return (last * 31 + before * 7) % _SUFFIXES


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = words(batch.column("text"), lower=True)
        prints, first, n = np.unique(found.fingerprints(), return_index=True, return_counts=True)
        shared = _suffix(found.data, found.starts[first], found.ends[first])
        yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(shared, pa.int32()), pa.array(n, pa.int64())], ["word", "shared", "n"])


@dataclass(frozen=True)
class Tokens:
    """Of a slice of texts: for each token, end included, its class and the class before; for each word its count if known here."""

    classes: np.ndarray
    before: np.ndarray
    text: np.ndarray
    prints: np.ndarray
    counts: np.ndarray
    shared: np.ndarray
    own: np.ndarray
    word_text: np.ndarray


def tokens(column: pa.Array, head: Head, sizes: Sizes) -> Tokens:
    found = words(column, lower=True)
    prints, shared = found.fingerprints(), _suffix(found.data, found.starts, found.ends)
    counts, own = head.find(prints)
    lengths = found.counts
    text = np.repeat(np.arange(len(lengths)), lengths + 1)
    ends = np.cumsum(lengths + 1) - 1
    classes = np.full(len(text), sizes.classes - 1)
    is_word = np.ones(len(text), bool)
    is_word[ends] = False
    classes[is_word] = np.where(own >= 0, own, sizes.classes - 1 - _SUFFIXES + shared)
    before = np.empty(len(text), np.int64)
    before[1:] = classes[:-1]
    before[ends - lengths] = sizes.classes  # the start
    return Tokens(classes, before, text, prints, counts, shared, own, found.text_of)


# --- training -----------------------------------------------------------------------------------------


@dataclass
class Model:
    """context: (classes and the start, places); turn: (places, places); output: (classes, places); bias: (classes)."""

    context: np.ndarray
    turn: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def log_probabilities(self) -> np.ndarray:
        """Natural logarithms, for each class before (and the start) of each class."""
        scores = self.context @ self.turn @ self.output.T + self.bias
        most = scores.max(axis=1, keepdims=True)
        return scores - most - np.log(np.exp(scores - most).sum(axis=1, keepdims=True))

    def normalisers(self, a: int, b: int) -> np.ndarray:
        """The logarithms that the scores after the contexts from a to b are lowered by."""
        scores = self.context[a:b] @ self.turn @ self.output.T + self.bias
        most = scores.max(axis=1)
        return most + np.log(np.exp(scores - most[:, None]).sum(axis=1))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: v.astype(np.float32) for k, v in vars(self).items()})
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Model:
        with np.load(io.BytesIO(data)) as arrays:
            return Model(**{k: arrays[k] for k in ("context", "turn", "output", "bias")})


def fresh(unigram: np.ndarray, sizes: Sizes) -> Model:
    rng = np.random.default_rng(7)
    context = 0.1 * rng.standard_normal((sizes.classes + 1, sizes.places))
    output = 0.1 * rng.standard_normal((sizes.classes, sizes.places))
    return Model(context.astype(np.float32), np.eye(sizes.places, dtype=np.float32), output.astype(np.float32), np.log(unigram).astype(np.float32))


def contrasted(model: Model, before: np.ndarray, after: np.ndarray, n: np.ndarray, unigram: np.ndarray, sizes: Sizes, seed: int) -> Model:
    """`steps` gradients on pairs drawn by their counts, each against `noise` words drawn by theirs."""
    rng = np.random.default_rng(seed)
    upto, noise_upto = np.cumsum(n / n.sum()), np.cumsum(unigram)
    log_noise = np.log(unigram * sizes.noise).astype(np.float32)
    now = Model(*(v.copy() for v in vars(model).values()))
    seen = {k: np.full(v.shape, 1e-3, np.float32) for k, v in vars(now).items()}

    def move(name: str, gradient: np.ndarray, at: np.ndarray | None = None) -> None:
        values, squares = getattr(now, name), seen[name]
        rows = slice(None) if at is None else at
        squares[rows] += gradient**2
        values[rows] += sizes.rate * gradient / np.sqrt(squares[rows])

    for _ in range(sizes.steps):
        drawn = np.minimum(np.searchsorted(upto, rng.random(sizes.batch)), len(n) - 1)
        c = before[drawn]
        noise = np.minimum(np.searchsorted(noise_upto, rng.random((sizes.batch, sizes.noise))), sizes.classes - 1)
        w = np.concatenate([after[drawn][:, None], noise], axis=1)
        turned = now.context[c] @ now.turn
        out = now.output[w]
        margin = np.einsum("bd,bkd->bk", turned, out) + now.bias[w] - log_noise[w]
        error = -1 / (1 + np.exp(-margin))
        error[:, 0] += 1
        error /= sizes.batch
        toward = np.einsum("bk,bkd->bd", error, out)
        words_at, place = np.unique(w, return_inverse=True)
        place = place.reshape(w.shape)
        # sums over the batch as products with sparse rows: by class, sorted
        order = np.argsort(place, axis=None, kind="stable")
        begins = np.searchsorted(place.reshape(-1)[order], np.arange(len(words_at)))
        rows = order // (sizes.noise + 1)
        out_gradient = np.add.reduceat(error.reshape(-1)[order, None] * turned[rows], begins)
        contexts_at, which = np.unique(c, return_inverse=True)
        order_c = np.argsort(which, kind="stable")
        begins_c = np.searchsorted(which[order_c], np.arange(len(contexts_at)))
        context_gradient = np.add.reduceat((toward @ now.turn.T)[order_c], begins_c)
        turn_gradient = now.context[c].T @ toward
        move("bias", np.bincount(place.reshape(-1), error.reshape(-1), len(words_at)).astype(np.float32), words_at)
        move("output", out_gradient, words_at)
        move("context", context_gradient, contexts_at)
        move("turn", turn_gradient)
    return now


def _learned(shared, unigram: np.ndarray, sizes: Sizes, turn: int):
    """The rows of a shard's model: of its own contexts, and of what all shards share, with the weight of its pairs."""

    def learn(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("before", "ascending"), ("after", "ascending")])
        before, after, n = (shard.column(c).to_numpy() for c in ("before", "after", "n"))
        number = int(before[0]) % sizes.shards
        found = contrasted(Model.from_bytes(shared.value), before, after, n, unigram, sizes, 1000 * turn + number)
        contexts = np.arange(number, len(found.context), sizes.shards)
        parts = [("context", contexts, found.context[contexts]), ("turn", np.arange(len(found.turn)), found.turn), ("output", np.arange(len(found.output)), np.c_[found.output, found.bias])]
        columns = [
            pa.array([name for name, rows, _ in parts for _ in rows]),
            pa.array(np.concatenate([rows for _, rows, _ in parts]), pa.int32()),
            pa.array(np.full(sum(len(rows) for _, rows, _ in parts), float(n.sum()))),
            pa.array([v for _, _, values in parts for v in values.astype(np.float64)], pa.list_(pa.float64())),
        ]
        return pa.table(columns, ["part", "row", "n", "places"])

    return learn


def _averaged(model: Model, parts: DataFrame, total: float, sizes: Sizes) -> Model:
    """The model with rows replaced by the shards' means, weighted by their pairs. Sums are of decimals, so that the order of shards doesn't matter."""
    weight = F.col("n") / F.lit(total)
    sums = [F.sum((F.get("places", F.lit(k)) * weight).cast("decimal(38,18)")).cast("double").alias(f"p{k}") for k in range(sizes.places + 1)]
    mean = parts.groupBy("part", "row").agg(F.sum(weight.cast("decimal(38,18)")).cast("double").alias("weight"), *sums).toArrow()
    now = Model(*(v.copy() for v in vars(model).values()))
    names, rows, weights = mean.column("part").to_numpy(zero_copy_only=False), mean.column("row").to_numpy(), mean.column("weight").to_numpy()
    values = np.stack([pc.fill_null(mean.column(f"p{k}"), 0).to_numpy() for k in range(sizes.places + 1)], axis=1) / weights[:, None]
    for name in ("context", "turn", "output"):
        at = names == name
        getattr(now, name)[rows[at]] = values[at, : sizes.places]
    now.bias[rows[names == "output"]] = values[names == "output", sizes.places]
    return now


def trained(pairs: DataFrame, unigram: np.ndarray, sizes: Sizes) -> Model:
    """From counts of pairs (before, after, n): rounds of training on every shard, each from the mean of the last round's models. To the driver come the rows of one model."""
    model = fresh(unigram, sizes)
    different, total = pairs.agg(F.count("*"), F.sum("n")).first()
    if not different:
        return model
    sizes = replace(sizes, shards=max(sizes.shards, -(-different // (sizes.batch * sizes.steps))))
    cells = pairs.withColumn("shard", F.col("before") % sizes.shards)
    for turn in range(sizes.rounds):
        shared = pairs.sparkSession.sparkContext.broadcast(model.to_bytes())
        with passing():
            parts = cells.groupBy("shard").applyInArrow(_learned(shared, unigram, sizes, turn), "part string, row int, n double, places array<double>")
            model = _averaged(model, stored(parts, "parts"), float(total), sizes)
        shared.unpersist()
    return model


def _normalisers(spark: SparkSession, shared, contexts: int) -> np.ndarray:
    """Of all contexts, worked out by blocks of them."""

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.from_bytes(shared.value)
        for batch in batches:
            for block in batch.column("id").to_numpy():
                found = model.normalisers(int(block) * _BLOCK, min(contexts, (int(block) + 1) * _BLOCK))
                yield pa.RecordBatch.from_arrays([pa.array([int(block)]), pa.array([found.astype(np.float64)], pa.list_(pa.float64()))], ["block", "values"])

    count = -(-contexts // _BLOCK)
    found = spark.range(0, count, 1, count).mapInArrow(blocks, "block bigint, values array<double>").collect()
    return np.concatenate([row["values"] for row in sorted(found, key=lambda row: row.block)])


def _pairs(head_of, sizes: Sizes):
    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = tokens(batch.column("text"), head_of.value, sizes)
            codes, n = np.unique(found.before * sizes.classes + found.classes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes // sizes.classes), pa.array(codes % sizes.classes), pa.array(n)], ["before", "after", "n"])

    return pairs


# --- scoring ------------------------------------------------------------------------------------------


def _summed(values: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    return np.bincount(text, values, texts) if len(text) else np.zeros(texts)


def _log10_of(model: Model, turned: np.ndarray, normalisers: np.ndarray, before: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Log10 probabilities of classes after the classes before."""
    out = np.empty(len(before))
    for a in range(0, len(before), _TOKENS):
        c, w = before[a : a + _TOKENS], classes[a : a + _TOKENS]
        out[a : a + _TOKENS] = np.einsum("ij,ij->i", turned[c], model.output[w]) + model.bias[w] - normalisers[c]
    return out / np.log(10)


def _scored(shared, sizes: Sizes):
    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, data, normalisers, share = shared.value
        model = Model.from_bytes(data)
        turned = model.context @ model.turn
        part, row = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            texts = batch.num_rows
            found = tokens(batch.column("text"), head, sizes)
            score = _summed(_log10_of(model, turned, normalisers, found.before, found.classes), found.text, texts)
            spread = found.own < 0  # words of a shared class: their share of it
            score -= _summed(share[found.shared[spread]], found.word_text[spread], texts)
            known = found.counts >= 0
            logs = np.log10(np.maximum(found.counts, 0) + 0.5)
            base = _summed(logs[known], found.word_text[known], texts)
            score += _summed(logs[known & spread], found.word_text[known & spread], texts)
            rest, rest_text = found.prints[~known], found.word_text[~known]
            order = np.lexsort((rest, rest_text))
            rest, rest_text = rest[order], rest_text[order]
            new = np.ones(len(rest), bool)
            new[1:] = (rest[1:] != rest[:-1]) | (rest_text[1:] != rest_text[:-1])
            times = np.diff(np.append(np.flatnonzero(new), len(rest)))
            at = np.append(0, np.cumsum(np.bincount(rest_text[new], minlength=texts))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(v)) for v in (rest[new].view(np.int64), times.astype(np.int32))]
            lengths = np.bincount(found.text, minlength=texts)
            in_head = _summed(known.astype(float), found.word_text, texts).astype(np.int64)
            uid = (part << 33) + row + np.arange(texts)
            row += texts
            columns = [batch.column("doc_id"), pa.array(uid), pa.array(lengths, pa.int64()), pa.array(in_head), pa.array(base), pa.array(score), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "uid", "n_tokens", "in_head", "base", "own", "rest", "times"])

    return scored


def score(documents: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the whole text's probability).

    Rows whose checksum of the doc_id says held_out teach nothing. A null or wordless text is an end alone. Without training rows every token has
    base probability 1 and no class is likelier than another. Every input row gives one row. Columns other than doc_id and text are not read.
    """
    spark = documents.sparkSession
    held = remainder(F.col("doc_id"), 5) == 1
    read = documents.select("doc_id", "text")
    training = read.filter(~held)
    ends = training.count()
    counts = training.select("text").mapInArrow(_counted, "word bigint, shared int, n bigint").groupBy("word", "shared").agg(F.sum("n").alias("n"))
    counts = stored(counts, "counts")
    shares = counts.groupBy("shared").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toPandas()
    total, kinds = int(shares.n.sum()) + ends, int(shares.kinds.sum()) + (ends > 0)
    sizes = replace(sizes, classes=max(sizes.classes, int(sizes.per_root * kinds**0.5)))

    # The head: down to the lowest level of counts, in eighths of a doubling, that fits; its own classes are its first words.
    level = F.floor(F.log2("n") * 8)
    levels = counts.groupBy(level.alias("level")).count().toPandas().sort_values("level", ascending=False)
    fit = levels[levels["count"].cumsum() <= sizes.head].level
    frequent = counts.filter(level >= int(fit.min())).toPandas() if len(fit) else shares.head(0).assign(word=[])
    frequent = frequent.sort_values(["n", "word"], ascending=[False, True])
    own = np.full(len(frequent), -1)
    own[: sizes.classes - 1 - _SUFFIXES] = np.arange(min(len(frequent), sizes.classes - 1 - _SUFFIXES))
    prints = frequent.word.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(prints)
    head = Head(prints[order], frequent.n.to_numpy(np.int64)[order], own[order])

    # What words of each class, own or shared, have of all tokens.
    first = frequent[own >= 0]
    of_class, of_kinds = np.zeros(_SUFFIXES), np.zeros(_SUFFIXES)
    np.add.at(of_class, shares.shared.to_numpy(int), shares.n.to_numpy(float))
    np.add.at(of_kinds, shares.shared.to_numpy(int), shares.kinds.to_numpy(float))
    np.subtract.at(of_class, first.shared.to_numpy(int), first.n.to_numpy(float))
    np.subtract.at(of_kinds, first.shared.to_numpy(int), 1.0)
    unigram = np.concatenate([np.zeros(sizes.classes - 1 - _SUFFIXES), of_class, [ends]])
    unigram[: len(first)] = first.n.to_numpy(float)
    unigram = (unigram + 0.5) / (unigram + 0.5).sum()
    share = np.log10(of_class + 0.5 * (of_kinds + 1))

    head_of = spark.sparkContext.broadcast(head)
    pairs = training.select("text").mapInArrow(_pairs(head_of, sizes), "before bigint, after bigint, n bigint").groupBy("before", "after").agg(F.sum("n").alias("n"))
    model = trained(stored(pairs, "pairs"), unigram, sizes)

    normalisers = _normalisers(spark, spark.sparkContext.broadcast(model.to_bytes()), len(model.context))
    shared = spark.sparkContext.broadcast((head, model.to_bytes(), normalisers, share))
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = read.mapInArrow(_scored(shared, sizes), f"doc_id {kind}, uid bigint, n_tokens bigint, in_head bigint, base double, own double, rest array<bigint>, times array<int>")
    rows = stored(rows, "scored")
    rest = rows.select("uid", F.explode(F.arrays_zip("rest", "times")).alias("r")).select("uid", F.col("r.rest").alias("word"), F.col("r.times").alias("times"))
    rest = rest.join(counts.select("word", "n"), "word", "left")
    logs = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    of_rest = rest.groupBy("uid").agg(F.sum(logs).alias("logs"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"))
    out = rows.drop("rest", "times").join(of_rest, "uid", "left")
    logs, known_rest = F.coalesce("logs", F.lit(0.0)), F.coalesce("known", F.lit(0))
    end_log = float(np.log10(ends + 0.5))
    base = F.col("base") + logs + F.lit(end_log) - F.col("n_tokens") * F.lit(float(np.log10(total + 0.5 * (kinds + 1))))
    return out.select(
        "doc_id",
        held.alias("held_out"),
        "n_tokens",
        (F.col("in_head") + known_rest + F.lit(1 if ends else 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("own") + logs).alias("score"),
    )
