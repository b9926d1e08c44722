"""Collocations: phrases of two and three words that occur together more often than their parts suggest.

1. Spark counts all words of each language. A word's key is a 64-bit fingerprint of language and word. Only words that are frequent enough themselves can be part
   of a candidate or of its parts.
2. Frequent words get numbers, so that an n-gram of them is packed into one integer; the table of numbers is bounded, and n-grams with a word beyond it keep the keys of all
   their words. Tasks count n-grams in counting quotient filters, one for each range of permuted keys, and the filters of a range are merged. Permuted keys are spread evenly,
   and a frequent phrase is one key in each task's filter, so no range is hot.
3. The counts of parts and the longer candidates around a phrase are joined to the candidates, and each language's best are ranked.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgertally.llm.quotient import added, encode, merged, permuted, restored
from ledgertally.llm.tables import slices, stored
from ledgertally.llm.words import Words, buffer, mixed

UNKNOWN = "und"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS_PIECE = np.zeros(256, bool)
_ENDS_PIECE[[*b".,;:!?", 10, 11, 12, 13]] = True
_OUTSIDE = _ENDS_PIECE.copy()
_OUTSIDE[[32, 9]] = True
#: Bits of the number of a word; three of them are one limb of 63 bits.
_BITS = 21


@dataclass(frozen=True)
class Mining:
    """least: occurrences of a candidate. inside: a candidate goes if a longer one has so many percent of its occurrences. best: rows for each language. dictionary: words
    that get a number. held: distinct n-grams that a task holds before it emits filters. merged: n-grams that a range may have, repeats across tasks included."""

    least: int = 10
    inside: int = 50
    best: int = 2000
    dictionary: int = (1 << _BITS) - 1
    held: int = 1 << 21
    merged: int = 1 << 21


def pieces(batch: pa.RecordBatch) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of lower-cased texts, their keys, and for each word but the last whether the next one is in the same piece."""
    data, offsets = buffer(batch.column("text"))
    data = _LOWER[data]
    outside = np.append(_OUTSIDE[data], True)
    new = np.zeros(len(data) + 1, bool)
    new[offsets] = True
    before = np.append(True, outside[:-1])
    starts, ends = np.flatnonzero(~outside & (before | new)), np.flatnonzero(~before & (outside | new))
    found = Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))
    langs = np.array([int.from_bytes(blake2b(lang.encode(), digest_size=8).digest()) for lang in batch.column("lang").to_pylist()], np.uint64)
    keys = mixed(found.fingerprints() ^ langs[found.text_of])
    breaks = np.cumsum(_ENDS_PIECE[data])
    breaks = (breaks[starts] if len(starts) else starts) + found.text_of
    return found, keys, breaks[1:] == breaks[:-1]


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each slice with their counts."""
    for batch in slices(batches):
        found, keys, _ = pieces(batch)
        keys, first, counts = np.unique(keys, return_index=True, return_counts=True)
        sizes = (found.ends - found.starts)[first]
        begins = np.append(0, np.cumsum(sizes))
        data = found.data[np.repeat(found.starts[first] - begins[:-1], sizes) + np.arange(begins[-1])]
        text = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(begins.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
        langs = batch.column("lang").take(pa.array(found.text_of[first]))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), langs, text, pa.array(counts, pa.int64())], ["key", "lang", "word", "f"])


def _grams(keys: np.ndarray, joined: np.ndarray, numbers: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of two and three words of a slice: one limb if all words have a number, else three. `whole`: what has no number is no part of a candidate."""
    place = np.minimum(np.searchsorted(numbers, keys), max(0, len(numbers) - 1))
    ids = np.where(numbers[place] == keys, place + 1, 0).astype(np.uint64) if len(numbers) else np.zeros(len(keys), np.uint64)
    packed, wide = [], []
    for size in (2, 3):
        at = np.flatnonzero(joined if size == 2 else joined[1:] & joined[:-1])
        known = np.logical_and.reduce([ids[at + k] > 0 for k in range(size)])
        value = np.zeros(int(known.sum()), np.uint64)
        for k in range(3):
            value = value << np.uint64(_BITS) | (ids[at[known] + k] if k < size else np.uint64(0))
        packed.append(value)
        if not whole:
            rest = at[~known]
            wide.append(np.stack([keys[rest + k] if k < size else np.zeros(len(rest), np.uint64) for k in range(3)], axis=1))
    return np.concatenate(packed), np.concatenate(wide) if wide else np.zeros((0, 3), np.uint64)


def _shuffled(wide: np.ndarray) -> np.ndarray:
    """Three limbs with the first one permuted under the others."""
    first = permuted(wide[:, 0] ^ mixed(wide[:, 1] ^ mixed(wide[:, 2])), 64)
    return np.concatenate([first[:, None], wide[:, 1:]], axis=1)


def _filters(numbers, whole: bool, range_bits: int, plan: Mining):
    """Filters of the n-grams of a task's texts, one for each range that it has any of."""

    def emitted(held: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for bits, (keys, counts) in held.items():
            if not len(keys):
                continue
            ranges = keys[:, 0] >> np.uint64(bits - range_bits) if range_bits else np.zeros(len(keys), np.uint64)
            begins = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])).tolist()
            for a, b in zip(begins, [*begins[1:], len(keys)]):
                data = encode(keys[a:b], counts[a:b], bits, range_bits)
                yield pa.RecordBatch.from_arrays([pa.array([bits], pa.int32()), pa.array([int(ranges[a])], pa.int64()), pa.array([data], pa.binary())], ["bits", "range", "filter"])

    def filters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = {63: (np.zeros((0, 1), np.uint64), np.zeros(0, np.int64)), 64: (np.zeros((0, 3), np.uint64), np.zeros(0, np.int64))}
        held = dict(none)
        for batch in slices(batches):
            _, keys, joined = pieces(batch)
            packed, wide = _grams(keys, joined, numbers.value, whole)
            packed, counts = np.unique(permuted(packed, 63), return_counts=True)
            new = {63: (packed[:, None], counts), 64: added(_shuffled(wide), np.ones(len(wide), np.int64))}
            held = {bits: added(*(np.concatenate(x) for x in zip(held[bits], new[bits]))) for bits in held}
            if sum(len(keys) for keys, _ in held.values()) >= plan.held:
                yield from emitted(held)
                held = dict(none)
        yield from emitted(held)

    return filters


def _merge(numbers, plan: Mining):
    """The frequent n-grams of a range, as the keys of their words."""

    def merge(group: pa.Table) -> pa.Table:
        keys, counts = merged(group.column("filter").to_pylist())
        keys, counts = keys[counts >= plan.least], counts[counts >= plan.least]
        if group.column("bits")[0].as_py() == 63:
            packed, mask = restored(keys[:, 0], 63), np.uint64((1 << _BITS) - 1)
            of = np.append(np.zeros(1, np.uint64), numbers.value)
            words = [of[(packed >> np.uint64(_BITS * k)) & mask] for k in (2, 1, 0)]
        else:
            first = restored(keys[:, 0], 64) ^ mixed(keys[:, 1] ^ mixed(keys[:, 2]))
            words = [first, keys[:, 1], keys[:, 2]]
        return pa.table([pa.array(w.view(np.int64)) for w in words] + [pa.array(counts, pa.int64())], ["w1", "w2", "w3", "a"])

    return merge


def _dictionary(words: DataFrame, plan: Mining) -> tuple[np.ndarray, bool]:
    """The sorted keys of the most frequent words, no more than a dictionary holds, and whether those are all."""
    level = F.floor(F.log2("f") * 64)
    sizes = words.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # a row for each 64th of a power of two
    held, lowest = 0, None
    for row in sizes:
        held += row["count"]
        if held > plan.dictionary:
            break
        lowest = row["level"]
    if lowest is None:
        return np.zeros(0, np.uint64), not sizes
    keys = words.filter(level >= lowest).select("key").toArrow().column("key").to_numpy()
    return np.sort(keys.view(np.uint64)), held <= plan.dictionary


def ngram_counts(documents: DataFrame, words: DataFrame, total: int, plan: Mining) -> DataFrame:
    """w1, w2, w3 (0 in pairs), a: the n-grams of two and three words with `least` or more occurrences. total: words in all texts."""
    spark = documents.sparkSession
    numbers, whole = _dictionary(words, plan)
    shared = spark.sparkContext.broadcast(numbers)  # of a bounded number of words
    range_bits = max(0, (2 * total // plan.merged).bit_length())
    filters = documents.mapInArrow(_filters(shared, whole, range_bits, plan), "bits int, range bigint, filter binary")
    return filters.groupBy("bits", "range").applyInArrow(_merge(shared, plan), "w1 bigint, w2 bigint, w3 bigint, a bigint")


def _score(left: str, right: str) -> Column:
    """1000000 * a * a / (l * r), rounded down, in whole numbers of up to 38 digits."""
    return F.expr(f"cast(1000000 as decimal(38,0)) * a * a div (cast({left} as decimal(38,0)) * {right})")


def collocations(documents: DataFrame, plan: Mining = Mining()) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A null text is empty, a null lang is `und`, also where that is a value of its own. Every row counts, repeated ones and those without an id as well; a language without a
    candidate has no row, nor has an empty table. Ties go by occurrences, then by the phrase's bytes. Columns other than text and lang are not read.
    """
    documents = documents.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counted = documents.mapInArrow(_counted, "key bigint, lang string, word string, f bigint")
    counted = stored(counted.groupBy("key").agg(F.min("lang").alias("lang"), F.min("word").alias("word"), F.sum("f").alias("f")), "words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    words = counted.filter(F.col("f") >= plan.least)
    total = counted.agg(F.sum("f")).first()[0] or 0
    grams = stored(ngram_counts(documents, words, total, plan), "ngrams")
    pairs, triples = grams.filter("w3 = 0").drop("w3"), grams.filter("w3 <> 0")

    named = {k: words.select(F.col("key").alias(f"w{k}"), F.col("word").alias(f"t{k}"), F.col("f").alias(f"f{k}"), *([F.col("lang")] if k == 1 else [])) for k in (1, 2, 3)}
    around = triples.select("w1", "w2", "a").union(triples.select("w2", "w3", "a")).groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    two = pairs.join(around, ["w1", "w2"], "left").filter(F.coalesce(F.col("longer") * 100 < F.col("a") * plan.inside, F.lit(True)))
    two = two.join(named[1], "w1").join(named[2], "w2")
    two = two.select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"))
    left, right = (pairs.select(F.col("w1").alias(x), F.col("w2").alias(y), F.col("a").alias(name)) for x, y, name in (("w1", "w2", "left"), ("w2", "w3", "right")))
    three = triples.join(left, ["w1", "w2"]).join(right, ["w2", "w3"])
    for k in (1, 2, 3):
        three = three.join(named[k], f"w{k}")
    phrase = F.concat_ws(" ", "t1", "t2", "t3").alias("phrase")
    first_cut, second_cut = (_score(l, r) for l, r in (("f1", "right"), ("left", "f3")))
    cut = first_cut <= second_cut
    three = three.select("lang", phrase, "a", F.when(cut, F.col("f1")).otherwise(F.col("left")).alias("l"), F.when(cut, F.col("right")).otherwise(F.col("f3")).alias("r"))
    scored = two.union(three).withColumn("score", _score("l", "r"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    best = ranked.filter(F.col("rank") <= plan.best)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
