"""Quality rules: counts within a document, and its perplexity under an n-gram model of its language.

The model is a modified Kneser-Ney trigram model over code points; capitals count as small letters, digits as 0, runs of blanks as one.
Each value of lang has a model of its own, null too. Spark counts the trigrams of all documents and turns them into one table of
probabilities by language and trigram, which grows with the languages and with what they write. A document is no evidence for itself: an n-gram of a
single text, copies included, counts as unseen. The most frequent n-grams of the table are broadcast, the others joined,
one row for each document and n-gram; both ways give the same sums, as logarithms are whole numbers of 10**-9.

A second pass gives each document's log probability per code point. The median of a language's documents and the usual distance from it make
its band; a document far above or far below is rejected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgertally.llm.tables import slices, stored
from ledgertally.llm.words import Words, buffer, mixed, words

#: Symbols of `kneser_ney` in one process.
SYMBOLS = 64
#: Bits of a symbol in the code of an n-gram: those of a code point.
BITS = 21
#: Logarithms are counted in steps of one in so many.
UNIT = 10**9
#: N-grams whose probabilities are broadcast at most, 16 bytes each.
HEAD = 1 << 19
#: A table of so many cells is addressed directly, a larger one sorted.
_DENSE = 1 << 24
_SIGNS = "#*$%&|<>"


def _fold() -> np.ndarray:
    """What code points below 2**17 count as: capitals as small letters, digits of ASCII as 0, its blanks and controls as a blank."""
    low = [chr(c).lower() for c in range(1 << 17)]
    out = np.array([ord(x) if len(x) == 1 else c for c, x in enumerate(low)], np.int64)
    out[48:58], out[:33], out[127] = 48, 32, 32
    return out


_FOLD = _fold()


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts, runs of blanks as one, each text between two blanks, and where each text begins (one more at the end)."""
    data, offsets = buffer(column)
    out = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    small = out < len(_FOLD)
    out[small] = _FOLD[out[small]]
    begins = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)
    sizes = np.diff(begins)
    # a blank before each text and one after it
    begins_out = np.append(0, np.cumsum(sizes + 2))
    padded = np.full(begins_out[-1], 32, np.int64)
    padded[np.arange(len(out)) + 2 * np.repeat(np.arange(len(sizes)), sizes) + 1] = out
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32)
    keep[begins_out[:-1]] = True
    return padded[keep], np.append(0, np.cumsum(keep))[begins_out]


def model_names(lang: pa.Array) -> pa.Array:
    """The model of each row: its lang after a sign; null has one without it."""
    return pc.fill_null(pc.binary_join_element_wise("=", lang.cast(pa.string()), ""), "")


@dataclass(frozen=True)
class Grams:
    """Of a slice of texts: the distinct trigrams of each model (its number, code, count), and for each trigram of the texts which of them it is.
    begins: of each text its first trigram (one more at the end)."""

    models: list[str]
    model: np.ndarray
    code: np.ndarray
    n: np.ndarray
    which: np.ndarray
    begins: np.ndarray


def _distinct(values: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted values below `kinds` that occur, how often, and where among them each value is. A table addressed directly grows with the values, not with `kinds`."""
    if kinds > min(_DENSE, 2 * len(values) + 4096):
        at, which, n = np.unique(values, return_inverse=True, return_counts=True)
        return at, n, which
    counts = np.bincount(values, minlength=1)
    at = np.flatnonzero(counts)
    rank = np.zeros(len(counts), np.int64)
    rank[at] = np.arange(len(at))
    return at, counts[at], rank[values]


def trigrams(column: pa.Array, lang: pa.Array) -> Grams:
    """The trigrams within each text, by the models of their languages."""
    found, begins = symbols(column)
    sizes = np.diff(begins)
    present, _, rank = _distinct(found, 1 << BITS)
    r = max(len(present), 1)
    dense = (rank[:-2] * r + rank[1:-1]) * r + rank[2:] if len(rank) > 2 else np.zeros(0, np.int64)
    dense = dense[np.arange(len(dense)) + 2 < np.repeat(begins[1:], sizes)[: len(dense)]]
    first = np.append(0, np.cumsum(np.maximum(sizes - 2, 0)))
    cells, _, cell = _distinct(dense, r**3)
    names = model_names(lang).dictionary_encode()
    models, of_text = names.dictionary.to_pylist(), names.indices.to_numpy()
    k = max(len(cells), 1)
    at, n, which = _distinct(np.repeat(of_text.astype(np.int64), np.diff(first)) * k + cell, len(models) * k)
    parts = cells[at % k]
    code = (present[parts // r**2] << 2 * BITS) | (present[parts // r % r] << BITS) | present[parts % r]
    return Grams(models, at // k, code, n, which, first)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """model, code, n, and the smallest and largest fingerprint of the texts that have the trigram."""
    for batch in slices(batches):
        found = trigrams(batch.column("text"), batch.column("lang"))
        models = pa.array(found.models, pa.string()).take(pa.array(found.model))
        prints = np.repeat(batch.column("print").to_numpy(), np.diff(found.begins))
        lo, hi = np.full(len(found.code), np.iinfo(np.int64).max), np.full(len(found.code), np.iinfo(np.int64).min)
        np.minimum.at(lo, found.which, prints)
        np.maximum.at(hi, found.which, prints)
        yield pa.RecordBatch.from_arrays([models, *map(pa.array, (found.code, found.n, lo, hi))], ["model", "code", "n", "lo", "hi"])


def _discounted(grams: DataFrame, lower: DataFrame | None, bits: int, order: int, kinds: int | None) -> DataFrame:
    """model, code, n, p of the n-grams of one order, from their counts and the probabilities one order below; as `kneser_ney` has it, but n-grams
    of one text alone (lo = hi) count as unseen."""
    n, step = F.col("n"), [1, 2, 3]
    m1, m2, m3, m4 = (F.col(f"m{k}") for k in (*step, 4))
    few, y = F.least(m1, m2, m3, m4) == 0, m1 / (m1 + 2 * m2)
    full = [(1 - 2 * y * m2 / m1, 0.95, 0.5), (2 - 3 * y * m3 / m2, 1.9, 0.75), (3 - 4 * y * m4 / m3, 2.9, 0.9)]
    taken = [F.when(few, F.lit(plain)).otherwise(F.least(F.greatest(d, F.lit(0.05)), F.lit(most))).alias(f"d{k}") for k, (d, most, plain) in zip(step, full, strict=True)]
    times = [F.sum((n == k).cast("long")).cast("double").alias(f"m{k}") for k in (*step, 4)]
    discounts = grams.groupBy("model").agg(*times, F.count("*").alias("kinds")).select("model", "kinds", *taken)  # one row per language
    grams = grams.withColumn("context", F.shiftright("code", bits))
    kept = F.col("lo") < F.col("hi")
    own_counts = [F.sum((kept & (F.least(n, F.lit(3)) == k)).cast("long")).alias(f"c{k}") for k in step]
    contexts = grams.groupBy("model", "context").agg(F.sum("n").alias("total"), F.sum(F.when(kept, F.lit(0)).otherwise(n)).alias("alone"), *own_counts)
    contexts = F.broadcast(contexts) if lower is None else contexts  # of single symbols there is one per language
    out = grams.join(contexts, ["model", "context"]).join(F.broadcast(discounts), "model")
    # What the n-grams of one text would have goes to the order below, with the discounts of the others: the probabilities after a context add to 1.
    gamma = (F.col("d1") * F.col("c1") + F.col("d2") * F.col("c2") + F.col("d3") * F.col("c3") + F.col("alone")) / F.col("total")
    own = (n - F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))) / F.col("total")
    own = F.when(kept, own).otherwise(F.lit(0.0))
    if lower is None:
        return out.select("model", "code", "n", (own + gamma / (F.lit(kinds) if kinds else F.col("kinds") + 1)).alias("p"))
    out = out.select("model", "code", "n", own.alias("own"), gamma.alias("gamma"), F.col("code").bitwiseAND(F.lit((1 << bits * (order - 1)) - 1)).alias("rest"))
    lower = lower.select("model", F.col("code").alias("rest"), F.col("p").alias("base"))
    return out.join(lower, ["model", "rest"]).select("model", "code", "n", (F.col("own") + F.col("gamma") * F.col("base")).alias("p"))


def probabilities(counts: DataFrame, bits: int = BITS, kinds: int | None = None) -> DataFrame:
    """model, code, n, log_p of every trigram, from model, code, n: log10 of its last symbol's probability after the two before, in steps of 1 / UNIT.

    An unseen symbol has one share of `kinds`, or of the language's own symbols and one more. With columns lo and hi, the smallest and largest
    fingerprint of the texts that have a trigram, those of one text alone count as unseen.
    """
    if "lo" not in counts.columns:
        counts = counts.withColumns({"lo": F.lit(0), "hi": F.lit(1)})
    grams = {3: counts}
    for order in (2, 1):
        code = F.col("code").bitwiseAND(F.lit((1 << bits * order) - 1)).alias("code")
        grams[order] = grams[order + 1].groupBy("model", code).agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    known = None
    for order in (1, 2, 3):
        known = _discounted(grams[order], known, bits, order, kinds)
    return known.select("model", "code", "n", F.round(F.log10("p") * UNIT).cast("long").alias("log_p"))


@dataclass(frozen=True)
class Head:
    """Of each model the sorted codes of frequent n-grams and their logarithms."""

    tables: dict[str, tuple[np.ndarray, np.ndarray]]

    def find(self, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
        """The logarithm of each distinct n-gram (0 where it isn't here), and whether it is here."""
        out, hit = np.zeros(len(grams.code), np.int64), np.zeros(len(grams.code), bool)
        ends = np.searchsorted(grams.model, np.arange(len(grams.models) + 1))
        for name, a, b in zip(grams.models, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            codes, logs = self.tables.get(name, (np.zeros(0, np.int64),) * 2)
            at, hit[a:b] = _found(codes, grams.code[a:b])
            out[a:b][hit[a:b]] = logs[at[hit[a:b]]]
        return out, hit


def _head(table: DataFrame, most: int) -> tuple[Head, bool]:
    """The n-grams down to the lowest level of counts, in eighths of a doubling, of which `most` are enough; and whether these are all."""
    level = F.floor(F.log2("n") * 8)
    levels = table.groupBy(level.alias("level")).count().toPandas().sort_values("level", ascending=False)
    fit = levels[levels["count"].cumsum() <= most].level
    if not len(fit):
        return Head({}), not len(levels)
    found = table.filter(level >= int(fit.min())).select("model", "code", "log_p").toPandas().sort_values(["model", "code"])
    tables = {name: (part.code.to_numpy(np.int64), part.log_p.to_numpy(np.int64)) for name, part in found.groupby("model")}
    return Head(tables), len(fit) == len(levels)


def _hashes(codes: np.ndarray, order: int) -> np.ndarray:
    return mixed(codes.astype(np.uint64) * np.uint64(4) + np.uint64(order))


@dataclass(frozen=True)
class Level:
    """N-grams of one order: sorted hashes with log10 probabilities, and sorted hashes of their contexts with log10 back-off weights."""

    hashes: np.ndarray
    log_p: np.ndarray
    contexts: np.ndarray
    back_off: np.ndarray


def _found(hashes: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key is among sorted hashes, and whether it is there."""
    at = np.minimum(np.searchsorted(hashes, key), max(len(hashes) - 1, 0))
    return at, (hashes[at] == key) if len(hashes) else np.zeros(len(key), bool)


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts of counts 1, 2, and 3 or more, by the counts of counts; where those are too few, plain ones."""
    n = [float((counts == k).sum()) for k in range(1, 5)]
    if min(n) == 0:
        return np.array([0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    return np.clip([1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]], [0.05, 0.05, 0.05], [0.95, 1.9, 2.9])


def kneser_ney(codes: np.ndarray, counts: np.ndarray) -> list[Level]:
    """The levels of orders 1 to 3 from the counts of trigrams of 64 symbols, in one process; the table made by Spark is tested against them. Lower orders count in how many contexts an n-gram was seen."""
    per_order = [(None, None)] * 4
    per_order[3] = (codes, counts.astype(np.float64))
    for order in (2, 1):
        above = per_order[order + 1][0]
        kinds, n = np.unique(above % SYMBOLS**order, return_counts=True)
        per_order[order] = (kinds, n.astype(np.float64))
    levels: list[Level] = []
    lower = None
    for order in (1, 2, 3):
        grams, n = per_order[order]
        taken = _discounts(n)[np.minimum(n, 3).astype(int) - 1]
        contexts, at = np.unique(grams // SYMBOLS, return_inverse=True)
        total, left = np.bincount(at, n), np.bincount(at, taken)
        gamma = left / total
        base = np.full(len(grams), 1 / SYMBOLS) if lower is None else lower[grams % SYMBOLS ** (order - 1)]
        p = (n - taken) / total[at] + gamma[at] * base
        if order == 1:
            full = np.full(SYMBOLS, gamma[0] / SYMBOLS)
            full[grams] = p
            grams, p, lower = np.arange(SYMBOLS), full, full
        else:
            # the probabilities of all n-grams of this order are needed once more, one order up: unseen ones by back-off
            if order == 2:
                dense = np.ones(SYMBOLS)
                dense[contexts] = gamma
                lower2 = (dense[:, None] * lower[None, :]).reshape(-1)
                lower2[grams] = p
                lower = lower2
        key, context_key = _hashes(grams, order), _hashes(contexts, order - 1)
        by, by_context = np.argsort(key), np.argsort(context_key)
        levels.append(Level(key[by], np.log10(p)[by], context_key[by_context], np.log10(gamma)[by_context]))
    return levels


def log_probabilities(levels: list[Level], codes: np.ndarray) -> np.ndarray:
    """log10 of the probability of the last symbol of each trigram after the two before."""
    out, missing = np.zeros(len(codes)), np.arange(len(codes))
    for order in (3, 2, 1):
        level, now = levels[order - 1], codes[missing] % SYMBOLS**order
        at, hit = _found(level.hashes, _hashes(now, order))
        out[missing[hit]] += level.log_p[at[hit]]
        missing, now = missing[~hit], now[~hit]
        at, hit = _found(level.contexts, _hashes(now // SYMBOLS, order - 1))  # back off, if the context is known
        out[missing[hit]] += level.back_off[at[hit]]
    return out


def _repeated(found: Words, prints: np.ndarray, width: int = 5) -> np.ndarray:
    """For each text, how many of its words lie in a window of `width` words that it has twice or more."""
    out = np.zeros(len(found.first) - 1, np.int64)
    if len(prints) < width:
        return out
    with np.errstate(over="ignore"):
        window = np.zeros(len(prints) - width + 1, np.uint64)
        for step in range(width):
            window = mixed(window * np.uint64(0x9FB21C651E98DF25) + prints[step : step + len(window)])
    for row, (a, b) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True)):
        if b - a > width:
            own = window[a : b - width + 1]
            order = np.argsort(own, kind="stable")
            same = own[order][1:] == own[order][:-1]
            if same.any():
                twice = np.zeros(len(own), bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                cover = np.zeros(b - a, bool)
                for step in range(width):
                    cover[step : step + len(own)] |= twice
                out[row] = cover.sum()
    return out


def _repeated_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


_IS_SIGN = np.zeros(256, bool)
_IS_SIGN[[ord(c) for c in _SIGNS]] = True


def counted(column: pa.Array) -> list[np.ndarray]:
    """For each text n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    found = words(column, lower=False)
    upto = np.append(0, np.cumsum((found.data & 0xC0) != 0x80))
    of_word = np.append(0, np.cumsum(upto[found.ends] - upto[found.starts]))
    signs = np.append(0, np.cumsum(_IS_SIGN[found.data]))[found.offsets]
    lines = np.array([_repeated_lines(t or "") for t in column.to_pylist()], np.int64)
    return [found.counts, np.diff(of_word[found.first]), np.diff(signs), lines, _repeated(found, found.fingerprints())]


@dataclass(frozen=True)
class Bands:
    """A document's log10 probability per code point is compared with its language's median; `width` times the usual distance on either side is
    allowed, `least` at least, and more for short texts, whose means scatter by chance. The distance is taken from documents of `long` code points or more, if there are any.
    `long` and `least` are 50 words and 0.3 a word, at six code points a word."""

    width: float = 9.0
    long: int = 300
    least: float = 0.05


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(head_of, names: Sequence[str]):
    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, part, row = head_of.value, TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            texts, found = batch.num_rows, trigrams(batch.column("text"), batch.column("lang"))
            logs, hit = head.find(found)
            sums = np.append(0, np.cumsum(logs[found.which]))[found.begins]
            # what the head does not have, once for each text
            missing = ~hit[found.which]
            text = np.repeat(np.arange(texts), np.diff(found.begins))[missing]
            pairs, times = np.unique(text * max(len(hit), 1) + found.which[missing], return_counts=True)
            at = np.searchsorted(pairs, np.arange(texts + 1) * max(len(hit), 1)).astype(np.int32)
            rest = found.code[pairs % max(len(hit), 1)]
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(v)) for v in (rest, times)]
            counts = counted(batch.column("text"))
            uid = (part << 33) + row + np.arange(texts)
            row += texts
            columns = [*(batch.column(c) for c in names), *map(pa.array, counts), pa.array(uid), model_names(batch.column("lang")), pa.array(np.diff(found.begins)), pa.array(np.diff(sums)), *lists]
            yield pa.RecordBatch.from_arrays(columns, [*names, *_COUNTS, *_OWN])

    return measure


#: Columns beside those of the documents: how many n-grams, of those in the head the sum of logarithms, and the others with their counts.
_OWN = ("_uid", "_model", "_scored", "_in_head", "_rest", "_times")


def judged(documents: DataFrame, bands: Bands = Bands(), columns: Sequence[str] = ("doc_id",), head: int = HEAD) -> DataFrame:
    """The given columns of each row, the counts of its whole text, base_failed, perplexity (of a code point), band_failed, kept.

    A null text has no words. base_failed: fewer than 10 words, or over 20 % of them in repeated windows of five. band_failed: the
    perplexity is outside its language's band; a text of blanks has perplexity 1 and is not compared. A language that is
    null has a band of its own. An empty table gives an empty one. Only `columns`, text and lang are read. At most `head` n-grams are broadcast.
    """
    spark, names = documents.sparkSession, list(columns)
    counts = documents.select("text", "lang", F.xxhash64("text").alias("print")).mapInArrow(_count, "model string, code bigint, n bigint, lo bigint, hi bigint")
    counts = counts.groupBy("model", "code").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    table = stored(probabilities(stored(counts, "trigrams")), "probabilities")
    frequent, whole = _head(table, head)
    shared = spark.sparkContext.broadcast(frequent)

    read = documents.select(*dict.fromkeys([*names, "text", "lang"]))
    kinds = "".join(f"`{c}` {kind}, " for c, kind in documents.select(*names).dtypes)
    kinds += "".join(f"{c} bigint, " for c in _COUNTS) + "_uid bigint, _model string, _scored bigint, _in_head bigint, _rest array<bigint>, _times array<bigint>"
    rows = stored(read.mapInArrow(_measured(shared, names), kinds), "measured")
    of_rest = F.lit(0)
    if not whole:
        rest = rows.select("_uid", F.col("_model").alias("model"), F.explode(F.arrays_zip("_rest", "_times")).alias("r"))
        rest = rest.select("_uid", "model", F.col("r._rest").alias("code"), F.col("r._times").alias("times"))
        rest = rest.join(table, ["model", "code"]).groupBy("_uid").agg(F.sum(F.col("times") * F.col("log_p")).alias("_of_rest"))
        rows = rows.join(stored(rest, "rest"), "_uid", "left")
        of_rest = F.coalesce("_of_rest", F.lit(0))
    rows = rows.withColumn("mean_log", (F.col("_in_head") + of_rest) / F.greatest(F.col("_scored"), F.lit(1)) / UNIT).withColumnRenamed("_model", "model")

    # Bins of a two-thousandth, one row per bin, model and length class, give medians without a list of all documents.
    usual = rows.filter("_scored > 0").select("model", (F.col("_scored") >= bands.long).alias("is_long"), F.round(F.col("mean_log") * 2000).cast("int").alias("bin"))
    usual = usual.groupBy("model", "is_long", "bin").agg(F.count("*").alias("n")).toPandas()
    allowed = []
    for model, part in usual.groupby("model"):
        part = part[part.is_long] if part.is_long.any() else part
        middle = _median(part.bin.to_numpy() / 2000, part.n.to_numpy())
        spread = 1.4826 * _median(np.abs(part.bin.to_numpy() / 2000 - middle), part.n.to_numpy())
        allowed.append((model, float(middle), float(max(spread * bands.width, bands.least))))
    limits = F.broadcast(spark.createDataFrame(allowed, "model string, middle double, allowed double"))  # one row per language
    slack = F.col("allowed") * F.sqrt(1 + bands.long / F.greatest(F.col("_scored"), F.lit(1)))
    outside = F.coalesce((F.col("_scored") > 0) & (F.abs(F.col("mean_log") - F.col("middle")) > slack), F.lit(False))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = rows.join(limits, "model", "left").withColumn("base_failed", base).withColumn("band_failed", outside)
    out = out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("mean_log"))).withColumn("kept", ~F.col("base_failed") & ~F.col("band_failed"))
    return out.select(*names, *_COUNTS, "base_failed", "perplexity", "band_failed", "kept")


def _median(values: np.ndarray, weights: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(upto, upto[-1] / 2)])
