"""Quotient filters by round trips, collocations against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from tests.llm.data import SCHEMA, documents

from ledgertally.llm import phrases, quotient
from ledgertally.llm.phrases import Mining, collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("bits", [63, 64])
def test_the_permutation_can_be_undone(bits):
    x = np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64)
    x = np.concatenate([x, np.array([0, 1, 2**bits - 1], np.uint64)])
    y = quotient.permuted(x, bits)
    assert (quotient.restored(y, bits) == x).all() and int(y.max()) < 2**bits and len(np.unique(y >> np.uint64(bits - 4))) == 16


@pytest.mark.parametrize("n, limbs, bits, range_bits", [(1, 1, 63, 0), (2, 3, 64, 3), (1000, 1, 63, 5), (1000, 3, 64, 0), (5000, 1, 63, 2), (257, 2, 64, 7)])
def test_filters_keep_keys_and_counts(n, limbs, bits, range_bits):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, (n, limbs), dtype=np.uint64)
    keys[:, 0] = quotient.permuted(keys[:, 0] & np.uint64(2**bits - 1), bits)
    if n > 500:
        keys[: n // 2, 0] = keys[0, 0] + np.arange(n // 2).astype(np.uint64) % np.uint64(50)  # long runs, and keys that differ in later limbs only
    keys[:, 0] &= np.uint64((1 << (bits - range_bits)) - 1)
    keys[:, 0] |= np.uint64(1 << (bits - range_bits)) if range_bits else np.uint64(0)
    counts = rng.choice([1, 2, 254, 255, 256, 10**12], n)
    keys, counts = quotient.added(keys, counts)
    data = quotient.encode(keys, counts, bits, range_bits)
    again, numbers = quotient.decode(data)
    assert (again == keys).all() and (numbers == counts).all()
    part = [quotient.encode(keys[k::3], counts[k::3], bits, range_bits) for k in range(3) if len(keys[k::3])]
    again, numbers = quotient.merged([*part, data])
    assert (again == keys).all() and (numbers == 2 * counts).all()


def test_filters_are_compact():
    keys = np.sort(quotient.permuted(np.arange(100_000, dtype=np.uint64), 63))[:, None]
    assert len(quotient.encode(keys, np.ones(100_000, np.int64), 63, 0)) < 8 << 17


def brute(rows, plan):
    counts, totals = {}, Counter()
    for text, lang in rows:
        mine = counts.setdefault(lang or "und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und" if lang is None else lang] += len(words)
            for size in (1, 2, 3):
                mine.update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        longer = Counter()
        for phrase, a in f.items():
            if len(phrase) == 3 and a >= plan.least:
                for part in (phrase[:2], phrase[1:]):
                    longer[part] = max(longer[part], a)
        found = []
        for phrase, a in f.items():
            if len(phrase) == 1 or a < plan.least or len(phrase) == 2 and 100 * longer[phrase] >= plan.inside * a and longer[phrase]:
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k, f[phrase[:k]], f[phrase[k:]]) for k in range(1, len(phrase)))
            found.append((-score, -a, " ".join(phrase).encode(), l, r))
        out += [(lang, rank, phrase.decode(), -a, l, r, totals[lang], -score) for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[: plan.best], 1)]
    return sorted(out)


def texts(seed: int = 4):
    rng = random.Random(seed)
    rows = []
    for k in range(160):
        lang = rng.choice(["en", "fr", None, "und", ""])
        words = [rng.choice(["New", "york", "the", "of", "état", "x", "y", "z", "日本", "a-b"]) for _ in range(rng.randint(0, 60))]
        words = [w + rng.choice(["", "", "", "", ",", ".", "\n", "!x"]) for w in words]
        rows.append((rng.choice([" ", "  ", "\t"]).join(words) + " united states of america " * rng.randint(0, 3), lang))
    rows.append((None, "en"))
    rows += [(row[1], row[2]) for row in documents()]
    return rows


@pytest.mark.parametrize("plan", [Mining(), Mining(least=3, best=40, merged=300, held=200), Mining(least=4, dictionary=0, merged=1000), Mining(least=4, dictionary=9), Mining(inside=90)])
def test_equals_brute_force(spark, plan):
    rows = texts()
    frame = spark.createDataFrame([(k, t, lang, "s", 1, True, "clash", 7, "clash", "clash", 1) for k, (t, lang) in enumerate(rows)], SCHEMA).repartition(6)
    got = sorted(tuple(r) for r in collocations(frame, plan).collect())
    assert got == brute(rows, plan) and len(got) > 10


def test_a_text_of_many_slices(spark):
    text = "one two three four. " * 300_000
    frame = spark.createDataFrame([(1, text, "en"), (2, None, None)], "doc_id bigint, text string, lang string")
    got = {r.phrase: (r.a, r.l, r.r, r.n, r.score) for r in collocations(frame).collect()}
    assert got == {"one two three": (300_000, 300_000, 300_000, 1_200_000, 10**6), "two three four": (300_000, 300_000, 300_000, 1_200_000, 10**6)}


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == [] == collocations(spark.createDataFrame([(1, None, None)], "doc_id bigint, text string, lang string")).collect()
