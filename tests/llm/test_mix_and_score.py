"""Mixing and language-model scores: exact shares and bases, closeness, odd rows."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from tests.llm.data import SCHEMA, documents, sentence

from ledgertally.llm import logbilinear, mixing

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shares(sizes: dict, weights=(5, 2, 1), limit=3) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped: set = set()
    while True:
        rest = sum(sizes.values()) - sum(limit * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        target = {s: limit * sizes[s] if s in capped else rest * weight[s] / free for s in order}
        more = {s for s in order if s not in capped and target[s] >= limit * sizes[s]}
        if not more or more | capped == set(order):
            return target
        capped |= more


def test_mix_of_odd_rows(spark):
    rng = random.Random(2)
    many = [(30_000 + k, sentence(rng, "en", rng.randint(1, 12)), "en", rng.choice(["big", "big", "s9", "zz", "ß", "Z"]), 1, True, "clash", 7, "clash", "clash", 1) for k in range(900)]
    rows = documents() + many
    frame = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mixed_sources(frame, columns=["doc_id", "source", "key"]).collect()
    assert len(got) == len(rows)
    sizes: Counter = Counter()
    for row in rows:
        sizes[row[3]] += len((row[1] or "").encode().split())
    target = shares(sizes)
    largest: Counter = Counter()
    taken: Counter = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], rel=1e-12)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    again = mixing.mixed_sources(frame.repartition(3, "text")).collect()
    key = lambda rs: sorted((str(r.doc_id), r.size, r.source_size, r.taken) for r in rs)
    assert key(again) == key(got)
    assert mixing.mixed_sources(frame.limit(0)).collect() == []
    empty = mixing.mixed_sources(frame.filter("doc_id in (900, 901, 902)")).collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 3


def test_long_documents_are_likelier_in_the_sampled_rest(spark):
    rows = [(k, " ".join(["w"] * (1 if k % 2 else 30)), "en", "a" if k < 2000 else "b", 1, True, "x", 1, "x", "x", 1) for k in range(2600)]
    got = [r for r in mixing.mixed_sources(spark.createDataFrame(rows, SCHEMA), weights=(1, 2)).collect() if r.target < r.source_size]
    short, long = (np.mean([r.taken > 0 for r in got if (r.size == 1) == is_short]) for is_short in (True, False))
    assert 0 < short < long < 1


def test_base_scores_are_exact_and_the_model_beats_them(spark):
    rng = random.Random(6)
    more = [(40_000 + k, sentence(rng, lang, 40), lang, "s", 1, True, "clash", 7, "clash", "clash", 1) for k in range(500) for lang in [rng.choice(["en", "de", "fr"])]]
    rows = documents() + more
    got = logbilinear.score(spark.createDataFrame(rows, SCHEMA), logbilinear.Sizes(classes=512, head=64, steps=80)).collect()
    assert len(got) == len(rows)
    tokens = [(r[0], [*(r[1] or "").encode().translate(LOWER).split(), None]) for r in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(t for i, ts in tokens if not held(i) for t in ts)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(ts), sum(c[t] > 0 for t in ts), n, round(sum(log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), 6)) for i, ts in tokens)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    unseen = [r for r in got if r.held_out and r.doc_id and r.doc_id >= 40_000]
    assert len(unseen) > 60 and sum(r.score for r in unseen) > 0.97 * sum(r.base_score for r in unseen)
    assert all(r.score < 0 for r in got)


def test_scores_without_training_rows_or_rows(spark):
    held = [r for r in documents() if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1]
    got = logbilinear.score(spark.createDataFrame(held, SCHEMA)).collect()
    assert len(got) == len(held) and all((r.n_known, r.train_tokens, round(r.base_score, 9)) == (0, 0, 0) for r in got)
    assert logbilinear.score(spark.createDataFrame([], SCHEMA)).collect() == []


def test_class_probabilities_are_normalised():
    sizes = logbilinear.Sizes(classes=300, steps=5, batch=64)
    unigram = np.full(300, 1 / 300)
    model = logbilinear.fresh(unigram, sizes)
    moved = logbilinear.contrasted(model, np.array([0, 1]), np.array([5, 6]), np.array([3, 4]), unigram, sizes, 1)
    assert np.allclose(np.exp(moved.log_probabilities()).sum(axis=1), 1, atol=1e-4)
    same = logbilinear.Model.from_bytes(moved.to_bytes())
    assert all(np.array_equal(a, b) for a, b in zip(vars(moved).values(), vars(same).values(), strict=True))
