"""Near-duplicates of texts and of vectors against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from tests.llm.data import SCHEMA, documents, sentence

from ledgertally.llm import caps, components, minhash

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def reach(nodes, links) -> dict:
    """The smallest node that each one reaches."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text: str | None, width: int) -> frozenset:
    words = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k + 1, k) for k in range(40)], [(0, k) for k in range(1, 30)], [(3, 2), (2, 3), (3, 2), (9, 8), (None, 1), (8, 2)], [(random.Random(k).randrange(60), random.Random(k + 999).randrange(60)) for k in range(45)]])
def test_components_reach_the_smallest(spark, edges):
    got = components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    nodes = {n for e in real for n in e}
    assert {r.node: r.component for r in got} == reach(nodes, real) and len(got) == len(nodes)


def variants(seed: int) -> list[tuple]:
    """Chains of texts that drift: neighbours are alike, ends are not; and groups around 80 %."""
    rng, rows = random.Random(seed), []
    for chain in range(3):
        words = sentence(rng, "en", 60).split()
        for k in range(25):
            rows.append((100 * chain + k + 10_000, " ".join(words)))
            for _ in range(2):
                words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    words = sentence(rng, "fr", 50).split()
    for k in range(40):
        own = list(words)
        for _ in range(rng.randint(1, 5)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        rows.append((20_000 + k, " ".join(own)))
    rng.shuffle(rows)
    return [(i, t, "en", "s", 1, True, "clash", 7, "clash", "clash", 1) for i, t in rows]


@pytest.mark.parametrize("width", [2, 5])
def test_documents_agree_with_all_pairs(spark, width):
    rows = documents() + variants(width)
    plan = minhash.Plan(width=width, block=16)
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), plan).collect()
    sets = [(r[0], shingles(r[1], width)) for r in rows if r[0] is not None and shingles(r[1], width)]
    links = [(i, j) for k, (i, s) in enumerate(sets) for j, t in sets[:k] if 100 * len(s & t) >= 80 * len(s | t)]
    want = reach({i for i, _ in sets}, links)
    assert len({want[i] for i, _ in sets}) < len(want)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == sorted(
        (str(r[0]), len(s), str(c), r[0] == c) for r in rows for s in [shingles(r[1], width)] for c in [want[r[0]] if s and r[0] is not None else r[0]]
    )


def test_no_documents(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    alone = minhash.near_duplicates(spark.createDataFrame(documents()[:1], SCHEMA)).collect()
    assert [(r.component_id, r.kept) for r in alone] == [(0, True)]


def vectors() -> list[tuple]:
    rng = np.random.default_rng(4)
    rows, near = [], lambda x, cosine: cosine * x + np.sqrt(1 - cosine**2) * (lambda y: y / np.linalg.norm(y))((lambda y: y - (y @ x) * x)(rng.standard_normal(len(x))))
    for k in range(60):
        x = rng.standard_normal(64)
        x /= np.linalg.norm(x)
        rows += [(10 * k, x), (10 * k + 1, near(x, 0.905)), (10 * k + 2, near(x, 0.895)), (10 * k + 3, 3e30 * x)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1001, rows[0][1]), (None, rows[0][1])]
    rows += [(1002, None), (1003, []), (1004, [0.0] * 64), (1005, [float("nan")] * 64), (1006, [float("inf")] + [0.0] * 63), (1007, [None] + [1.0] * 63), (1008, [1.0, 2.0]), (1009, [2.0, 4.0]), (1010, [1.0])]
    return [(i, None if x is None else [None if v is None else float(v) for v in x], 1, "clash") for i, x in rows]


def test_vectors_agree_with_all_pairs(spark):
    rows = vectors()
    got = caps.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n_links int, id string")).collect()
    usable = [(k, r[0], np.array(r[1], float)) for k, r in enumerate(rows) if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    unit = {k: caps.unit(x) for k, _, x in usable}
    links = [(a, b) for a, i, x in usable for b, j, y in usable if a < b and len(x) == len(y) and unit[a] @ unit[b] >= 0.9]
    degree = np.bincount(np.array(links).reshape(-1), minlength=len(rows))
    ids = [r[0] for r in rows]
    want = reach({i for i in ids if i is not None}, [(ids[a], ids[b]) for a, b in links])
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == sorted(
        (str(i), int(degree[k]), str(c), i == c) for k, i in enumerate(ids) for c in [None if i is None else want[i]]
    )
    assert degree.sum() > 100
    assert caps.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).collect() == []


def test_rows_of_one_vec_id_with_other_vectors_are_classes_of_their_own(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.99, 0.1, 0.0]), (5, [0.0, 1.0, 0.0]), (7, [0.0, 1.0, 0.01]), (3, [0.0, 0.0, 1.0]), (9, [0.0, 0.0, 2.0])]
    got = caps.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == [(3, 1, 3, True), (5, 1, 5, True), (5, 1, 5, True), (5, 1, 5, True), (7, 1, 5, False), (9, 1, 3, False)]


@pytest.mark.parametrize("vectors", [10, 50_000, 10**8])
def test_filters_find_pairs_at_the_very_cosine(vectors):
    rng, plan = np.random.default_rng(6), caps.Caps()
    for places in (2, 64):
        x = caps.unit(rng.standard_normal((400, places)))
        y = rng.standard_normal((400, places))
        y = caps.unit(y - (x * y).sum(axis=1, keepdims=True) * x)
        z = 0.9 * x + np.sqrt(1 - 0.81) * y
        met = np.zeros(400, bool)
        for number in range(plan.codes):
            code = caps.code(places, plan, number, vectors)
            lists = [set((r.astype(np.int64) << 40 | f).tolist()) for r, f in (caps.decoded(v, code) for v in (x, z))]
            met[[key >> 40 for key in lists[0] & lists[1]]] = True
        assert met.all()


def test_code_lists_are_all_directions_above_the_threshold():
    x, code = caps.unit(np.random.default_rng(7).standard_normal((5, 20))), caps.code(20, caps.Caps(shared=2), 0, 1000)
    rows, filters = caps.decoded(x, code)
    turned, half = x @ code.rotation, len(code.rotation) // 2
    scores = (turned[:, :half] @ code.words[0].T)[:, :, None] + (turned[:, half:] @ code.words[1].T)[:, None, :]
    want = np.argwhere(scores.reshape(5, -1) >= code.threshold)
    assert sorted(zip(rows.tolist(), filters.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))
