"""The main text of web pages: gradient-boosted trees over the nodes of a page, and a choice that holds together.

A model says of every node how likely it holds main text. It learns from a bounded sample of pages that mark their article by tags, as they are and in layouts drawn at random (see
`layouts`). The choice is the most likely one in which every kept node's parent is kept: a node's worth is its log odds and the worth of those children that are worth keeping, so
that an article can lose an advert and a sidebar can't keep a paragraph unless the evidence for that outweighs the one against its parents.
"""

from __future__ import annotations

import pickle
import random
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgertally.llm.boosting import Boosting, Trees, fit
from ledgertally.llm.dom import FEATURES, Forest, Tree, levels, measured, parse
from ledgertally.llm.layouts import MARK, Layout, marked
from ledgertally.llm.tables import slices, stored


@dataclass(frozen=True)
class Extraction:
    """pages: the sample, of pages of up to `longest` characters. layouts: of each of them, besides the page as it is; more where there are fewer pages.
    nodes: that the trees are fitted to."""

    pages: int = 400
    longest: int = 50_000
    layouts: int = 3
    nodes: int = 40_000
    boosting: Boosting = field(default_factory=Boosting)


def _made_up(count: int = 60) -> list[list[tuple[bool, str]]]:
    """Blocks of articles of made-up words, in case that no page marks its article."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))
    said = lambda n: " ".join(word() + (rng.choice(",.;") if rng.random() < 0.12 else "") for _ in range(n)).capitalize() + "."
    return [[(True, said(rng.randint(2, 8))), *((False, said(rng.randint(3, 100))) for _ in range(rng.randint(1, 12)))] for _ in range(count)]


_SYLLABLES = "lo ra mi ten der in ka sol us et an per".split()


def holding(forest: Forest, leaves: np.ndarray) -> np.ndarray:
    """Which nodes have one of the leaves below them or are one."""
    out = leaves.copy()
    for at in levels(forest.depth):
        np.logical_or.at(out, forest.parent[at], out[at])
    return out


def _examples(pages: list[str], plan: Extraction) -> tuple[np.ndarray, np.ndarray]:
    """Features of nodes, and whether they hold main text."""
    trees, answers, seed = [], [], 0
    texts = []
    for page in pages:
        tree = parse(page)
        main = marked(tree)
        if main is not None and any(main):
            trees.append(tree)
            answers.append(main)
            heading = [bits & 4 for bits in tree.own]
            blocks = [(bool(h), text) for h, text, m in zip(heading, tree.text, main) if m]
            rest = [w for text, m in zip(tree.text, main) if text and not m for w in text.split()]
            texts.append((blocks, rest + [w for _, text in blocks[:3] for w in text.split()][: len(rest) + 20]))
    texts += [(blocks, [w for _, t in blocks for w in t.split()]) for blocks in _made_up()]
    for blocks, words in texts:
        for _ in range(plan.layouts * max(1, plan.pages // len(texts))):
            seed += 1
            tree = parse(Layout(seed, blocks, words).page())
            answers.append([MARK in text for text in tree.text])
            tree.text = [text.replace(MARK, "") for text in tree.text]
            trees.append(tree)
    forest = measured(trees)
    y = holding(forest, np.array([a for answer in answers for a in answer], bool))
    keep = np.flatnonzero(forest.parent != np.arange(len(y)))  # the body is always kept
    keep = np.random.default_rng(7).permutation(keep)[: plan.nodes]
    return forest.features[keep], y[keep].astype(np.float64)


def _trained(plan: Extraction):
    def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = [page for batch in batches for page in batch.column("html").to_pylist()]
        model = fit(*_examples(pages, plan), plan.boosting)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    return train


def train(pages: DataFrame, plan: Extraction = Extraction()) -> Trees:
    """The model, fitted in one task on a sample of up to `plan.pages` pages, chosen by a hash of the page; without pages that mark their article, on pages of made-up words."""
    usable = pages.filter(F.col("html").isNotNull() & (F.length("html") <= plan.longest)).select("html", F.xxhash64("page_id", "html").alias("at"))
    usable = usable.filter(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    every = max(1, usable.count() // (2 * plan.pages))
    sample = usable.filter(F.pmod("at", F.lit(every)) == 0).orderBy("at", "html").limit(plan.pages).select("html")
    spark = pages.sparkSession
    sample = stored(sample, "sample").repartition(1).sortWithinPartitions("html")
    filled = sample.union(spark.createDataFrame([("",)], "html string")).coalesce(1)  # one task even without pages
    return pickle.loads(filled.mapInArrow(_trained(plan), "model binary").first()["model"])


def chosen(forest: Forest, odds: np.ndarray) -> np.ndarray:
    """The nodes of the most likely choice with all parents of kept nodes kept. The bodies are kept."""
    worth, root = odds.copy(), forest.parent == np.arange(len(odds))
    by_depth = levels(forest.depth)
    for at in by_depth[:-1]:
        np.add.at(worth, forest.parent[at], np.maximum(0, worth[at]))
    keep = root | (worth > 0)
    for at in by_depth[::-1][1:]:
        keep[at] &= keep[forest.parent[at]]
    return keep


def main_texts(pages: list[str], model: Trees) -> list[str]:
    """The kept blocks of each page, in page order, joined by a blank."""
    forest = measured([parse(page) for page in pages])
    odds = model.log_odds(forest.features) if len(forest.text) else np.zeros(0)
    keep = chosen(forest, odds) if len(forest.text) else np.zeros(0, bool)
    keep &= np.array([bool(t) for t in forest.text], bool) if len(keep) else keep
    out = []
    for a, b in zip(forest.begins[:-1].tolist(), forest.begins[1:].tolist()):
        out.append(" ".join(forest.text[k] for k in (np.flatnonzero(keep[a:b]) + a).tolist()))
    return out


def _extract(model: Trees):
    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = main_texts([page or "" for page in batch.column("html").to_pylist()], model)
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return extract


def extracted(pages: DataFrame, plan: Extraction = Extraction(), model: Trees | None = None) -> DataFrame:
    """Per page: page_id, url, text (main text), n_chars (its code points).

    A null page is an empty one, and one without main text has the text "". Every row has its result, also repeated ones and those without page_id or url. White space is what
    Unicode calls so; a block is what HTML shows on lines of its own. Whole pages are read, whatever their length. Columns other than page_id, url and html are not read.
    """
    pages = pages.select("page_id", "url", "html")
    kind = {name: pages.schema[name].dataType.simpleString() for name in ("page_id", "url")}
    model = model or train(pages, plan)
    assert model.feature.max() < len(FEATURES)
    return pages.mapInArrow(_extract(model), f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars bigint")
