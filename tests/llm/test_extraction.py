"""Parsing, boosting and the choice against brute force, main texts against pages whose article is known."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter
from html import unescape

import numpy as np
import pytest

from ledgertally.llm import boosting, dom, extraction
from ledgertally.llm.layouts import MARK, Layout, marked

SCHEMA = "page_id bigint, url string, html string, text string, n_chars string, model int"


def leaves(html: str) -> list[str]:
    return [t for t in dom.parse(html).text if t]


@pytest.mark.parametrize(
    "html, expected",
    [
        ("", []),
        (None or " \n\t ", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<p>b</p>c<br>d", ["a", "b", "c d"]),
        ("<p>one<b>two</b> <i>thr\n\nee</i></p>", ["onetwo thr ee"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>", ["a", "b", "c"]),
        ("<head><title>no</title><meta><div>yes</div>", ["yes"]),
        ("<script>if (a<b) '</p>'</SCRIPT >x<style>p{}</style><!-- no <p> --><!DOCTYPE x>y<?php z?>", ["xy"]),
        ('<div title="a > b" class=x>in</div>', ["in"]),
        ("<p>a <button>no</button> b <select><option>no</select>c</p>", ["a b c"]),
        ("</div></p>a</article><p>b", ["a", "b"]),
        ("1 < 2 <3 <a b <p>c", ["1 < 2 <3 <a b", "c"]),
        ('<p class="x>a</p><p>b</p>', ["a", "b"]),
        ("x<!-- open <p>no", ["x"]),
        ("x<script>open <p>no", ["x"]),
        ("<p>&#x41;&eacute;&nbsp;&unknown; &lt;b&gt;", ["Aé &unknown; <b>"]),
        ("<svg><p>no</p></svg>yes", ["yes"]),
    ],
)
def test_blocks(html, expected):
    assert leaves(html) == expected


def test_markup_of_any_kind_takes_linear_time():
    for part in ("<div>", "<a ", "<p class='", "</p>", "<li>", "<!--", "<b", "&", "<table><tr><td>", '<a href="x>'):
        tree = dom.parse(part * 60_000)
        assert len(tree.parent) >= 1
    deep = dom.parse("<div>" * 3000 + "text" + "</div>" * 3000)
    forest = dom.measured([deep, dom.parse(""), dom.parse("<p>x")])
    assert forest.depth.max() == 3000 and len(forest.features) == len(forest.parent) and np.isfinite(forest.features).all()


def test_features_by_hand():
    tree = dom.parse('<div class="Main-menu"><ul><li><a>ab</a></li><li>cde</li></ul></div><p>One, two.</p>')
    f = dom.measured([dom.parse("<p>other</p>"), tree])
    at = {name: k for k, name in enumerate(dom.FEATURES)}
    root = f.features[f.begins[1]]
    assert [root[at[n]] for n in ("chars", "words", "stops", "leaves", "nodes", "children", "linked", "depth")] == [14, 4, 2, 3, 6, 2, 2, 0]
    first, paragraph = f.features[f.begins[1] + 1], f.features[f.begins[1] + 5]
    assert first[at["own_division"]] == first[at["own_menu"]] == 1 and first[at["next"]] == 9 and first[at["link_share"]] == pytest.approx(0.4)
    assert paragraph[at["own_paragraph"]] == 1 and paragraph[at["previous"]] == 5 and paragraph[at["before"]] == pytest.approx(5 / 14) and paragraph[at["place"]] == 1
    item = f.features[f.begins[1] + 4]
    assert item[at["above_menu"]] == 1 and item[at["own_menu"]] == 0 and item[at["of_siblings"]] == 2


def test_the_choice_is_the_most_likely_one():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        parent = np.array([0] + [int(rng.integers(0, k)) for k in range(1, n)])
        depth = np.zeros(n, np.int64)
        for k in range(1, n):
            depth[k] = depth[parent[k]] + 1
        odds = rng.normal(size=n)
        forest = dom.Forest(parent, depth, np.array([0, n]), [""] * n, np.zeros((n, 0)))
        keep = extraction.chosen(forest, odds)
        best = max(sum(odds[1:][list(c)]) for c in itertools.product([False, True], repeat=n - 1) if all(p == 0 or not c[k] or c[p - 1] for k, p in enumerate(parent[1:])))
        assert keep[0] and all(keep[parent[k]] for k in np.flatnonzero(keep)) and odds[1:][keep[1:]].sum() == pytest.approx(best)


def test_trees_learn_what_depends_on_two_features():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 6)).astype(np.float32)
    x[:, 5] = rng.integers(0, 2, 4000)
    y = ((x[:, 0] > 0) ^ (x[:, 5] > 0.5)).astype(float)
    model = boosting.fit(x[:3000], y[:3000])
    assert ((model.log_odds(x[3000:]) > 0) == y[3000:]).mean() > 0.97
    stump = boosting.fit(x[:100], y[:100], boosting.Boosting(trees=1, depth=1, rate=1.0, least=1e-9, penalty=1e-9, bins=200))
    losses = {}  # every split of every feature, by the gain of one step
    slope, bend = y[:100] - y[:100].mean(), np.full(100, y[:100].mean() * (1 - y[:100].mean()))
    for k in range(6):
        for v in np.unique(x[:100, k])[:-1]:
            right = x[:100, k] > v
            losses[k, v] = sum(slope[s].sum() ** 2 / bend[s].sum() for s in (right, ~right))
    assert losses[int(stump.feature[0, 0]), stump.above[0, 0]] == pytest.approx(max(losses.values()))
    assert boosting.fit(x[:50], np.ones(50)).log_odds(x[:5]).min() > 2


@pytest.fixture(scope="module")
def model(spark, tables):
    return extraction.train(spark.read.parquet(f"{tables}/pages.parquet"))


def known(html: str) -> str:
    inside = re.search(r"<article>(.*)</article>", html, re.S).group(1)
    return " ".join(unescape(re.sub(r"</?b>", "", re.sub(r"</?p>|</?h1>|<br>", "\n", inside))).split())


def test_all_pages_of_the_table(spark, tables, model):
    pages = spark.read.parquet(f"{tables}/pages.parquet")
    rows = extraction.extracted(pages, model=model).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(rows) == pages.count()
    for row in rows:
        assert row.text == known(row.html) and row.n_chars == len(row.text)


def test_layouts_that_were_not_learned(spark, tables, model):
    same = recall = precision = count = 0
    for k, row in enumerate(spark.read.parquet(f"{tables}/pages.parquet").select("html").limit(200).collect()):
        tree = dom.parse(row.html)
        main = marked(tree)
        blocks = [(k == 0, text) for k, text in enumerate(t for t, m in zip(tree.text, main) if m)]
        words = [w for t, m in zip(tree.text, main) if t and not m for w in t.split()]
        html = Layout(10**7 + k, blocks, words).page()
        truth = Counter(" ".join(t.replace(MARK, "") for t in dom.parse(html).text if MARK in t).split())
        got = extraction.main_texts([html.replace(MARK, "")], model)[0]
        shared = sum((truth & Counter(got.split())).values())
        count, same = count + 1, same + (Counter(got.split()) == truth)
        recall, precision = recall + shared / max(1, sum(truth.values())), precision + shared / max(1, len(got.split()))
    assert same / count > 0.85 and recall / count > 0.97 and precision / count > 0.97


WORDS = random.Random(9)
PROSE = [" ".join(WORDS.choice("river stone winter letter garden window silver morning harbour, and the of. to a".split()) for _ in range(n)).capitalize() + "." for n in (60, 45, 80, 38, 52)]
PARAGRAPHS = "".join(f"<p>{p}</p>" for p in PROSE)
LINKS = "<ul>" + "".join(f'<li><a href="/{k}">Link {k}</a></li>' for k in range(8)) + "</ul>"
ARTICLE = "The title " + " ".join(PROSE)


@pytest.mark.parametrize(
    "html",
    [
        f"<body><header><a>Site</a><nav>{LINKS}</nav></header><main><article><h1>The title</h1>{PARAGRAPHS}</article></main><footer><p>&copy; all rights</p></footer>",
        f'<body><div class="navbar">{LINKS}</div><div id="content"><h1>The title</h1>{PARAGRAPHS}</div><div class="sidebar"><h3>More</h3>{LINKS}</div><div class="footer">&copy; x</div>',
        f'<div class="cookie-banner"><p>We use cookies to improve what you see here.</p><button>OK</button></div><article><h1>The title</h1>{PARAGRAPHS}</article><form><label>Mail</label><input><button>Go</button></form>',
        f'<article><h1>The title</h1>{"".join(f"<p>{p}</p>" + ("<div class=advert>Buy this now, it is cheap</div>" if k == 2 else "") for k, p in enumerate(PROSE))}</article>',
        f'<article><h1>The title</h1>{PARAGRAPHS}</article><section id="comments"><h2>Comments</h2><div class="comment"><p>I do not agree with any of this, sorry.</p></div><div class="comment"><p>Nice.</p></div></section>',
        f"<nav>{LINKS}</nav><main><h1>The title</h1>{PARAGRAPHS}</main><aside><h2>Related</h2>{LINKS}</aside><footer>&copy; x</footer>",
    ],
)
def test_pages_of_other_sites(model, html):
    assert extraction.main_texts([html], model) == [ARTICLE]


def test_odd_rows(spark, model):
    long = "<article>" + f"<p>{PROSE[0]}</p>" * 20_000 + "</article><footer>&copy; x</footer>"  # of several slices
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<nav><ul><li><a>x</a></li></ul></nav>"), (4, "u", long), (5, "u", f"<article>{PARAGRAPHS}</article>"), (5, "u", f"<article>{PARAGRAPHS}</article>")]
    frame = spark.createDataFrame([(*row, "clash", "clash", 1) for row in rows], SCHEMA)
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in extraction.extracted(frame, model=model).collect()), key=str)
    both = " ".join(PROSE)
    expected = [(1, "u", "", 0), (2, None, "", 0), (0, "u", "", 0), (4, "u", text := " ".join([PROSE[0]] * 20_000), len(text)), (5, "u", both, len(both)), (5, "u", both, len(both))]
    assert got == sorted(expected, key=str)


def test_tables_without_a_marked_page(spark):
    assert extraction.extracted(spark.createDataFrame([], SCHEMA)).collect() == []
    frame = spark.createDataFrame([(1, "u", f'<div class="menu">{LINKS}</div><div class="content"><h1>The title</h1>{PARAGRAPHS}</div>', "", "", 1)], SCHEMA)
    (row,) = extraction.extracted(frame).collect()  # a model of made-up words is a rougher one
    assert row.text in (ARTICLE, ARTICLE.removeprefix("The title "))
