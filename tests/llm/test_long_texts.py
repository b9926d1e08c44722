"""A text of more than two slices through the operators on documents."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tests.llm.data import SYLLABLES, sentence
from tests.llm.test_duplicates import shingles
from tests.llm.test_filters import counts_by_hand
from tokenizers import Tokenizer

from ledgertally.llm import arraymerge, automaton, langid, logbilinear, minhash, mixing, ordinal, packing, perplexity
from ledgertally.llm.tables import SLICE_BYTES

BYTES, WORDS = (public_tokenizers.path(f"{name}.json") for name in ("byte_bpe_50k", "word_bpe_49k"))


@pytest.fixture(scope="module")
def rows() -> dict:
    rng = random.Random(31)
    common = [sentence(rng, "en", 1) for _ in range(4000)]
    words = [rng.choice(common) for _ in range(800_000)]
    long = " ".join(words)
    assert len(long) > 2 * SLICE_BYTES
    words[400_000] = "changed"
    texts = {1: long, 2: " ".join(words), 3: None, 4: ""}
    return texts | {10 + k: sentence(rng, lang, 60) for k in range(90) for lang in [list(SYLLABLES)[k % 3]]}


@pytest.fixture(scope="module")
def frame(spark, rows):
    data = [(i, t, "en" if i < 10 else list(SYLLABLES)[(i - 10) % 3], f"s{i % 3}") for i, t in rows.items()]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string").repartition(3).cache()


def test_near_duplicates(frame, rows):
    got = {r.doc_id: r for r in minhash.near_duplicates(frame).collect()}
    assert got[1].n_shingles == len(shingles(rows[1], 5)) and (got[1].kept, got[2].kept, got[2].component_id) == (True, False, 1)
    assert all(got[i].kept and got[i].component_id == i for i in rows if i != 2)


def test_mixing_scores_and_rules(frame, rows):
    size = {i: len((t or "").split()) for i, t in rows.items()}
    assert {r.doc_id: r["size"] for r in mixing.mixed_sources(frame).collect()} == size
    scored = {r.doc_id: r for r in logbilinear.score(frame, logbilinear.Sizes(rounds=1, steps=20)).collect()}
    assert all(scored[i].n_tokens == size[i] + 1 and np.isfinite(scored[i].score) for i in rows)
    judged = {r.doc_id: r for r in perplexity.judged(frame).collect()}
    for i in (1, 3, 4, 10):
        row = judged[i]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == counts_by_hand(rows[i])
    assert judged[1].kept


def test_models_on_whole_texts(spark, frame, rows):
    got = {r.doc_id: r.lang_pred for r in langid.identify(frame).collect()}
    assert got[1] == got[2] == "en" and got[3] == got[4] == "und"
    labels = spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in rows], "doc_id bigint, quality int, toxic int")
    assert {r.doc_id for r in ordinal.toxicity(frame, labels).collect()} == set(rows)


def test_tokens_equal_the_library(frame, rows):
    for path, found in ((BYTES, arraymerge.token_counts(frame, BYTES)), (WORDS, automaton.encoded(frame, WORDS, digests=True))):
        library = Tokenizer.from_file(path)
        want = {i: len(library.encode(rows[i] or "", add_special_tokens=False).ids) for i in (1, 3, 4, 10, 50)}
        got = {r.doc_id: r.n_tokens for r in found.collect()}
        assert {i: got[i] for i in want} == want
    library = Tokenizer.from_file(BYTES)
    for row in packing.packed(frame.filter("doc_id in (1, 4, 10)"), BYTES, 2, digest=True).collect():
        ids = np.array([*library.encode(rows[row.doc_id], add_special_tokens=False).ids, 2], np.uint32)
        assert (row.n_tokens, row.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
