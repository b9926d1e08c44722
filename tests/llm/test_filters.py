"""Language ID, quality rules, toxicity: exact counts, held-out accuracy, odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.data import SCHEMA, SYLLABLES, documents, sentence

from ledgertally.llm import langid, ordinal, perplexity


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def counts_by_hand(text: str | None) -> tuple:
    text = text or ""
    words = words_of(text)
    windows: dict = {}
    for k in range(len(words) - 4):
        windows.setdefault(tuple(words[k : k + 5]), []).append(k)
    repeated = {k + d for at in windows.values() if len(at) > 1 for k in at for d in range(5)}
    lines = [line for line in text.split("\n") if words_of(line)]
    return (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), sum(line in lines[:k] for k, line in enumerate(lines)), len(repeated))


def test_counts_agree_with_the_rules_by_hand():
    rng = random.Random(4)
    texts = [None, "", " \n ", "a b c d e a b c d e", "x\nx\n\nx \n y", "é ü #*$ <b>|", "a b c d e f a b c d e f g a b c d"]
    texts += [" ".join(rng.choice(["ab", "ab", "cd", "é", "#\n", "\n\n"]) for _ in range(rng.randrange(80))) for _ in range(200)]
    assert [tuple(map(int, row)) for row in zip(*perplexity.counted(pa.array(texts, pa.string())), strict=True)] == list(map(counts_by_hand, texts))


def test_kneser_ney_sums_to_one_and_keeps_seen_order():
    rng = np.random.default_rng(2)
    codes, counts = np.unique(rng.integers(0, 20, 3000) * 4096 + rng.integers(0, 9, 3000) * 64 + rng.integers(0, 9, 3000), return_counts=True)
    levels = perplexity.kneser_ney(codes, counts)
    for context in (codes[0] // 64, codes[-1] // 64, 63 * 64 + 1, 63 * 64 + 63):  # seen, seen, half seen, never seen
        p = 10 ** perplexity.log_probabilities(levels, context * 64 + np.arange(64))
        assert p.sum() == pytest.approx(1, abs=1e-9) and (p > 0).all()
    assert all((level.hashes[1:] > level.hashes[:-1]).all() for level in levels)


def test_quality_of_odd_and_of_garbled_rows(spark):
    rng = random.Random(8)
    rows = [(1000 + k, sentence(rng, "en", 80), "en") for k in range(150)]
    rows += [(2000 + k, "".join(rng.choice("qxzj#$~0") for _ in range(600)).replace("~", " "), "en") for k in range(4)]
    frame = spark.createDataFrame([(i, t, g, "s", 1, True, "clash", 7, "clash", "clash", 1) for i, t, g in rows] + documents(), SCHEMA)
    got = perplexity.judged(frame).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == frame.count() and all(not by_id[2000 + k].kept and by_id[2000 + k].band_failed for k in range(4))
    assert sum(by_id[1000 + k].kept for k in range(150)) == 150
    texts = {r[0]: r[1] for r in rows} | {r[0]: r[1] for r in documents()}
    for doc_id in (900, 901, 902, 903, 905, 908, 1003):
        row = by_id[doc_id]
        n = counts_by_hand(texts[doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == n
        assert row.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and (not row.kept or not row.base_failed)
    assert perplexity.judged(frame.limit(0)).collect() == []


def test_every_language_is_judged_by_its_own_model(spark):
    rng = random.Random(12)
    many = [(3000 + k, sentence(rng, "en", 80), "en") for k in range(200)]
    alone = [(4000 + k, "".join(rng.choice("qxzj") for _ in range(9)).join([" "] * 40), None) for k in range(25)]
    same = [(5000 + k, sentence(rng, "de", 80), "sr-Latn-RS") for k in range(200)] + [(6000 + k, "zq xj " * 60, "sr-Latn-BA") for k in range(25)]
    frame = spark.createDataFrame([(i, t, g, "s", 1, True, "clash", 7, "clash", "clash", 1) for i, t, g in many + alone + same], SCHEMA)
    got = {r.doc_id: r for r in perplexity.judged(frame).collect()}
    assert not any(got[i].band_failed for i, _, _ in many + alone + same)
    few = {r.doc_id: r for r in perplexity.judged(frame, head=40).collect()}
    assert few == got


def test_probabilities_of_the_table_are_those_of_one_process(spark):
    rng = np.random.default_rng(5)
    kinds = {"=a": 9, "=b": 30, "": 3}
    rows, want = [], {}
    for name, k in kinds.items():
        codes, counts = np.unique(rng.integers(0, k, 4000) * 4096 + rng.integers(0, k, 4000) * 64 + np.minimum(rng.geometric(0.2, 4000), 63), return_counts=True)
        logs = perplexity.log_probabilities(perplexity.kneser_ney(codes, counts), codes)
        rows += zip([name] * len(codes), codes.tolist(), counts.tolist(), strict=True)
        want |= {(name, c): p for c, p in zip(codes.tolist(), logs.tolist(), strict=True)}
    found = perplexity.probabilities(spark.createDataFrame(rows, "model string, code bigint, n bigint"), 6, 64).collect()
    got = {(r.model, r.code): r.log_p / 10**9 for r in found}
    assert len(found) == len(want) and got == pytest.approx(want, abs=1e-8)


def test_probabilities_add_to_one_where_some_ngrams_are_of_one_text(spark):
    rng = np.random.default_rng(6)
    rows = []
    for a in range(5):
        for b in range(5):
            for c in range(5):
                text = int(rng.integers(0, 4))
                rows.append(("m", a * 4096 + b * 64 + c, int(rng.geometric(0.3)), text, text if rng.random() < 0.5 or a == 3 else text + 1))
    rows += [("of one text", code, n, 1, 1) for _, code, n, _, _ in rows]
    found = perplexity.probabilities(spark.createDataFrame(rows, "model string, code bigint, n bigint, lo bigint, hi bigint"), 6, 5).collect()
    sums: dict = {}
    for r in found:
        sums[r.model, r.code // 64] = sums.get((r.model, r.code // 64), 0) + 10 ** (r.log_p / 10**9)
    assert len(sums) == 50 and all(s == pytest.approx(1, abs=1e-7) for s in sums.values())


def test_more_languages_than_are_learned(spark):
    rng = random.Random(21)
    rows = [(k, sentence(rng, "en", 12), f"l{k % 1500}", "s", 1) for k in range(3000)] + [(9000 + k, sentence(rng, "fr", 30), "fr", "s", 1) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")
    model = langid.train(frame, langid.Fit(languages=12, epochs=1, sample=400))
    assert len(model.languages) == 12 and "fr" in model.languages
    got = {r.doc_id: r.lang_pred for r in langid.identified(frame, model).collect()}
    assert sum(got[9000 + k] == "fr" for k in range(60)) >= 55 and set(got.values()) <= set(model.languages)


def test_neighbouring_characters_are_symbols_of_their_own():
    texts = ["日本", "旦本", "日末", "ÉÀ 12", "éà 34", "😀x", "😁x"]
    found = perplexity.trigrams(pa.array(texts), pa.array(["ja"] * 7))
    grams = [tuple(found.code[found.which[a:b]].tolist()) for a, b in zip(found.begins[:-1], found.begins[1:], strict=True)]
    assert grams[3] == grams[4] and len(set(grams)) == 6
    assert grams[0] == ((32 << 42) | (0x65E5 << 21) | 0x672C, (0x65E5 << 42) | (0x672C << 21) | 32)


def test_scripts_without_blanks_are_judged_by_what_they_say(spark):
    rng = random.Random(14)
    kinds = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(rng.randint(1, 3))) for _ in range(60)]
    clean = ["".join(rng.choice(kinds) for _ in range(250)) for _ in range(120)]
    run = [" ".join(t[k : k + 8] for k in range(0, len(t), 8)) if d % 2 else t for d, t in enumerate(clean)]
    junk = [" ".join("".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(8)) for _ in range(60)) for _ in range(4)]
    junk += ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(500)) for _ in range(4)]
    frame = spark.createDataFrame([(k, t, "zh") for k, t in enumerate(run + junk)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.band_failed for r in perplexity.judged(frame).collect()}
    assert not any(got[k] for k in range(120)) and all(got[120 + k] for k in range(8))


def test_language_of_held_out_and_odd_rows(spark):
    rng = random.Random(9)
    rows = [(5000 + k, sentence(rng, lang, rng.randint(5, 60)), lang) for k in range(300) for lang in [rng.choice(list(SYLLABLES))]]
    frame = spark.createDataFrame([(i, t, g, "s", 1, True, "clash", 7, "clash", "clash", 1) for i, t, g in rows] + documents(), SCHEMA)
    got = langid.identify(frame).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == frame.count()
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in got)
    held = [(i, g) for i, _, g in rows if by_id[i].held_out]
    assert len(held) > 40 and np.mean([by_id[i].lang_pred == g for i, g in held]) > 0.97
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (900, 901, 902, 904))
    assert all(0 <= r.score <= 1 for r in got) and {r.lang_pred for r in got} <= {"und", *SYLLABLES}
    assert langid.identify(frame.limit(0)).collect() == []
    none = langid.identify(frame.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_toxicity_of_held_out_and_odd_rows(spark):
    rng = random.Random(10)
    bad = ["vile", "rotten", "wretch", "swine", "louse", "fiend"]
    rows, labels = [], []
    for k in range(600):
        words, toxic = sentence(rng, "en", 60).split(), k % 3 == 0
        for _ in range(rng.randint(1, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((7000 + k, " ".join(words).upper() if k % 7 == 0 else " ".join(words), "en"))
        if k < 400:
            labels.append((7000 + k, int(toxic), "clash"))
    labels += [(None, 1, "x"), (7001, None, "x"), (7000, 1, "x"), (424242, 1, "x")]
    frame = spark.createDataFrame([(i, t, g, "s", 1, True, "clash", 7, "clash", "clash", 1) for i, t, g in rows] + documents(), SCHEMA)
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int, text string")
    got = ordinal.toxicity(frame, known).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == frame.count()
    right = [by_id[7000 + k].toxic == (k % 3 == 0) for k in range(400, 600)]
    assert np.mean(right) > 0.95 and np.mean([by_id[7000 + k].toxic for k in range(400, 600) if k % 3]) < 0.04
    few, many = ([r for (i, t, _) in rows if (n := sum(t.lower().count(w) for w in bad)) and (n <= 1 if least else n >= 6) for r in [by_id[i].severity]] for least in (True, False))
    assert np.mean(many) > np.mean(few) + 0.5
    assert (by_id[900].toxic, by_id[900].severity, by_id[901].severity) == (False, 0.0, 0.0)
    assert not any(r.toxic for r in ordinal.toxicity(frame, known.limit(0)).collect())
    assert ordinal.toxicity(frame.limit(0), known).collect() == []


def test_thresholds_are_in_order_and_odds_sum_to_one():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 4, 300)
    begins = np.arange(301) * 3
    at = np.concatenate([[10 + g, 50 + rng.integers(0, 30), 90 + rng.integers(0, 30)] for g in grade])
    model = ordinal.fitted(at, begins, grade, ordinal.Fit())
    assert (np.diff(model.thresholds) > 0).all()
    odds = model.odds(np.linspace(-9, 9, 50))
    assert np.allclose(odds.sum(axis=1), 1) and (np.diff(odds @ np.arange(4)) > 0).all()
    assert (model.odds(np.add.reduceat(model.weights[at], begins[:-1])).argmax(axis=1) == grade).mean() > 0.95


def test_trigram_tables_grow_with_the_slice_not_with_its_symbols():
    import tracemalloc

    values = np.array([5, (1 << 24) - 1, 5, 7], np.int64)
    tracemalloc.start()
    try:
        at, n, which = perplexity._distinct(values, 1 << 24)
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert peak < 1 << 20
    assert at.tolist() == [5, 7, (1 << 24) - 1] and n.tolist() == [2, 1, 1] and which.tolist() == [0, 2, 0, 1]
    text = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 300)) * 2
    found = perplexity.trigrams(pa.array([text, "ab ab", None]), pa.array(["zh", None, "zh"]))
    assert found.n.sum() == len(found.which) and found.begins[-1] == len(found.which)


def test_a_task_gives_back_the_memory_it_freed(monkeypatch):
    from ledgertally.llm import tables

    calls = []
    monkeypatch.setattr(tables, "released", lambda: calls.append(len(calls)))
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 300, None, "b" * 300, "c"])], ["text"])
    out = tables.slices([batch, batch], limit=400)
    taken = [next(out), next(out), next(out)]
    assert not calls  # not while slices are still being taken
    taken += list(out)
    assert [s.num_rows for s in taken] == [2, 2, 2, 2] and calls == [0]
    tables.released()  # the real one runs where the C library has no malloc_trim too
