"""The stages one after the other on odd rows, and the registered queries."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
from pyspark.sql import functions as F
from tests.llm.data import SCHEMA, documents, sentence
from tests.llm.test_duplicates import reach, shingles
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from ledgertally.llm import langid, mixing, perplexity


def test_stages_keep_clean_documents_and_return_the_columns(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == corpus_pipeline.COLUMNS, name
        before, after = ({r.doc_id for r in d.select("doc_id").collect()} for d in (docs, out))
        assert after <= before
        if name == "language_id":
            assert not after & {900, 901, 902, 904} and set(range(60)) <= after
        if name == "quality_rules":
            assert not after & {903, 906, 907, 908} and len(after & set(range(60))) >= 58
        if name == "near_dedup":
            assert not after & {60, 63, 66, 69}
        docs = spark.createDataFrame(out.collect(), out.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(last) == docs.count() and {"ids_sha256", "decoded_sha256"} <= set(last[0].asDict())


def test_near_dedup_keeps_texts_that_share_a_doc_id(spark):
    rng = random.Random(3)
    a, b, c = (sentence(rng, "en", 40) for _ in range(3))
    rows = [(1, a, "en"), (1, b, "en"), (1, b, "de"), (1, b, "en"), (2, c, "en"), (3, a, "en"), (4, a + " more", "en"), (None, c, "en"), (None, c, "en"), (5, None, "en"), (5, None, "en"), (6, "", None)]
    frame = spark.createDataFrame([(i, t, g, "s", 1) for i, t, g in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    got = sorted(((r.doc_id, r.text, r.lang) for r in corpus_pipeline.near_dedup(spark, frame, "").collect()), key=str)
    assert got == sorted([(1, a, "en"), (1, b, "de"), (2, c, "en"), (None, c, "en"), (None, c, "en"), (5, None, "en"), (6, "", None)], key=str)
    unique = frame.filter("doc_id > 1 or text = '" + a + "'")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, unique.filter("doc_id <> 5"), "").collect()) == [(1, a), (2, c), (6, "")]


def brute_run(rows: list[tuple], spark) -> list[tuple]:
    """The rows of run() by plain Python around the two models, which have tests of their own: shingles, groups and choices by hand."""
    frame = spark.createDataFrame(rows, SCHEMA)
    rejected = langid.identify(frame).toPandas()
    learned = langid.train(frame.filter(langid.remainder(F.col("doc_id"), 4) != 2))
    named = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in langid.identified(frame, learned, ["doc_id", "text"]).collect()}
    assert len(rejected) == len(rows)
    kept = [(i, t, g if g is not None else named[i, t][0], s, n) for i, t, g, s, n, *_ in rows if named[i, t][0] != "und" and named[i, t][1] >= corpus_pipeline.SURE]
    docs = spark.createDataFrame(kept, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    good = {(r.text, r.lang) for r in perplexity.judged(docs, columns=["text", "lang"]).collect() if r.kept}
    kept = [r for r in kept if (r[1], r[2]) in good]
    nodes = sorted({(r[0], r[1]) for r in kept if r[0] is not None})
    sets = {n: shingles(n[1], 5) for n in nodes}
    links = [(a, b) for k, a in enumerate(nodes) for b in nodes[:k] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    least = reach(nodes, links)
    survivors = {least[n]: None for n in nodes}
    kept = [min(r for r in kept if r[:2] == n) for n in survivors] + [r for r in kept if r[0] is None]
    docs = spark.createDataFrame(kept, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = []
    for r in mixing.mixed_sources(docs, columns=["doc_id", "text"]).collect():
        out += [(r.doc_id, *library(r.text))] * r.copies
    return sorted(out, key=str)


def library(text: str | None) -> tuple:
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coder.no_truncation(), coder.no_padding()
    ids = coder.encode(text or "", add_special_tokens=False).ids
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), digest(" ".join(map(str, ids))), digest(coder.decode(ids, skip_special_tokens=False))


def test_run_equals_brute_force(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)
    assert got == brute_run(rows, spark) and len(got) > 40


def test_stages_take_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert [stage(spark, empty, "").count() for _, stage in corpus_pipeline.STAGES] == [0] * 5


def test_every_operator_is_registered_once():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
