"""The corpus pipeline: language ID, quality rules, near-duplicates, mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns a DataFrame; all but the last return the columns of
documents. A stage's rows are written as Parquet and read again for the next one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgertally.llm import automaton, langid, minhash, mixing, perplexity
from ledgertally.llm.tables import passing, stored, table
from ledgertally.operators.keyfilter import split_by_list
from ledgertally.workers import importable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language ID of less than this probability rejects a document.
SURE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those of no clear language; a null lang becomes the prediction. Learns from rows that are not held out."""
    importable(spark)
    model = langid.train(docs.filter(langid.remainder(F.col("doc_id"), 4) != 2))
    kept = langid.identified(docs, model, COLUMNS).filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= SURE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what fails the rules on counts, or whose perplexity is outside its language's band. Texts are judged by themselves and their lang, so rejected ones are told by both."""
    importable(spark)
    keyed = docs.select("*", *[F.xxhash64(F.lit(seed), "lang", "text").alias(f"_print{seed}") for seed in (1, 2)])
    with passing():
        verdicts = perplexity.judged(keyed, columns=["_print1", "_print2"])
        rejected = stored(verdicts.filter("not kept").select("_print1", "_print2").distinct(), "rejected", keep=True)
    near, clean = split_by_list(keyed, rejected, "_print1")
    return clean.unionByName(near.join(rejected, ["_print1", "_print2"], "left_anti")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group at 80 % of five-word shingles.

    Rows alike in doc_id and text are one document, of which the one with the smallest other columns stays. Other rows that share a doc_id are documents of their own, told apart by a
    fingerprint of their text. Rows without a doc_id all stay.
    """
    importable(spark)
    with passing():
        shared = stored(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).filter("a <> b").select("doc_id"), "shared", keep=True)
        row = F.col("doc_id")
        if not shared.isEmpty():
            row = F.col("doc_id").cast("decimal(38,0)") * F.lit(1 << 60) + F.pmod(F.xxhash64("text"), F.lit(1 << 60))
            row = row.cast("decimal(38,0)")
        keyed = docs.withColumn("_row", row)
        found = stored(minhash.near_duplicates(keyed.select(F.col("_row").alias("doc_id"), "text")).filter("doc_id is not null"), "found")
        of_row = found.groupBy(F.col("doc_id").alias("_row")).agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
        touched = stored(of_row.filter("not kept or rows > 1"), "touched", keep=True)
    near, alone = split_by_list(keyed, touched, "_row")
    near = near.join(touched.filter("not kept").select("_row"), "_row", "left_anti")
    one = near.groupBy("_row").agg(F.min(F.struct(*COLUMNS)).alias("document")).select("document.*")
    return alone.select(*COLUMNS).unionByName(one)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; a document that it leaves out goes."""
    importable(spark)
    mixed = mixing.mixed_sources(docs, columns=COLUMNS).select(F.struct(*COLUMNS).alias("document"), "copies").filter("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("document.*")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids and of the text they decode to."""
    importable(spark)
    return automaton.encoded(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("bpe", bpe),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)  # what a stage leaves besides its rows is small
    return STAGES[-1][1](spark, docs, sf_dir)
