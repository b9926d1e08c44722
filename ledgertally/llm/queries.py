"""The registered queries of the subpackage: each operator with its production parameters over a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgertally.llm.arraymerge import token_counts
from ledgertally.llm.automaton import encoded
from ledgertally.llm.caps import near_vectors
from ledgertally.llm.extraction import extracted
from ledgertally.llm.langid import identify
from ledgertally.llm.logbilinear import score
from ledgertally.llm.minhash import Plan, near_duplicates
from ledgertally.llm.mixing import mixed_sources
from ledgertally.llm.ordinal import toxicity
from ledgertally.llm.packing import packed
from ledgertally.llm.perplexity import judged
from ledgertally.llm.phrases import collocations
from ledgertally.llm.sql import ORACLE_SQL as ORACLE_SQL
from ledgertally.llm.tables import table
from ledgertally.llm.whitening import whitened

#: A context window of so many tokens.
WINDOW = 1024


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by shingles of two words here; the operator's own default is five."""
    return near_duplicates(table(spark, sf_dir, "documents"), Plan(width=2))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sources(table(spark, sf_dir, "documents")).drop("copies")


def op3_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op4_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > WINDOW)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, digest=True)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_mix": op2_mix,
    "op3_score": op3_score,
    "op4_caps": op4_caps,
    "op5_quality": op5_quality,
    "op6_token_counts": op6_token_counts,
    "op7_bpe": op7_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_token_ids": op9_token_ids,
    "op10_langid": op10_langid,
    "op11_whiten": op11_whiten,
    "op12_phrases": op12_phrases,
    "op13_html": op13_html,
}
