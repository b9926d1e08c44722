"""A Bloom filter of a list's keys, which facts meet before they are summed and shuffled.

Facts whose key is on no list would be summed by key and shuffled only for the join to drop them. The filter lets all listed keys through and few others: a key sets three bits of one
64-bit word, and a fact asks that word. The words are worked out by Spark when the query runs, as a scalar subquery, so no job runs while a plan is built and no broadcast join is needed; a
list takes about 32 bits a key, up to 8 MB in all. Beyond that more strangers pass, and the join, which follows anyway, drops them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Words of the largest filter.
MOST_WORDS = 1 << 20
KEYS_PER_WORD = 2


def _bits(hashed: Column) -> Column:
    """Three bits of a word, chosen by a hash."""
    places = [F.shiftright(hashed, 6 * k).bitwiseAND(F.lit(63).cast("bigint")).cast("int") for k in range(3)]
    first, second, third = (F.call_function("shiftleft", F.lit(1).cast("bigint"), place) for place in places)
    return first.bitwiseOR(second).bitwiseOR(third)


def key_words(keys: DataFrame, key: str, most_words: int = MOST_WORDS) -> DataFrame:
    """One row with one column, ``words``: the filter of the keys, its size a power of two."""
    hashed = keys.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("hash"))
    word = F.pmod(F.shiftright("hash", 18), F.lit(most_words).cast("bigint"))
    largest = hashed.groupBy(word.alias("word")).agg(F.bit_or(_bits(F.col("hash"))).alias("bits"), F.count("*").alias("keys"))
    whole = largest.agg(F.collect_list(F.struct("word", "bits")).alias("pairs"), F.coalesce(F.sum("keys"), F.lit(0)).alias("keys"))
    needed = F.greatest(F.ceil(F.log2(F.greatest(F.col("keys"), F.lit(1)) / KEYS_PER_WORD)), F.lit(0))
    sized = whole.withColumn("size", F.least(F.lit(most_words).cast("bigint"), F.pow(F.lit(2), needed).cast("bigint")))
    empty = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1), lambda k: F.struct(k.alias("word"), F.lit(0).cast("bigint").alias("bits")))
    folded = sized.select("size", F.explode(F.concat("pairs", empty)).alias("pair")).select(F.pmod("pair.word", F.col("size")).alias("word"), "pair.bits")
    words = folded.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda pair: pair["bits"]).alias("words"))


def may_be_listed(keys: DataFrame, key: str, most_words: int = MOST_WORDS) -> Column:
    """Whether the filter of the keys lets a fact's key through; false for a null. Both keys have one type."""
    words = key_words(keys, key, most_words).scalar()
    hashed, size = F.xxhash64(key), F.size(words).cast("bigint")
    word = F.get(words, F.pmod(F.shiftright(hashed, 18), size).cast("int"))
    bits = _bits(hashed)
    return F.col(key).isNotNull() & (word.bitwiseAND(bits) == bits)


def only_listed(facts: DataFrame, keys: DataFrame, key: str, most_words: int = MOST_WORDS) -> DataFrame:
    """The facts without most of those whose key is none of the keys. Keys of another type than the facts' are left to the join."""
    if facts.schema[key].dataType != keys.schema[key].dataType:
        return facts
    return facts.where(may_be_listed(keys, key, most_words))


def split_by_list(facts: DataFrame, keys: DataFrame, key: str, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """Facts whose key may be one of the keys, and facts whose key is none of them, with those without a key. Only the first need a join."""
    listed = may_be_listed(keys, key, most_words)
    return facts.where(listed), facts.where(~listed)
