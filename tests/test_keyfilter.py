"""The key filter lets every listed key through and few others."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgertally.operators.keyfilter import key_words, only_listed, split_by_list
from ledgertally.operators.matching import key_list, listed_sums


def keys_of(spark, count, step=1, kind="string"):
    return spark.range(count).select((F.col("id") * step).cast(kind).alias("key"))


@pytest.mark.parametrize("count, most", [(0, 1 << 20), (1, 1 << 20), (5000, 1 << 20), (5000, 16), (5000, 1)])
def test_listed_keys_pass(spark, count, most):
    keys = keys_of(spark, count, 7).union(keys_of(spark, count, 7)).union(spark.createDataFrame([(None,)], "key string"))
    facts = keys_of(spark, 70_000)
    passed = {row.key for row in only_listed(facts, keys, "key", most).collect()}
    assert passed >= {str(7 * k) for k in range(min(count, 10_000))}
    assert len(passed) <= count + (0.005 * 70_000 if most > 16 else 70_000)
    if not count:
        assert not passed


def test_the_filter_grows_with_the_list(spark):
    sizes = {count: len(key_words(keys_of(spark, count), "key").first().words) for count in (0, 1, 3, 1000, 100_000)}
    assert sizes == {0: 1, 1: 1, 3: 2, 1000: 512, 100_000: 65_536}
    assert len(key_words(keys_of(spark, 1000), "key", 64).first().words) == 64


@pytest.mark.parametrize("kind", ["bigint", "double", "decimal(20,2)", "date"])
def test_keys_of_any_type(spark, kind):
    cast = "date_add(date'2020-01-01', cast(id as int))" if kind == "date" else f"cast(id as {kind})"
    facts, keys = (spark.range(n).select(F.expr(cast).alias("key")) for n in (50_000, 20))
    passed = only_listed(facts, keys, "key")
    assert passed.join(keys, "key").count() == 20 and passed.count() < 400


def test_keys_of_two_types_are_left_to_the_join(spark):
    facts, keys = keys_of(spark, 100, kind="bigint"), keys_of(spark, 5, kind="int")
    assert only_listed(facts, keys, "key").count() == 100
    assert listed_sums(facts.withColumn("value", F.lit(1)), key_list(keys, "key", "key"), ["key"], ["value"]).count() == 5


def test_what_is_not_listed_is_not_shuffled(spark):
    """The facts that reach the partial sums, with 0.1 % of the keys on the list."""
    facts = keys_of(spark, 400_000).withColumn("value", F.lit(1))
    keys = keys_of(spark, 400, 997)
    assert only_listed(facts, keys, "key").count() < 400_000 / 100
    assert listed_sums(facts, key_list(keys, "key", "key"), ["key"], ["value"]).count() == 400


def test_split_loses_no_row(spark):
    keys = keys_of(spark, 300, 50)
    facts = keys_of(spark, 20_000).union(spark.createDataFrame([(None,)] * 7, "key string"))
    listed, rest = split_by_list(facts, keys, "key")
    assert listed.count() + rest.count() == 20_007 and rest.where("key is null").count() == 7
    assert rest.join(keys, "key", "left_semi").count() == 0 and listed.join(keys, "key", "left_semi").count() == 300
