from __future__ import annotations

import random
from collections import defaultdict
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgertally.functions.numbers import number
from ledgertally.operators.monthly import average_by_month, count_by_month, in_month_order
from ledgertally.operators.ranking import sum_by, sum_top_k, top_k
from ledgertally.operators.storage import column_bytes, column_shares
from ledgertally.operators.transfers import self_pairs

JANUARY_2016, FEBRUARY_2016, JANUARY_2017 = 1452000000, 1455000000, 1484000000


@pytest.fixture
def moments(spark):
    rows = [(JANUARY_2017, 1), (JANUARY_2016, 2), (JANUARY_2016, 5), (FEBRUARY_2016, 3)]
    return spark.createDataFrame(rows, "ts bigint, v int")


def test_month_order(moments):
    counts = count_by_month(moments, "ts")
    text = [row.month for row in in_month_order(counts).collect()]
    time = [row.month for row in in_month_order(counts, chronological=True).collect()]
    assert text == ["01/2016", "01/2017", "02/2016"]
    assert time == ["01/2016", "02/2016", "01/2017"]
    assert in_month_order(counts, limit=2).count() == 2


def test_averages(moments):
    rows = average_by_month(moments, "ts", "v").collect()
    assert {row.month: row.average for row in rows} == {"01/2016": 3.5, "01/2017": 1.0, "02/2016": 3.0}


def test_averages_leave_nulls_out(spark):
    frame = spark.createDataFrame([(0, Decimal("1.5")), (0, None), (0, Decimal("2.5"))], "ts bigint, v decimal(10,2)")
    assert average_by_month(frame, "ts", "v").collect() == [("01/1970", 2.0)]


def test_ties_and_short_results(spark):
    frame = spark.createDataFrame([("c", 1), ("a", 1), ("b", 2), ("d", 1)], "k string, v bigint")
    assert [row.k for row in top_k(frame, "v", ["k"], 3).collect()] == ["b", "a", "c"]
    assert top_k(frame, "v", ["k"], 10).count() == 4
    assert sum_top_k(frame, ["k"], "v", 1).collect() == [("b", 2)]


def test_empty_text_is_a_key(spark):
    frame = spark.createDataFrame([("", 1), ("", 2), ("a", 1)], "k string, v bigint")
    assert {tuple(row) for row in sum_by(frame, ["k"], "v").collect()} == {("", 3), ("a", 1)}


def test_self_pairs(spark):
    frame = spark.createDataFrame([("a", "a"), ("a", "b"), ("", ""), (None, None)], "s string, t string")
    assert sorted(tuple(row) for row in self_pairs(frame, "s", "t").collect()) == [("", ""), ("a", "a")]


def test_bytes_of_hex_columns(spark):
    frame = spark.range(1000).select(
        F.concat(F.lit("0x"), F.repeat(F.lit("ab"), 32)).alias("hash"),
        F.lit(1).alias("flag"),
        F.lit(None).cast("string").alias("nothing"),
        F.concat(F.lit("0x"), F.repeat(F.lit("c"), 512)).alias("odd.`name"),
    )
    sizes = {row.column_name: row.size_bytes for row in column_bytes(frame).collect()}
    assert sizes == {"hash": 32000.0, "flag": -500.0, "nothing": 0.0, "odd.`name": 256000.0}
    shares = column_shares(frame)
    assert shares.columns == ["column_name", "space_saved", "percentage_saved"]
    assert abs(sum(row.percentage_saved for row in shares.collect()) - 100) < 1e-9
    assert column_bytes(frame, ["flag"]).collect() == [("flag", -500.0)]


def test_nulls_count_as_rows_but_not_in_the_mean(spark):
    frame = spark.createDataFrame([("0x1234",), (None,)], "h string")
    assert column_bytes(frame).first().size_bytes == 2.0 * 2


def test_shares_of_nothing(spark):
    frame = spark.createDataFrame([(None,)], "h string")
    assert column_shares(frame).collect() == [("h", 0.0, None)]


def test_hex_texts_take_half_a_byte_for_each_character_behind_the_prefix(spark):
    frame = spark.createDataFrame([("0x" + "a" * 64, "0x" + "b" * 512, "")] * 3, "hash string, bloom string, nothing string")
    assert {r.column_name: r.size_bytes for r in column_bytes(frame, ["hash", "bloom", "nothing"]).collect()} == {"hash": 3 * 32.0, "bloom": 3 * 256.0, "nothing": -3.0}


def literals():
    chosen = random.Random(5)

    def one():
        sign = chosen.choice(["", "-", "+"])
        return chosen.choice([
            str(chosen.randrange(-(10**20), 10**27)),
            f"{sign}{chosen.randrange(10 ** chosen.randrange(1, 20))}.{chosen.randrange(10 ** chosen.randrange(1, 15))}",
            f"{sign}{chosen.randrange(10**9)}.{chosen.randrange(1000)}e{chosen.randrange(-12, 40)}",
            sign + str(chosen.randrange(10**39, 10**40)),
            sign + str(chosen.randrange(10**77, 10**78)),
            chosen.choice([" 5 ", "0", "-0", "0.0e5", "1E3", ".5", "5.", "-.25e1", "1e28", "-1e-28", "1.50e-27", "00012.500"]),
        ])

    return [one() for _ in range(1200)]


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_sums_are_exact_and_rounded_once(spark, partitions):
    texts = literals()
    frame = spark.createDataFrame([(t, i % 7 if i > 20 else 100 + i) for i, t in enumerate(texts)], "v string, k int").repartition(partitions)
    found = {row.k: row.total for row in sum_by(frame.select("k", number(F.col("v")).alias("v")), ["k"], "v").collect()}
    exact = defaultdict(Fraction)
    for i, t in enumerate(texts):
        exact[i % 7 if i > 20 else 100 + i] += Fraction(Decimal(t.strip()))
    assert found == {k: float(total) for k, total in exact.items()}


def test_large_and_fine_literals_cancel_exactly(spark):
    values = ["1e300", "1e-40", "7", "-1e300", "-1e-40"]
    frame = spark.createDataFrame([(v,) for v in values], "v string").select(number(F.col("v")).alias("v"), F.lit(1).alias("k"))
    assert sum_by(frame, ["k"], "v").first().total == 7.0
    assert sum_by(frame.limit(0), ["k"], "v").count() == 0


def test_means_leave_out_rows_without_a_value(spark):
    rows = [("2020-01-05", "10", 10), ("2020-01-09", None, None), ("2020-02-01", None, None)]
    frame = spark.createDataFrame(rows, "d string, v string, w int").select(F.col("d").cast("date").alias("d"), number(F.col("v")).alias("v"), "w")
    for value in ("v", "w"):
        assert {r.month: r.average for r in average_by_month(frame, "d", value).collect()} == {"01/2020": 10.0, "02/2020": None}
