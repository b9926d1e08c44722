from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from ledgertally.functions.checks import is_float, is_int
from ledgertally.functions.months import epoch_month, month_label
from ledgertally.functions.numbers import as_double, double_text, number, sums, whole_order, whole_text
from ledgertally.functions.texts import hex_bytes, joined, json_scalar, stripped, text_length
from ledgertally.operators.monthly import with_month


def answers(spark, texts, check):
    frame = spark.createDataFrame([(text,) for text in texts], "text string")
    return {row[0]: row[1] for row in frame.select("text", check(F.col("text"))).collect()}


def test_integers(spark):
    good = ["12", " 12 ", "+5", "-7", "0", "99999999999999999999", "1" * 60]
    bad = ["12.5", "1e3", "", "n/a", "1 2", "0x10", "1_000", "value", None]
    result = answers(spark, good + bad, is_int)
    assert all(result[text] for text in good)
    assert not any(result[text] for text in bad)
    assert None not in result.values()


def test_floats(spark):
    good = ["1e3", "1.5e9", "12.5", "5", "-5.", ".5", " 7 ", "+2E-3", "1" * 40]
    bad = ["1.0d", "1f", "0x10", "nan", "inf", "Infinity", "", ".", "e5", "1e400", "1.2.3", "value", None]
    result = answers(spark, good + bad, is_float)
    assert all(result[text] for text in good)
    assert not any(result[text] for text in bad)
    assert None not in result.values()


def python_accepts(convert, text):
    try:
        return abs(convert(text)) < float("inf")
    except ValueError:
        return False


def test_checks_agree_with_python_on_random_texts(spark):
    chosen = random.Random(11)
    letters = "0123456789+-. eE\tdx"
    texts = {"".join(chosen.choice(letters) for _ in range(chosen.randrange(1, 8))) for _ in range(20000)}
    integers, floats = answers(spark, texts, is_int), answers(spark, texts, is_float)
    assert {t for t in texts if integers[t]} == {t for t in texts if python_accepts(int, t)}
    assert {t for t in texts if floats[t]} == {t for t in texts if python_accepts(float, t)}


def test_accepted_texts_have_their_python_value(spark):
    texts = [" 12 ", "+5", "-7", "\t8", "5.", ".5", "+.5e-3", " 1e3", "007", "-0", "1E+2", "12345678901234567890"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("v", number(F.col("t")))
    values = [row[0] for row in frame.select(as_double(frame, "v")).collect()]
    assert values == [float(t) for t in texts]
    integers = [t for t in texts if python_accepts(int, t)]
    exact = spark.createDataFrame([(t,) for t in integers], "t string").select(whole_text(number(F.col("t"))))
    assert [int(row[0]) for row in exact.collect()] == [int(t) for t in integers]


def test_month_boundaries(spark):
    frame = spark.createDataFrame([(1548979199,), (1548979200,), (-1,), (0,)], "s bigint")
    labels = [row[0] for row in frame.select(month_label(epoch_month(F.col("s")))).collect()]
    assert labels == ["01/2019", "02/2019", "12/1969", "01/1970"]


def test_months_agree_with_the_standard_library(spark):
    chosen = random.Random(7)
    seconds = [chosen.randrange(0, 4 * 10**9) for _ in range(2000)]
    frame = spark.createDataFrame([(s,) for s in seconds], "s bigint")
    labels = [row[0] for row in frame.select(month_label(epoch_month(F.col("s")), "-")).collect()]
    assert labels == [time.strftime("%m-%Y", time.gmtime(s)) for s in seconds]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_months_ignore_the_session_time_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = spark.createDataFrame([("1548979199",), ("1548979200.75",)], "ts string")
        plain = spark.sql("SELECT timestamp_ntz'2019-01-31 23:59:59' AS ts")
        zoned = spark.sql("SELECT timestamp_seconds(1548979199) AS ts")
        for frame, expected in [(texts, ["01/2019", "02/2019"]), (plain, ["01/2019"]), (zoned, ["01/2019"])]:
            rows = with_month(frame, "ts").select(month_label(F.col("month_index"))).collect()
            assert [row[0] for row in rows] == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_moments_outside_the_calendar_are_dropped(spark):
    frame = spark.createDataFrame([("9" * 18,), ("9" * 30,), ("1e30",), ("0",)], "ts string")
    assert with_month(frame, "ts").count() == 1


def test_numbers_add_up_exactly(spark):
    values = ["1" + "0" * 26, "1", "2.5", "1e3", "9" * 27, "1" + "0" * 35, None]
    frame = spark.createDataFrame([(v,) for v in values], "v string").select(number(F.col("v")).alias("v"), F.lit(2).alias("w"))
    summed = sums(frame, [], ["v", "w"])
    row = summed.select("v", "v_rows", "w", "w_rows", "rows", as_double(summed, "v").alias("double")).first()
    assert {e.limb: int(e.value) for e in row.v} == {-1: 5 * 10**27, 0: 10**26 + 1 + 2 + 1000 + int("9" * 27), 1: 10**7}
    assert row.double == float(10**35 + 10**26 + 1003 + int("9" * 27)) and list(row)[1:5] == [6, 14, 7, 7]


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_whole_numbers_of_any_length(spark, partitions):
    chosen = random.Random(partitions)
    texts = [str(chosen.randrange(-(10**n), 10**n)) for n in [1, 5, 27, 28, 29, 38, 39, 56, 57, 85, 200, 1000] for _ in range(60)] + ["0", "-0", " 12 ", "+007", "9" * 200, "-" + "9" * 84]
    frame = spark.createDataFrame([(t, i % 5) for i, t in enumerate(texts)], "v string, k int").repartition(partitions)
    summed = sums(frame.select("k", number(F.col("v")).alias("v")), ["k"], ["v"])
    found = {row.k: row.text for row in summed.select("k", whole_text(F.col("v")).alias("text")).collect()}
    assert found == {k: str(sum(int(t) for t in texts[k::5])) for k in range(5)}
    each = frame.select("v", whole_text(number(F.col("v"))).alias("text"))
    assert all(row.text == str(int(row.v)) for row in each.collect())
    ordered = [int(row.text) for row in each.orderBy(whole_order(F.col("text"))).collect()]
    assert ordered == sorted(ordered)


def test_literals_of_any_size(spark):
    texts = ["1e300", "1e-300", "-2.5e-310", "0e99999999999", "1e-99999999999", "1" * 300 + ".5", "7." + "3" * 300, "-1e28", "0.000"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("v", number(F.col("t")))
    assert [row[0] for row in frame.select(as_double(frame, "v")).collect()] == [float(t) for t in texts]


def test_double_text(spark):
    chosen = random.Random(3)
    values = [chosen.uniform(-1, 1) * 10 ** chosen.randrange(-12, 30) for _ in range(3000)]
    values += [chosen.uniform(1e-4, 1e-3) for _ in range(300)]
    values += [0.0, 1.0, 1e15, 1e16, 1e18, 12345678901.23456, 4.321987654321987e18, 1e-4, 1e-5, 0.5, 100.0, 2.5e100]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    texts = [row[0] for row in frame.select(double_text(F.col("v"))).collect()]
    assert [float(text) for text in texts] == values
    # In rare cases two texts of the same length read back as the same double.
    assert sum(text == repr(v) for text, v in zip(texts, values)) > 0.99 * len(values)
    assert texts[-12:] == [repr(v) for v in values[-12:]]


def test_texts(spark):
    frame = spark.createDataFrame([('["a,b"]', 12.5, None)], "t string, d double, n string")
    row = frame.select(
        stripped(F.col("t"), '[]"'),
        joined(F.col("t"), F.col("d").cast("string")),
        text_length(F.col("d")),
        json_scalar(F.lit('say "é"\n')),
        json_scalar(F.lit(5)),
        json_scalar(F.col("n")),
    ).first()
    assert list(row) == ["a,b", '["a,b"],12.5', 4, '"say \\"é\\"\\n"', "5", "null"]


def test_hex_bytes(spark):
    frame = spark.createDataFrame([(66.0,), (514.0,), (1.0,), (None,)], "m double")
    assert [row[0] for row in frame.select(hex_bytes(F.col("m"))).collect()] == [32.0, 256.0, -0.5, 0.0]
