"""Exact sums of amounts of any length, the same however the rows are partitioned.

A ledger amount in wei does not fit 64 bits and a double sum depends on the order of addition. So a text amount becomes a *number*: an array of
*limbs*, each the number of the limb and a whole number of up to 28 digits. Limb 0 counts units, limb 1 units of 10**28, limb -1 units of 10**-28, and so on: as many as the literal
has digits for, and only those. Most amounts have one. A sum adds each limb of a group on its own, as decimals, in one grouping by key and limb; the few limbs of a key then
make its *total*. Carries are passed on at the end, and the total becomes a double, rounded once, or the text of a whole number of any length.
The helpers below take such a column or any plain numeric one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgertally.functions.checks import is_plain

LIMB_DIGITS = 28
LIMB = f"decimal({LIMB_DIGITS},0)"
EXACT = "decimal(38,0)"
#: Exponents beyond this one belong to a literal that is zero in every double.
LARGEST_EXPONENT = 99_999


def number(text: Column) -> Column:
    """The limbs of a text that passed ``is_float`` or ``is_int``, the finest first; null of a null."""
    plain = F.when(is_plain(text), text.try_cast(LIMB))
    return F.when(plain.isNotNull(), F.array(_limb(F.lit(0), plain))).when(text.isNotNull(), _split(text))


def _limb(limb: Column, value: Column, kind: str = LIMB) -> Column:
    return F.struct(limb.cast("int").alias("limb"), value.cast(kind).alias("value"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _split(text: Column) -> Column:
    """The limbs of any literal: its digits, in groups that end at multiples of 28 places from the point."""
    literal = F.upper(F.regexp_replace(text, r"\s", ""))
    mantissa = F.substring_index(literal, "E", 1)
    written = F.substring_index(literal, "E", -1)
    beyond = F.when(written.startswith("-"), -LARGEST_EXPONENT).otherwise(LARGEST_EXPONENT)
    exponent = F.when(literal.contains("E"), F.coalesce(written.try_cast("int"), beyond)).otherwise(0)
    behind = F.when(mantissa.contains("."), F.length(F.substring_index(mantissa, ".", -1))).otherwise(0)
    digits = F.ltrim(F.translate(mantissa, "+-.", ""), F.lit("0"))
    parts = F.struct(
        F.when(mantissa.startswith("-"), F.lit("-")).otherwise(F.lit("")).alias("sign"),
        digits.alias("digits"),
        (F.greatest(F.least(exponent, F.lit(LARGEST_EXPONENT)), F.lit(-LARGEST_EXPONENT)) - behind).alias("last"),
    )

    def grouped(p: Column) -> Column:
        lowest = F.floor(p["last"] / LIMB_DIGITS)
        padded = F.concat(p["digits"], F.repeat(F.lit("0"), (p["last"] - lowest * LIMB_DIGITS).cast("int")))

        def cut(x: Column) -> Column:
            """The groups of a text of full ones, the last of them first."""
            count = (F.length(x["text"]) / LIMB_DIGITS).cast("int")
            group = lambda k: F.concat(p["sign"], F.substring(x["text"], (count - 1 - k) * LIMB_DIGITS + 1, F.lit(LIMB_DIGITS))).try_cast(LIMB)
            return F.transform(F.sequence(F.lit(0), count - 1), lambda k: _limb(x["lowest"] + k, group(k)))

        full = F.ceil(F.length(padded) / LIMB_DIGITS) * LIMB_DIGITS
        return _let(F.struct(lowest.alias("lowest"), F.lpad(padded, full.cast("int"), F.lit("0")).alias("text")), cut)

    return _let(parts, lambda p: F.when(p["digits"] == "", F.array(_limb(F.lit(0), F.lit(0)))).otherwise(grouped(p)))


def is_number(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.ArrayType)


def sums(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Totals per group: ``*keys, *values, *values_rows, rows``, with how many rows have each value, and how many there are.

    A null is no value. A group without any has an empty total, or a null if the column is a plain one.
    """
    limbed = [value for value in values if is_number(df, value)]
    plain = [value for value in values if value not in limbed]
    counts = [*[f"{value}_rows" for value in values], "rows"]
    if not limbed:
        present = [F.count(value).alias(f"{value}_rows") for value in plain]
        return df.groupBy(*keys).agg(*[F.sum(value).alias(value) for value in plain], *present, F.count("*").alias("rows"))

    def entries(at: int, value: str) -> Column:
        return F.transform(value, lambda e, k: F.struct(F.lit(at).alias("of"), e["limb"].alias("limb"), e["value"].cast(EXACT).alias("value"), (k == 0).alias("first")))

    listed = [F.coalesce(entries(at, value), F.array().cast("array<struct<of:int,limb:int,value:decimal(38,0),first:boolean>>")) for at, value in enumerate(limbed)]
    every = F.concat(*listed) if len(listed) > 1 else entries(0, limbed[0])
    rows = df.select(*keys, *plain, F.posexplode_outer(every).alias("place", "entry"))
    once = F.coalesce(F.col("place") == 0, F.lit(True))  # a row's first entry stands for the row
    parts = rows.groupBy(*keys, F.col("entry.of").alias("_of"), F.col("entry.limb").alias("_limb")).agg(
        F.sum("entry.value").alias("_value"),
        F.count_if("entry.first").alias("_first"),
        *[F.sum(F.when(once, F.col(value))).alias(value) for value in plain],
        *[F.count(F.when(once, F.col(value))).alias(f"{value}_rows") for value in plain],
        F.count_if(once).alias("rows"),
    )
    own = lambda at, kept: F.when(F.col("_of") == at, kept)
    return parts.groupBy(*keys).agg(
        *[F.collect_list(own(at, _limb(F.col("_limb"), F.col("_value"), EXACT))).alias(value) for at, value in enumerate(limbed)],
        *[F.sum(value).alias(value) for value in plain],
        *[F.coalesce(F.sum(own(at, F.col("_first"))), F.lit(0)).alias(f"{value}_rows") for at, value in enumerate(limbed)],
        *[F.sum(f"{value}_rows").alias(f"{value}_rows") for value in plain],
        F.sum("rows").alias("rows"),
    ).select(*keys, *values, *counts)


def _carried(total: Column, use: Callable[[Column, Column, Column], Column]) -> Column:
    """``use`` of a total's lowest limb, its digits from there on, each below the base, and the carry that is left, which has the sign of all."""
    base = F.lit("1" + "0" * LIMB_DIGITS).cast(EXACT)
    limbs = F.transform(total, lambda e: e["limb"])
    start = F.struct(F.lit(0).cast(EXACT).alias("carry"), F.array().cast(f"array<{LIMB}>").alias("digits"))

    def step(state: Column, limb: Column) -> Column:
        here = F.aggregate(F.filter(total, lambda e: e["limb"] == limb), state["carry"], lambda a, e: (a + e["value"]).cast(EXACT))

        def split(x: Column) -> Column:
            digit = F.pmod(x, base)
            return F.struct(((x - digit) / base).cast(EXACT).alias("carry"), F.concat(state["digits"], F.array(digit.cast(LIMB))).alias("digits"))

        return _let(here, split)

    summed = F.aggregate(F.sequence(F.array_min(limbs), F.array_max(limbs)), start, step)
    return _let(F.struct(F.array_min(limbs).alias("lowest"), summed.alias("sum")), lambda x: use(x["lowest"], x["sum"]["digits"], x["sum"]["carry"]))


def _negated(total: Column) -> Column:
    return F.transform(total, lambda e: _limb(e["limb"], -e["value"], EXACT))


def _digits(total: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use`` of a total's digits as a signed text and the number of the limb that they end with. Null for an empty total."""

    def written(sign: str) -> Callable[[Column, Column, Column], Column]:
        def joined(lowest: Column, digits: Column, carry: Column) -> Column:
            padded = F.transform(F.reverse(digits), lambda d: F.lpad(d.cast("string"), LIMB_DIGITS, "0"))
            whole = F.ltrim(F.concat(carry.cast("string"), F.array_join(padded, "")), F.lit("0"))
            return F.when(carry >= 0, use(F.concat(F.lit(sign), F.when(whole == "", F.lit("0")).otherwise(whole)), lowest))

        return joined

    only = total[0]
    single = F.when((F.size(total) == 1) & (only["limb"] == 0), use(only["value"].cast("string"), only["limb"]))
    known = F.when(F.size(total) > 0, F.coalesce(_carried(total, written("")), _carried(_negated(total), written("-"))))
    return F.coalesce(single, known)


def times(df: DataFrame, column: str, factor: Column) -> Column:
    """The value counted ``factor`` times."""
    if not is_number(df, column):
        return F.col(column) * factor
    small = F.forall(column, lambda e: F.abs(e["value"]) < F.lit("1" + "0" * LIMB_DIGITS).cast(EXACT))

    def below_base(lowest: Column, digits: Column, carry: Column) -> Column:
        return F.transform(F.concat(digits.cast(f"array<{EXACT}>"), F.array(carry)), lambda d, k: _limb(lowest + k, d, EXACT))

    limbs = F.when(small, F.col(column).cast(f"array<struct<limb:int,value:{EXACT}>>")).otherwise(_carried(F.col(column), below_base))
    return F.transform(limbs, lambda e: _limb(e["limb"], e["value"] * factor, EXACT))


def as_double(df: DataFrame, column: str) -> Column:
    """One double of a total or of a plain numeric column; null only when there was nothing to add."""
    if not is_number(df, column):
        return F.col(column).cast("double")
    return _digits(F.col(column), lambda digits, lowest: F.concat(digits, F.lit("E"), (lowest * LIMB_DIGITS).cast("string")).cast("double"))


def whole_text(total: Column) -> Column:
    """The digits of a total of whole numbers, however many."""
    return _digits(total, lambda digits, lowest: F.when(digits == "0", digits).otherwise(F.concat(digits, F.repeat(F.lit("0"), lowest * LIMB_DIGITS))))


def whole_order(text: Column) -> Column:
    """A text that sorts as the whole number of these digits does."""
    size = F.lpad(F.length(text).cast("string"), 10, "0")
    turned = F.translate(F.concat(size, F.substr(text, F.lit(2))), "0123456789", "9876543210")
    return F.when(text.startswith("-"), F.concat(F.lit("0"), turned)).otherwise(F.concat(F.lit("1"), size, text))


#: Marks a text column that holds numbers, for sinks that tell numbers from texts.
WHOLE = {"whole_number": True}


def double_text(value: Column) -> Column:
    """Text of a double in the form result files use: ``12345678901.23456``, ``1e+18``, ``0.5``.

    The shortest digits that read back as the same double; plain from 1e-4 up to below 1e16, exponent form outside.
    """
    shorter = F.format_string("%.15e", value)
    digits = F.when(shorter.try_cast("double") == value, shorter).otherwise(F.format_string("%.16e", value))
    decimal = F.rtrim(digits.try_cast("decimal(38,22)").cast("string"), F.lit("0"))
    plain = F.when(decimal.endswith("."), F.concat(decimal, F.lit("0"))).otherwise(decimal)
    size = F.abs(value)
    return (
        F.when(size == 0, F.lit("0.0"))
        .when((size >= 1e-4) & (size < 1e16), plain)
        .when(size > 0, F.regexp_replace(digits, r"\.?0+e", "e"))
    )
