"""Inner joins of a very large fact table with a list of keys, and sums over the joined rows.

The list (contracts, scams) may name a key more than once, with the same or with other attributes, and every mention
counts: these are inner joins, not semi-joins. The list is collapsed to one row per key and attributes with its
number of mentions, ``copies``, so that repeated mentions become a factor instead of rows. The facts are collapsed to totals per key, by
partial sums before the shuffle, so that a key's share of the facts doesn't matter. Then both are joined; Spark broadcasts the list if its measured
size allows it. A key with very many attributes has its list rows dealt out by salts, and its totals given to each of them.
Nothing runs while a plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ledgertally.functions.numbers import WHOLE, as_double, sums, times
from ledgertally.operators.keyfilter import only_listed
from ledgertally.operators.ranking import finished, largest_first

#: So many attributes of a key make a salt.
SPREAD = 100_000


@dataclass(frozen=True)
class KeyList:
    """A collapsed list: ``rows`` has ``key, *attributes, copies``."""

    rows: DataFrame
    key: str
    attributes: tuple[str, ...]


def key_list(
    listed: DataFrame, key: str, listed_key: str, attributes: Sequence[str] = (), dedupe_right: bool = False
) -> KeyList:
    """Collapse a list. With ``dedupe_right`` a repeated mention counts once."""
    mentions = listed.select(F.col(listed_key).alias(key), *attributes).where(F.col(key).isNotNull())
    rows = mentions.groupBy(key, *attributes).agg(F.count("*").alias("copies"))
    if dedupe_right:
        rows = rows.withColumn("copies", F.lit(1).cast("bigint"))
    return KeyList(rows, key, tuple(attributes))


def listed_totals(
    facts: DataFrame, listed: KeyList, values: Sequence[str], also: Sequence[str] = (), spread: int = SPREAD
) -> DataFrame:
    """Totals of the facts per listed key, ``also`` and attributes.

    Gives ``key, *also, *attributes, *values, *values_rows, rows, copies``: values, rows that have each of them, and ``rows`` over the
    facts once, and how often the list has that row.
    """
    key, attributes = listed.key, listed.attributes
    columns = [key, *also, *attributes, *values, *[f"{value}_rows" for value in values], "rows", "copies"]
    facts = only_listed(facts.select(key, *also, *values), listed.rows, key)
    totals = sums(facts, [key, *also], values)
    if attributes:
        return _join_spread(totals, listed, spread).select(*columns)
    return totals.join(listed.rows, key).select(*columns)


def _join_spread(totals: DataFrame, listed: KeyList, spread: int) -> DataFrame:
    """Join on key and salt. Only keys of over ``spread`` attributes have more than one, and there are few of those."""
    key = listed.key
    fan_outs = listed.rows.groupBy(key).agg(F.count("*").alias("fan_out")).where(F.col("fan_out") > spread)
    heavy = fan_outs.select(key, F.ceil(F.col("fan_out") / spread).cast("bigint").alias("salts"))
    one = F.lit(1).cast("bigint")
    salt = F.pmod(F.xxhash64(*listed.attributes), F.coalesce("salts", one))
    rows = listed.rows.join(heavy, key, "left").withColumn("salt", salt).drop("salts")
    salts = F.sequence(F.lit(0).cast("bigint"), F.coalesce("salts", one) - 1)
    spread_totals = totals.join(heavy, key, "left").withColumn("salt", F.explode(salts)).drop("salts")
    return spread_totals.join(rows, [key, "salt"])


def listed_sums(
    facts: DataFrame, listed: KeyList, by: Sequence[str], values: Sequence[str], spread: int = SPREAD
) -> DataFrame:
    """Sums over the joined rows, every mention counted, grouped by columns of the facts or attributes of the list.

    Gives ``*by, *values, *values_rows, rows``; the values as doubles, ``value_rows`` without the rows whose value is null.
    """
    also = [name for name in by if name not in listed.attributes and name != listed.key]
    totals = listed_totals(facts, listed, values, also, spread)
    counts = [*[f"{value}_rows" for value in values], "rows"]
    weighted = totals.select(
        *by,
        *[times(totals, value, F.col("copies")).alias(value) for value in values],
        *[(F.col(count) * F.col("copies")).alias(f"{count}_weighted") for count in counts],
    )
    weights = [f"{count}_weighted" for count in counts]
    summed = sums(weighted, by, [*values, *weights])
    return summed.select(
        *by, *[as_double(summed, value).alias(value) for value in values], *[F.col(w).alias(c) for w, c in zip(weights, counts)]
    )


def top_listed(totals: DataFrame, keys: Sequence[str], value: str, k: int = 10, whole: bool = False) -> DataFrame:
    """The k largest joined rows. A key named n times is n rows, but no more than k of them can be in the result."""
    totals = totals.withColumn(value, finished(totals, value, whole).alias(value, metadata=WHOLE if whole else {}))
    order = [largest_first(totals, value), *keys]
    ranked = totals.orderBy(*order).limit(k)
    repeated = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("copies", F.lit(k)))))
    return repeated.orderBy(*order).limit(k).select(*keys, value)
