"""Wider questions about a ledger: several results from one pass, rings of traders, contract types, popular contracts and their gas.

As in ``questions`` every function takes split text fields and applies the question's own checks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ledgertally.functions.checks import is_float
from ledgertally.functions.numbers import as_double, number, sums, times
from ledgertally.operators.keyfilter import may_be_listed, only_listed
from ledgertally.operators.matching import key_list, listed_totals
from ledgertally.operators.monthly import MONTH, in_month_order, labelled, with_month
from ledgertally.operators.rings import rings
from ledgertally.operators.sketches import merged_sketches, quantile_sketches, with_quantiles
from ledgertally.plans.questions import TIME, TOP_ROWS, top_contracts
from ledgertally.sources.lines import well_formed
from ledgertally.sources.scratch import stored

GAS_PRICE, CONTRACT_GAS = "gas price", "contract gas"


def monthly_activity(transactions: DataFrame, chronological: bool = False, limit: int | None = None) -> DataFrame:
    """Transactions per month and their mean value, from one pass; the mean leaves out transactions without a readable value."""
    valid = well_formed(transactions, ints=[TIME])
    dated = with_month(valid.select(TIME, number(F.when(is_float(F.col("value")), F.col("value"))).alias("value")), TIME)
    summed = sums(dated, [MONTH], ["value"])
    mean = as_double(summed, "value") / F.nullif(F.col("value_rows"), F.lit(0))
    return in_month_order(summed.select(labelled(summed), F.col("rows").alias("transactions"), mean.alias("average")), chronological, limit)


def monthly_gas(transactions: DataFrame, contracts: DataFrame) -> DataFrame:
    """Mean gas price per month, and mean gas per month over the calls of contracts, from one pass.

    Each row feeds the questions whose checks it passes: the price for all rows of a month, the gas under its contract's key, which the list is joined to as totals.
    """
    valid = with_month(well_formed(transactions, ints=[TIME], floats=["gas_price"]).select(TIME, "to_address", "gas", "gas_price"), TIME)
    listed = key_list(contracts, "to_address", "address")
    entry = lambda question, key, text: F.struct(F.lit(question).alias("question"), key.alias("to_address"), text.alias("text"))
    called = is_float(F.col("gas")) & may_be_listed(listed.rows, "to_address")
    entries = F.array(entry(GAS_PRICE, F.lit(None).cast("string"), F.col("gas_price")), F.when(called, entry(CONTRACT_GAS, F.col("to_address"), F.col("gas"))))
    fed = valid.select(MONTH, F.explode(entries).alias("entry")).where(F.col("entry").isNotNull())
    fed = fed.select(MONTH, "entry.question", "entry.to_address", number(F.col("entry.text")).alias("amount"))
    totals = sums(fed, ["question", "to_address", MONTH], ["amount"]).join(listed.rows, "to_address", "left")
    copies = F.when(F.col("question") == GAS_PRICE, F.lit(1).cast("bigint")).otherwise(F.col("copies"))
    known = totals.withColumn("copies", copies).where(F.col("copies").isNotNull())
    weighted = known.select("question", MONTH, times(known, "amount", F.col("copies")).alias("amount"), (F.col("amount_rows") * F.col("copies")).alias("calls"))
    summed = sums(weighted, ["question", MONTH], ["amount", "calls"])
    return summed.select("question", labelled(summed), (as_double(summed, "amount") / F.col("calls")).alias("average")).orderBy("question", "month")


def popular_contract_gas(transactions: DataFrame, contracts: DataFrame, k: int = TOP_ROWS) -> DataFrame:
    """Per month the mean gas of contract calls, and of calls of the k contracts that received most: ``month, average, calls, popular_average, popular_calls``.

    The k keys come back from their own question and mark the totals that both means are made of, so the two are over the same calls.
    """
    popular = top_contracts(transactions, contracts, k).select(F.col("address").alias("to_address")).distinct()
    valid = well_formed(transactions, ints=[TIME], floats=["gas_price", "gas"])
    calls = with_month(valid.select(TIME, "to_address", number(F.col("gas")).alias("gas")), TIME)
    totals = listed_totals(calls, key_list(contracts, "to_address", "address"), ["gas"], [MONTH])
    marked = totals.join(popular.withColumn("popular", F.lit(True)), "to_address", "left")
    gas, counted = times(totals, "gas", F.col("copies")), F.col("gas_rows") * F.col("copies")
    parts = marked.select(MONTH, gas.alias("gas"), counted.alias("calls"), F.when(F.col("popular"), gas).alias("popular_gas"), F.when(F.col("popular"), counted).alias("popular_calls"))
    summed = sums(parts, [MONTH], ["gas", "calls", "popular_gas", "popular_calls"])
    means = {"average": ("gas", "calls"), "popular_average": ("popular_gas", "popular_calls")}
    averages = {title: as_double(summed, total) / F.nullif(F.col(count), F.lit(0)) for title, (total, count) in means.items()}
    return in_month_order(summed.select(labelled(summed), averages["average"].alias("average"), "calls", averages["popular_average"].alias("popular_average"), F.coalesce("popular_calls", F.lit(0)).alias("popular_calls")))


def trade_rings(transactions: DataFrame) -> DataFrame:
    """Rings of traders, in which value can come back to each member through the others: wash-trade candidates of any number of parties.

    ``ring`` (its smallest address), ``traders``, ``pairs`` (of members with transfers from one to the other), ``transfers`` and ``total`` value within the ring, the largest first.
    """
    valid = well_formed(transactions, floats=["value"]).where("from_address <> to_address and from_address <> '' and to_address <> ''")
    moved = sums(valid.select("from_address", "to_address", number(F.col("value")).alias("value")), ["from_address", "to_address"], ["value"])
    moved = stored(moved, "moved")
    found = stored(rings(moved.select(F.col("from_address").alias("u"), F.col("to_address").alias("v"))), "rings")
    of = {name: found.select(F.col("node").alias(f"{name}_address"), F.col("ring").alias(name)) for name in ("from", "to")}
    # Only transfers of members meet the members.
    inside = only_listed(only_listed(moved, of["from"], "from_address"), of["to"], "to_address")
    inside = inside.join(of["from"], "from_address").join(of["to"], "to_address").where("`from` = `to`")
    weighed = inside.select(F.col("from").alias("ring"), F.lit(1).cast("bigint").alias("pairs"), F.col("rows").alias("transfers"), "value")
    totals = sums(weighed, ["ring"], ["pairs", "transfers", "value"])
    sizes = found.groupBy("ring").agg(F.count("*").alias("traders"))
    joined = totals.join(sizes, "ring")
    return joined.select("ring", "traders", "pairs", "transfers", as_double(joined, "value").alias("total")).orderBy(F.desc("total"), "ring")


@dataclass(frozen=True)
class TypeRules:
    """What tells contract types apart, tried in this order. ``idle``: no more calls than this. ``private``: no more senders than this. ``even``: the upper quartile of the values
    is at most so many times the lower one. ``peaked``: the 95th percentile is at least so many times the median."""

    idle: int = 10
    private: int = 2
    even: float = 2.0
    peaked: float = 2.0


#: Groups that the calls of a contract are dealt to.
PARTS = 16
QUANTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}


def contract_features(transactions: DataFrame, contracts: DataFrame) -> DataFrame:
    """Of each called contract ``address, calls, senders, q25, median, q75, q95``: quantiles of the values received, as sketches give them (see ``operators.sketches``)."""
    valid = well_formed(transactions, floats=["value"]).select(F.col("to_address").alias("address"), "from_address", F.col("value").try_cast("double").alias("value"))
    listed = key_list(contracts, "address", "address")
    calls = only_listed(valid, listed.rows, "address")
    # A contract's calls are dealt out by sender, so that one with a third of all calls is many groups; their sketches are merged then.
    dealt = calls.withColumn("part", F.pmod(F.xxhash64("from_address"), F.lit(PARTS)))
    sketches = merged_sketches(quantile_sketches(dealt, ["address", "part"], "value"), ["address"])
    counts = calls.groupBy("address", "from_address").agg(F.count("*").alias("calls")).groupBy("address").agg(F.sum("calls").alias("calls"), F.count("*").alias("senders"))
    rows = counts.join(sketches, "address").join(listed.rows.select("address"), "address", "left_semi")
    return with_quantiles(rows, QUANTILES)


def contract_types(transactions: DataFrame, contracts: DataFrame, rules: TypeRules = TypeRules()) -> DataFrame:
    """How many contracts are of each type, the most frequent first: ``contract_type, contracts, calls``."""
    features = contract_features(transactions, contracts)
    kind = (
        F.when(F.col("calls") <= rules.idle, "idle")
        .when(F.col("senders") <= rules.private, "private")
        .when(F.col("q75") <= rules.even * F.col("q25"), "even")
        .when(F.col("q95") >= rules.peaked * F.col("median"), "peaked")
        .otherwise("mixed")
    )
    counted = features.groupBy(kind.alias("contract_type")).agg(F.count("*").alias("contracts"), F.sum("calls").alias("calls"))
    return counted.orderBy(F.desc("contracts"), "contract_type")
