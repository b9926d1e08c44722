"""The questions about a ledger, from split text fields (or staged parquet of them) to a result.

Every function takes DataFrames as ``read_fields`` gives them and applies the question's own validity checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgertally.functions.checks import is_int
from ledgertally.functions.numbers import number
from ledgertally.operators.matching import key_list, listed_sums, listed_totals, top_listed
from ledgertally.operators.monthly import (
    MONTH,
    average_by_month,
    count_by_month,
    in_month_order,
    labelled,
    with_month,
)
from ledgertally.operators.ranking import sum_by, sum_top_k, top_k
from ledgertally.operators.registry import registry_addresses
from ledgertally.operators.storage import column_bytes, column_shares
from ledgertally.operators.transfers import self_pairs
from ledgertally.sources.layouts import DROPPABLE_BLOCK_COLUMNS
from ledgertally.sources.lines import well_formed, without_header

# How many rows the published top lists keep.
TOP_ROWS = 10
TOP_SCAMS = 15
BAD_SIZE_KEY = "0"
BAD_SIZE_VALUE = "1"

TIME = "block_timestamp"


def monthly_transactions(
    transactions: DataFrame, chronological: bool = False, limit: int | None = None
) -> DataFrame:
    """Transactions per month."""
    valid = well_formed(transactions, ints=[TIME])
    return in_month_order(count_by_month(valid, TIME), chronological, limit)


def monthly_value(
    transactions: DataFrame, chronological: bool = False, limit: int | None = None
) -> DataFrame:
    """Mean transaction value per month."""
    valid = well_formed(transactions, ints=[TIME], floats=["value"])
    valued = valid.select(TIME, number(F.col("value")).alias("value"))
    return in_month_order(average_by_month(valued, TIME, "value"), chronological, limit)


def top_contracts(transactions: DataFrame, contracts: DataFrame, k: int = TOP_ROWS) -> DataFrame:
    """Contracts that received most, exact to the last wei, as texts of digits."""
    valid = well_formed(transactions, ints=["block_number", "value"])
    received = valid.select(F.col("to_address").alias("address"), number(F.col("value")).alias("value"))
    listed = key_list(contracts, "address", "address")
    return top_listed(listed_totals(received, listed, ["value"]), ["address"], "value", k, whole=True)


def miner_sizes(blocks: DataFrame) -> DataFrame:
    """Size mined per miner, as a text of digits. A block whose size is no integer counts as 1 for the key '0'."""
    body = without_header(blocks, "hash", "hash")
    sized = is_int(F.col("size"))
    mined = body.select(
        F.when(sized, F.col("miner")).otherwise(BAD_SIZE_KEY).alias("miner"),
        number(F.when(sized, F.col("size")).otherwise(BAD_SIZE_VALUE)).alias("size"),
    )
    return sum_by(mined, ["miner"], "size", name="size", whole=True)


def top_miners(blocks: DataFrame, k: int = TOP_ROWS) -> DataFrame:
    """Miners by the size of their blocks."""
    return top_k(miner_sizes(blocks), "size", ["miner"], k)


def monthly_gas_price(
    transactions: DataFrame, chronological: bool = False, limit: int | None = None
) -> DataFrame:
    """Mean gas price per month."""
    valid = well_formed(transactions, ints=[TIME], floats=["gas_price"])
    priced = valid.select(TIME, number(F.col("gas_price")).alias("gas_price"))
    return in_month_order(average_by_month(priced, TIME, "gas_price"), chronological, limit)


def monthly_contract_gas(
    transactions: DataFrame, contracts: DataFrame, chronological: bool = False, limit: int | None = None
) -> DataFrame:
    """Mean gas per month over the calls of contracts."""
    valid = well_formed(transactions, ints=[TIME], floats=["gas_price", "gas"])
    calls = with_month(valid.select(TIME, "to_address", number(F.col("gas")).alias("gas")), TIME)
    sums = listed_sums(calls, key_list(contracts, "to_address", "address"), [MONTH], ["gas"])
    averages = sums.select(labelled(sums), (F.col("gas") / F.col("gas_rows")).alias("average"))
    return in_month_order(averages, chronological, limit)


def top_scams(transactions: DataFrame, scams: DataFrame, k: int = TOP_SCAMS) -> DataFrame:
    """Scams that received most, with their category."""
    received = _received(well_formed(transactions, ints=[TIME], floats=["value"]))
    listed = key_list(well_formed(scams, ints=["id"]), "to_address", "address", ["id", "category"])
    sums = listed_sums(received, listed, ["id", "category"], ["value"])
    totals = sums.select("id", "category", F.col("value").alias("total"))
    return top_k(totals, "total", ["id", "category"], k)


def monthly_scam_value(transactions: DataFrame, registry: DataFrame) -> DataFrame:
    """Value received per month and scam category, in no order. ``registry`` holds the JSON documents."""
    received = with_month(_received(well_formed(transactions, floats=["value", TIME])), TIME)
    listed = key_list(registry_addresses(registry), "to_address", "address", ["category"])
    sums = listed_sums(received, listed, [MONTH, "category"], ["value"])
    return sums.select(labelled(sums, "-"), "category", F.col("value").alias("total"))


def top_self_transfers(transactions: DataFrame, k: int = TOP_ROWS) -> DataFrame:
    """Addresses that moved most value to themselves."""
    valid = self_pairs(well_formed(transactions, floats=["value"]), "from_address", "to_address")
    moved = valid.select("from_address", "to_address", number(F.col("value")).alias("value"))
    return sum_top_k(moved, ["from_address", "to_address"], "value", k)


def droppable_block_bytes(blocks: DataFrame) -> DataFrame:
    """Bytes that go away with the columns a working currency could do without. ``blocks`` is the typed table."""
    return column_bytes(blocks, DROPPABLE_BLOCK_COLUMNS)


def block_column_shares(blocks: DataFrame) -> DataFrame:
    """Bytes and percentage of every block column."""
    return column_shares(blocks)


def _received(valid: DataFrame) -> DataFrame:
    return valid.select(TIME, "to_address", number(F.col("value")).alias("value"))

