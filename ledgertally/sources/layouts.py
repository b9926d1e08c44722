"""Field positions and schemas of the ledger dumps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Layout:
    """A comma-separated line: how many fields it must have and which of them are used."""

    arity: int
    columns: dict[str, int]


# Field counts and zero-based positions in the dumps.
TRANSACTIONS = Layout(
    arity=15,
    columns={
        "block_number": 3,
        "from_address": 5,
        "to_address": 6,
        "value": 7,
        "gas": 8,
        "gas_price": 9,
        "block_timestamp": 11,
    },
)
CONTRACTS = Layout(arity=6, columns={"address": 0})
BLOCKS = Layout(arity=19, columns={"hash": 1, "miner": 9, "size": 12})
SCAMS = Layout(arity=8, columns={"id": 0, "category": 4, "address": 6})

# The block columns in file order. Numbers get number types, so that a length is the
# length of the number and not of its padding; hex texts stay texts.
BLOCKS_SCHEMA = T.StructType(
    [
        T.StructField("number", T.LongType()),
        T.StructField("hash", T.StringType()),
        T.StructField("parent_hash", T.StringType()),
        T.StructField("nonce", T.StringType()),
        T.StructField("sha3_uncles", T.StringType()),
        T.StructField("logs_bloom", T.StringType()),
        T.StructField("transactions_root", T.StringType()),
        T.StructField("state_root", T.StringType()),
        T.StructField("receipts_root", T.StringType()),
        T.StructField("miner", T.StringType()),
        T.StructField("difficulty", T.DecimalType(38, 0)),
        T.StructField("total_difficulty", T.DecimalType(38, 0)),
        T.StructField("size", T.LongType()),
        T.StructField("extra_data", T.StringType()),
        T.StructField("gas_limit", T.LongType()),
        T.StructField("gas_used", T.LongType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("transaction_count", T.LongType()),
        T.StructField("base_fee_per_gas", T.LongType()),
    ]
)

# The block columns a working currency could do without.
DROPPABLE_BLOCK_COLUMNS = ["logs_bloom", "sha3_uncles", "transactions_root", "state_root", "receipts_root"]

REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField(
            "result",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("addresses", T.ArrayType(T.StringType())),
                        T.StructField("status", T.StringType()),
                        T.StructField("category", T.StringType()),
                    ]
                ),
            ),
        )
    ]
)
