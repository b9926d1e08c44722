"""Ledger-shaped text lines rendered from the star-schema tables, bad lines among them.

They let the questions run from raw text on the given tables: every row of the table becomes a line, and what is
damaged in it follows from the row's own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgertally.sources.layouts import BLOCKS_SCHEMA, REGISTRY_SCHEMA


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _text(expression: str) -> Column:
    return F.expr(f"cast({expression} as string)")


def _line(*fields: Column | str) -> Column:
    """Fields joined by commas; constant ones are given as text and joined beforehand."""
    pieces, constant = [], ""
    for number, field in enumerate(fields):
        constant += "," if number else ""
        if isinstance(field, str):
            constant += field
        else:
            pieces += [F.lit(constant), field]
            constant = ""
    return F.concat(*pieces, F.lit(constant)).alias("value")


def transaction_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One transaction per line item: supplier pays part, price in units of 10**13 as the value."""
    epoch = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', l_shipdate)"
    cents = "cast(round(l_extendedprice * 100) as bigint)"
    return table(spark, folder, "lineitem").select(
        _line(
            "0x",
            "",
            "0x",
            F.expr("if(l_linenumber = 1 and l_returnflag = 'R', concat(l_orderkey, '.5'), string(l_orderkey))"),
            "",
            F.expr("if(l_tax = 0 and l_discount = 0, '', concat('a', l_suppkey))"),
            F.expr("if(l_tax = 0, '', concat('a', l_partkey))"),
            F.expr(
                f"""case when l_linenumber = 2 then concat({cents}, '.5e-3')
                         when l_linenumber = 3 and l_linestatus = 'O' then 'n/a'
                         else concat({cents}, '0000000000000') end"""
            ),
            F.expr("if(l_linenumber = 3 and l_returnflag = 'N', '', string(int(l_quantity)))"),
            F.expr(
                """if(l_linenumber = 4 and l_linestatus = 'F', 'nan',
                      concat(int(round(l_discount * 100)), '000000000'))"""
            ),
            F.expr("if(l_linenumber = 6, '\"0x,00\"', '0x')"),
            F.expr(
                f"""case l_linenumber when 5 then '' when 7 then concat({epoch}, '.75') else string({epoch}) end"""
            ),
            "",
            "",
            "",
        )
    )


def contract_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Parts below size 25 are contracts, the smallest of them listed twice; size 10 gives a short line."""
    mentions = F.expr("explode(sequence(1, if(p_size < 5, 2, 1)))")
    parts = table(spark, folder, "part").where("p_size < 25").withColumn("mention", mentions)
    rest = ["0x", "", "false", "false"]
    return parts.select(
        F.when(F.col("p_size") == 10, _line(F.expr("concat('a', p_partkey)"), *rest))
        .otherwise(_line(F.expr("concat('a', p_partkey)"), *rest, _text("p_size")))
        .alias("value")
    )


def scam_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every part is a scam by its brand number and type; some are listed under a second id, some lines are bad."""
    second = F.expr("explode(if(p_size < 5, array('', '9'), array('')))")
    parts = table(spark, folder, "part").withColumn("prefix", second)
    return parts.select(
        _line(
            F.expr("concat(prefix, if(p_size = 7, 'x', ''), substr(p_brand, 7))"),
            F.expr("if(p_size = 8, concat(p_name, ', the second'), p_name)"),
            "http://example.com",
            "0",
            F.col("p_type"),
            "",
            F.expr("concat('a', p_partkey)"),
            "Active",
        )
    )


def registry_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON document per part with a map of one entry: no, one or two addresses."""
    addresses = """case when p_size > 40 then array()
                        when p_size < 20 then array(concat('a', p_partkey), concat('a', p_partkey + 1))
                        else array(concat('a', p_partkey)) end"""
    entry = f"""named_struct('id', substr(p_brand, 7), 'addresses', {addresses},
                             'status', 'Active', 'category', p_type)"""
    text = F.to_json(F.struct(F.expr(f"map(string(p_partkey), {entry})").alias("result")))
    return table(spark, folder, "part").select(text.alias("value"))


def registry_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The same documents, parsed from their text."""
    parsed = F.from_json("value", REGISTRY_SCHEMA).alias("document")
    return registry_lines(spark, folder).select(parsed).select("document.*")


def block_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One block per order, mined by its customer; a header line, sizes that are no number, lines with a comma more."""
    fields = {
        "number": _text("o_orderkey"),
        "hash": F.expr("if(o_orderkey = 0, 'hash', concat('0x', lower(hex(o_orderkey))))"),
        "miner": _text("o_custkey"),
        "size": F.expr(
            "if(o_orderstatus = 'P' and o_orderpriority = '5-LOW', 'n/a', string(cast(floor(o_totalprice) as bigint)))"
        ),
        "extra_data": F.expr("if(o_orderstatus = 'P' and o_orderpriority = '1-URGENT', '0x,1', '0x')"),
    }
    return table(spark, folder, "orders").select(_line(*[fields.get(name, "") for name in BLOCKS_SCHEMA.names]))


def block_table(spark: SparkSession, folder: str) -> DataFrame:
    """One typed block per order, with hex texts of the usual lengths."""
    digest = "concat('0x', md5(string({0})), md5(string({0})))"
    values = {
        "number": "o_orderkey",
        "hash": digest.format("o_orderkey"),
        "parent_hash": digest.format("o_custkey"),
        "nonce": "concat('0x', substr(md5(string(o_orderkey)), 1, 16))",
        "sha3_uncles": digest.format("o_orderkey + 1"),
        "logs_bloom": "concat('0x', repeat(md5(string(o_orderkey)), 16))",
        "transactions_root": digest.format("o_orderkey + 2"),
        "state_root": digest.format("o_orderkey + 3"),
        "receipts_root": digest.format("o_orderkey + 4"),
        "miner": "concat('0x', substr(md5(string(o_custkey)), 1, 20), substr(md5(string(o_custkey)), 1, 20))",
        "difficulty": "o_orderkey * 1000",
        "total_difficulty": "cast(o_orderkey as decimal(38,0)) * 1000000",
        "size": "cast(floor(o_totalprice) as bigint)",
        "extra_data": "o_orderpriority",
        "gas_limit": "o_custkey * 100",
        "gas_used": "o_custkey",
        "timestamp": "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)",
        "transaction_count": "length(o_orderpriority)",
        "base_fee_per_gas": "null",
    }
    return table(spark, folder, "orders").select(
        *[F.expr(values[f.name]).cast(f.dataType).alias(f.name) for f in BLOCKS_SCHEMA.fields]
    )
