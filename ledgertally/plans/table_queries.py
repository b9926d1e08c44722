"""The operators and questions over the star-schema tables, one function per registered query."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgertally.functions.checks import is_float, is_int
from ledgertally.functions.texts import joined
from ledgertally.operators.matching import key_list, listed_sums, listed_totals, top_listed
from ledgertally.operators.monthly import (
    MONTH,
    average_by_month,
    count_by_month,
    in_month_order,
    labelled,
    with_month,
)
from ledgertally.operators.ranking import sum_top_k, top_k
from ledgertally.operators.registry import registry_addresses
from ledgertally.operators.storage import column_bytes, column_shares
from ledgertally.operators.transfers import self_pairs
from ledgertally.jobs import read_job_result, run_job
from ledgertally.plans import ledger_lines as lines
from ledgertally.plans import questions, studies
from ledgertally.plans.ledger_lines import table
from ledgertally.sinks.results import (
    reheader,
    report_csv,
    write_csv,
    write_json,
    write_json_array,
    write_json_map,
    write_rendered_array,
)
from ledgertally.sources.layouts import BLOCKS, BLOCKS_SCHEMA, CONTRACTS, REGISTRY_SCHEMA, SCAMS, TRANSACTIONS
from ledgertally.sources.lines import read_fields, read_staged, split_fields, stage_fields
from ledgertally.sources.results import read_pairs, read_rendered, read_result_csv, split_rendered
from ledgertally.sources.registry_scan import read_registry_entries
from ledgertally.sources.scratch import scratch_folder
from ledgertally.sources.tables import read_csv, read_registry

MONEY = "decimal(18,2)"


def _money(df: DataFrame, *names: str) -> DataFrame:
    """Prices as exact decimals, so that sums do not depend on the order of rows."""
    return df.withColumns({name: F.col(name).cast(MONEY) for name in names})


def _lineitem(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(*names)


def _small_parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").where("p_size < 25")


# --- operators on typed tables ---------------------------------------------------------------------


def monthly_count(spark: SparkSession, folder: str) -> DataFrame:
    return in_month_order(count_by_month(table(spark, folder, "orders"), "o_orderdate", "orders"))


def first_months(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten months of the counts, by time."""
    counts = count_by_month(table(spark, folder, "orders"), "o_orderdate", "orders")
    return in_month_order(counts, chronological=True, limit=10)


def monthly_avg(spark: SparkSession, folder: str) -> DataFrame:
    return average_by_month(_money(table(spark, folder, "orders"), "o_totalprice"), "o_orderdate", "o_totalprice")


def monthly_avg_sorted(spark: SparkSession, folder: str) -> DataFrame:
    items = _money(_lineitem(spark, folder, "l_shipdate", "l_extendedprice"), "l_extendedprice")
    averages = average_by_month(items, "l_shipdate", "l_extendedprice")
    return in_month_order(averages, chronological=True)


def epoch_month(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem").select((F.col("l_orderkey") * 10000).alias("seconds"))
    counted = with_month(items, "seconds").groupBy(MONTH).agg(F.count("*").alias("n"))
    return counted.select(labelled(counted, "-"), "n")


def topk_sum_join(spark: SparkSession, folder: str) -> DataFrame:
    items = _money(_lineitem(spark, folder, "l_partkey", "l_extendedprice"), "l_extendedprice")
    listed = key_list(_small_parts(spark, folder), "l_partkey", "p_partkey")
    top = top_listed(listed_totals(items, listed, ["l_extendedprice"]), ["l_partkey"], "l_extendedprice", 10)
    return top.withColumnRenamed("l_extendedprice", "total")


def topk_sum(spark: SparkSession, folder: str) -> DataFrame:
    items = _lineitem(spark, folder, "l_suppkey", "l_quantity").withColumn(
        "l_quantity", F.col("l_quantity").cast("bigint")
    )
    return sum_top_k(items, ["l_suppkey"], "l_quantity", 10, name="quantity")


def joined_monthly_avg(spark: SparkSession, folder: str) -> DataFrame:
    items = _money(_lineitem(spark, folder, "l_partkey", "l_shipdate", "l_quantity"), "l_quantity")
    listed = key_list(_small_parts(spark, folder), "l_partkey", "p_partkey")
    sums = listed_sums(with_month(items, "l_shipdate"), listed, [MONTH], ["l_quantity"])
    return in_month_order(sums.select(labelled(sums), (F.col("l_quantity") / F.col("l_quantity_rows")).alias("average")))


def topk_composite(spark: SparkSession, folder: str) -> DataFrame:
    items = _money(_lineitem(spark, folder, "l_partkey", "l_extendedprice"), "l_extendedprice")
    listed = key_list(table(spark, folder, "part"), "l_partkey", "p_partkey", ["p_brand", "p_type"])
    sums = listed_sums(items, listed, ["p_brand", "p_type"], ["l_extendedprice"])
    totals = sums.select("p_brand", "p_type", F.col("l_extendedprice").alias("total"))
    return top_k(totals, "total", ["p_brand", "p_type"], 15)


def registry_month_sum(spark: SparkSession, folder: str) -> DataFrame:
    """A registry of suppliers by region, as JSON text and back, joined with the line items."""
    places = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    entry = F.struct(
        F.col("s_suppkey").cast("string").alias("id"),
        F.array(F.col("s_suppkey").cast("string")).alias("addresses"),
        F.lit("Active").alias("status"),
        F.col("r_name").alias("category"),
    )
    suppliers = table(spark, folder, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    text = suppliers.select(F.to_json(F.struct(F.create_map("s_name", entry).alias("result"))).alias("value"))
    documents = text.select(F.from_json("value", REGISTRY_SCHEMA).alias("d")).select("d.*")
    items = _money(_lineitem(spark, folder, "l_suppkey", "l_shipdate", "l_extendedprice"), "l_extendedprice")
    keyed = with_month(items, "l_shipdate").withColumn("l_suppkey", F.col("l_suppkey").cast("string"))
    listed = key_list(registry_addresses(documents), "l_suppkey", "address", ["category"])
    sums = listed_sums(keyed, listed, [MONTH, "category"], ["l_extendedprice"])
    return sums.select(labelled(sums, "-"), "category", F.col("l_extendedprice").alias("total"))


def json_map_explode(spark: SparkSession, folder: str) -> DataFrame:
    entries = table(spark, folder, "events").select(
        "event_type", F.explode(F.from_json("props", "map<string,bigint>")).alias("name", "number")
    )
    return entries.groupBy("event_type", "name").agg(F.count("*").alias("n"), F.sum("number").alias("total"))


def array_explode(spark: SparkSession, folder: str) -> DataFrame:
    elements = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("pos", "element"))
    exact = elements.withColumn("element", F.col("element").cast("double"))
    return exact.groupBy("label", "pos").agg(
        F.count("*").alias("n"),
        F.min("element").alias("smallest"),
        F.max("element").alias("largest"),
        F.sum(F.floor(F.col("element") * 1000000)).alias("millionths"),
    )


def self_pair_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Trade inside one nation: customer nation equal to supplier nation.

    Line items become sums per order and supplier nation before they meet the orders: one shuffle of sums, and an order has few nations.
    """
    items = _money(_lineitem(spark, folder, "l_orderkey", "l_suppkey", "l_extendedprice"), "l_extendedprice")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    sums = items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey", "s_nationkey").agg(F.sum("l_extendedprice").alias("part"))
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    buyers = table(spark, folder, "orders").select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    own = self_pairs(sums.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")), "c_nationkey", "s_nationkey")
    top = sum_top_k(own, ["c_nationkey", "s_nationkey"], "part", 10)
    return top.withColumn("total", F.col("total").cast("decimal(28,2)"))


def valid_lines(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines each question's checks let through, all counted in one pass."""
    fields = split_fields(lines.transaction_lines(spark, folder), TRANSACTIONS)
    checks = {
        "int_time": is_int(F.col("block_timestamp")),
        "int_block": is_int(F.col("block_number")),
        "float_time": is_float(F.col("block_timestamp")),
        "float_value": is_float(F.col("value")),
        "float_price": is_float(F.col("gas_price")),
    }
    rules = {
        "monthly transactions": ["int_time"],
        "monthly value": ["int_time", "float_value"],
        "top contracts": ["int_block"],
        "gas": ["float_price", "float_time"],
        "scam value by month": ["float_value", "float_time"],
        "self transfers": ["float_value"],
    }
    # One-element explode: each check is made once, whatever number of rules uses it.
    passed = fields.select(F.explode(F.array(F.struct(*[check.alias(name) for name, check in checks.items()]))).alias("passed"))
    counts = [F.count_if(reduce(and_, [F.col("passed")[name] for name in names])) for names in rules.values()]
    one_row = passed.agg(*[count.alias(f"n{i}") for i, count in enumerate(counts)])
    pairs = [part for i, rule in enumerate(rules) for part in (F.lit(rule), F.col(f"n{i}"))]
    return one_row.select(F.stack(F.lit(len(rules)), *pairs).alias("rule", "lines"))


def header_lines(spark: SparkSession, folder: str) -> DataFrame:
    sizes = questions.miner_sizes(split_fields(lines.block_lines(spark, folder), BLOCKS))
    return sizes.withColumn("size", F.col("size").cast("bigint"))


def column_bytes_query(spark: SparkSession, folder: str) -> DataFrame:
    return column_bytes(table(spark, folder, "customer"))


def column_percent(spark: SparkSession, folder: str) -> DataFrame:
    return column_shares(table(spark, folder, "customer").withColumn("nothing", F.lit(None).cast("string")))


def render_pairs(spark: SparkSession, folder: str) -> DataFrame:
    counts = count_by_month(table(spark, folder, "orders"), "o_orderdate", "orders")
    texts = counts.select(joined(F.col("month"), F.col("orders").cast("string")).alias("text"))
    parts = texts.select("text", *split_rendered(F.col("text"), ["month", "orders"]))
    return parts.withColumn("orders", F.col("orders").cast("bigint"))


def pairs_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per (month, status) as a JSON array of nested pairs, read back and flattened."""
    dated = with_month(table(spark, folder, "orders").select("o_orderdate", "o_orderstatus"), "o_orderdate")
    counts = dated.groupBy(MONTH, "o_orderstatus").agg(F.count("*").alias("orders"))
    path = scratch_folder(spark, "pairs")
    write_json_array(counts.select(labelled(counts, "-"), "o_orderstatus", "orders"), path)
    back = read_pairs(spark, path, ["month", "status", "orders"])
    return back.withColumn("orders", F.col("orders").cast("bigint"))


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The customers as CSV with header, read back with inferred types under new names."""
    path = scratch_folder(spark, "customers")
    write_csv(table(spark, folder, "customer"), path)
    back = read_csv(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))
    return reheader(
        back, ["key", "name", "segment", "balance"], ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"]
    )


def json_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as JSON lines, read back with a schema."""
    path = scratch_folder(spark, "parts")
    parts = table(spark, folder, "part")
    write_json(parts, path)
    return spark.read.schema(parts.schema).json(path)


def staged_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Transaction fields staged as parquet once, then two columns of it read for one question."""
    path = scratch_folder(spark, "transactions")
    stage_fields(split_fields(lines.transaction_lines(spark, folder), TRANSACTIONS), path)
    return questions.monthly_value(read_staged(spark, path, TRANSACTIONS))


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions written as text files and read as any dump is."""
    path = scratch_folder(spark, "lines")
    lines.transaction_lines(spark, folder).write.text(path)
    return questions.monthly_gas_price(read_fields(spark, path, TRANSACTIONS))


def registry_file(spark: SparkSession, folder: str) -> DataFrame:
    """The registry as JSON files, read with its schema: addresses per category."""
    path = scratch_folder(spark, "registry")
    lines.registry_lines(spark, folder).write.text(path)
    listed = registry_addresses(read_registry(spark, path))
    return listed.groupBy("category", "status").agg(F.count("*").alias("addresses"))


def registry_document(spark: SparkSession, folder: str) -> DataFrame:
    """The whole registry as one document in one file, read by many tasks."""
    path = scratch_folder(spark, "document")
    entries = lines.registry_documents(spark, folder).select(F.explode("result").alias("key", "entry"))
    write_json_map(entries.select("key", F.to_json("entry").alias("entry")), path, '{"success": true, "result": {', "}}", single=True)
    listed = registry_addresses(read_registry_entries(spark, path))
    return listed.groupBy("category", "status").agg(F.count("*").alias("addresses"))


def block_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The block table as CSV with header, read back with its schema."""
    path = scratch_folder(spark, "blocks")
    write_csv(lines.block_table(spark, folder), path)
    return questions.block_column_shares(read_csv(spark, path, BLOCKS_SCHEMA))


def block_csv_inferred(spark: SparkSession, folder: str) -> DataFrame:
    """The same with types inferred from the files."""
    path = scratch_folder(spark, "blocks")
    write_csv(lines.block_table(spark, folder), path)
    return questions.block_column_shares(read_csv(spark, path))


def job_result(spark: SparkSession, folder: str) -> DataFrame:
    """A job as a user runs it, on text files, and its result read from the folder of the run."""
    base = scratch_folder(spark, "job")
    lines.transaction_lines(spark, folder).write.text(f"{base}/dump")
    found = run_job(spark, "monthly-transactions", {"transactions": f"{base}/dump"}, f"{base}/results")
    back = read_job_result(spark, "monthly-transactions", found)
    return back.select(F.col("Date").alias("month"), F.col("Value").cast("bigint").alias("transactions"))


def rendered_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per month as an array of joined texts, read back as two columns."""
    path = scratch_folder(spark, "rendered")
    write_rendered_array(count_by_month(table(spark, folder, "orders"), "o_orderdate", "orders"), path)
    back = read_rendered(spark, path, ["month", "orders"])
    return back.withColumn("orders", F.col("orders").cast("bigint"))


def report_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The largest suppliers as a JSON array, turned into a CSV report, read back under other names."""
    base = scratch_folder(spark, "report")
    write_json_array(topk_sum(spark, folder), f"{base}/json")
    report_csv(spark, f"{base}/json", f"{base}/csv", ["Supplier", "Quantity"])
    back = read_result_csv(spark, f"{base}/csv", ["supplier", "quantity"])
    return back.select(F.col("supplier").cast("bigint"), F.col("quantity").cast("bigint"))


def preview(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey").limit(10)


# --- whole questions, from text lines ---------------------------------------------------------------


def _transactions(spark: SparkSession, folder: str) -> DataFrame:
    return split_fields(lines.transaction_lines(spark, folder), TRANSACTIONS)


def _contracts(spark: SparkSession, folder: str) -> DataFrame:
    return split_fields(lines.contract_lines(spark, folder), CONTRACTS)


def ledger_monthly_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return questions.monthly_transactions(_transactions(spark, folder))


def ledger_monthly_value(spark: SparkSession, folder: str) -> DataFrame:
    return questions.monthly_value(_transactions(spark, folder))


def ledger_top_contracts(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts beyond 64 bits, given as digits."""
    top = questions.top_contracts(_transactions(spark, folder), _contracts(spark, folder))
    return top.withColumn("value", F.col("value").cast("string"))


def ledger_top_miners(spark: SparkSession, folder: str) -> DataFrame:
    top = questions.top_miners(split_fields(lines.block_lines(spark, folder), BLOCKS))
    return top.withColumn("size", F.col("size").cast("bigint"))


def ledger_gas_price(spark: SparkSession, folder: str) -> DataFrame:
    return questions.monthly_gas_price(_transactions(spark, folder))


def ledger_contract_gas(spark: SparkSession, folder: str) -> DataFrame:
    return questions.monthly_contract_gas(_transactions(spark, folder), _contracts(spark, folder))


def ledger_top_scams(spark: SparkSession, folder: str) -> DataFrame:
    return questions.top_scams(
        _transactions(spark, folder), split_fields(lines.scam_lines(spark, folder), SCAMS)
    )


def ledger_scam_months(spark: SparkSession, folder: str) -> DataFrame:
    return questions.monthly_scam_value(_transactions(spark, folder), lines.registry_documents(spark, folder))


def ledger_self_transfers(spark: SparkSession, folder: str) -> DataFrame:
    return questions.top_self_transfers(_transactions(spark, folder))


def ledger_block_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return questions.droppable_block_bytes(lines.block_table(spark, folder))


def ledger_block_shares(spark: SparkSession, folder: str) -> DataFrame:
    return questions.block_column_shares(lines.block_table(spark, folder))


# --- wider questions, from text lines -----------------------------------------------------------------


def ledger_monthly_activity(spark: SparkSession, folder: str) -> DataFrame:
    return studies.monthly_activity(_transactions(spark, folder))


def ledger_monthly_gas(spark: SparkSession, folder: str) -> DataFrame:
    return studies.monthly_gas(_transactions(spark, folder), _contracts(spark, folder))


def ledger_popular_gas(spark: SparkSession, folder: str) -> DataFrame:
    return studies.popular_contract_gas(_transactions(spark, folder), _contracts(spark, folder))


def ledger_rings(spark: SparkSession, folder: str) -> DataFrame:
    return studies.trade_rings(_transactions(spark, folder))


def ledger_contract_features(spark: SparkSession, folder: str) -> DataFrame:
    return studies.contract_features(_transactions(spark, folder), _contracts(spark, folder))


def ledger_contract_types(spark: SparkSession, folder: str) -> DataFrame:
    return studies.contract_types(_transactions(spark, folder), _contracts(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "monthly_count": monthly_count,
    "first_months": first_months,
    "monthly_avg": monthly_avg,
    "monthly_avg_sorted": monthly_avg_sorted,
    "epoch_month": epoch_month,
    "topk_sum_join": topk_sum_join,
    "topk_sum": topk_sum,
    "joined_monthly_avg": joined_monthly_avg,
    "topk_composite": topk_composite,
    "registry_month_sum": registry_month_sum,
    "json_map_explode": json_map_explode,
    "array_explode": array_explode,
    "self_pair_topk": self_pair_topk,
    "valid_lines": valid_lines,
    "header_lines": header_lines,
    "column_bytes": column_bytes_query,
    "column_percent": column_percent,
    "render_pairs": render_pairs,
    "pairs_roundtrip": pairs_roundtrip,
    "csv_roundtrip": csv_roundtrip,
    "json_roundtrip": json_roundtrip,
    "staged_fields": staged_fields,
    "text_files": text_files,
    "registry_file": registry_file,
    "registry_document": registry_document,
    "block_csv": block_csv,
    "block_csv_inferred": block_csv_inferred,
    "job_result": job_result,
    "rendered_roundtrip": rendered_roundtrip,
    "report_roundtrip": report_roundtrip,
    "preview": preview,
    "ledger_monthly_transactions": ledger_monthly_transactions,
    "ledger_monthly_value": ledger_monthly_value,
    "ledger_top_contracts": ledger_top_contracts,
    "ledger_top_miners": ledger_top_miners,
    "ledger_gas_price": ledger_gas_price,
    "ledger_contract_gas": ledger_contract_gas,
    "ledger_top_scams": ledger_top_scams,
    "ledger_scam_months": ledger_scam_months,
    "ledger_self_transfers": ledger_self_transfers,
    "ledger_block_bytes": ledger_block_bytes,
    "ledger_block_shares": ledger_block_shares,
    "ledger_monthly_activity": ledger_monthly_activity,
    "ledger_monthly_gas": ledger_monthly_gas,
    "ledger_popular_gas": ledger_popular_gas,
    "ledger_rings": ledger_rings,
    "ledger_contract_features": ledger_contract_features,
    "ledger_contract_types": ledger_contract_types,
}
