"""The same results as ``table_queries`` in plain SQL, for checking with another engine.

Nothing here goes through text lines: which lines are damaged is stated as a condition on the tables. A decimal
becomes a double by way of its text, so that the conversion is correctly rounded.
"""

from __future__ import annotations

from ledgertally.sources.layouts import DROPPABLE_BLOCK_COLUMNS

MONTH = "strftime({0}, '%m/%Y')"
DASHED = "strftime({0}, '%m-%Y')"


def _mean(value: str) -> str:
    return f"sum({value}::decimal(18,2))::varchar::double / count({value})"


def _sizes(source: str, columns: dict[str, str]) -> str:
    """One row: bytes of every column by the length of its text."""
    parts = ", ".join(
        f"coalesce((avg(length(({text})::varchar)) - 2) * 4 / 8, 0.0) * count(*) AS b{i}"
        for i, text in enumerate(columns.values())
    )
    return f"WITH sizes AS (SELECT {parts} FROM {source})"


def _column_bytes(source: str, columns: dict[str, str]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, b{i} AS size_bytes FROM sizes" for i, name in enumerate(columns)
    )
    return f"{_sizes(source, columns)} {rows}"


def _column_shares(source: str, columns: dict[str, str]) -> str:
    total = " + ".join(f"b{i}" for i in range(len(columns)))
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, b{i} AS space_saved, b{i} / ({total}) * 100 AS percentage_saved FROM sizes"
        for i, name in enumerate(columns)
    )
    return f"{_sizes(source, columns)} {rows}"


CUSTOMER = {name: name for name in ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]}

DIGEST = "'0x' || md5(({0})::varchar) || md5(({0})::varchar)"
BLOCK_COLUMNS = {
    "number": "o_orderkey",
    "hash": DIGEST.format("o_orderkey"),
    "parent_hash": DIGEST.format("o_custkey"),
    "nonce": "'0x' || substr(md5(o_orderkey::varchar), 1, 16)",
    "sha3_uncles": DIGEST.format("o_orderkey + 1"),
    "logs_bloom": "'0x' || repeat(md5(o_orderkey::varchar), 16)",
    "transactions_root": DIGEST.format("o_orderkey + 2"),
    "state_root": DIGEST.format("o_orderkey + 3"),
    "receipts_root": DIGEST.format("o_orderkey + 4"),
    "miner": "'0x' || substr(md5(o_custkey::varchar), 1, 20) || substr(md5(o_custkey::varchar), 1, 20)",
    "difficulty": "o_orderkey * 1000",
    "total_difficulty": "o_orderkey::hugeint * 1000000",
    "size": "floor(o_totalprice)::bigint",
    "extra_data": "o_orderpriority",
    "gas_limit": "o_custkey * 100",
    "gas_used": "o_custkey",
    "timestamp": "epoch(o_orderdate)::bigint",
    "transaction_count": "length(o_orderpriority)",
    "base_fee_per_gas": "NULL",
}

# Transactions whose line has the right number of fields. ``wei`` and ``rest`` are the integer values (in units of
# 10**13) and the values written with an exponent.
TX = """tx AS (
  SELECT *, round(l_extendedprice * 100)::bigint AS cents,
         CASE WHEN l_linenumber <> 2 THEN round(l_extendedprice * 100)::bigint END AS wei,
         CASE WHEN l_linenumber = 2 THEN round(l_extendedprice * 100)::bigint END AS rest,
         CASE WHEN l_tax = 0 THEN '' ELSE 'a' || l_partkey END AS to_address,
         CASE WHEN l_tax = 0 AND l_discount = 0 THEN '' ELSE 'a' || l_suppkey END AS from_address,
         l_linenumber NOT IN (5, 7) AS int_time,
         l_linenumber <> 5 AS float_time,
         NOT (l_linenumber = 3 AND l_linestatus = 'O') AS float_value,
         NOT (l_linenumber = 4 AND l_linestatus = 'F') AS float_price,
         NOT (l_linenumber = 3 AND l_returnflag = 'N') AS float_gas,
         NOT (l_linenumber = 1 AND l_returnflag = 'R') AS int_block
  FROM lineitem WHERE l_linenumber <> 6)"""
CONTRACTS = """contracts AS (
  SELECT 'a' || p_partkey AS address FROM part WHERE p_size < 25 AND p_size <> 10
  UNION ALL SELECT 'a' || p_partkey FROM part WHERE p_size < 5)"""
SCAMS = """scams AS (
  SELECT substr(p_brand, 7) AS id, p_type AS category, 'a' || p_partkey AS address FROM part WHERE p_size NOT IN (7, 8)
  UNION ALL SELECT '9' || substr(p_brand, 7), p_type, 'a' || p_partkey FROM part WHERE p_size < 5)"""
REGISTRY = """registry AS (
  SELECT p_type AS category, 'a' || p_partkey AS address FROM part WHERE p_size <= 40
  UNION ALL SELECT p_type, 'a' || (p_partkey + 1) FROM part WHERE p_size < 20)"""
# In ten-thousandths, as whole numbers, and rounded once at the end.
PARTS = "(coalesce(sum(wei), 0)::hugeint * 100000000000000000 + coalesce(sum(rest * 10 + 5), 0)::hugeint)"
VALUE_SUM = f"(({PARTS} // 10000)::varchar || '.' || lpad(({PARTS} % 10000)::varchar, 4, '0'))::double"
BAD_SIZE = "(o_orderstatus = 'P' AND o_orderpriority = '5-LOW')"
MINER_SIZES = f"""SELECT CASE WHEN {BAD_SIZE} THEN '0' ELSE o_custkey::varchar END AS miner,
         sum(CASE WHEN {BAD_SIZE} THEN 1 ELSE floor(o_totalprice)::bigint END)::bigint AS size
  FROM orders
  WHERE o_orderkey <> 0 AND NOT (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')
  GROUP BY 1"""
MONTHLY_VALUE = f"""WITH {TX}
  SELECT {MONTH.format('l_shipdate')} AS month, ({VALUE_SUM}) / count(*) AS average
  FROM tx WHERE int_time AND float_value GROUP BY 1 ORDER BY 1"""

GAS_PRICE = f"""WITH {TX}
  SELECT {MONTH.format('l_shipdate')} AS month,
         sum(round(l_discount * 100)::bigint * 1000000000)::varchar::double / count(*) AS average
  FROM tx WHERE int_time AND float_price GROUP BY 1 ORDER BY 1"""

REGISTRY_SIZES = f"""WITH {REGISTRY}
        SELECT category, 'Active' AS status, count(*) AS addresses FROM registry GROUP BY 1"""
CONTRACT_GAS = f"""SELECT {MONTH.format('l_shipdate')} AS month, sum(l_quantity::bigint)::varchar::double / count(*) AS average
        FROM tx JOIN contracts ON to_address = address
        WHERE int_time AND float_price AND float_gas GROUP BY 1"""
# Values as doubles, as far as a line has one.
VALUE = "(CASE WHEN l_linenumber = 2 THEN cents::varchar || '.5e-3' ELSE cents::varchar || '0000000000000' END)::double"
FEATURES = f"""SELECT to_address AS address, count(*) AS calls, count(DISTINCT from_address) AS senders,
               quantile_disc({VALUE}, 0.25) AS q25, quantile_disc({VALUE}, 0.5) AS median,
               quantile_disc({VALUE}, 0.75) AS q75, quantile_disc({VALUE}, 0.95) AS q95
        FROM tx WHERE float_value AND to_address IN (SELECT address FROM contracts) GROUP BY 1"""


ORACLE_SQL: dict[str, str] = {
    "monthly_count": f"""SELECT {MONTH.format('o_orderdate')} AS month, count(*) AS orders
        FROM orders GROUP BY 1 ORDER BY 1""",
    "first_months": f"""SELECT {MONTH.format('o_orderdate')} AS month, count(*) AS orders
        FROM orders GROUP BY 1 ORDER BY min(o_orderdate) LIMIT 10""",
    "monthly_avg": f"""SELECT {MONTH.format('o_orderdate')} AS month, {_mean('o_totalprice')} AS average
        FROM orders GROUP BY 1""",
    "monthly_avg_sorted": f"""SELECT {MONTH.format('l_shipdate')} AS month, {_mean('l_extendedprice')} AS average
        FROM lineitem GROUP BY 1 ORDER BY min(l_shipdate)""",
    "epoch_month": f"""SELECT {DASHED.format('make_timestamp(l_orderkey * 10000 * 1000000)')} AS month, count(*) AS n
        FROM lineitem GROUP BY 1""",
    "topk_sum_join": """SELECT l_partkey, sum(l_extendedprice::decimal(18,2))::decimal(28,2) AS total
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 25
        GROUP BY l_partkey ORDER BY total DESC, l_partkey LIMIT 10""",
    "topk_sum": """SELECT l_suppkey, sum(l_quantity::bigint)::bigint AS quantity
        FROM lineitem GROUP BY l_suppkey ORDER BY quantity DESC, l_suppkey LIMIT 10""",
    "joined_monthly_avg": f"""SELECT {MONTH.format('l_shipdate')} AS month, {_mean('l_quantity')} AS average
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 25 GROUP BY 1""",
    "topk_composite": """SELECT p_brand, p_type, sum(l_extendedprice::decimal(18,2))::varchar::double AS total
        FROM lineitem JOIN part ON l_partkey = p_partkey
        GROUP BY p_brand, p_type ORDER BY total DESC, p_brand, p_type LIMIT 15""",
    "registry_month_sum": f"""SELECT {DASHED.format('l_shipdate')} AS month, r_name AS category,
               sum(l_extendedprice::decimal(18,2))::varchar::double AS total
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
             JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        GROUP BY 1, 2""",
    "json_map_explode": """SELECT event_type, name, count(*) AS n,
               sum(json_extract(props, '$.' || name)::bigint)::bigint AS total
        FROM (SELECT event_type, props, unnest(json_keys(props)) AS name FROM events) GROUP BY 1, 2""",
    "array_explode": """SELECT label, pos, count(*) AS n, min(element) AS smallest, max(element) AS largest,
               sum(floor(element * 1000000)::bigint)::bigint AS millionths
        FROM (SELECT label, (generate_subscripts(embedding, 1) - 1)::integer AS pos,
                     unnest(embedding)::double AS element FROM embeddings)
        GROUP BY 1, 2""",
    "self_pair_topk": """SELECT c_nationkey, s_nationkey, sum(l_extendedprice::decimal(18,2))::decimal(28,2) AS total
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN supplier ON l_suppkey = s_suppkey
        WHERE c_nationkey = s_nationkey GROUP BY 1, 2 ORDER BY total DESC, 1, 2 LIMIT 10""",
    "valid_lines": f"""WITH {TX}
        SELECT 'monthly transactions' AS rule, count(*) FILTER (WHERE int_time) AS lines FROM tx
        UNION ALL SELECT 'monthly value', count(*) FILTER (WHERE int_time AND float_value) FROM tx
        UNION ALL SELECT 'top contracts', count(*) FILTER (WHERE int_block) FROM tx
        UNION ALL SELECT 'gas', count(*) FILTER (WHERE float_price AND float_time) FROM tx
        UNION ALL SELECT 'scam value by month', count(*) FILTER (WHERE float_value AND float_time) FROM tx
        UNION ALL SELECT 'self transfers', count(*) FILTER (WHERE float_value) FROM tx""",
    "header_lines": MINER_SIZES,
    "column_bytes": _column_bytes("customer", CUSTOMER),
    "column_percent": _column_shares("customer", CUSTOMER | {"nothing": "NULL"}),
    "render_pairs": f"""SELECT month || ',' || orders AS text, month, orders FROM
        (SELECT {MONTH.format('o_orderdate')} AS month, count(*) AS orders FROM orders GROUP BY 1)""",
    "pairs_roundtrip": f"""SELECT {DASHED.format('o_orderdate')} AS month, o_orderstatus AS status, count(*) AS orders
        FROM orders GROUP BY 1, 2""",
    "csv_roundtrip": """SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance
        FROM customer""",
    "json_roundtrip": "SELECT * FROM part",
    "staged_fields": MONTHLY_VALUE,
    "text_files": GAS_PRICE,
    "registry_file": REGISTRY_SIZES,
    "registry_document": REGISTRY_SIZES,
    "block_csv": _column_shares("orders", BLOCK_COLUMNS),
    "block_csv_inferred": _column_shares("orders", BLOCK_COLUMNS),
    "job_result": f"""WITH {TX}
        SELECT {MONTH.format('l_shipdate')} AS month, count(*) AS transactions FROM tx WHERE int_time GROUP BY 1""",
    "rendered_roundtrip": f"""SELECT {MONTH.format('o_orderdate')} AS month, count(*) AS orders
        FROM orders GROUP BY 1""",
    "report_roundtrip": """SELECT l_suppkey AS supplier, sum(l_quantity::bigint)::bigint AS quantity
        FROM lineitem GROUP BY l_suppkey ORDER BY quantity DESC, l_suppkey LIMIT 10""",
    "preview": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 10",
    "ledger_monthly_transactions": f"""WITH {TX}
        SELECT {MONTH.format('l_shipdate')} AS month, count(*) AS transactions
        FROM tx WHERE int_time GROUP BY 1 ORDER BY 1""",
    "ledger_monthly_value": MONTHLY_VALUE,
    "ledger_top_contracts": f"""WITH {TX}, {CONTRACTS}
        SELECT address, units::varchar || '0000000000000' AS value
        FROM (SELECT to_address, sum(wei) AS units FROM tx
              WHERE int_block AND float_value AND l_linenumber <> 2 GROUP BY 1)
             JOIN contracts ON to_address = address
        ORDER BY units DESC, address LIMIT 10""",
    "ledger_top_miners": f"SELECT * FROM ({MINER_SIZES}) ORDER BY size DESC, miner LIMIT 10",
    "ledger_gas_price": GAS_PRICE,
    "ledger_contract_gas": f"""WITH {TX}, {CONTRACTS}
        SELECT {MONTH.format('l_shipdate')} AS month, sum(l_quantity::bigint)::varchar::double / count(*) AS average
        FROM tx JOIN contracts ON to_address = address
        WHERE int_time AND float_price AND float_gas GROUP BY 1 ORDER BY 1""",
    "ledger_top_scams": f"""WITH {TX}, {SCAMS}
        SELECT id, category, {VALUE_SUM} AS total FROM tx JOIN scams ON to_address = address
        WHERE int_time AND float_value GROUP BY 1, 2 ORDER BY total DESC, id, category LIMIT 15""",
    "ledger_scam_months": f"""WITH {TX}, {REGISTRY}
        SELECT {DASHED.format('l_shipdate')} AS month, category, {VALUE_SUM} AS total
        FROM tx JOIN registry ON to_address = address WHERE float_time AND float_value GROUP BY 1, 2""",
    "ledger_self_transfers": f"""WITH {TX}
        SELECT from_address, to_address, {VALUE_SUM} AS total FROM tx
        WHERE float_value AND from_address = to_address
        GROUP BY 1, 2 ORDER BY total DESC, 1, 2 LIMIT 10""",
    "ledger_block_bytes": _column_bytes("orders", {name: BLOCK_COLUMNS[name] for name in DROPPABLE_BLOCK_COLUMNS}),
    "ledger_block_shares": _column_shares("orders", BLOCK_COLUMNS),
    "ledger_monthly_activity": f"""WITH {TX}
        SELECT month, transactions, average
        FROM (SELECT {MONTH.format('l_shipdate')} AS month, count(*) AS transactions FROM tx WHERE int_time GROUP BY 1)
             LEFT JOIN ({MONTHLY_VALUE}) USING (month)""",
    "ledger_monthly_gas": f"""WITH {TX}, {CONTRACTS}
        SELECT 'gas price' AS question, month, average FROM ({GAS_PRICE})
        UNION ALL SELECT 'contract gas', month, average FROM ({CONTRACT_GAS})""",
    "ledger_popular_gas": f"""WITH {TX}, {CONTRACTS}, top_rows AS (  -- the ten joined rows, a contract named twice among them
          SELECT DISTINCT to_address FROM (
            SELECT to_address, units FROM (SELECT to_address, sum(wei) AS units FROM tx
              WHERE int_block AND float_value AND l_linenumber <> 2 GROUP BY 1) JOIN contracts ON to_address = address
            ORDER BY units DESC, to_address LIMIT 10)),
        calls AS (
          SELECT {MONTH.format('l_shipdate')} AS month, l_quantity::bigint AS gas, to_address IN (SELECT to_address FROM top_rows) AS popular
          FROM tx JOIN contracts ON to_address = address WHERE int_time AND float_price AND float_gas)
        SELECT month, sum(gas)::varchar::double / count(*) AS average, count(*) AS calls,
               (sum(gas) FILTER (WHERE popular))::varchar::double / nullif(count(*) FILTER (WHERE popular), 0) AS popular_average,
               count(*) FILTER (WHERE popular) AS popular_calls
        FROM calls GROUP BY 1""",
    "ledger_rings": f"""WITH RECURSIVE {TX}, moves AS (
          SELECT * FROM tx WHERE float_value AND from_address <> to_address AND from_address <> '' AND to_address <> ''),
        steps AS (
          SELECT DISTINCT from_address AS u, to_address AS v FROM moves WHERE to_address IN (SELECT from_address FROM moves)),
        reached AS (
          SELECT u, v FROM steps UNION SELECT reached.u, steps.v FROM reached JOIN steps ON reached.v = steps.u),
        members AS (
          SELECT a.u AS node, least(a.u, min(a.v)) AS ring FROM reached a JOIN reached b ON a.u = b.v AND a.v = b.u
          WHERE a.u <> a.v GROUP BY a.u)
        SELECT x.ring, (SELECT count(*) FROM members WHERE members.ring = x.ring) AS traders,
               count(DISTINCT from_address || ' ' || to_address) AS pairs, count(*) AS transfers, {VALUE_SUM} AS total
        FROM moves JOIN members x ON from_address = x.node JOIN members y ON to_address = y.node AND x.ring = y.ring
        GROUP BY x.ring""",
    "ledger_contract_features": f"WITH {TX}, {CONTRACTS} {FEATURES}",
    "ledger_contract_types": f"""WITH {TX}, {CONTRACTS}, features AS ({FEATURES})
        SELECT CASE WHEN calls <= 10 THEN 'idle' WHEN senders <= 2 THEN 'private' WHEN q75 <= 2 * q25 THEN 'even'
                    WHEN q95 >= 2 * median THEN 'peaked' ELSE 'mixed' END AS contract_type,
               count(*) AS contracts, sum(calls)::bigint AS calls
        FROM features GROUP BY 1""",
}
