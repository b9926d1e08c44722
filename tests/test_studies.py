"""The wider questions against brute force on small ledgers, and what their plans hold."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgertally.operators.rings import rings
from ledgertally.operators.sketches import RANK_ERROR, merged_sketches, quantile_sketches, with_quantiles
from ledgertally.plans import studies
from ledgertally.plans.table_queries import QUERIES


def components(edges):
    """Rings by mutual reach: node to the smallest member."""
    nodes = {n for e in edges for n in e}
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    reach = {}
    for node in nodes:
        seen, todo = set(), [node]
        while todo:
            for other in after[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        reach[node] = seen
    ring = {n: min({n} | {m for m in reach[n] if n in reach[m]}) for n in nodes if any(n in reach[m] for m in reach[n] - {n})}
    return ring


RANDOM = [[(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)] for r, n, m in [(random.Random(k), 12, 12 + 3 * k) for k in range(4)]]


@pytest.mark.parametrize(
    "edges",
    [
        [],
        [("a", "a"), ("a", "b")],
        [("a", "b"), ("b", "a"), ("b", "a")],
        [(f"n{k:02}", f"n{(k + 1) % 14:02}") for k in range(14)],
        [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "e"), ("f", "g"), ("z", "a")],
        [("hub", f"s{k}") for k in range(30)] + [(f"s{k}", "hub") for k in range(0, 30, 3)],
        *RANDOM,
    ],
)
def test_rings_are_mutual_reach(spark, edges):
    frame = spark.createDataFrame(edges, "u string, v string")
    found = {row.node: row.ring for row in rings(frame).collect()}
    assert found == components([e for e in edges if e[0] != e[1]])


def ledger(spark, rows):
    titles = ["block_number", "from_address", "to_address", "value", "gas", "gas_price", "block_timestamp"]
    return spark.createDataFrame(rows, ", ".join(f"{t} string" for t in titles)).repartition(3)


def test_value_within_rings(spark):
    moves = [("a", "b", "5"), ("b", "c", "7"), ("c", "a", "1e1"), ("c", "x", "100"), ("a", "a", "9"), ("p", "q", "2"), ("q", "p", "3"), ("q", "p", "n/a"), ("b", "", "4"), ("a", "b", "6")]
    found = studies.trade_rings(ledger(spark, [("1", f, t, v, "1", "1", "0") for f, t, v in moves])).collect()
    assert [tuple(row) for row in found] == [("a", 3, 3, 4, 28.0), ("p", 2, 2, 2, 5.0)]


def test_sketches_keep_their_rank_error_and_can_be_merged(spark):
    chosen = random.Random(2)
    rows = [("hot", chosen.lognormvariate(0, 3)) for _ in range(30_000)] + [(f"k{k % 40}", float(k)) for k in range(4000)] + [("none", None)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(9)
    shares = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q95": 0.95}
    whole = quantile_sketches(frame, ["k"], "v")
    parts = merged_sketches(quantile_sketches(frame.withColumn("part", F.spark_partition_id()), ["k", "part"], "v"), ["k"])
    for sketches in (whole, parts):
        found = {row.k: row for row in with_quantiles(sketches, shares).collect()}
        values = sorted(v for k, v in rows if k == "hot")
        for title, share in shares.items():
            rank = sum(v <= found["hot"][title] for v in values) / len(values)
            assert abs(rank - share) <= 2 * RANK_ERROR
            for k in range(40):  # fewer rows than a sketch keeps
                own = sorted(v for key, v in rows if key == f"k{k}")
                assert found[f"k{k}"][title] == own[-(-int(round(share * 1000)) * len(own) // 1000) - 1]
    assert {row.k: row.q50 for row in with_quantiles(whole, shares).collect()}["none"] is None


def test_types_of_contracts(spark):
    def calls(address, senders, values):
        return [("1", senders[k % len(senders)], address, str(v), "1", "1", "0") for k, v in enumerate(values)]

    rows = calls("i", ["s"], [1] * 3) + calls("p", ["s", "t"], range(30)) + calls("e", "stu", [10] * 30) + calls("k", "stu", [1, 3, 9] * 10 + [100] * 4)
    rows += calls("m", "stu", [1, 2, 5, 6, 7, 7] * 4) + calls("not listed", "stu", [1] * 50) + [("1", "s", "i", "n/a", "1", "1", "0")]
    contracts = spark.createDataFrame([(a,) for a in "ipekmi"] + [("never called",), (None,)], "address string")
    found = {row.contract_type: (row.contracts, row.calls) for row in studies.contract_types(ledger(spark, rows), contracts).collect()}
    assert found == {"idle": (1, 3), "private": (1, 30), "even": (1, 30), "peaked": (1, 34), "mixed": (1, 24)}


@pytest.mark.parametrize("name, scans", [("ledger_monthly_gas", 1), ("ledger_monthly_activity", 1), ("ledger_popular_gas", 2)])
def test_text_is_read_once_for_several_results(spark, tables, name, scans):
    plan = QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert sum("Scan parquet" in line and "l_orderkey" in line for line in plan.splitlines()) == scans


def test_both_gas_results_are_those_of_their_own_questions(spark, tables):
    both = defaultdict(dict)
    for row in QUERIES["ledger_monthly_gas"](spark, tables).collect():
        both[row.question][row.month] = row.average
    for question, name in ((studies.GAS_PRICE, "ledger_gas_price"), (studies.CONTRACT_GAS, "ledger_contract_gas")):
        assert both[question] == {row.month: row.average for row in QUERIES[name](spark, tables).collect()}
