"""All plans of the list joins against a brute-force join in Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgertally.functions.numbers import number
from ledgertally.operators.matching import key_list, listed_sums, listed_totals, top_listed
from ledgertally.operators.registry import registry_addresses
from ledgertally.sources.layouts import REGISTRY_SCHEMA

PLANS = {"one salt": {}, "salts of two attributes": {"spread": 2}}


def data(seed):
    """Facts with a third of all rows on one key, lists with repeated mentions and a key of many attributes."""
    chosen = random.Random(seed)
    keys = [f"k{i}" for i in range(12)] + ["", "only fact"]
    facts = [(chosen.choice(keys) if chosen.random() > 0.34 else "k1", chosen.randrange(3), chosen.randrange(100))
             for _ in range(400)]
    listed = [(chosen.choice(["k1", "k2", "k3", "", "only list"]), str(chosen.randrange(4)), chosen.choice("xy"))
              for _ in range(60)]
    listed += [("k1", f"id{i}", "x") for i in range(30)] + [(None, "1", "x")]
    return facts, listed


@pytest.fixture(params=[1, 2])
def case(spark, request):
    facts, listed = data(request.param)
    return (
        facts,
        listed,
        spark.createDataFrame(facts, "to string, month int, value bigint").repartition(5),
        spark.createDataFrame(listed, "address string, id string, category string").repartition(3),
    )


@pytest.mark.parametrize("plan", PLANS)
def test_sums_by_attributes(case, plan):
    facts, listed, facts_df, listed_df = case
    sums = PLANS[plan]
    expected = defaultdict(lambda: [0.0, 0])
    for to, _, value in facts:
        for address, id_, category in listed:
            if to == address:
                expected[id_, category][0] += value
                expected[id_, category][1] += 1
    listed_keys = key_list(listed_df, "to", "address", ["id", "category"])
    found = listed_sums(facts_df, listed_keys, ["id", "category"], ["value"], **sums)
    assert {(r.id, r.category): [r.value, r.rows] for r in found.collect()} == dict(expected)


@pytest.mark.parametrize("plan", PLANS)
def test_sums_by_month_and_attribute(case, plan):
    facts, listed, facts_df, listed_df = case
    sums = PLANS[plan]
    expected = Counter()
    for to, month, value in facts:
        for address, _, category in listed:
            if to == address:
                expected[month, category] += value
    found = listed_sums(
        facts_df, key_list(listed_df, "to", "address", ["category"]), ["month", "category"], ["value"], **sums
    )
    assert {(r.month, r.category): r.value for r in found.collect()} == dict(expected)


@pytest.mark.parametrize("plan", PLANS)
def test_means_count_every_mention(case, plan):
    facts, listed, facts_df, listed_df = case
    sums = PLANS[plan]
    rows = [(month, value) for to, month, value in facts for address, _, _ in listed if to == address]
    found = listed_sums(facts_df, key_list(listed_df, "to", "address"), ["month"], ["value"], **sums)
    for row in found.collect():
        values = [value for month, value in rows if month == row.month]
        assert (row.value, row.rows) == (sum(values), len(values))


@pytest.mark.parametrize("k", [1, 3, 10, 500])
def test_top_rows_keep_repeated_mentions(case, k):
    facts, listed, facts_df, listed_df = case
    totals = Counter()
    for to, _, value in facts:
        totals[to] += value
    joined = [(address, totals[address]) for address, _, _ in listed if address in totals]
    expected = sorted(joined, key=lambda row: (-row[1], row[0]))[:k]
    listed_keys = key_list(listed_df, "to", "address")
    found = top_listed(listed_totals(facts_df, listed_keys, ["value"]), ["to"], "value", k)
    assert [tuple(row) for row in found.collect()] == expected


def test_dedupe_counts_a_mention_once(case):
    facts, listed, facts_df, listed_df = case
    listed_keys = key_list(listed_df, "to", "address", dedupe_right=True)
    found = top_listed(listed_totals(facts_df, listed_keys, ["value"]), ["to"], "value", 100)
    assert len(found.collect()) == len({a for a, _, _ in listed} & {to for to, _, _ in facts})


@pytest.mark.parametrize("plan", PLANS)
def test_number_structs(spark, plan):
    sums = PLANS[plan]
    facts = spark.createDataFrame([("a", "1" + "0" * 25), ("a", "0.5"), ("b", "7")], "to string, value string")
    facts = facts.select("to", number(F.col("value")).alias("value"))
    listed = spark.createDataFrame([("a", "s"), ("a", "s"), ("a", "t"), ("b", "s")], "address string, id string")
    found = listed_sums(facts, key_list(listed, "to", "address", ["id"]), ["id"], ["value"], **sums)
    assert {r.id: (r.value, r.rows) for r in found.collect()} == {"s": (2e25 + 8.0, 5), "t": (1e25 + 0.5, 2)}


def test_lists_collapse_and_plans_start_no_job(spark):
    listed = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2"), ("b", "1")], "address string, id string")
    facts = spark.range(100).selectExpr("string(id % 7) as to", "id as value")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "nothing may run")
    collapsed = key_list(listed, "to", "address", ["id"])
    listed_sums(facts, collapsed, ["id"], ["value"])
    assert tracker.getJobIdsForGroup("planning") == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {tuple(row) for row in collapsed.rows.collect()} == {("a", "1", 2), ("a", "2", 1), ("b", "1", 1)}


def test_facts_are_collapsed_before_the_shuffle_and_small_lists_are_broadcast(spark):
    facts = spark.range(100).selectExpr("string(id % 7) as to", "id as value")
    listed = spark.range(5).selectExpr("string(id) as address")
    found = listed_sums(facts, key_list(listed, "to", "address"), ["to"], ["value"])
    assert sorted((r.to, r.value) for r in found.collect()) == [(str(k), float(sum(range(k, 100, 7)))) for k in range(5)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan[: plan.index("Initial Plan")] and "partial_sum(value" in plan


def test_a_key_of_many_attributes_is_dealt_out(spark):
    facts = spark.range(6000).selectExpr("if(id % 3 = 0, 'hot', string(id % 50)) as to", "int(id % 60) as month", "id as value")
    listed = spark.range(50_000).selectExpr("'hot' as address", "string(id) as id").union(spark.sql("select '7', 'x'"))
    found = listed_totals(facts, key_list(listed, "to", "address", ["id"]), ["value"], ["month"], spread=1000)
    assert found.where("to = 'hot'").count() == 50_000 * 20
    assert found.selectExpr("sum(value)").first()[0] == 50_000 * sum(range(0, 6000, 3)) + sum(k for k in range(6000) if k % 3 and k % 50 == 7)


def test_registry(spark):
    document = """{"result": {"one": {"id": 1, "addresses": ["a", "b"], "status": "Active", "category": "Phishing",
                   "name": "x"}, "two": {"id": "2", "addresses": [], "status": "Offline", "category": "Scamming"},
                   "three": {"id": 3, "addresses": ["a"], "status": "Offline", "category": "Fake ICO"}}}"""
    documents = spark.createDataFrame([(document,)], "value string").select(
        F.from_json("value", REGISTRY_SCHEMA).alias("d")
    )
    rows = registry_addresses(documents.select("d.*")).collect()
    assert sorted(tuple(row) for row in rows) == [
        ("1", "Active", "Phishing", "a"),
        ("1", "Active", "Phishing", "b"),
        ("3", "Offline", "Fake ICO", "a"),
    ]


def test_means_leave_out_null_values(spark):
    facts = spark.createDataFrame([("a", 1, 10.0), ("a", 1, None), ("b", 1, None), ("a", 2, 4.0)], "k string, m int, v double")
    for attributes in ([], ["x"]):
        listed = spark.createDataFrame([("a", "p"), ("a", "p"), ("b", "p")], "k string, x string")
        sums = listed_sums(facts, key_list(listed, "k", "k", attributes), ["m"], ["v"]).collect()
        assert sorted((r.m, r.v / r.v_rows, r.rows) for r in sums) == [(1, 10.0, 5), (2, 4.0, 2)]
