"""What the plans of the registered queries must and must not hold."""

from __future__ import annotations

import re

import pytest

from ledgertally.plans.table_queries import QUERIES

#: Reads a document by prefix sums over its splits.
WINDOWED = ["registry_document"]
TOP_K = ["topk_sum_join", "topk_sum", "topk_composite", "self_pair_topk", "ledger_top_contracts", "ledger_top_miners",
         "ledger_top_scams", "ledger_self_transfers", "preview", "first_months"]


@pytest.fixture(scope="module")
def plans(spark, tables):
    return {name: query(spark, tables)._jdf.queryExecution().toString() for name, query in QUERIES.items()}


def physical(plan):
    return plan[plan.index("== Physical Plan ==") :]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cross_join(plans, name):
    plan = physical(plans[name])
    for node in ["Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "RDDScan", *([] if name in WINDOWED else ["Window"])]:
        assert node not in plan, node


@pytest.mark.parametrize("name", TOP_K)
def test_top_k_keeps_k_rows_per_task(plans, name):
    plan = physical(plans[name])
    assert "TakeOrderedAndProject" in plan
    assert "rangepartitioning" not in plan


@pytest.mark.parametrize("name", ["column_bytes", "column_percent", "ledger_block_bytes", "ledger_block_shares"])
def test_column_sizes_take_one_pass(plans, name):
    plan = physical(plans[name])
    assert plan.count("Scan parquet") == 1
    assert plan.count("Exchange") == 1


def test_columns_and_filters_reach_the_scan(plans):
    plan = physical(plans["topk_sum_join"])
    assert "ReadSchema: struct<l_partkey:bigint,l_extendedprice:double>" in plan
    assert "LessThan(p_size,25)" in plan


def test_facts_meet_a_list_by_its_filter_and_as_totals(plans):
    plan = physical(plans["ledger_contract_gas"])
    assert re.search(r"Exchange hashpartitioning\(to_address#\d+, month_index#", plan), "partial sums are shuffled, not rows"
    for name in ["ledger_contract_gas", "ledger_top_scams", "ledger_scam_months", "ledger_top_contracts", "topk_sum_join", "topk_composite", "joined_monthly_avg", "registry_month_sum"]:
        plan = physical(plans[name])
        assert re.search(r"Filter .*subquery#\d+.*xxhash64\(", plan), name


def test_each_line_is_split_once(plans):
    for name in ["ledger_monthly_value", "ledger_self_transfers", "valid_lines", "ledger_top_miners"]:
        assert physical(plans[name]).count("split(value") == 1
