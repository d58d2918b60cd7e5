"""Plan-shape checks: equi-joins only, pushdown/pruning reach the scan, aggregation instead of
unbounded windows, no row-at-a-time Python UDFs."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

# the topic queries fit models eagerly; their plans are covered by the fits themselves
SKIP = {"topic_distribution", "topic_keywords", "topic_scores", "logit_coefficients", "effect_table", "fitted_ranking"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(E.queries()) - SKIP))
def test_no_nested_loop_or_cartesian(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "BroadcastNestedLoopJoin" not in plan
    assert "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan  # no row-at-a-time Python UDF anywhere


def test_committee_chain_is_aggregation_not_window(spark):
    plan = _plan(E.queries()["committee_features"](spark, SF_SMALL))
    assert "Window" not in plan
    assert "HashAggregate" in plan or "SortAggregate" in plan or "ObjectHashAggregate" in plan


def test_scan_pruning_and_pushdown(spark):
    plan = E.queries()["bill_features"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    # lineitem is read for history/sponsors with only the columns the chain needs
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_linestatus:string>" in plan
    assert "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,O)" in plan


def test_cap_is_window_group_limit(spark):
    df = E.queries()["match_capped"](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_matching_uses_equi_keys(spark):
    plan = _plan(E.queries()["match_and"](spark, SF_SMALL))
    assert "SortMergeJoin" in plan or "BroadcastHashJoin" in plan or "ShuffledHashJoin" in plan
    assert "token" in plan and "month" in plan


def test_model_table_flags_come_without_a_text_for_each_bill(spark, monkeypatch):
    """Bills name their text by its document; the whole texts stay with the documents."""
    from billcov.operators import similarity
    from billcov.plans import catalog

    seen = []
    monkeypatch.setattr(similarity, "similarity_flags", lambda bills, *a, texts=None, **b: seen.append((bills.columns, texts.columns)) or bills.selectExpr("bill_number", "year", "0 AS Bill_Sim_Binary"))
    catalog.q_model_table(spark, "/root/testdata/sf0.001")
    assert seen == [(["bill_number", "year", "doc_id"], ["doc_id", "text"])]
