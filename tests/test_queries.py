"""Registered queries against their DuckDB statements (all of them with CASELOOM_ALL=1)."""

import os

import pytest

from tests.oracle_check import compare, connect

FAST = ["a1_counts", "a7_censoring", "a12_top_values", "a13_constancy", "a15_leakage", "p2_clean", "p6_local_clock", "p8_components", "w4_running_counts", "w6_marked_distance", "d2_chronological_split",
        "d8_group_holdout", "e1_vocabulary", "e6_case_numbers", "m1_transitions", "m5_greedy_rollout", "v2_accuracy", "v12_similarity", "v18_binary_report", "f5_forgetting", "t2_validation",
        "t12_counterfactual_examples", "t22_gated_choice", "t25_world_state", "t26_run_summary", "st2_world_state"]


def names():
    from __spark_entry__ import oracle_sql

    return sorted(oracle_sql()) if os.environ.get("CASELOOM_ALL") else FAST


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", names())
def test_matches_oracle(spark, sf_dir, con, name):
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, sf_dir)
    assert compare(df.columns, [tuple(r) for r in df.collect()], con, oracle_sql()[name]) is None


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
