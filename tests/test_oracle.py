"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as E
from conflictlake.operators.conflicts import STATUSES
from conflictlake.plans.queries import REGISTRY
from conftest import SF001, SF01
from oracle_check import compare, duck

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, name, E.queries()[name], E.oracle_sql()[name], SF001, con)
    assert ok, msg


def test_every_query_has_oracle():
    assert set(REGISTRY) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_the_data_exercises_the_rules(spark):
    """Each status, note and fail flag occurs in the query outputs."""
    q = lambda name: E.queries()[name](spark, SF01)
    assert {r.status for r in q("status_counts").collect()} == set(STATUSES)
    assert {r.notes for r in q("merge_notes").select("notes").distinct().collect()} == {"", "a parent is the base", "two initial commits"}
    flags = q("conflict_metrics").selectExpr("bool_or(fail_max_lines)", "bool_or(fail_token_count)", "bool_or(fail_incoherent)", "bool_or(not resolution_in_left_or_right)").first()
    assert all(flags)
    assert q("conflict_resolve").where("block_no > 1").count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "status" in df.columns
