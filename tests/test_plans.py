"""Physical-plan checks: the properties the scale design relies on."""

import re

import __spark_entry__ as E
from conftest import SF01


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_plan_has_no_duplicated_work(spark):
    df = E.queries()["conflict_resolve"](spark, SF01)
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    plan = _plan(df)
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    # one round-robin spread of the single-split test table, nothing else
    assert len(re.findall(r"Exchange", plan)) <= 1
    # one line split per text (document, conflict file, merged file)
    assert plan.count("split(") == 3
    # per context one search for the first place, one for a second, one for the nearest; no list of places
    assert plan.count("locate(") == 6 and plan.count("sequence(") == 0
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    logical = df._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in logical


def test_metrics_and_selection_add_no_exchange(spark):
    plan = _plan(E.queries()["select_conflicts"](spark, SF01))
    assert len(re.findall(r"Exchange", plan)) <= 1
    assert "Python" not in plan


def test_top_n_and_pushdown(spark):
    plan = _plan(E.queries()["top_n_slice"](spark, SF01))
    assert "TakeOrderedAndProject(limit=110, offset=10" in plan
    assert "PushedFilters: [IsNotNull(c_mktsegment), IsNotNull(c_acctbal), EqualTo(c_mktsegment,BUILDING)]" in plan


def test_merge_cap_uses_group_limit(spark):
    from conflictlake.operators import history as H
    from conflictlake.plans.inputs import standin_commits, standin_refs, table
    cust = table(spark, SF01, "customer")
    m = H.capped_merges(standin_commits(cust), H.branch_refs(standin_refs(cust), 3), None, 15)
    assert "WindowGroupLimit" in _plan(m)
