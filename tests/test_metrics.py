"""Golden metrics / selection / summary / split cases M01-M09 (FIXTURES.md §4)."""

from pyspark.sql import functions as F

import pytest

from conflictlake.operators import dataset as D
from conflictlake.operators import metrics as M
from conflictlake.operators import summary as S

BLOCK = "<<<<<<< L\nx\n=======\ny\n>>>>>>> R\n"


def _m(spark, rows, **kw):
    df = spark.createDataFrame(rows, "conflict_id string, conflict string, resolved string, tok long")
    out = M.compute_metrics(df, keep_cols=("tok",), **kw)
    return {r.conflict_id: r for r in out.collect()}


def test_m01_m03_limits(spark):
    c20 = "c\n" * 15 + BLOCK
    c21 = "c\n" * 16 + BLOCK
    got = _m(spark, [("a", c20, "c\n" * 15 + "x\n", 1), ("b", c21, "c\n" * 16 + "x\n", 1)])
    assert (got["a"].full_conflict_lines, got["a"].fail_max_lines, got["a"].selected) == (20, False, True)
    assert got["b"].fail_max_lines and not got["b"].selected
    r2 = "z\n" * 7
    r3 = "z\n" * 8
    got = _m(spark, [("c", BLOCK, r2, 1), ("d", BLOCK, r3, 1)])
    assert not got["c"].fail_incoherent and got["d"].fail_incoherent and got["d"].incoherent_resolution_size


def test_m02_token_limit(spark):
    rows = [("a", BLOCK, "x\n", 512), ("b", BLOCK, "x\n", 513)]
    df = spark.createDataFrame(rows, "conflict_id string, conflict string, resolved string, tok long")
    out = {r.conflict_id: r for r in M.compute_metrics(df, keep_cols=("tok",), token_count=F.col("tok")).collect()}
    assert not out["a"].fail_token_count and out["b"].fail_token_count


def test_m04_m06_parts(spark):
    got = _m(spark, [
        ("t", "p\n<<<<<<< L\n a  b\n=======\nq\n>>>>>>> R\ns\n", "p\nab\ns\n", 1),
        ("n", BLOCK, "x\n", 1),
        ("e", "<<<<<<< L\nx\n||||||| B\n=======\ny\n>>>>>>> R\n", "x\n", 1),
        ("x", "<<<<<<< L\nx\n=======\ny\n", "x\n", 1),
    ])
    assert got["t"].resolution_in_left_or_right and got["t"].selected
    assert (got["t"].context_before_lines, got["t"].context_after_lines, got["t"].resolution_lines) == (1, 1, 1)
    assert got["n"].base_lines == -1 and got["e"].base_lines == 0
    assert got["x"].reject_reason == "no_end_marker"


def _metrics_rows(spark):
    rows = [("1-0-1", True, False, False, False), ("1-0-2", False, True, False, False),
            ("2-0-1", True, False, False, False), ("9-0-1", True, False, False, False)]
    return spark.createDataFrame(rows, "conflict_id string, selected boolean, fail_max_lines boolean, "
                                       "fail_token_count boolean, fail_incoherent boolean")


def test_m07_m08_summary(spark):
    m = _metrics_rows(spark)
    idx = spark.createDataFrame([(1, "o/a"), (2, "o/b")], "merge_idx long, repository string")
    got = {r.repository: r for r in S.repository_summary(m, idx).collect()}
    assert set(got) == {"o/a", "o/b"}
    assert (got["o/a"].total_conflicts, got["o/a"].selected_conflicts, got["o/a"].selection_rate) == (2, 1, 0.5)
    assert S.unmapped_count(m, idx).first()[0] == 1
    basic = S.repository_summary(m, None).collect()
    assert [(r.repository, r.total_conflicts, r.selected_conflicts) for r in basic] == [("ALL_REPOSITORIES", 4, 3)]
    nomap = spark.createDataFrame([(7, "o/z")], "merge_idx long, repository string")
    assert [r.repository for r in S.repository_summary(m, nomap).collect()] == ["ALL_REPOSITORIES"]


def test_m09_split_sizes(spark):
    pairs = spark.createDataFrame([(f"{i}-0-1", "c", "r") for i in range(7)],
                                  "conflict_id string, conflict string, resolved string")
    for ts, n_test in ((0.2, 2), (0, 0), (1, 7), (0.5, 4)):
        ds = D.build_dataset(pairs, test_size=ts)
        sizes = {r.split: r.rows for r in D.split_sizes(ds).collect()}
        assert sizes.get("test", 0) == n_test and sizes.get("train", 0) == 7 - n_test
    a = {r.conflict_id: r.split for r in D.build_dataset(pairs).collect()}
    b = {r.conflict_id: r.split for r in D.build_dataset(pairs.repartition(5)).collect()}
    assert a == b


def test_split_moves_no_text(spark):
    """Only ids go through an exchange; the texts stay where they are."""
    pairs = spark.range(30).selectExpr("cast(id as string) as conflict_id", "concat('c', id) as conflict", "concat('r', id) as resolved")
    plan = D.build_dataset(pairs.repartition(3), 0.2, 42)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "RepartitionByExpression" not in plan and "Window" not in plan


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dedupe_before_split_keeps_sizes_exact(spark, seed):
    rows = [(f"{i}", f"c{i % 37}", "r") for i in range(100)]
    pairs = spark.createDataFrame(rows, "conflict_id string, conflict string, resolved string")
    sizes = {r.split: r.rows for r in D.split_sizes(D.build_dataset(pairs, 0.2, seed, dedupe=True)).collect()}
    assert sizes == {"test": 8, "train": 29}


def test_summary_reports(spark):
    m = _metrics_rows(spark)
    p = M.fail_percentages(m).first()
    assert (p.n, p.pct_fail_max_lines, p.pct_fail_token_count) == (4, 25.0, 0.0)
    assert M.fail_percentages(m.limit(0)).count() == 0
    idx = spark.createDataFrame([(1, "o/a"), (2, "o/b")], "merge_idx long, repository string")
    tot = S.summary_totals(S.repository_summary(m, idx)).first()
    assert (tot.total_repositories, tot.contributing_repositories, tot.total_selected) == (2, 2, 2)
    counts = {r.repository: r.conflicts for r in S.per_repository_counts(S.with_repository(m, idx)).collect()}
    assert counts == {"o/a": 2, "o/b": 1, None: 1}
    assert [r.merge_id for r in S.first_merge_ids(m, 2).collect()] == ["1", "2"]
    order = [r.repository for r in S.order_summary(S.repository_summary(m, idx)).collect()]
    assert order == ["o/a", "o/b"]


def test_pairs_of_a_dataset_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    schema = "conflict_id string, conflict string, resolved string"
    pairs = spark.createDataFrame([(f"{i}-0-0", f"c{i}", "r") for i in range(50)], schema).mapInArrow(count, schema)
    assert len(D.build_dataset(pairs, 0.2).collect()) == 50
    assert made.value == 50
