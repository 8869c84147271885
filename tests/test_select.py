"""Rows at a rank against a sort, on skewed numbers, texts with long common heads, and ties."""

import random

import pytest

from conflictlake.operators import repos as RP
from conflictlake.operators import select as S
from conflictlake.operators.dataset import assign_split


def _rows(seed, n=700):
    rnd = random.Random(seed)
    number = [lambda: rnd.choice([1.0, 2.0, 2.0, 2.0]), lambda: 10.0 ** rnd.randint(-300, 300), lambda: rnd.gauss(0, 1e-9), lambda: float(rnd.randint(0, 5)),
              lambda: rnd.choice([0.0, -1e308, 1e308, float("inf"), float("nan")])]
    text = [lambda: "same/" * 20 + rnd.choice(["", "a", "é", "日本"]), lambda: "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9))), lambda: "x"]
    return [(rnd.choice(number)(), rnd.choice(text)(), i) for i in range(n)]


def _key(v):
    return (v != v, 0.0 if v != v else v) if isinstance(v, float) else v.encode() if isinstance(v, str) else v


@pytest.mark.parametrize("small", [1, 20])
def test_nth_against_sort(spark, monkeypatch, small):
    monkeypatch.setattr(S, "SMALL", small)
    monkeypatch.setattr(S, "ACCURACY", 50)
    rows = _rows(small)
    df = spark.createDataFrame(rows, "v double, t string, i long").repartition(3).cache()
    for order in ([("v", False)], [("t", False)], [("v", True), ("t", False)], [("t", True), ("i", False)]):
        at = [("v", "t", "i").index(c) for c, _ in order]
        want = sorted(rows, key=lambda r: 0)
        for j, (c, falls) in reversed(list(zip(at, order))):
            want.sort(key=lambda r: _key(r[j]), reverse=falls)
        for k in (0, 1, 333, 699):
            row, before = S.nth(df, order, k)
            assert [_key(x) for x in row] == [_key(want[k][j]) for j in at]
            assert before == next(q for q, r in enumerate(want) if [_key(r[j]) for j in at] == [_key(x) for x in row])
    assert S.nth(df, [("v", False)], 700) is None and S.nth(df.limit(0), [("v", False)], 0) is None


def test_slice_far_down_equals_the_sorted_slice(spark, monkeypatch):
    rows = [(f"r{i % 37}" if i % 41 else None, "Java", str(random.Random(i).choice([1, 2, 5, "x", "NaN", i]))) for i in range(600)]
    df = spark.createDataFrame(rows, "repository string, language string, stars string").repartition(4)
    near = {(a, n): [(r.stars, r.repository) for r in RP.top_n_slice(df, "Java", a, n).collect()] for a, n in [(0, 5), (100, 50), (300, 1000), (9999, 5), (10, 0)]}
    monkeypatch.setattr(RP, "TOP_ROWS", -1)
    monkeypatch.setattr(S, "SMALL", 10)
    for (a, n), want in near.items():
        got = RP.top_n_slice(df, "Java", a, n)
        assert [(r.stars, r.repository) for r in got.collect()] == want and got.columns == df.columns


def test_plans_sort_no_table(spark, monkeypatch, tmp_path):
    """Neither the split nor the statistics range-partition rows."""
    df = spark.range(1000).selectExpr("cast(id as string) conflict_id", "double(id) stars")
    for out in (assign_split(df), RP.star_stats(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan
    got = RP.star_stats(df).first()
    assert got["median_stars"] == 499.5 and got["n"] == 1000
    assert assign_split(df).where("split = 'test'").count() == 200
    empty = RP.star_stats(df.limit(0)).first()
    assert empty["n"] == 0 and empty["median_stars"] is None
