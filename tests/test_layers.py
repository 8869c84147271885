"""Levels of a commit graph: shortcuts, values and their number on deep and wide histories."""

import random

import pytest

from conflictlake.operators import history as H
from conflictlake.operators import layers as L
from tests.test_graph import C_SCHEMA, _ancestors, _random_dag


def _nested(n):
    """n nested merges: commit i merges i + 1 and a commit that forked further down."""
    rnd = random.Random(n)
    rows, parents, at = [], {}, 0
    for i in range(n):
        parents[i] = [i + 1] if i + 1 < n else []
        if i + 2 < n:
            q = min(n - 1, i + rnd.randint(2, 40))
            parents[i].append(q)
        rows.append(("deep", f"deep:{i}", [f"deep:{q}" for q in parents[i]], i))
    return rows, parents


def test_shortcuts_keep_reachability_and_nothing_implied():
    rnd = random.Random(1)
    for _ in range(40):
        n = rnd.randint(2, 30)
        edges = [(u, v) for u in range(n) for v in range(u + 1, n) if rnd.random() < 0.15]
        border = rnd.sample(range(n), rnd.randint(1, n))
        got = L.shortcuts(edges, border)
        down = lambda es, x: _ancestors({i: [v for u, v in es if u == i] for i in range(n)}, x) - {x}
        for b in border:
            assert down(got, b) == down(edges, b) & set(border)
        for e in got:
            rest = [x for x in got if x != e]
            assert e[1] not in down(rest, e[0])


@pytest.mark.parametrize("block", [4, 16])
def test_values_over_many_levels(spark, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    monkeypatch.setattr(L, "WORD", 3)
    monkeypatch.setattr(H, "WORD", 3)
    rnd = random.Random(block)
    rows, want = [], {}
    for r in range(4):
        repo = f"r{r}"
        n = rnd.randint(30, 90)
        more, parents = _random_dag(rnd, n, repo)
        rows += more
        heads = rnd.sample(range(n), 5)
        want[repo] = (heads, {i: _ancestors(parents, i) for i in range(n)})
    commits = spark.createDataFrame(rows, C_SCHEMA).repartition(3)
    refs = spark.createDataFrame([(repo, f"refs/heads/{k}", f"{repo}:{h}", k) for repo, (hs, _) in want.items() for k, h in enumerate(hs)],
                                 "repository string, path string, head_sha string, ref_rank int")
    layers = L.Layers(commits)
    assert len(layers.levels) > 1 or layers.wide
    got = {(x["repository"], x["path"], x["sha"]) for x in H.ref_commits(commits, refs, layers).collect()}
    assert got == {(repo, f"refs/heads/{k}", f"{repo}:{i}") for repo, (hs, anc) in want.items() for k, h in enumerate(hs) for i in anc[h]}
    first = {(x["repository"], x["sha"]): x["ref_rank"] for x in H.first_reaching_ref(commits, refs, layers).collect()}
    assert first == {(repo, f"{repo}:{i}"): min(k for k, h in enumerate(hs) if i in anc[h]) for repo, (hs, anc) in want.items() for i in set().union(*(anc[h] for h in hs))}
    old = {(x["repository"], x["sha"]): x["oldest"] for x in H.oldest_ancestor(commits, None, layers).collect()}
    assert old == {(repo, f"{repo}:{i}"): f"{repo}:{max(a)}" for repo, (_, anc) in want.items() for i, a in anc.items()}
    layers.delete()


def test_thousands_of_nested_merges_take_few_rounds(spark, monkeypatch):
    """3000 nested merges, blocks of 128 places: a few stored tables, not one per merge."""
    monkeypatch.setattr(L, "BLOCK", 128)
    n = 3000
    rows, parents = _nested(n)
    commits = spark.createDataFrame(rows, C_SCHEMA).repartition(4)
    layers = L.Layers(commits)
    assert not layers.wide and len(layers.levels) <= 6
    refs = spark.createDataFrame([("deep", "deep:0", 1), ("deep", "deep:1500", 0)], "repository string, head_sha string, ref_rank int")
    got = {x["sha"]: x["ref_rank"] for x in H.first_reaching_ref(commits, refs, layers).collect()}
    late = _ancestors(parents, 1500)
    assert got == {f"deep:{i}": 0 if i in late else 1 for i in range(n)}
    assert len(layers.parts) <= 30
    pairs = [(a, b) for a, b in [(0, 2999), (3, 4), (10, 12), (100, 2000), (2998, 2999), (5, 5)]]
    asked = spark.createDataFrame([("deep", f"{a}-{b}", f"deep:{a}", f"deep:{b}") for a, b in pairs], "repository string, pair_id string, start string, target string")
    assert {x["pair_id"]: x["is_ancestor"] for x in H.ancestor_pairs(commits, asked, layers).collect()} == {f"{a}-{b}": b in _ancestors(parents, a) for a, b in pairs}
    layers.delete()


def test_wide_history_falls_back_to_rounds(spark, monkeypatch):
    """Every commit of a first half is a child of one in the second: all are border commits."""
    monkeypatch.setattr(L, "BLOCK", 8)
    rows = [("w", f"w{i}", [f"w{i + 20}"] if i < 20 else [], i) for i in range(40)]
    commits = spark.createDataFrame(rows, C_SCHEMA)
    layers = L.Layers(commits)
    assert layers.wide
    refs = spark.createDataFrame([("w", f"w{i}", i) for i in range(0, 20, 3)], "repository string, head_sha string, ref_rank int")
    got = {x["sha"]: x["ref_rank"] for x in H.first_reaching_ref(commits, refs, layers).collect()}
    assert got == {f"w{j}": i for i in range(0, 20, 3) for j in (i, i + 20)}


def test_order_is_checked_and_empty_tables(spark):
    bad = spark.createDataFrame([("r", "a", ["b"], 1), ("r", "b", [], 0)], C_SCHEMA)
    with pytest.raises(ValueError):
        L.Layers(bad)
    none = spark.createDataFrame([], C_SCHEMA)
    refs = spark.createDataFrame([("r", "p", "a", 0)], "repository string, path string, head_sha string, ref_rank int")
    assert H.ref_commits(none, refs).collect() == [] and H.oldest_ancestor(none).collect() == []
