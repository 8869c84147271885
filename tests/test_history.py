"""Golden history cases G01-G10 (FIXTURES.md §3)."""

import random

from conflictlake.operators import history as H
from conflictlake.streaming.incremental import combine_merges

C_SCHEMA = "repository string, sha string, parents array<string>, commit_ord long"
R_SCHEMA = "repository string, path string, head_sha string, ref_ord int"


def _commits(spark, graph, order):
    """graph: child -> parents; order: shas newest first."""
    rows = [("r", s, graph.get(s, []), i) for i, s in enumerate(order)]
    return spark.createDataFrame(rows, C_SCHEMA)


def _refs(spark, refs):
    return spark.createDataFrame([("r", p, h, i) for i, (p, h) in enumerate(refs)], R_SCHEMA)


def _notes(spark, graph, order, refs=(("refs/heads/main", "m"),), cap=100, branches=1000):
    m = H.collect_merges(_refs(spark, refs), _commits(spark, graph, order), None, cap, branches)
    return {r.merge_commit: r for r in m.collect()}


def test_g01_g04_notes(spark):
    assert _notes(spark, {"m": ["p", "q"], "p": ["b"], "q": ["b"]}, ["m", "p", "q", "b"])["m"].notes == ""
    assert _notes(spark, {"m": ["p", "q"], "q": ["p"]}, ["m", "q", "p"])["m"].notes == "a parent is the base"
    assert _notes(spark, {"m": ["p", "q"]}, ["m", "p", "q"])["m"].notes == "two initial commits"
    g4 = {"m": ["p", "q"], "p": ["b", "r"], "q": ["b"]}
    assert _notes(spark, g4, ["m", "p", "q", "b", "r"])["m"].notes == "two initial commits"


def test_g05_g06_not_merges(spark):
    got = _notes(spark, {"m": ["p", "p"], "n": ["p", "q", "r"], "k": ["m", "n"]}, ["k", "m", "n", "p", "q", "r"],
                 refs=(("refs/heads/main", "k"),))
    assert set(got) == {"k"}
    got = _notes(spark, {"m": ["p", "p"], "k": ["a", "b"], "x": ["k", "b"]}, ["x", "m", "k", "p", "a", "b"],
                 refs=(("refs/heads/main", "x"), ("refs/heads/dev2", "m")), cap=2)
    assert set(got) == {"x", "k"}   # the degenerate merge does not use up the cap


def test_g07_first_ref_wins(spark):
    graph = {"t0": ["m"], "t2": ["m"], "m": ["p", "q"]}
    refs = (("refs/heads/a", "t0"), ("refs/heads/b", "zz"), ("refs/heads/c", "t2"))
    got = _notes(spark, graph, ["t0", "t2", "m", "p", "q", "zz"], refs)
    assert list(got) == ["m"] and got["m"].branch_name == "refs/heads/a"


def test_g08_g09_refs(spark):
    r = H.branch_refs(_refs(spark, [("refs/heads/a", "x"), ("refs/heads/b", "x"), ("refs/tags/t", "y")]))
    assert [(x.path, x.ref_rank) for x in r.collect()] == [("refs/heads/a", 0)]
    refs = [("refs/heads/a", "x"), ("refs/heads/b", "y"), ("refs/heads/maintenance", "z")]
    r = H.branch_refs(_refs(spark, refs), max_branches=1)
    assert [(x.path, x.ref_rank) for x in r.collect()] == [("refs/heads/maintenance", 0)]


def test_g10_incremental(spark):
    ex = spark.createDataFrame([("r", "k1", 0), ("r", "k2", 1)], "repository string, merge_commit string, merge_idx long")
    new = spark.createDataFrame([("r", f"n{i}", i) for i in range(4)] + [("r", "k1", 9)],
                                "repository string, merge_commit string, commit_ord long")
    got = sorted((r.pos, r.merge_commit, r.source) for r in combine_merges(ex, new, 3).collect())
    assert got == [(0, "k1", "existing"), (1, "k2", "existing"), (2, "n0", "new")]


def test_dense_merge_index_and_duplicates(spark):
    m = spark.createDataFrame([("b", "2"), ("a", "9"), ("a", "1"), ("c", "0")], "repository string, merge_commit string")
    got = sorted((r.merge_idx, r.repository, r.merge_commit) for r in H.number_merges(m).collect())
    assert got == [(0, "a", "1"), (1, "a", "9"), (2, "b", "2"), (3, "c", "0")]
    d = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1")], "repository string, merge_commit string")
    assert [(r.repository, r.n) for r in H.duplicate_merge_keys(d).collect()] == [("a", 2)]


def test_notes_of_all_merges_in_one_walk(spark, monkeypatch):
    from conflictlake.operators import layers as L
    rnd = random.Random(11)
    rows = []
    for r in range(3):
        parents = [[] if i < 2 or rnd.random() < 0.05 else rnd.sample(range(i), min(i, rnd.choice([1, 2, 2]))) for i in range(90)]
        rows += [(f"r{r}", f"{r}:{i}", [f"{r}:{p}" for p in ps] + ["gone"] * (len(ps) == 1 and i % 3 == 0), -i) for i, ps in enumerate(parents)]
    commits = spark.createDataFrame(rows, "repository string, sha string, parents array<string>, commit_ord long")
    merges = H.merge_candidates(commits).withColumnRenamed("sha", "merge_commit")
    known = {(r, s): ps for r, s, ps, _ in rows}
    order = {(r, s): o for r, s, _, o in rows}

    def above(r, s):
        out, todo = set(), [s]
        while todo:
            x = todo.pop()
            if (r, x) in known and x not in out:
                out.add(x)
                todo += known[r, x]
        return out

    def note(r, a, b):
        one, two = above(r, a), above(r, b)
        if a in two or b in one:
            return H.NOTE_PARENT_IS_BASE
        last = [max(x, key=lambda s: order[r, s]) if x else None for x in (one, two)]
        return H.NOTE_TWO_ROOTS if last[0] != last[1] else ""

    walks = []
    real = L.Layers.spread
    monkeypatch.setattr(L.Layers, "spread", lambda self, *a, **k: walks.append(1) or real(self, *a, **k))
    got = H.merge_notes(commits, merges).collect()
    assert len(got) == merges.count() > 100  # more than one word of marks in a repository
    assert {r.notes for r in got} == {"", H.NOTE_PARENT_IS_BASE, H.NOTE_TWO_ROOTS}
    assert all(r.notes == note(r.repository, r.parent_1, r.parent_2) for r in got)
    assert len(walks) == 1
