"""Runs on stored state: a new head, a raised cap, an unfinished run, repositories left alone."""

import os
import random
import tempfile

from conflictlake.operators import history as H
from conflictlake.operators.layers import Layers
from conflictlake.operators.stored import Stored
from conflictlake.streaming.collection import MergeStore
from tests.test_graph import C_SCHEMA, _random_dag

R_SCHEMA = "repository string, path string, head_sha string, ref_ord int"


def _history(spark, seed=3, repos=4, n=60):
    rnd = random.Random(seed)
    rows = []
    for r in range(repos):
        rows += _random_dag(rnd, n, f"owner/r{r}")[0]
    return spark.createDataFrame(rows, C_SCHEMA)


def _refs(spark, heads):
    return spark.createDataFrame([(r, f"refs/heads/b{i}", f"{r}:{h}", i) for r, hs in heads.items() for i, h in enumerate(hs)], R_SCHEMA)


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def _found(df):
    return {(r["repository"], r["merge_commit"], r["notes"]) for r in df.collect()}


def test_one_new_head_touches_one_repository(spark):
    commits = _history(spark)
    old = {f"owner/r{r}": [30, 45] for r in range(4)}
    new = {**old, "owner/r2": [30, 45, 2]}
    path = tempfile.mkdtemp(prefix="store-")
    store = MergeStore(spark, path)
    assert store.collect(_refs(spark, old), commits, 1000) == 4
    before = _files(path)
    assert store.collect(_refs(spark, old), commits, 1000) == 0 and _files(path) == before
    plan = Stored(store.due(H.branch_refs(_refs(spark, new)), 1000), "plan").df
    read = store._counted("labels", "sha string, ref_rank long, branch_name string, run string, repository string", plan)
    assert "dynamicpruning" in read._jdf.queryExecution().toString()
    assert store.collect(_refs(spark, new), commits, 1000) == 1
    after = _files(path)
    changed = {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)}
    assert changed and all("r2" in f for f in changed)
    assert {f for f in changed if "/status/" not in f} <= after.keys() - before.keys()  # labels and merges only grow
    assert _found(store.merges()) == _found(H.collect_merges(_refs(spark, new), commits, None, 1000))
    labels = [(r["repository"], r["sha"]) for r in store.labels().collect()]
    assert len(labels) == len(set(labels))
    assert {r["complete"] for r in store.status().collect()} == {True}
    pos = {}
    for r in store.merges().collect():
        pos.setdefault(r["repository"], []).append(r["pos"])
    assert all(sorted(p) == list(range(len(p))) for p in pos.values())


def test_raised_cap_takes_what_was_left_out(spark):
    commits = _history(spark, 5, 3)
    refs = _refs(spark, {f"owner/r{r}": [0, 7] for r in range(3)})
    store = MergeStore(spark, tempfile.mkdtemp(prefix="store-"))
    store.collect(refs, commits, 4)
    assert {(r["n_merges"], r["complete"]) for r in store.status().collect()} == {(4, False)}
    first = [(r["repository"], r["pos"], r["merge_commit"]) for r in store.merges().collect()]
    assert store.collect(refs, commits, 4) == 0
    assert store.collect(refs, commits, 9) == 3
    want = H.collect_merges(refs, commits, None, 9)
    assert _found(store.merges()) == _found(want)
    got = [(r["repository"], r["pos"], r["merge_commit"]) for r in store.merges().collect()]
    assert set(first) <= set(got)
    branch = {(r["repository"], r["merge_commit"]): r["branch_name"] for r in want.collect()}
    assert {(r["repository"], r["merge_commit"]): r["branch_name"] for r in store.merges().collect()} == branch


def test_run_without_status_does_not_count(spark, monkeypatch):
    commits = _history(spark, 6, 2)
    refs = _refs(spark, {f"owner/r{r}": [10] for r in range(2)})
    store = MergeStore(spark, tempfile.mkdtemp(prefix="store-"))
    append = MergeStore._append

    def lost(self, df, name):
        append(self, df, name)
        if name == "merges":
            raise RuntimeError("driver lost before the status was written")

    monkeypatch.setattr(MergeStore, "_append", lost)
    try:
        store.collect(refs, commits, 50)
    except RuntimeError:
        pass
    monkeypatch.setattr(MergeStore, "_append", append)
    assert store.merges().collect() == [] and store.labels().collect() == []
    store.collect(refs, commits, 50)
    assert _found(store.merges()) == _found(H.collect_merges(refs, commits, None, 50))


def test_empty_tables(spark):
    store = MergeStore(spark, tempfile.mkdtemp(prefix="store-"))
    assert store.collect(spark.createDataFrame([], R_SCHEMA), spark.createDataFrame([], C_SCHEMA)) == 0
    assert store.merges().collect() == [] and store.status().collect() == []


def test_first_run_lays_the_history_out_once(spark, monkeypatch):
    from conflictlake.streaming import collection as C
    made = []
    monkeypatch.setattr(C, "Layers", lambda commits: made.append(1) or Layers(commits))
    commits = _history(spark, n=30)
    refs = _refs(spark, {f"owner/r{r}": [10, 2] for r in range(4)})
    store = MergeStore(spark, tempfile.mkdtemp(prefix="store-"))
    store.collect(refs, commits, 3)
    assert made == [1]
    assert _found(store.merges()) == _found(H.collect_merges(refs, commits, None, 3))
