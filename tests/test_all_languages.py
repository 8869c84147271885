"""All builds in one run against a run of each build by itself."""

import random
import tempfile

from conflictlake.operators import conflicts as X
from conflictlake.operators import dataset as D
from conflictlake.operators import files as FI
from conflictlake.operators import history as H
from conflictlake.operators import metrics as M
from conflictlake.plans import all_languages as A
from tests.test_graph import C_SCHEMA, _random_dag

BUILDS = [(0, "reaper", "java", 0, 2, 3, 100, 0.4), (1, "reaper", "java", 1, 4, 50, 100, 0.25), (2, "github", "cpp", 0, 9, 4, 1, 1.0), (3, "github", "go", 5, 9, 4, 100, 0.5)]


def _tables(spark):
    rnd = random.Random(4)
    repos = [("reaper", "Java", f"j{i}", str(100 - i)) for i in range(4)] + [("github", "Cpp", f"c{i}", "7") for i in range(3)] + [("github", "Go", "g0", "1"), ("reaper", "Java", "bad", "many")]
    commits, refs, status, work, final = [], [], [], [], []
    for _, lang, name, _ in repos:
        rows, parents = _random_dag(rnd, 30, name)
        commits += rows
        refs += [(name, f"refs/heads/b{k}", f"{name}:{h}", k) for k, h in enumerate((0, 9, 3))]
        for sha, ps in parents.items():
            if len(ps) == 2:
                for path in ("src/A.java", "src/b.cpp", "src/b.h", "x.go", "B.java"):
                    key = (name, f"{name}:{sha}")
                    status.append((*key, rnd.choice(["UU", "UU", "AA"]), path))
                    work.append((*key, path, f"a{sha}\nb\n<<<<<<< L\nx{sha}\n=======\ny\n>>>>>>> R\nc\nd\n"))
                    if rnd.random() < 0.9:
                        final.append((*key, path, f"a{sha}\nb\nx{sha}{path}\nc\nd\n"))
    m = "repository string, merge_commit string, "
    return {"catalogue": spark.createDataFrame(repos, "source string, language string, repository string, stars string"),
            "commits": spark.createDataFrame(commits, C_SCHEMA), "refs": spark.createDataFrame(refs, "repository string, path string, head_sha string, ref_ord int"),
            "status": spark.createDataFrame(status, m + "xy string, path string"), "worktree": spark.createDataFrame(work, m + "path string, text string"),
            "final": spark.createDataFrame(final, m + "path string, text string")}


def _alone(t, build, language, repos, max_merges, max_branches, test_size):
    """One build with the operators of a single run."""
    mine = lambda df: df.where(df["repository"].isin(repos))
    merges = H.number_merges(H.collect_merges(mine(t["refs"]), mine(t["commits"]), None, max_merges, max_branches))
    ids = merges.select("merge_idx", "repository", "merge_commit")
    named = lambda df: df.join(ids, ["repository", "merge_commit"])
    files = FI.pair_texts(FI.conflicted_files(named(t["status"]).select("merge_idx", "xy", "path"), language), named(t["worktree"]), named(t["final"]))
    pairs = M.selected(M.metrics(X.resolved_pairs(X.extract_blocks(files.select("merge_idx", "file_no", "path", "conflict_text", "merged_text"))), keep_cols=("conflict", "resolved")))
    data = D.build_dataset(pairs, test_size, D.DEFAULT_SEED, language)
    return ({(r["merge_idx"], r["merge_commit"], r["notes"], r["branch_name"]) for r in merges.collect()},
            {(r["conflict_id"], r["question"], r["answer"], r["split"]) for r in data.collect()})


def test_one_run_equals_a_run_per_build(spark):
    d = tempfile.mkdtemp(prefix="builds-")
    t = _tables(spark)
    for k, df in t.items():
        df.write.parquet(f"{d}/{k}")
    config = spark.createDataFrame(BUILDS, A.CONFIG)
    A.build_all(spark, config, {k: f"{d}/{k}" for k in t}, f"{d}/out")
    t = {k: spark.read.parquet(f"{d}/{k}") for k in t}
    read = lambda n: spark.read.parquet(f"{d}/out/{n}")
    repos = {0: ["j0", "j1"], 1: ["j1", "j2", "j3"], 2: ["c0", "c1", "c2"], 3: []}
    chosen = {}
    for r in read("repositories").collect():
        chosen.setdefault(r["build"], []).append(r["repository"])
    assert {b: sorted(x) for b, x in chosen.items()} == {b: x for b, x in repos.items() if x}
    for build, _, language, _, _, n, branches, share in BUILDS:
        merges, data = _alone(t, build, language, repos[build], n, branches, share)
        got = read("merges").where(f"build = {build}")
        assert {(r["merge_idx"], r["merge_commit"], r["notes"], r["branch_name"]) for r in got.collect()} == merges
        rows = read("dataset").where(f"build = {build}").collect()
        assert {(r["conflict_id"], r["question"], r["answer"], r["split"]) for r in rows} == data
        assert bool(data) == bool(repos[build])
        if share not in (0, 1) and rows:
            assert sum(r["split"] == "test" for r in rows) == -(-len(rows) * int(share * 100) // 100)


def test_config_table_has_every_row(spark):
    rows = A.config_table(spark).collect()
    assert len(rows) == 12 and rows[10]["first"] == 1000 and {r["max_branches"] for r in rows} == {100}
