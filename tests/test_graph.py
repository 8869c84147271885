"""Reachability labels on random DAGs and a deep chain against brute force."""

import random

import pytest

from conflictlake.operators import history as H

C_SCHEMA = "repository string, sha string, parents array<string>, commit_ord long"


def _random_dag(rnd, n, repo):
    """Commits 0..n-1, 0 newest; parents are older commits (first parent
    usually the next one, so chains are long)."""
    rows, parents = [], {}
    for i in range(n):
        ps = []
        if i < n - 1 and rnd.random() < 0.9:
            ps.append(i + 1 if rnd.random() < 0.7 else rnd.randint(i + 1, n - 1))
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            if i < n - 1:
                q = rnd.randint(i + 1, n - 1)
                if q not in ps:
                    ps.append(q)
        parents[i] = ps
        rows.append((repo, f"{repo}:{i}", [f"{repo}:{q}" for q in ps], i))
    return rows, parents


def _ancestors(parents, i):
    seen, stack = set(), [i]
    while stack:
        x = stack.pop()
        if x in seen:
            continue
        seen.add(x)
        stack.extend(parents[x])
    return seen


def _brute(parents, heads):
    first = {}
    for rank, h in enumerate(heads):
        for x in _ancestors(parents, h):
            first.setdefault(x, rank)
    oldest = {i: max(_ancestors(parents, i)) for i in parents}
    return first, oldest


@pytest.mark.parametrize("seed", [5, 6])
def test_labels_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows, expect = [], {}
    for r in range(6):
        repo = f"r{r}"
        n = rnd.randint(5, 40)
        rr, parents = _random_dag(rnd, n, repo)
        rows += rr
        heads = rnd.sample(range(n), min(3, n))
        expect[repo] = (heads, *_brute(parents, heads))
    commits = spark.createDataFrame(rows, C_SCHEMA)
    refs = spark.createDataFrame([(repo, f"{repo}:{h}", k) for repo, (hs, _, _) in expect.items()
                                  for k, h in enumerate(hs)], "repository string, head_sha string, ref_rank int")
    got = {(r.repository, r.sha): r.ref_rank for r in H.first_reaching_ref(commits, refs).collect()}
    old = {(r.repository, r.sha): r.oldest for r in H.oldest_ancestor(commits).collect()}
    for repo, (_, first, oldest) in expect.items():
        assert {k[1]: v for k, v in got.items() if k[0] == repo} == {f"{repo}:{i}": v for i, v in first.items()}
        for i, o in oldest.items():
            assert old[(repo, f"{repo}:{i}")] == f"{repo}:{o}"


def test_deep_chain_with_merges(spark, monkeypatch):
    """A 3000-commit first-parent chain with side branches merged back: stretches
    are contracted, so the rounds stored grow with log2 of the stretch and the
    number of merges, not with 3000; superseded rounds are deleted."""
    from conflictlake.operators import stored
    n, rows = 3000, []
    for i in range(n):
        ps = [f"c{i + 1}"] if i < n - 1 else []
        if i % 500 == 0 and i + 2 < n:
            ps.append(f"s{i}")
            rows.append(("r", f"s{i}", [f"c{i + 2}"], 2 * i + 1))
        rows.append(("r", f"c{i}", ps, 2 * i))
    commits = spark.createDataFrame(rows, C_SCHEMA)
    refs = spark.createDataFrame([("r", "c0", 0), ("r", "s1000", 1)], "repository string, head_sha string, ref_rank int")
    made, gone = [], []
    write, delete = stored.Stored.__init__, stored.Stored.delete
    monkeypatch.setattr(stored.Stored, "__init__", lambda self, *a: (write(self, *a), made.append(self.path))[0])
    monkeypatch.setattr(stored.Stored, "delete", lambda self: (delete(self), gone.append(self.path))[0])
    got = {r.sha: r.ref_rank for r in H.first_reaching_ref(commits, refs).collect()}
    assert len(got) == n + 6 and got["c2999"] == 0 and got["s1000"] == 0
    assert len(made) <= 40 and len(gone) >= len(made) // 3
    made.clear()
    old = {r.sha: r.oldest for r in H.oldest_ancestor(commits).collect()}
    assert old["c0"] == "c2999" and old["s500"] == "c2999"
    assert len(made) <= 40


def test_wanted_commits_only(spark):
    rnd = random.Random(11)
    rows, parents = _random_dag(rnd, 40, "r")
    commits = spark.createDataFrame(rows, C_SCHEMA)
    ask = [0, 7, 21, 39]
    wanted = spark.createDataFrame([("r", f"r:{i}") for i in ask], "repository string, sha string")
    got = {r.sha: r.oldest for r in H.oldest_ancestor(commits, wanted).collect()}
    assert got == {f"r:{i}": f"r:{max(_ancestors(parents, i))}" for i in ask}


def test_ancestor_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "WORD", 5)
    rnd = random.Random(9)
    rows, pairs, expect = [], [], {}
    for r in range(5):
        repo = f"r{r}"
        n = rnd.randint(5, 40)
        rr, parents = _random_dag(rnd, n, repo)
        rows += rr
        for q in range(6):
            a, b = sorted(rnd.sample(range(n), 2))
            pid = f"{repo}-{q}"
            pairs.append((repo, pid, f"{repo}:{a}", f"{repo}:{b}"))
            expect[pid] = b in _ancestors(parents, a)
        pairs.append((repo, f"{repo}-back", f"{repo}:{n - 1}", f"{repo}:0"))
        pairs.append((repo, f"{repo}-self", f"{repo}:1", f"{repo}:1"))
        expect[f"{repo}-back"], expect[f"{repo}-self"] = False, True
    commits = spark.createDataFrame(rows, C_SCHEMA)
    pdf = spark.createDataFrame(pairs, "repository string, pair_id string, start string, target string")
    assert {r.pair_id: r.is_ancestor for r in H.ancestor_pairs(commits, pdf).collect()} == expect
