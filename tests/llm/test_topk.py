import math

import numpy as np
import pytest

from conflictlake.llm import topk as T


def brute(rows, k, every=20):
    good = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in good if j != i and len(c) == len(q))
            out += [(i, n + 1, j, -v) for n, (v, j) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [0.2, 3e3, 1e6])
def test_against_all_pairs(spark, monkeypatch, scale):
    monkeypatch.setattr(T, "QUERY_BLOCK", 7)
    monkeypatch.setattr(T, "CANDIDATE_BLOCK", 150)
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, scale, 8)]) for i in range(420)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)]  # ties
    rows += [(2000 + i, [float(x) for x in range(3)]) for i in range(25)]  # another dimension
    rows += [(3000, None), (3020, []), (3040, [None] * 8), (3060, [float("nan")] * 8), (3080, [float("inf")] * 8), (None, rows[0][1]), (5, rows[9][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, dim int").repartition(4)
    got = sorted(tuple(r) for r in T.top_k(df).collect())
    assert got == brute(rows, 20)


def test_bounds_decide_without_reading_all():
    """Clustered data: most queries end before the lists do, with the same result."""
    rng = np.random.default_rng(2)
    centre = rng.integers(-30, 30, (12, 16))
    c = centre[rng.integers(0, 12, 3000)] + rng.integers(-1, 2, (3000, 16))
    ids = np.arange(3000)
    for r, at, score in T.best(c[:40], ids[:40], c, ids, 20):
        s = c @ c[r]
        want = np.lexsort((ids[ids != r], -s[ids != r]))[:20]
        assert ids[at].tolist() == ids[ids != r][want].tolist() and score.tolist() == s[ids != r][want].tolist()


def test_reading_goes_on_until_bounds_decide():
    """Vectors without clusters: no query needs the scores of all candidates."""
    rng = np.random.default_rng(4)
    c = np.floor(64 * rng.normal(0, 1 / 8, (2000, 64))).astype(np.int64)
    ids = np.arange(2000)
    for scale in (1, 10 ** 12):  # the second beyond 53 bits
        left = T.survivors(c[:50] * scale, c * scale, ids[:50, None] == ids, 20)
        assert all(20 <= len(rows) <= 125 and read < 2000 for rows, read in left)
        for r, at, score in T.best(c[:50] * scale, ids[:50], c * scale, ids, 20):
            s = [int(x) * scale ** 2 for x in c @ c[r]]
            want = sorted((j for j in range(2000) if j != r), key=lambda j: (-s[j], j))[:20]
            assert at.tolist() == want and [int(x) for x in score] == [s[j] for j in want]


def test_empty_and_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert T.top_k(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(r) for r in T.top_k(spark.createDataFrame([(0, [1.0]), (7, [0.5])], schema)).collect()] == [(0, 1, 7, 2048)]
