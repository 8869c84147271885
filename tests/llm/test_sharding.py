import hashlib
import random

import pytest

from conflictlake.llm import sharding as S


def brute(rows, limit):
    """Split one bucket at a time, bit by bit of the key's hash."""
    todo, out = [("", list(rows))], {}
    while todo:
        name, group = todo.pop()
        if sum(b for _, b in group) <= limit or len(group) == 1 or len(name) == 60:
            out[name] = group
            continue
        for bit in "01":
            part = [x for x in group if f"{int(hashlib.md5(str(x[0]).encode()).hexdigest()[:15], 16):060b}"[len(name)] == bit]
            if part:
                todo.append((name + bit, part))
    return out


@pytest.mark.parametrize("limit", [50, 2000, 10 ** 9])
def test_splits(spark, limit):
    rng = random.Random(1)
    rows = [(i, "é" * rng.choice([0, 1, 5, 40, 200])) for i in range(1500)]
    docs = spark.createDataFrame([(i, t, "a", "b", 7) for i, t in rows], "doc_id long, text string, bucket string, shard string, bytes int").repartition(4)
    got = {}
    for r in S.shards(docs, limit).collect():
        got.setdefault(r["shard"], []).append((r["doc_id"], r["n_bytes"]))
        assert r["shard_depth"] == len(r["shard"])
    want = brute([(i, 2 * len(t)) for i, t in rows], limit)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_hot_key_and_nulls(spark):
    rows = [(5, "same text")] * 400 + [(None, None), (None, "n"), (None, "x" * 500)] + [(5, f"t{i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = S.shards(docs, 100).collect()
    assert len(out) == len(rows)
    sums = {}
    for r in out:
        sums.setdefault(r["shard"], []).append(r["n_bytes"])
    assert all(sum(v) <= 100 or len(v) == 1 for v in sums.values())
    assert all(sum(sums[r["shard"]]) == r["shard_bytes"] and len(sums[r["shard"]]) == r["shard_rows"] for r in out)


def test_empty(spark):
    assert S.shards(spark.createDataFrame([], "doc_id long, text string"), 10).collect() == []
