import random
import re

import pytest
from pyspark.sql import functions as F

from conflictlake.llm import mixing


def shares(sizes, weights, percent=150, times=2):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, got, free = sum(sizes.values()) * percent / 100, {}, set(names)
    while free:
        level = (total - sum(got.values())) / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > times * sizes[s]]
        if not over:
            got.update({s: level * w[s] for s in free})
            break
        for s in over:
            got[s] = times * sizes[s]
            free.discard(s)
    return got


def corpus():
    rng = random.Random(4)
    rows = []
    for i in range(900):
        src = rng.choices(["a", "B", "é", "", None, "src10", "src9"], [40, 10, 8, 1, 5, 20, 3])[0]
        n = rng.choice([0, 1, 5, 30, 30, 30, 400])
        rows.append((i, rng.choice([" ", "\n\t", "\x0b"]).join("w%d" % rng.randrange(9) for _ in range(n)) if n else rng.choice(["", None, " \n"]), src))
    return rows + [(5, "same row here", "a")] * 300 + [(None, "no id", "B")] * 3 + [(9999, "x " * 50_000, "a")]


SCHEMA = "doc_id long, text string, source string, cell string, size string, target int, copies int"


def test_mix(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "k", "k", 1, 2) for r in rows], SCHEMA).repartition(5)
    out = [r.asDict() for r in mixing.mix(docs, [5, 2, 1]).collect()]
    assert sorted(str((r["doc_id"], r["source"])) for r in out) == sorted(str((d, s)) for d, _, s in rows)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, longest = {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
        longest[s] = max(longest.get(s, 0), count(t))
    want = shares(sizes, [5, 2, 1])
    taken = {}
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * longest[s] + 1, s
    again = mixing.mix(docs.repartition(3, "text"), [5, 2, 1])
    key = lambda r: str((r["doc_id"], r["source"], r["size"], r["copies"]))
    assert sorted(map(key, (r.asDict() for r in again.collect()))) == sorted(map(key, out))
    rows_out = mixing.mixed_documents(docs, [5, 2, 1])
    assert rows_out.columns == docs.columns
    assert rows_out.count() == sum(r["copies"] for r in out)
    got = {r["source"]: r["n"] for r in rows_out.groupBy("source").agg(F.sum(mixing.word_count("text")).alias("n")).collect()}
    assert {s: n for s, n in got.items() if n} == {s: n for s, n in taken.items() if n}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs, [5, 2, 1]).collect() == []
    assert mixing.mixed_documents(docs, [5, 2, 1]).collect() == []
