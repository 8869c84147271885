import random
import re

import pytest

from conflictlake.llm import ngram_join as J


def grams(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, percent):
    s = [grams(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s[i]), least.get(find(i)) if s[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    rows, base = [], [[rng.choice(words) for _ in range(rng.choice([3, 8, 40, 120]))] for _ in range(25)]
    for i in range(220):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 7])):
            t[rng.randrange(len(t))] = rng.choice(words)
        if rng.random() < 0.3:
            at = rng.randrange(len(t))
            t[at:at] = passage
        sep = rng.choice([" ", "\n", "\t\x0b"])
        rows.append((i * 7 % 223, sep.join(w.upper() if rng.random() < 0.1 else w for w in t)))
    hot = [rng.choice(words) for _ in range(100)]
    for i in range(60):
        t = list(hot)
        t[rng.randrange(100)] = rng.choice(words)
        rows.append((1000 + i, " ".join(t)))
    return rows + [(500, None), (501, ""), (502, " \n"), (503, "Solo"), (504, "solo"), (505, "é\xa0ü"), (3, rows[0][1]), (None, "solo"), (None, "nobody else"), (7, "x y z"), (7, "x y z")]


@pytest.mark.parametrize("n,percent,cell", [(4, 85, 256), (5, 80, 8), (1, 50, 16)])
def test_components(spark, monkeypatch, n, percent, cell):
    monkeypatch.setattr(J, "CELL", cell)
    rows = corpus(n)
    docs = spark.createDataFrame([(d, t, "a", "b", 1) for d, t in rows], "doc_id long, text string, cid string, size string, label int").repartition(5)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.join(docs, n, percent).collect()]
    assert sorted(got, key=str) == brute(rows, n, percent)


def test_one_of_each(spark):
    rows = corpus(9)
    docs = spark.createDataFrame([(d, t, "a", 5) for d, t in rows], "doc_id long, text string, cid string, size int").repartition(4)
    out = J.one_of_each(docs)
    assert out.columns == docs.columns
    kept = sorted((r["doc_id"] for r in out.collect()), key=str)
    # one row of each component, not of each smallest id: two components may share one
    parts = J.join(docs, 5, 80).where("n_shingles > 0").select("label", "component_id").distinct().collect()
    want = brute(rows, 5, 80)
    assert {r["component_id"] for r in parts} == {c for _, n, c in want if n}
    assert kept == sorted([*(r["component_id"] for r in parts), *(d for d, n, _ in want if not n)], key=str)


def test_one_of_each_keeps_columns_whatever_their_names(spark):
    rows = [(i, f"word{i % 3} " * 3 + " ".join(f"x{i % 3}y{j}" for j in range(30)), 100 + i, f"n{i}", 7, 8) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long, `hash` string, `least` int, `__d` int")
    out = J.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == rows[:3]


def test_one_of_each_goes_by_component_not_by_id(spark):
    """A repeated id does not merge unlinked documents; near copies without ids leave one row."""
    say = lambda w, n=40: " ".join(f"{w}{i}" for i in range(n))
    rows = [(7, say("a")), (7, say("b")), (9, say("b") + " end"), (7, say("b")), (None, say("c")), (None, say("c") + " end"), (None, say("d")), (0, say("d")), (None, say("e"))]
    out = J.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = sorted(((r["doc_id"], r["text"].split()[0]) for r in out), key=str)
    assert got == sorted([(7, "a0"), (7, "b0"), (None, "c0"), (0, "d0"), (None, "e0")], key=str)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert J.join(docs).collect() == []
    assert J.one_of_each(docs).collect() == []
