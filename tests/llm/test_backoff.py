"""Backoff automaton against a direct recursion over Python dictionaries."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from conflictlake.llm import backoff as B
from conflictlake.llm import tally

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, order, strength):
    texts = [[*WORD.findall(lower(t or "")), "</s>"] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    counts = [Counter() for _ in range(order)]
    learnt = 0
    for words, h in zip(texts, held):
        if h:
            continue
        learnt += 1
        padded = ["<s>"] * (order - 1) + words
        for k in range(order):
            for i in range(order - 1, len(padded)):
                counts[k][tuple(padded[i - k:i + 1])] += 1
    n, v = sum(counts[0].values()), len(counts[0])

    def history(h):
        return learnt if set(h) == {"<s>"} else counts[len(h) - 1][h]

    def p(h, w):
        if not h:
            return (counts[0][w,] + 1) / (n + v + 1)
        return (counts[len(h)][(*h, w)] + strength * p(h[1:], w)) / (history(h) + strength)

    out = []
    for (i, _), words, h in zip(rows, texts, held):
        padded = ["<s>"] * (order - 1) + words
        score = sum(math.log10(p(tuple(padded[k - order + 1:k]), padded[k])) for k in range(order - 1, len(padded)))
        base = sum(math.log10((counts[0][w,] + 1) / (n + v + 1)) for w in words)
        out.append((i, h, len(words), sum(counts[0][w,] > 0 for w in words), n, base, score))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    vocab = ["a", "B", "b", "the", "The", "é", "x" * 50, "word", "#", "</s>", "…"]
    rows = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([0, 1, 2, 5, 40])))) for i in range(120)]
    return rows + [(None, "a b"), (3, None), (3, ""), (4, "\n\t a\x0bthe  "), (5, " ".join(f"w{i % 700}" for i in range(9000))), (900, "new words here")]


def same(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[6], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_recursion(spark, monkeypatch, order):
    """Blocks of a few texts and slices of a few keys, so that every text meets counts of others."""
    monkeypatch.setattr(B, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(tally, "SLICE_KEYS", 500)
    rows = corpus(order)
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, score double, held string").repartition(4)
    # the tests' word list has the end token's spelling; a word is never the end of a text
    want = brute([(i, t and t.replace("</s>", "<//s>")) for i, t in rows], order, 7.0)
    same([tuple(r) for r in B.score(docs, order, 7.0).collect()], want)


def test_sums_to_one(spark):
    """Over all words of a small vocabulary, the class of unknown words and the end."""
    train = [(0, "a b a c"), (1, "b a"), (3, "c")]
    vocab = ["a", "b", "c", "unknown", ""]
    asked = [(1000 + i, f"a b {w}") for i, w in enumerate(vocab)]
    docs = spark.createDataFrame([(*r, False) for r in train] + [(*r, True) for r in asked], "doc_id long, text string, h boolean")
    got = {r["doc_id"]: r["score"] for r in B.score(docs, 2, 3.0, held=docs["h"]).collect()}
    end = got[1004]  # "a b" and the end
    p = brute([(i, t) for i, t in train], 2, 3.0)
    assert len(p) == 3
    # p(w | b) of each word: the text's score less that of "a b", less the end after w
    from collections import defaultdict
    counts = defaultdict(Counter)
    for _, t in train:
        w = ["<s>", *t.split(), "</s>"]
        for x, y in zip(w, w[1:]):
            counts[x][y] += 1
    n = sum(len(t.split()) + 1 for _, t in train)
    one = lambda w: (sum(c[w] for c in counts.values()) + 1) / (n + 4 + 1)
    two = lambda h, w: (counts[h][w] + 3 * one(w)) / (sum(counts[h].values()) + 3)
    total = 0.0
    prefix = math.log10(two("<s>", "a") * two("a", "b"))
    for i, w in enumerate(vocab[:-1]):
        total += 10 ** (got[1000 + i] - prefix) / two(w, "</s>")
    total += 10 ** (end - prefix)
    assert abs(total - 1) < 1e-9


def test_no_training_text_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b"), (2, None)], "doc_id long, text string")
    from pyspark.sql import functions as F
    got = {r["doc_id"]: tuple(r)[1:] for r in B.score(docs, held=F.lit(True)).collect()}
    assert got == {None: (True, 3, 0, 0, 0.0, 0.0), 2: (True, 1, 0, 0, 0.0, 0.0)}
    assert B.score(docs.limit(0)).collect() == []


def test_packing_round_trip():
    import numpy as np
    rnd = random.Random(3)
    for n in (0, 1, 2, 1000):
        v = np.array([rnd.getrandbits(rnd.choice([1, 8, 30, 63])) for _ in range(n)], np.uint64)
        assert (tally.unpack_numbers(tally.pack_numbers(v)) == v).all()
        k = np.unique(np.array([rnd.getrandbits(64) for _ in range(n)], np.uint64))
        if n:
            assert (tally.unpack_sorted(tally.pack_sorted(k)) == k).all()
            at, edges = tally.slice_edges(k, 7)
            assert edges[0] == 0 and edges[-1] == len(k) and (np.diff(at) > 0).all() and at.max() < 7


def test_blocks_are_handed_over_one_at_a_time(spark, monkeypatch):
    from conflictlake.llm import common
    handed, most = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    real = B.map_arrow

    def watched(df, fn, schema):
        def run(batches):
            def each():
                for b in batches:
                    handed.add(1)
                    most.add(int(b.num_rows > 1))
                    yield b
            yield from fn(each())
        return real(df, run, schema) if "answered" in df.columns else real(df, fn, schema)

    monkeypatch.setattr(B, "map_arrow", watched)
    monkeypatch.setattr(B, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(common, "BATCH_BYTES", 1)
    rows = [(i, f"w{i} " * 400) for i in range(60)]
    out = B.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).count()
    assert out == 60 and handed.value >= 60 and most.value == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None
