import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conflictlake.llm import packing

PATH = P.path("byte_bpe_50k.json")


def one_by_one(lengths, cap, docs, cost, rule="norm", w=(1.0, 1e-6, 1e-6)):
    """Plain vector best-fit decreasing, item by item."""
    size = np.array([cap, docs, cost], float)
    bins = []
    for n in sorted(lengths, reverse=True):
        item = np.array([n, 1, n * n], float)
        best = None
        for i, b in enumerate(bins):
            if (b >= item).all():
                s = (((b - item) / size) ** 2 * w).sum() if rule == "norm" else -(b * item / size ** 2 * w).sum()
                if best is None or s < best[0] - 1e-15:
                    best = (s, i)
        if best is None:
            bins.append(size - item)
        else:
            bins[best[1]] -= item
    return len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("docs,cost", [(64, 64 * 64), (3, 64 * 64), (64, 2000.0 + 64 * 64 / 2)])
def test_plan_is_best_fit(docs, cost, rule):
    rng = np.random.default_rng(5)
    for _ in range(20):
        x = rng.integers(1, 40, rng.integers(1, 200))
        c = {int(k): int(n) for k, n in zip(*np.unique(x, return_counts=True))}
        plan = packing.best_fit_plan(c, 64, docs, cost, rule)
        got = {}
        for length, rank, n, each, lo, off in plan.tolist():
            for i in range(n):
                for k in range(each):
                    got.setdefault(lo + i, []).append((off + k * length, length))
        assert sorted(n for v in got.values() for _, n in v) == sorted(x.tolist())
        for v in got.values():
            at = 0
            for off, n in sorted(v):
                assert off == at
                at += n
            assert at <= 64 and len(v) <= docs and sum(n * n for _, n in v) <= cost
        want = one_by_one(x.tolist(), 64, docs, cost, rule)
        assert abs(len(got) - want) <= (1 if rule == "norm" else 3)


def test_too_large_piece_is_refused():
    with pytest.raises(ValueError):
        packing.best_fit_plan({10: 1}, 20, 4, 50.0)


def test_documents(spark):
    texts = ["", None, "a", "it's ² x", "word " * 900, "b c " * 5000, "a", "a"]
    rows = [(i, t, "l", "x", 0) for i, t in enumerate(texts)] + [(2, "a", "l", "x", 0), (None, "n", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cell string, rank string, local int")
    pieces = packing.token_pieces(docs, PATH, with_ids=True, keep=["cell", "rank", "local"])
    out = [r.asDict() for r in packing.pack(pieces).collect()]
    tok = Tokenizer.from_file(PATH)
    want = []
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or min(len(ids), 1024)
        edges = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, k, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())) for k, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, ((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out))) == sorted(map(key, want))
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in seqs.values():
        at = 0
        for off, n in sorted(v):
            assert off == at
            at += n
        assert at <= 1024
    assert len(seqs) == one_by_one([w[3] for w in want], 1024, 1024, 1024.0 ** 2)
    whole = packing.sequences(packing.pack(pieces)).where(F.size("ids") > 1024).count()
    assert whole == 0


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.token_pieces(docs, PATH)).collect() == []
