import random
import re

import public_tokenizers as P
import pytest

from conflictlake.llm import token_counts as T

PATH = P.path("piece_bpe_32k.model")


def brute(word, scores, byte_score):
    """Best segmentation by plain dynamic programming, one word at a time."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        options = [(best[end - 1][0] + byte_score * n, -best[end - 1][1] - n)]
        options += [(best[at][0] + scores[word[at:end]], -best[at][1] - 1) for at in range(end) if word[at:end] in scores]
        s, few = max(options)
        best.append((s, -few))
    return best[-1][1]


def every_split(word, scores):
    if not word:
        return [(0.0, 0)]
    return [(scores[word[:i]] + s, n - 1) for i in range(1, len(word) + 1) if word[:i] in scores for s, n in every_split(word[i:], scores)]


def test_terminal_counts():
    rng = random.Random(2)
    scores = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))): float(-rng.randrange(1, 9)) for _ in range(25)} | {"a": -4.0, "b": -5.0}
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(0, 11))) for _ in range(300)}
    got = T.terminal_counts(list(words), scores, -100.0)
    for w in words:
        assert got[w] == -max(every_split(w, scores))[1] == brute(w, scores, -100.0)


@pytest.mark.parametrize("stored", [300_000, 3])
def test_documents(spark, monkeypatch, stored):
    monkeypatch.setattr(T, "STORED", stored)
    texts = [None, "", " \n", "The the theme them", "中文 ü \U0001f600 a\xa0b", "x" * 3000, "naïve café " * 2000, "the", "the"]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, __text int").repartition(2)
    scores, byte_score = T.piece_scores(PATH)
    got = {r["doc_id"]: (r[1], r[2]) for r in T.token_counts(docs, PATH, keep=["doc_id"]).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        each = {x: brute(T.MARK + x, scores, byte_score) for x in set(w)}
        assert got[i] == (len(w), sum(each[x] for x in w))
    assert T.token_counts(docs.limit(0), PATH, keep=["doc_id"]).collect() == []
