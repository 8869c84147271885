"""Alignment against a byte-by-byte version with the public libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P

from conflictlake.llm import alignment as A
from conflictlake.llm import tally

BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file(BYTES)
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    of = A._byte_of()
    vocab = {i: t for t, i in ta.get_vocab().items()}
    links, out = Counter(), []
    for doc, text in rows:
        if not text:
            out.append((doc, 0, 0, 0, [], ""))
            continue
        a = ta.encode(" " + text, add_special_tokens=False).ids
        b = tb.encode([text], num_threads=1)[0]
        ba = [bytes(of[c] for c in vocab[i]) for i in a]
        bb = [bytes([int(tb.id_to_piece(i)[3:-1], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + text).encode()
        if b"".join(ba) != whole or b"".join(bb) != whole:
            out.append((doc, 0, 0, 0, [], ""))
            continue
        i = j = na = nb = 0
        ga, gb, groups, mine = [], [], [], []
        while i < len(a) or j < len(b):
            if na <= nb and i < len(a):
                ga.append(a[i])
                na += len(ba[i])
                i += 1
            else:
                gb.append(b[j])
                nb += len(bb[j])
                j += 1
            if na == nb:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                mine.append((ga[-1], gb[-1]))
                ga, gb = [], []
        links.update(mine)
        out.append((doc, len(a), len(b), len(groups), mine, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, b), n in links.items():
        best[b] = max(best[b], n)
    return links, [(d, na, nb, g, len(mine), sum(links[x] == best[x[1]] for x in mine), sum(links[x] for x in mine), s) for d, na, nb, g, mine, s in out]


def corpus(seed):
    rnd = random.Random(seed)
    words = "the of and tokenization Überraschung naïve don't 12345 3.14 <|endoftext|> <s> </s> <unk> ▁ ﬁ 日本語 🙂 x\ty á ​ <0x41> \n".split(" ")
    rows = [(i, "".join(rnd.choice(words) + rnd.choice([" ", "  ", "\n", ""]) for _ in range(rnd.choice([1, 3, 30])))) for i in range(150)]
    return rows + [(None, "null id"), (1, None), (1, ""), (2, " "), (2, "\x00"), (7, "same text"), (7, "same text"), (8, "a" * 5000 + " " * 3000 + "b"), (9, "long " * 4000)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(tally, "SLICE_KEYS", 100)
    rows = corpus(1)
    links, want = brute(rows)
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n_a int, links string").repartition(4)
    found = A.Alignment(docs, BYTES, PIECES)
    assert {(r["a_id"], r["b_id"]): r["n"] for r in found.pair_counts().collect()} == links
    got = [tuple(r) for r in found.documents().collect()]
    found.delete()
    assert sorted(got, key=str) == sorted(want, key=str)


def test_fast_path_is_used():
    both = A.pair(BYTES, PIECES)
    text = "the state of the art and the rest of it"
    n_a, n_b, n, _, a, b = both.groups(text, both.b.encode([text])[0])
    assert n_a == n_b == n == 10 and (both.same[a] == b).all()


def test_inverse_hash():
    import numpy as np
    v = np.arange(0, 1 << 31, 9_999_991, dtype=np.uint64)
    assert (A._unmixed(A.W.mix(v)) == v).all()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert A.align(docs, BYTES, PIECES).collect() == []
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in A.align(docs, BYTES, PIECES).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
