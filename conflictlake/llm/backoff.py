r"""Language-model scores of texts by a weighted backoff automaton.

Words are ``[^\x20\x09-\x0D]+`` with A-Z lower-cased; an end token closes every
text.  The model is a word n-gram model whose orders are smoothed into each other
by a Dirichlet prior (hierarchical Dirichlet model): with c the training counts,

    p1(w)     = (c(w) + 1) / (N + V + 1)
    pk(w | h) = (c(h w) + strength * p(k-1)(w | h')) / (c(h) + strength)

where h' is h without its first word.  All words that training does not know are
one class of count 0.  Every order sums to one.

Read as an automaton: a state is a history that training has seen, the empty
history is the root.  A seen n-gram is an arc with its log-probability, which
leads to the longest seen history that ends the n-gram.  Where a state has no arc
for a word, its failure arc costs log(strength / (c(h) + strength)) and leads to
the state of h'.  One left-to-right traversal carries the state and adds up.

The corpus is cut into blocks of texts.  Counts are made of every n-gram of all
training texts, none is left out; they go through ``tally``, which tells each
block the corpus-wide counts of exactly the n-grams that its texts hold.  So a
task needs its own part of the automaton only, and nothing that grows with the
corpus is collected or broadcast but three numbers (N, V and the training texts).
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conflictlake.llm import words as W
from conflictlake.llm.common import byte_column, chunks, large_rows, map_arrow_lean as map_arrow
from conflictlake.llm.tally import SUMMARY, answers, by_block, pack_numbers, request_rows, slices_for, unpack_numbers
from conflictlake.operators.stored import Stored

BLOCK_BYTES = 4 << 20
END = np.uint64(0x9AE16A3B2F90404F)  # hash of the end token
BEGIN = np.uint64(0xC949D7C7509E6557)  # hash of a history before the first word
STRENGTH = 300.0


def held_out(id_col: str, parts: int = 7, part: int = 2):
    """Whether a document is kept from training: CRC-32 of its id as text (null: empty)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(parts)) == part


def blocks(docs: DataFrame, id_col: str, text_col: str, held) -> DataFrame:
    """Texts as word numbers: block, ids, lengths, held, words (hash by number), tokens.

    A block holds about BLOCK_BYTES of text, a longer text is a block of its own.
    Numbers stand in the order of falling frequency, so they pack well.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), held.alias("held"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"block long, ids array<{kind}>, lengths array<int>, held array<boolean>, words binary, tokens binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for b in batches:
            raw, off, _ = byte_column(b.column(1))
            for lo, hi in chunks(off, BLOCK_BYTES):
                n = hi - lo
                row, _, _, h = W.hash_words(W.LOWER[raw[off[lo]:off[hi]]], off[lo:hi + 1] - off[lo])
                lengths = np.bincount(row, minlength=n) + 1
                hashes = np.insert(h, np.searchsorted(row, np.arange(n), "right"), END)  # after each text's last word
                known, at, times = np.unique(hashes, return_inverse=True, return_counts=True)
                order = np.argsort(-times, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                one = np.array([0, n], np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), pa.ListArray.from_arrays(one, b.column(0)[lo:hi]), pa.ListArray.from_arrays(one, pa.array(lengths, pa.int32())),
                    pa.ListArray.from_arrays(one, b.column(2)[lo:hi]), pa.array([known[order].tobytes()]), pa.array([pack_numbers(place[at])])],
                    names=["block", "ids", "lengths", "held", "words", "tokens"])
                number += 1

    return map_arrow(source, cut, schema)


class Grams:
    """The n-grams of a block: per order the sorted distinct hashes, where each token's n-gram is among them, and one place of each."""

    def __init__(self, words: bytes, tokens: bytes, lengths: np.ndarray, order: int):
        self.tokens = unpack_numbers(tokens).astype(np.int64)
        self.n_words = len(words) // 8
        self.first = np.zeros(len(self.tokens), bool)
        self.first[np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)] = True
        known = np.frombuffer(words, np.uint64)
        by = np.argsort(known)
        rank = np.empty(len(by), np.int32)
        rank[by] = np.arange(len(by), dtype=np.int32)
        one = level = known[self.tokens]
        self.keys, self.where, self.at = [known[by]], [rank[self.tokens]], []
        for k in range(2, order + 1):
            before = np.empty_like(level)
            before[1:] = level[:-1]
            before[self.first] = BEGIN + np.uint64(k)
            level = W.mix(before * np.uint64(0x9E3779B97F4A7C15) + one + np.uint64(k))
            keys, where = np.unique(level, return_inverse=True)
            self.keys.append(keys)
            self.where.append(where.astype(np.int32))
        for keys, where in zip(self.keys, self.where):
            at = np.empty(len(keys), np.int64)
            at[where] = np.arange(len(where))
            self.at.append(at)


def _counts(coded: DataFrame, order: int, slices: list[int]) -> DataFrame:
    """REQUEST rows: training counts of every n-gram of every block; the slices of the orders follow each other."""
    base = np.cumsum([0, *slices])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, lengths, held, words, tokens in zip(*(c for c in b.columns)):
                n = np.array(lengths.as_py(), np.int64)
                g = Grams(words.as_py(), tokens.as_py(), n, order)
                learnt = np.repeat(~np.array(held.as_py(), bool), n)
                rows = []
                for k in range(order):
                    counts = np.bincount(g.where[k], learnt, len(g.keys[k])).astype(np.uint64)
                    rows += request_rows(block.as_py(), g.keys[k], counts, slices[k], int(base[k]))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                                                 names=["slice", "block", "keys", "counts"])

    return map_arrow(coded.select("block", "lengths", "held", "words", "tokens"), ask, "slice long, block long, keys binary, counts binary")


class Automaton:
    """States, arcs and failure arcs of the part of the model that the n-grams of one block can use."""

    def __init__(self, g: Grams, counts: list[np.ndarray], n_tokens: int, n_types: int, n_texts: int, strength: float):
        order = len(counts)
        p = [(counts[0] + 1.0) / (n_tokens + n_types + 1.0)]
        word = [g.tokens[at] for at in g.at]
        seen = [c > 0 for c in counts]
        # state numbers: 0 the root, then the seen histories by order, then the histories before a first word
        self.begin = [0]
        state, size = [], 1
        for k in range(order - 1):
            s = np.zeros(len(counts[k]), np.int64)
            s[seen[k]] = np.arange(size, size + int(seen[k].sum()))
            size += int(seen[k].sum())
            state.append(s)
        for _ in range(order - 1):
            self.begin.append(size)
            size += 1
        fail, back = np.zeros(size, np.int64), np.zeros(size)
        for k, s in enumerate(state):
            known = seen[k]
            back[s[known]] = np.log10(strength / (counts[k][known] + strength))
            if k:
                fail[s[known]] = state[k - 1][g.where[k - 1][g.at[k][known]]]
        for k in range(1, order):
            back[self.begin[k]], fail[self.begin[k]] = np.log10(strength / (n_texts + strength)), self.begin[k - 1]
        # the root has an arc for every word; an unknown one leads back to the root
        by_word = np.empty(len(counts[0]), np.int64)
        by_word[word[0]] = np.arange(len(word[0]))
        self.root_cost = np.log10(p[0])[by_word].tolist()
        self.root_goto = (state[0][by_word] if order > 1 else np.zeros(len(by_word), np.int64)).tolist()
        keys, costs, gotos = [], [], []
        for k in range(1, order):
            at = g.at[k]
            starts = g.first[at]
            before = g.where[k - 1][np.maximum(at - 1, 0)]
            history = np.where(starts, n_texts, counts[k - 1][before])
            lower = g.where[k - 1][at]
            p.append((counts[k] + strength * p[k - 1][lower]) / (history + strength))
            source = np.where(starts, self.begin[k], state[k - 1][before])
            target = state[k] if k < order - 1 else state[k - 1][lower]
            known = seen[k]
            keys.append((source * g.n_words + word[k])[known])
            costs.append(np.log10(p[k][known]))
            gotos.append(target[known])
        none = [np.zeros(0, np.int64)]
        self.arcs = dict(zip(np.concatenate(keys or none).tolist(), range(sum(map(len, keys)))))
        self.cost, self.goto = (array(t, np.concatenate(x or none).astype(d).tobytes()) for t, x, d in (("d", costs, np.float64), ("q", gotos, np.int64)))
        self.fail, self.back, self.n_words = fail.tolist(), back.tolist(), g.n_words

    def score(self, tokens: list[int]) -> float:
        """Log10 probability of one text, in one traversal from its begin."""
        find, n, cost, goto, fail, back = self.arcs.get, self.n_words, self.cost, self.goto, self.fail, self.back
        root_cost, root_goto = self.root_cost, self.root_goto
        state, total = self.begin[-1], 0.0
        for w in tokens:
            while state:
                arc = find(state * n + w)
                if arc is not None:
                    total += cost[arc]
                    state = goto[arc]
                    break
                total += back[state]
                state = fail[state]
            else:
                total += root_cost[w]
                state = root_goto[w]
        return total


def score(docs: DataFrame, order: int = 2, strength: float = STRENGTH, id_col: str = "doc_id", text_col: str = "text", held=None) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held`` marks the documents that are scored only (default: CRC-32 of the id).
    A null text is an empty one: its single token is the end.  Repeated rows are
    texts like any other and count as often as they occur; null ids are ids.  A
    word that training does not know has count 0.  Without any training text every
    token has probability one.  An empty table gives an empty table.  Other columns
    of ``docs`` are not read, whatever their names.
    """
    held = held_out(id_col) if held is None else F.coalesce(held, F.lit(False))
    spark = docs.sparkSession
    coded = Stored(blocks(docs, id_col, text_col, held), "lm-blocks")
    size = coded.df.agg(F.sum(F.size("lengths")), F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")),
                        F.sum(F.size(F.filter("held", lambda x: ~x))), F.sum(F.expr("length(words) div 8"))).first()
    n_tokens, n_texts, n_types = (size[i] or 0 for i in (1, 2, 3))
    # a block has at most as many n-grams of an order as tokens, and of order 1 as words
    slices = [slices_for(n_types), *[slices_for(n_tokens)] * (order - 1)]
    types = slices[0]

    def summary(number: int, keys: np.ndarray, totals: np.ndarray) -> bytes:
        return f"{np.count_nonzero(totals)},{totals.sum()}".encode() if number < types else b""

    with large_rows(spark):
        told = Stored(answers(_counts(coded.df, order, slices), sum(slices), summary), "lm-counts")
    said = F.split(F.decode("totals", "UTF-8"), ",")
    sums = told.df.where((F.col("block") == SUMMARY) & (F.col("slice") < types)).select(
        said[0].cast("long").alias("types"), said[1].cast("long").alias("tokens"))
    v, n = (x or 0 for x in sums.agg(F.sum("types"), F.sum("tokens")).first())
    kind = coded.df.schema["ids"].dataType.elementType.simpleString()
    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    edge = np.cumsum([0, *slices])

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, lengths, held_, words, tokens, answered = (c[i] for c in b.columns)
                length = np.array(lengths.as_py(), np.int64)
                g = Grams(words.as_py(), tokens.as_py(), length, order)
                parts = [[] for _ in range(order)]
                for a in answered.as_py():
                    parts[int(np.searchsorted(edge, a["slice"], "right")) - 1].append(unpack_numbers(a["totals"]))
                counts = [np.concatenate(x).astype(np.float64) for x in parts]
                known = counts[0][g.where[0]]
                row = np.repeat(np.arange(len(length)), length)
                base = np.bincount(row, np.log10((known + 1.0) / (n + v + 1.0)), len(length))
                hit = np.bincount(row, known > 0, len(length)).astype(np.int64)
                a = Automaton(g, counts, n, v, n_texts, strength)
                ends = np.cumsum(length)
                total = [a.score(g.tokens[e - k:e].tolist()) for e, k in zip(ends.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([ids.values, held_.values, pa.array(length), pa.array(hit), pa.array(np.full(len(length), n, np.int64)),
                                                  pa.array(base), pa.array(total, pa.float64())],
                                                 names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                del a, g, counts, parts, answered  # before the next block is read

    met = coded.df.join(by_block(told.df), "block").select("ids", "lengths", "held", "words", "tokens", "answered")
    with large_rows(spark):
        out = Stored(map_arrow(met, traverse, schema), "lm-scores")
    coded.delete()
    told.delete()
    return out.df
