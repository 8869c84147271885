"""Modified Kneser-Ney word bigrams, counted over all documents, without a bound on what is counted.

Texts are cut into blocks of a few MB.  A block asks for the corpus-wide numbers of
exactly the bigrams and words it holds: it sends its sorted 64-bit hashes to slices
of the key space, and a slice answers every block in the order of its keys.  So each
task holds the sorted hash arrays of its own block or of a slice only, the model
grows with the corpus, and no more than a few numbers a language are collected.

Bigrams ``(v, w)`` go first.  One that always follows the same word (the same of 256
classes of words, by hash) counts once, however often it occurs, any other as often
as it occurs: a passage copied a thousand times as it is teaches the model no more
than one copy.  The first block of each
bigram in its slice owns it; what the owners add up by word are the numbers of
distinct bigrams, each counted once:

    cont(w)   distinct bigrams that end in w
    total(v)  counts of the bigrams that begin with v
    freed(v)  what the discounts take from them: all of a count of 1, else D2 or D3+

    p1(w)     = max(cont(w) - D, 0) / sum of cont + share of all words alike
    p2(w | v) = max(c(v w) - D, 0) / total(v) + freed(v) / total(v) * p1(w)

What moves is kept small: numbers go as byte planes under zstd, words as 48 bits of
their hash, and the bigrams, the requests by word and the blocks that meet their
answers go in rounds (PAIR_ROUNDS and ROUNDS once there are as many slices), so that only a
part of the shuffles is on disk at a time.

A count of 1 is always taken whole (cut-off at 2), so no text predicts itself.  Both
orders sum to one.  Words of two languages are different words.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conflictlake.llm import words as W
from conflictlake.llm.common import map_arrow_lean as map_arrow
from conflictlake.llm.common import large_rows, shuffles_dropped
from conflictlake.llm.tally import SUMMARY, slice_edges, slices_for
from conflictlake.llm.tally import pack_numbers as planes
from conflictlake.llm.tally import unpack_numbers as from_planes
from conflictlake.operators.stored import Rounds, delete_path
from conflictlake.session import ensure_checkpoint_dir

START = np.uint64(0x6A09E667F3BCC909)  # hash of the mark before a text's first word
REQUEST = "slice long, block long, keys binary, vals array<binary>"
ANSWER = "block long, slice long, vals array<binary>"
UNIT = 1 << 16  # freed mass is summed in whole units, so sums do not depend on their order
PAIR_ROUNDS = 2  # each forms the bigrams of all blocks anew
ROUNDS = 16
STEP = 1 << 16  # tokens whose bigrams are formed at once
WORD_BITS = 48
SPARE_BITS = 16  # of a bigram's key, beyond those that the number of bigrams needs
_G = np.uint64(0x9E3779B97F4A7C15)
_CUT = np.uint64(64 - WORD_BITS)


def pack_numbers(values: np.ndarray) -> bytes:
    raw = planes(values)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_numbers(raw: bytes) -> np.ndarray:
    return from_planes(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True))


def pack_steps(keys: np.ndarray) -> bytes:
    """Numbers that mostly rise, by their differences (modulo 2^64)."""
    return pack_numbers(np.diff(keys, prepend=np.uint64(0)))


def unpack_steps(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(raw), dtype=np.uint64)


def keyed(code: np.ndarray, what: np.ndarray) -> np.ndarray:
    """Word hashes of one language apart from those of all others."""
    return W.mix(what.astype(np.uint64) + (code.astype(np.uint64) + np.uint64(1)) * _G)


def coded(row: np.ndarray, h: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, bytes, bytes, int]:
    """(tokens a text, distinct words, word numbers, number of distinct words) of a block; a start mark opens every text."""
    n = len(code)
    lengths = np.bincount(row, minlength=n) + 1
    hashes = np.insert(keyed(code[row], h), np.searchsorted(row, np.arange(n)), keyed(code, np.full(n, START))) >> _CUT
    known, _, at = W.distinct(hashes)
    times = np.bincount(at, minlength=len(known))
    order = np.argsort(-times, kind="stable")  # frequent words get small numbers, which pack well
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    said = np.diff(known[order], prepend=np.uint64(0)) & np.uint64((1 << WORD_BITS) - 1)  # words of one frequency rise
    return lengths, pack_numbers(said), pack_numbers(place[at]), len(known)


class Pairs:
    """Distinct words and bigrams of a block: sorted hashes, and where each token's word and bigram stand.

    ``of`` picks bigrams by their keys (default: all of them).
    """

    def __init__(self, words: bytes, tokens: bytes, lengths: np.ndarray, code: np.ndarray, short: int, of: Callable | None = None):
        known = unpack_steps(words) << _CUT
        by = np.argsort(known)
        rank = np.empty(len(by), np.int32)
        rank[by] = np.arange(len(by))
        self.words = known[by]
        self.at = rank[unpack_numbers(tokens).view(np.int64)]  # of each token among the words
        self.row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.code = np.zeros(len(known), np.int64)  # language of each word
        self.code[self.at] = code[self.row]
        first = np.ones(len(self.at), bool)
        first[1:] = self.row[1:] != self.row[:-1]
        times, top = self.words * _G, (self.words >> np.uint64(56)).astype(np.uint8)
        keys, seconds, lefts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint8)]
        for lo in range(0, len(self.at), STEP):
            i = np.flatnonzero(~first[lo:lo + STEP]) + lo  # tokens that end a bigram
            key = W.mix(times[self.at[i - 1]] + self.words[self.at[i]] + np.uint64(2)) >> np.uint64(short) << np.uint64(short)
            if of is not None:
                mine = of(key)
                key, i = key[mine], i[mine]
            # the word before the bigram; before a text's first word there is none, the word after it stands in
            left = top[self.at[np.maximum(i - 2, 0)]]
            opens = np.flatnonzero(first[i - 1])
            after = np.minimum(i[opens] + 1, len(self.at) - 1)
            left[opens] = np.where((self.row[after] != self.row[i[opens]]) | (after == i[opens]), 0, top[self.at[after]])
            for out, x in ((keys, key), (seconds, i.astype(np.int32)), (lefts, left)):
                out.append(x)
        key, left = np.concatenate(keys), np.concatenate(lefts)
        self.second = i = np.concatenate(seconds)
        del keys, seconds, lefts
        self.keys, one, self.where = W.distinct(key)
        del key
        self.n = np.bincount(self.where, minlength=len(self.keys))
        self.v, self.w = self.at[i[one] - 1], self.at[i[one]]  # words of each distinct bigram
        self.low, self.high = np.full(len(self.keys), 255, np.uint8), np.zeros(len(self.keys), np.uint8)
        np.minimum.at(self.low, self.where, left)
        np.maximum.at(self.high, self.where, left)


def short_by(keys: int) -> int:
    """Low bits that keys can do without: SPARE_BITS more than the number of keys needs leave one in 2^SPARE_BITS to collide."""
    return max(0, 64 - SPARE_BITS - int(keys).bit_length())


def slice_number(keys: np.ndarray, slices: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)


def request_rows(block: int, keys: np.ndarray, values: list[np.ndarray], slices: int, base: int = 0, short: int = 0) -> list[tuple]:
    numbers, edges = slice_edges(keys, slices)
    return [(base + int(n), block, pack_steps(keys[lo:hi] >> np.uint64(short)), [pack_numbers(v[lo:hi]) for v in values]) for n, lo, hi in zip(numbers, edges, edges[1:])]


def _batch(rows: list[tuple], kinds: tuple, names: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=list(names))


_ASK = ((pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary())), ("slice", "block", "keys", "vals"))
_TELL = ((pa.int64(), pa.int64(), pa.list_(pa.binary())), ("block", "slice", "vals"))


def _least(x: np.ndarray) -> np.ndarray:
    """Numbers below 256 as bytes, any other as int64."""
    return x.astype(np.uint8) if not len(x) or x.max() < 256 else x.view(np.int64)


def exchange(requests: DataFrame, slices: int, settle: Callable) -> DataFrame:
    """ANSWER rows of every request, and a SUMMARY row per slice.

    ``settle(values, where, n)`` gets the values of all requests of a slice and the
    number of the key of each, and returns arrays by key and the summary numbers.
    The first array is told as twice its value, plus 1 to the one block that owns the key.
    """

    def close(number: int, rows: list[tuple]) -> Iterator[tuple]:
        keys = [unpack_steps(k) for _, k, _ in rows]
        edges = np.cumsum([0, *map(len, keys)])
        joined = np.concatenate(keys)
        del keys
        every, first, where = W.distinct(joined)
        n, where = len(every), where.astype(np.int32)
        del joined, every
        values = [np.concatenate([_least(unpack_numbers(x)) for x in col]) for col in zip(*(v for _, _, v in rows))]
        out, said = settle(values, where, n)
        del values
        told = [x[where] for x in out]
        told[0] *= 2
        told[0][first] += 1
        for (block, _, _), lo, hi in zip(rows, edges, edges[1:]):
            yield block, number, [pack_numbers(x[lo:hi]) for x in told]
        yield SUMMARY, number, [",".join(map(str, said)).encode()]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, rows = None, []
        for b in batches:
            for number, block, keys, vals in zip(*(c.to_pylist() for c in b.columns)):
                if number != open_ and rows:
                    yield _batch(list(close(open_, rows)), *_TELL)
                    rows = []
                open_ = number
                rows.append((block, keys, vals))
        if rows:
            yield _batch(list(close(open_, rows)), *_TELL)

    return map_arrow(requests.repartition(-(-slices // 2), "slice").sortWithinPartitions("slice", "block"), add, ANSWER)


def summaries(told: DataFrame, width: int, group=None) -> dict[int, np.ndarray]:
    """The numbers of all slices of a group, added up by Spark (``group`` is a column of few values)."""
    said = F.split(F.decode(F.col("vals")[0], "UTF-8"), ",")
    rows = told.where(F.col("block") == SUMMARY).groupBy((F.lit(0) if group is None else group).cast("long").alias("group")).agg(
        *[F.sum(said[i].cast("long")).alias(f"n{i}") for i in range(width)]).collect()
    return {r["group"]: np.array([r[f"n{i}"] for i in range(width)], np.int64) for r in rows}


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return [int(np.count_nonzero(c == i)) for i in (1, 2, 3, 4)]


def pair_settle(values, where, n):
    count, low, wide = values
    total = np.bincount(where, count, n).astype(np.int64)
    least, most = np.full(n, 255), np.zeros(n, np.int64)
    np.minimum.at(least, where, low)
    np.maximum.at(most, where, low + wide)  # 255 at most
    total[least == most] = 1
    return [total], _counts_of_counts(total)


def word_settle(values, where, n):
    out = []
    for v in values:
        s = np.zeros(n, np.int64)
        np.add.at(s, where, v)
        out.append(s)
    return out, [*_counts_of_counts(out[0]), int((out[0] > 2).sum()), int(out[0].sum())]


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of a count of 0, 1, 2 and more, from the counts of counts 1 to 4; a count of 1 goes whole."""
    n1, n2, n3, n4 = (int(x) for x in n[:4])
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d2 = 2 - 3 * y * n3 / n2 if n2 else 1.0
    d3 = 3 - 4 * y * n4 / n3 if n3 else 1.5
    return np.array([0.0, 1.0, min(max(d2, 0.1), 1.9), min(max(d3, 0.1), 2.9)])


def ask_pairs(coded_blocks: DataFrame, slices: int, short: int, part: int = 0, parts: int = 1) -> DataFrame:
    """Requests for the bigrams of every block, of the slices whose number is ``part`` modulo ``parts``."""

    def mine(keys: np.ndarray) -> np.ndarray:
        return np.flatnonzero(slice_number(keys, slices) % np.uint64(parts) == part)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, codes, lengths, words, tokens in zip(*b.columns):
                g = Pairs(words.as_py(), tokens.as_py(), np.array(lengths.as_py(), np.int64), np.array(codes.as_py(), np.int64), short, mine if parts > 1 else None)
                rows = request_rows(block.as_py(), g.keys, [g.n, g.low, g.high - g.low], slices, short=short) if len(g.keys) else []
                del g
                if rows:
                    yield _batch(rows, *_ASK)

    return map_arrow(coded_blocks.select("block", "codes", "lengths", "words", "tokens"), ask, REQUEST)


def by_block(told: DataFrame) -> DataFrame:
    rows = told.where(F.col("block") != SUMMARY)
    return rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("slice", "vals"))).alias("answered"))


def _told(answered: list, i: int, lo: int, hi: int) -> np.ndarray:
    parts = [unpack_numbers(a["vals"][i]) for a in answered if lo <= a["slice"] < hi]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def ask_words(met: DataFrame, d: np.ndarray, short: int, pair_slices: int, word_slices: int) -> DataFrame:
    """Requests by word; the slices of the languages follow those of the bigrams."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, codes, lengths, words, tokens, answered in zip(*b.columns):
                g = Pairs(words.as_py(), tokens.as_py(), np.array(lengths.as_py(), np.int64), np.array(codes.as_py(), np.int64), short)
                told = _told(answered.as_py() or [], 0, 0, pair_slices)
                c, own, n = told >> 1, (told & 1).astype(bool), len(g.words)
                v, w, c = g.v[own], g.w[own], c[own]
                cont = np.bincount(w, minlength=n)
                total = np.bincount(v, c, n).astype(np.int64)
                freed = np.bincount(v, np.rint(d[np.minimum(c, 3)] * UNIT), n).astype(np.int64)
                rows = []
                for code in np.unique(g.code):
                    of = g.code == code
                    rows += request_rows(block.as_py(), g.words[of], [cont[of], total[of], freed[of]], word_slices, pair_slices + int(code) * word_slices, int(_CUT))
                del g, told, c, own, v, w, cont, total, freed, of
                if rows:
                    yield _batch(rows, *_ASK)

    return map_arrow(met.select("block", "codes", "lengths", "words", "tokens", "answered"), ask, REQUEST)


class Unigrams:
    """By language code: discounts of cont, sum of cont, and what every word gets alike."""

    def __init__(self, numbers: dict[int, np.ndarray], codes: int):
        n = np.array([numbers.get(c, np.zeros(6, np.int64)) for c in range(codes)])
        self.d = np.array([discounts(x) for x in n])
        self.sum = np.maximum(n[:, 5], 1).astype(float)
        types = n[:, 0] + n[:, 1] + n[:, 4]
        self.alike = (n[:, 0] + self.d[:, 2] * n[:, 1] + self.d[:, 3] * n[:, 4]) / self.sum / (types + 1)


def bits(g: Pairs, answered: list, d: np.ndarray, u: Unigrams, pair_slices: int, word_slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each word of a block after the word before it, and on its own."""
    c = _told(answered, 0, 0, pair_slices) >> 1
    cont, total, freed = (np.zeros(len(g.words), np.int64) for _ in range(3))
    for code in np.unique(g.code):
        of, lo = g.code == code, pair_slices + int(code) * word_slices
        for out, i in ((cont, 0), (total, 1), (freed, 2)):
            out[of] = _told(answered, i, lo, lo + word_slices)
    cont >>= 1
    p1 = (cont - u.d[g.code, np.minimum(cont, 3)]) / u.sum[g.code] + u.alike[g.code]
    whole = np.maximum(total[g.v], 1)
    p2 = (c - d[np.minimum(c, 3)]) / whole + freed[g.v] / UNIT / whole * p1[g.w]
    return tuple(-np.log2(np.clip(p, 1e-300, 1.0))[g.where] for p in (p2, p1[g.w]))


def _part(column: str, part: int, parts: int):
    return F.pmod(F.xxhash64(F.col(column)), F.lit(parts)) == part


def meet(blocks: DataFrame, told: DataFrame, part: int, parts: int) -> DataFrame:
    """The blocks of one round with their answers."""
    return blocks.where(_part("block", part, parts)).join(by_block(told.where(_part("block", part, parts))), "block", "left")


def model(blocks: DataFrame, n_pairs: int, n_words: int, codes: int):
    """(rounds of told blocks, scorer, tables to delete when done) of blocks with columns block, codes, lengths, words, tokens.

    A round has rows of ``blocks`` and their answers, each block is in one round; ``scorer(codes,
    lengths, words, tokens, answered)`` gives the bits of each text of a row, by bigrams and
    by single words.
    """
    spark = blocks.sparkSession
    pair_slices, word_slices = slices_for(n_pairs), slices_for(n_words)
    halves, rounds = min(PAIR_ROUNDS, pair_slices), min(ROUNDS, pair_slices)
    short = short_by(n_pairs)
    with shuffles_dropped(spark), large_rows(spark):
        pairs, words = Rounds(spark, "kn-pairs"), Rounds(spark, "kn-words")
        for r in range(halves):
            pairs.add(exchange(ask_pairs(blocks, pair_slices, short, r, halves), -(-pair_slices // halves), pair_settle))
        told = pairs.read()
        d = discounts(summaries(told, 4).get(0, np.zeros(4, np.int64)))
        asked = f"{ensure_checkpoint_dir(spark)}/kn-asked-{uuid.uuid4().hex}"
        for r in range(rounds):
            asks = ask_words(meet(blocks, told, r, rounds), d, short, pair_slices, word_slices)
            asks.withColumn("part", F.pmod("slice", F.lit(rounds))).write.partitionBy("part").mode("append").parquet(asked)
        for r in range(rounds):
            mine = spark.read.schema(f"{REQUEST}, part long").parquet(asked).where(F.col("part") == r).drop("part")
            words.add(exchange(mine, -(-codes * word_slices // rounds), word_settle))
            delete_path(spark, f"{asked}/part={r}")
        delete_path(spark, asked)
    u = Unigrams(summaries(words.read(), 6, F.floor((F.col("slice") - pair_slices) / word_slices)), codes)

    def scorer(codes_, lengths, words_, tokens, answered) -> list[np.ndarray]:
        g = Pairs(words_, tokens, lengths, codes_, short)
        return [np.bincount(g.row[g.second], each, len(lengths)) for each in bits(g, answered or [], d, u, pair_slices, word_slices)]

    both = told.union(words.read())
    return [meet(blocks, both, r, rounds) for r in range(rounds)], scorer, [pairs, words]
