"""Exact Jaccard join of documents on word n-gram sets, as a grouped prefix join.

Two documents link when ``100 * |A & B| >= percent * |A | B|``.  With the
n-grams of every document in one global order, linked documents share an n-gram
among their first ``|A| - ceil(percent * |A| / 100) + 1`` (the prefix).  The order
is by falling hash, n-grams that are frequent in the corpus last: an n-gram of a
passage that many documents share thus rarely gets into a prefix.

1. Documents with equal n-gram sets form a *class*, classes with equal prefix
   and size a *group*; only one row per group posts its prefix.
2. The postings of an n-gram form a *list*; lists of one group go, the others
   are expanded to their classes, and the classes of a group are a list too.
3. Every class picks a *head*: the class that leads most of its lists (the one in
   most lists leads a list), if they share as many prefix n-grams as the threshold
   implies.  Classes with a common head form a cluster, and clusters are verified
   in blocks of CELL classes: a task takes the whole sets of a block and its head
   and gets all overlaps at once as a matrix product.  Only edges that connect
   something leave the task.  What is still apart in a cluster of several blocks is
   verified block against block, without its largest component against itself.
4. Pairs from different clusters in different components, which a list brings
   together early enough in both to share as many lists as the threshold implies,
   are verified one by one, if counts by part of the hash space leave it possible.

So a group of copies costs rows in proportion to its size, and no link between
components is lost.

N-grams are 64-bit hashes.  Verification intersects whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conflictlake.llm import words as W
from conflictlake.llm.common import byte_column, chunks, lean, map_arrow_lean as map_arrow, settled, settled_with, temp_name, text_batches
from conflictlake.operators.stored import Stored

SLOTS, BLOCK, FAN = 1 << 20, 1 << 12, 256
SIEVE_BITS = 1 << 24
GROUP_WEIGHT = 1 << 20  # classes of one group share their whole prefix
CELL = 256
PARTS = 256  # of the hash space, a power of two
CHUNK = 2 << 20  # bytes of text whose n-grams are in memory at once


def shingles(raw: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the ``n``-word runs of each text, A-Z in lower case; a shorter text is one run."""
    row, _, _, h = W.hash_words(W.LOWER[raw], off)
    full = W.runs(h, n)
    at = np.flatnonzero(row[:len(full)] == row[n - 1:]) if len(full) else np.zeros(0, np.int64)
    rows, hashes = [row[at]], [full[at]]
    count = np.bincount(row, minlength=len(off) - 1)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            rows.append(short)
            hashes.append(W.runs(h, k, seed=1000 + k)[first[short]])
    return np.concatenate(rows), np.concatenate(hashes)


def _source(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(text.alias("t"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tkey"))


def frequency_levels(docs: DataFrame, n: int) -> np.ndarray:
    """How far above the mean each hash slot's n-gram count is, over all documents (log2, 0 for most).

    Every task counts its n-grams in a table of fixed size; the tables are added
    up by slot ranges in two rounds, at most FAN of them in a group; what more than
    FAN * FAN tasks leave is added up here, row by row.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            raw, off, _ = byte_column(b.column(0))
            for lo, hi in chunks(off, CHUNK):
                h = shingles(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], n)[1]
                total += np.bincount((h & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        parts = total.reshape(-1, BLOCK)
        some = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([TaskContext.get().partitionId()] * len(some), pa.int32()),
                                          pa.array([parts[i].tobytes() for i in some], pa.binary())], names=["block", "part", "counts"])

    def add(t: pa.Table) -> pa.Table:
        whole = np.zeros(BLOCK, np.int64)
        for x in t["counts"]:
            whole += np.frombuffer(x.as_buffer(), np.int64)
        return pa.table({"block": t["block"].slice(0, 1), "part": pa.array([t["part"][0].as_py() // FAN], pa.int32()), "counts": pa.array([whole.tobytes()], pa.binary())})

    schema = "block int, part int, counts binary"
    sums = map_arrow(docs.select(F.col("text").cast("string").alias("t")), count, schema)
    for _ in range(2):
        sums = sums.groupBy("block", F.floor(F.col("part") / FAN).alias("g")).applyInArrow(add, schema)
    total = np.zeros(SLOTS, np.int64)
    with text_batches(docs.sparkSession):
        for r in sums.toLocalIterator():  # SLOTS numbers in all
            total[r["block"] * BLOCK:(r["block"] + 1) * BLOCK] += np.frombuffer(r["counts"], np.int64)
    usual = 4 * max(total.mean(), 4.0)
    return np.clip(np.floor(np.log2(np.maximum(total, 1) / usual)) + 1, 0, 63).astype(np.uint8)


def _ordered(row: np.ndarray, h: np.ndarray, level: np.ndarray):
    """Distinct n-grams of each row in the global order: (row, order key, hash)."""
    key = (level[(h & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (h >> np.uint64(6))
    by = np.lexsort((key, row))
    row, key, h = row[by], key[by], h[by]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new], h[new]


def _running(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])


SIGNED = "doc_id long, tkey long, cid long, size int, phash long, last long, prefix binary"


def signatures(docs: DataFrame, n: int, percent: int, levels) -> DataFrame:
    """Per document: class id (0: no n-gram), set size, prefix, and the place of its last n-gram in the order."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for b in batches:
            raw, off, _ = byte_column(b.column(0))
            for lo, hi in chunks(off, CHUNK):
                row, key, h = _ordered(*shingles(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], n), level)
                m = hi - lo
                size = np.bincount(row, minlength=m)
                first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                take = np.where(size > 0, size + (-percent * size // 100) + 1, 0)

                one, two = _running(h), _running(W.mix(h ^ np.uint64(0x5851F42D4C957F2D)))
                cid = W.mix((one[first[1:]] - one[first[:-1]]) ^ W.mix(two[first[1:]] - two[first[:-1]] + size.astype(np.uint64)))
                cid = np.where(size > 0, cid | np.uint64(1), 0)
                pre = _running(W.mix(key))
                phash = W.mix(pre[first[:-1] + take] - pre[first[:-1]])
                end = first[:-1] + take
                last = np.where(take > 0, np.append(key, np.uint64(0))[np.maximum(end - 1, 0)] >> np.uint64(1), 0)
                prefix = [key[a:a + k].tobytes() for a, k in zip(first[:-1].tolist(), take.tolist())]
                yield pa.RecordBatch.from_arrays([b.column(1)[lo:hi], b.column(2)[lo:hi], pa.array(cid.view(np.int64)), pa.array(size.astype(np.int32)),
                                                  pa.array(phash.view(np.int64)), pa.array(last.astype(np.int64)), pa.array(prefix, pa.binary())],
                                                 names=["doc_id", "tkey", "cid", "size", "phash", "last", "prefix"])

    return map_arrow(_source(docs), sign, SIGNED)


def _lists(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, entries): the classes with their group, and the lists that several classes share."""
    some = signed.where("size > 0")
    classes = some.groupBy("cid").agg(F.first("size").alias("size"), F.first("phash").alias("phash"), F.first("last").alias("last"), F.min("doc_id").alias("least"),
                                      F.min(F.struct("doc_id", "tkey")).alias("source"))
    heads = classes.groupBy("phash", "size").agg(F.min("cid").alias("gid"), F.count("*").alias("n_classes"))
    classes = settled(classes.join(heads, ["phash", "size"]), "classes")
    posting = some.groupBy("phash", "size").agg(F.min("cid").alias("gid"), F.first("prefix").alias("prefix"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off, _ = byte_column(b.column(1))
            n = np.diff(off) // 8
            for lo, hi in chunks(off, CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data[off[lo]:off[hi]].tobytes(), np.int64)),
                                                  pa.array(np.repeat(b.column(0).to_numpy()[lo:hi], n[lo:hi]))], names=["list", "gid"])

    posts = map_arrow(posting.select("gid", "prefix"), expand, "list long, gid long")
    shared = settled(posts.withColumn("n", F.count("*").over(Window.partitionBy("list"))).where("n > 1").drop("n"), "shared")
    shared = shared.withColumn("lists", F.count("*").over(Window.partitionBy("gid")))  # of the group, so of each of its classes
    by_ngram = shared.join(classes.select("gid", "cid", "size", "last"), "gid").select("list", "cid", "size", "last", F.lit(1).alias("weight"), "lists")
    by_group = classes.where("n_classes > 1").select(F.xxhash64(F.lit("group"), "gid").alias("list"), "cid", "size", "last", F.lit(GROUP_WEIGHT).alias("weight"), F.lit(GROUP_WEIGHT).cast("long").alias("lists"))
    return classes, settled(by_ngram.unionByName(by_group), "entries")


def _needed(percent: int):
    """How many prefix n-grams two linked sets share at least, and whether the sizes allow a link.

    Up to the earlier of the two prefix ends, every common n-gram is in both
    prefixes; past it, the set whose prefix ends there has only its rest to share.
    """
    overlap = F.ceil(percent * (F.col("size") + F.col("other")) / (100 + percent) - 1e-9)
    mine, its = (F.ceil(percent * F.col(c) / 100 - 1e-9) - 1 for c in ("size", "other"))
    rest = F.when(F.col("last") < F.col("its_last"), mine).when(F.col("last") > F.col("its_last"), its).otherwise(F.greatest(mine, its))
    return F.greatest(overlap - rest, F.lit(1)), 100 * F.least("size", "other") >= percent * F.greatest("size", "other")


def _sieve(keys: DataFrame) -> np.ndarray:
    """A bit map of fixed size with the bit of every key set."""
    slot = F.col("tkey").bitwiseAND(F.lit(SIEVE_BITS - 1))
    rows = keys.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast((tkey & {SIEVE_BITS - 1}) % 64 as int))").alias("bit"))
    out = np.zeros(SIEVE_BITS // 64, np.int64)
    for r in rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():  # SIEVE_BITS / 64 rows at most
        out[r["word"]] = r["bits"]
    return out.view(np.uint64)


def _wanted_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(t, cid): the text of one document of each wanted class.

    A bit map of the wanted texts' hashes leaves out most other texts before the
    join, which is exact.  Rows that repeat a document are in one task after the
    join and go there."""
    spark = docs.sparkSession
    keys = settled(wanted.select(F.coalesce("source.doc_id", F.lit(0)).alias("k"), F.col("source.tkey").alias("tkey"), "cid"), "wanted")
    sieve = spark.sparkContext.broadcast(_sieve(keys))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = b.column(1).to_numpy().view(np.uint64) & np.uint64(SIEVE_BITS - 1)
            word = sieve.value[(slot >> np.uint64(6)).astype(np.int64)]
            yield b.filter(pa.array(((word >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)))

    src = _source(docs).select("t", "tkey", F.coalesce("doc_id", F.lit(0)).alias("k"))
    rows = map_arrow(src, thin, src.schema).join(keys, ["k", "tkey"])
    return rows.dropDuplicates(["k", "tkey", "cid"]).select("t", "cid")


def _distinct(raw: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of each text: (row, hash), and where each row begins and ends."""
    row, h = shingles(raw, off, n)
    by = np.lexsort((h, row))
    row, h = row[by], h[by]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h = row[new], h[new]
    return row, h, np.searchsorted(row, np.arange(len(off)))


def sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(cid, ngrams): the sorted n-gram hashes of each wanted class."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off, _ = byte_column(b.column(0))
            for lo, hi in chunks(off, CHUNK):
                _, h, edge = _distinct(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], n)
                yield pa.RecordBatch.from_arrays([b.column(1)[lo:hi], pa.array([h[x:y].tobytes() for x, y in zip(edge, edge[1:])], pa.binary())], names=["cid", "ngrams"])

    with text_batches(docs.sparkSession):
        return settled(map_arrow(_wanted_texts(docs, wanted), collect, "cid long, ngrams binary"), "sets")


def could_link(docs: DataFrame, pairs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that a count of n-grams by part of the hash space does not rule out.

    Two sets share at most the smaller count of each of PARTS parts, so a pair
    whose sum of these stays below the overlap it needs cannot link.  That takes
    a kilobyte a class in place of its whole set."""
    met = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "cid")
    wanted = classes.join(met, "cid", "left_semi").select("cid", "source")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off, _ = byte_column(b.column(0))
            for lo, hi in chunks(off, CHUNK):
                row, h, _ = _distinct(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], n)
                parts = np.bincount(row * PARTS + (W.mix(h) >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64), minlength=(hi - lo) * PARTS).astype("<u4")
                width = 4 * PARTS
                data = parts.tobytes()
                yield pa.RecordBatch.from_arrays([b.column(1)[lo:hi], pa.array([data[i * width:(i + 1) * width] for i in range(hi - lo)], pa.binary())], names=["cid", "parts"])

    with text_batches(docs.sparkSession):
        counted = settled(map_arrow(_wanted_texts(docs, wanted), count, "cid long, parts binary"), "parts")
    both = pairs.join(counted.select(F.col("cid").alias("a"), F.col("parts").alias("x")), "a").join(
        counted.select(F.col("cid").alias("b"), F.col("parts").alias("y")), "b").select("a", "b", "x", "y")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), "<u4").reshape(-1, PARTS).astype(np.int64) for c in batch.columns[2:])
            most, whole = np.minimum(x, y).sum(1), x.sum(1) + y.sum(1)
            yield batch.select([0, 1]).filter(pa.array(100 * most >= percent * (whole - most)))

    return settled(map_arrow(both, test, "a long, b long"), "possible")


def _sets(col) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in col]


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("ngrams").alias("x")), "a").join(
        sets.select(F.col("cid").alias("b"), F.col("ngrams").alias("y")), "b").select("a", "b", "x", "y")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_sets(batch.column(2)), _sets(batch.column(3))):
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                same = int((y[at] == x).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both, test, "a long, b long")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """|x & y| of every x of ``left`` and y of ``right``, some thousand n-grams at a time."""
    gram = np.concatenate([*left, *right])
    side = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    by = np.argsort(gram, kind="stable")
    gram, side = gram[by], side[by]
    new = np.concatenate([[True], gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1 if len(gram) else new
    gram_column, side = column[shared], side[shared]
    _, column = np.unique(gram_column, return_inverse=True)
    out = np.zeros((len(left), len(right)), np.float32)
    width, at = 4096, 0
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        to = np.searchsorted(column, lo + width)
        m = np.zeros((len(left) + len(right), width), np.float32)
        m[side[at:to], column[at:to] - lo] = 1
        out += m[:len(left)] @ m[len(left):].T
        at = to
    return out


def cell_links(cells: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect the classes of each cell.

    ``cells``: (head, i, j, cid, left, right, label, ngrams), at most about twice
    CELL rows a cell.  Classes on the left are compared with those on the right.
    """

    def verify(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        cid, label = t["cid"].to_numpy(), t["label"].to_numpy()
        is_left, is_right = (np.asarray(t[c]) for c in ("left", "right"))
        sets = _sets(t["ngrams"].chunk(0) if t.num_rows else [])
        size = np.array([len(x) for x in sets], np.int64)
        li, ri = np.flatnonzero(is_left), np.flatnonzero(is_right)
        same = _overlaps([sets[i] for i in li], [sets[i] for i in ri]).astype(np.int64) if len(li) and len(ri) else np.zeros((len(li), len(ri)), np.int64)
        ok = 100 * same >= percent * (size[li][:, None] + size[ri][None, :] - same)
        up = {x: x for x in label.tolist()}

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        a, b = [], []
        for x, y in zip(*np.nonzero(ok)):
            u, v = top(int(label[li[x]])), top(int(label[ri[y]]))
            if u != v:  # an edge only if it connects
                up[u] = v
                a.append(cid[li[x]])
                b.append(cid[ri[y]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.groupBy("head", "i", "j").applyInArrow(lean(verify), "a long, b long")


def components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (cid, label) after joining what ``edges`` (a, b) connect; a component has its smallest label.

    Each round hooks every component to its smallest neighbour and shortens the
    resulting trees to stars by pointer jumping; edges inside a component go.
    """
    edges, told = settled_with(edges, "links", n=F.count("*"))
    if not told["n"]:
        return labels
    while True:
        e = edges.join(labels.select(F.col("cid").alias("a"), F.col("label").alias("la")), "a").join(
            labels.select(F.col("cid").alias("b"), F.col("label").alias("lb")), "b").where("la <> lb")
        hook, told = settled_with(e.select(F.greatest("la", "lb").alias("u"), F.least("la", "lb").alias("v")).groupBy("u").agg(F.min("v").alias("v")), "hooks", n=F.count("*"))
        if not told["n"]:
            return labels
        while True:
            up = hook.select(F.col("u").alias("v"), F.col("v").alias("top"))
            hook, told = settled_with(hook.join(up, "v", "left").select("u", F.coalesce("top", "v").alias("v"), "top"), "jump", moved=F.count("top"))
            hook = hook.drop("top")
            if not told["moved"]:
                break
        labels = settled(labels.join(hook.select(F.col("u").alias("label"), F.col("v").alias("to")), "label", "left").select(
            "cid", F.coalesce("to", "label").alias("label")), "labels")


def join(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, and the keys tkey (hash of the text), class_id and label.

    ``component_id`` is the smallest doc_id that links reach.  A null text or one
    without words has no n-gram, links with nothing and is its own component.
    Rows with a null doc_id take part; a component of such rows only has a null
    id.  Rows that repeat an id are documents of their own, so two components may
    have one ``component_id``; ``label`` (a class_id, null without n-grams) tells
    them apart.
    """
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs, n))
    with text_batches(docs.sparkSession):
        whole = Stored(signatures(docs, n, percent, levels), "signed")
    classes, entries = _lists(whole.df)
    signed = settled(whole.df.select("doc_id", "tkey", "cid", "size"), "documents")
    whole.delete()  # the prefixes are in the lists now
    need, fits = _needed(percent)
    per_list = Window.partitionBy("list")
    led = entries.withColumn("head", F.min(F.struct(-F.col("lists"), F.xxhash64("cid"), "cid", "size", "last")).over(per_list))
    star = led.where("cid <> head.cid").select("cid", "size", "last", "weight", F.col("head.cid").alias("to"), F.col("head.size").alias("other"), F.col("head.last").alias("its_last"))
    star = star.groupBy("cid", "to", "size", "other", "last", "its_last").agg(F.sum("weight").alias("common")).where(fits & (F.col("common") >= need))
    heads = settled(star.groupBy("cid").agg(F.max(F.struct("common", "to")).alias("best")).select("cid", F.col("best.to").alias("head")), "heads")
    members = settled(heads.union(heads.select(F.col("head").alias("cid"), "head").distinct()), "members")
    labels = settled(entries.select("cid").distinct().withColumn("label", F.col("cid")), "labels")
    sets = sets_of(docs, classes.join(members.select("cid").distinct(), "cid", "left_semi").select("cid", "source"), n)
    blocks = members.groupBy("head").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks"))
    placed = settled(members.join(blocks, "head").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")), "placed")

    # each block with its head: the head is a member of one block and joins the others
    others = placed.where("cid = head").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("head", "cid", "i")
    own = placed.where("cid <> head").select("head", "cid", F.col("block").alias("i")).unionByName(others)
    cells = own.withColumn("j", F.col("i")).join(sets, "cid").withColumns({"left": F.lit(True), "right": F.lit(True), "label": F.col("cid")})
    labels = components(labels, cell_links(cells, percent))

    # clusters of several blocks: what is not in the largest component, block against block
    wide = placed.where("blocks > 1").join(labels, "cid")
    most = wide.groupBy("head", "label").agg(F.count("*").alias("n")).groupBy("head").agg(F.max(F.struct("n", "label")).alias("m"), F.count("*").alias("parts"))
    wide = wide.join(most.where("parts > 1").select("head", F.col("m.label").alias("largest")), "head").withColumn("minor", F.col("label") != F.col("largest"))
    wide, told = settled_with(wide.select("head", "cid", "label", "block", "blocks", "minor"), "wide", n=F.count("*"))
    if told["n"]:
        minors = wide.where("minor").groupBy("head").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
        both = wide.join(minors, "head")
        row = ["head", "cid", "label"]
        left = both.where("minor").withColumn("i", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = both.withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cells = left.select(*row, "i", "j", F.lit(True).alias("left"), F.lit(False).alias("right")).unionByName(
            right.select(*row, "i", "j", F.lit(False).alias("left"), F.lit(True).alias("right")))
        labels = components(labels, cell_links(cells.join(sets, "cid"), percent))

    # across clusters
    led = entries.join(labels, "cid").join(heads, "cid", "left").withColumn("head", F.coalesce("head", "cid"))
    # two classes that share ``need`` of their lists share one of the first ``reach - need + 1`` of either, in any order of the lists
    led = led.withColumn("reach", F.count_if(F.col("weight") == 1).over(Window.partitionBy("cid"))).withColumn(
        "nth", F.row_number().over(Window.partitionBy("cid").orderBy("weight", "list"))).drop("lists")
    led = led.withColumn("lo", F.min("label").over(per_list)).withColumn("hi", F.max("label").over(per_list)).where("lo <> hi").drop("lo", "hi")
    mine = settled(led, "open")
    its = mine.select("list", F.col("cid").alias("to"), F.col("label").alias("label2"), F.col("size").alias("other"), F.col("last").alias("its_last"),
                      F.col("head").alias("head2"), F.col("reach").alias("its_reach"), F.col("nth").alias("its_nth"))
    early = (F.col("weight") > 1) | ((F.col("nth") + need <= F.col("reach") + 1) & (F.col("its_nth") + need <= F.col("its_reach") + 1))
    rest = mine.join(its, "list").where((F.col("label") < F.col("label2")) & (F.col("head") != F.col("head2")) & (F.col("head") != F.col("to")) & (F.col("head2") != F.col("cid"))
                                        & fits & early)
    pairs, told = settled_with(rest.select(F.col("cid").alias("a"), F.col("to").alias("b")).distinct(), "pairs", n=F.count("*"))
    if told["n"]:
        pairs = could_link(docs, pairs, classes, n, percent)
        met = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "cid")
        sets = sets_of(docs, classes.join(met, "cid", "left_semi").select("cid", "source"), n)
        labels = components(labels, linked(pairs, sets, percent))

    named = classes.select("cid", "least").join(labels, "cid", "left").select("cid", "least", F.coalesce("label", "cid").alias("label"))
    comps = named.groupBy("label").agg(F.min("least").alias("component_id"))
    found = named.join(comps, "label").select("cid", "component_id", "label")
    own = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return signed.join(found, "cid", "left").select("doc_id", F.col("size").cast("long").alias("n_shingles"), own.alias("component_id"), "tkey", F.col("cid").alias("class_id"),
                                                    F.when(F.col("size") > 0, F.col("label")).alias("label"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: a row with its smallest id (same columns).

    Documents without n-grams all stay; of components without any id one row stays.
    """
    rows = settled(join(docs, n, percent), "components")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "tkey"))
    id_, hash_, least, nth = (temp_name(docs, c) for c in ("id", "hash", "least", "nth"))
    key = rows.where("n_shingles > 0").groupBy("label").agg(first.alias("pick")).select(F.col("pick.doc_id").alias(id_), F.col("pick.tkey").alias(hash_))
    names = [F.col(f"`{c}`") for c in docs.columns]
    text = F.col("text").cast("string")
    src = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(hash_, F.xxhash64(text))
    src = src.withColumn(least, F.coalesce(id_, F.lit(0)))
    bare = ~F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keep = key.select(F.coalesce(id_, F.lit(0)).alias(least), hash_).distinct()
    order = Window.partitionBy(least, hash_).orderBy(F.col(id_).asc_nulls_last())
    first = src.where(~bare).join(keep, [least, hash_], "left_semi").withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1)
    return first.select(*names).unionByName(src.where(bare).select(*names))
