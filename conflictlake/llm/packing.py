"""Best-fit packing of documents into token sequences.

Vector best-fit: a sequence has three residual capacities (tokens, documents,
attention cost = sum of squared lengths); pieces are placed in order of falling
length, each into the open sequence where it fits in every dimension and that
scores best, by the norm of what would stay free or by the weighted dot product
of piece and residual.  A piece that fits nowhere opens a new sequence.

Only lengths matter to that decision, and a length is at most ``capacity``.  So
Spark counts the pieces of each length, the driver packs *counts* (sequences in
the same state are one entry, at most ``capacity`` lengths come in), and the
plan - a few numbers per run of equal placements - tells each piece its place by
its rank among the pieces of its length.  The packing is that of one global
best-fit run, yet no task and no driver ever sees more than a histogram.

Ranks are counted inside (length, bucket) cells, buckets by a hash of the
document, so a length that a third of all pieces share is spread like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conflictlake.llm import bpe
from conflictlake.llm.common import map_arrow, settled, temp_name, text_batches

END_ID = 2
CELL_ROWS = 8192

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
                 keep: list[str] | None = None) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: the text's ids and the end id, cut from the back.

    Only longer documents are cut; all pieces but the first are full.  A null
    text is an empty one (its single token is the end id).  Rows are independent:
    a repeated row gives repeated pieces.  ``keep`` lists columns to carry along,
    ``with_ids`` adds the ids themselves as ``ids``.  One narrow pass, text by text.
    """
    keep = keep or []
    cols = [F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"), *[F.col(c) for c in keep]]
    source = docs.select(*cols)
    schema = PIECES + (", ids array<int>" if with_ids else "")
    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[2:])
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = bpe.load(tokenizer)
        for b in batches:
            out, ids, src = [], [], []
            for i, (doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
                raw = tok.id_bytes(text.as_py() or "") + end
                n = len(raw) // 4
                first = n % capacity or min(n, capacity)
                edges = [0, *range(first, n + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
                    part = raw[4 * lo:4 * hi]
                    out.append((doc, k, lo, hi - lo, zlib.crc32(part)))
                    src.append(i)
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            if not out:
                continue
            arrays = [pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            take = pa.array(src)
            yield pa.RecordBatch.from_arrays(arrays + [b.column(2 + j).take(take) for j in range(len(keep))], names=names + keep)

    return map_arrow(source, cut, schema + extra)


def best_fit_plan(counts: dict[int, int], capacity: int, max_docs: int, max_cost: float,
                  rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6)) -> np.ndarray:
    """Vector best-fit over a histogram of lengths.

    Returns rows (length, first rank, sequences, copies per sequence, first
    sequence, offset): the pieces of that length with rank in
    [first, first + sequences * copies) fill consecutive sequences from the
    offset on.  A piece placed where the residual scores best leaves that
    sequence an even better fit for the next equal piece, so equal pieces fill a
    sequence before the next one is touched, exactly as one by one.
    """
    w = np.array(weights) / np.array([capacity, max_docs, max_cost], float) ** 2
    states: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # (used, docs, cost) -> sequence ranges
    plan: list[tuple[int, int, int, int, int, int]] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        todo, rank, cost = counts[length], 0, length * length
        if length > capacity or cost > max_cost or max_docs < 1:
            raise ValueError(f"a piece of {length} tokens fits in no sequence")

        def room(used: int, docs: int, spent: int) -> int:
            return int(min((capacity - used) // length, max_docs - docs, (max_cost - spent) // cost))

        def place(key, ranges, times):
            """Put ``times`` copies into each sequence of ``ranges``; what stays of the ranges, and its new state."""
            nonlocal todo, rank
            used, docs, spent = key
            for at, (lo, n) in enumerate(ranges):
                each, left = times, []
                k = min(n, todo // each)
                if k == 0:
                    if todo == 0:
                        return ranges[at:]
                    k, each = 1, todo
                plan.append((length, rank, k, each, lo, used))
                states.setdefault((used + each * length, docs + each, spent + each * cost), []).append((lo, k))
                todo, rank = todo - k * each, rank + k * each
                if k < n:
                    left = [(lo + k, n - k)]
                if left:
                    return left + ranges[at + 1:] if todo == 0 else place(key, left + ranges[at + 1:], times)
            return []

        moved = True
        while todo and moved:  # the dot product puts one copy at a time, so it may come back to a sequence
            keys, moved = list(states), False
            free = np.array([capacity, max_docs, max_cost], float) - np.array(keys, float).reshape(-1, 3)
            item = np.array([length, 1, cost], float)
            fits = np.flatnonzero((free >= item).all(1))
            score = ((free[fits] - item) ** 2 * w).sum(1) if rule == "norm" else -(free[fits] * item * w).sum(1)
            for i in fits[np.argsort(score, kind="stable")]:
                if todo == 0:
                    break
                key, moved = keys[i], True
                left = place(key, states.pop(key), room(*key) if rule == "norm" else 1)
                if left:
                    states.setdefault(key, []).extend(left)
        while todo:
            per = min(room(0, 0, 0), todo)
            n = todo // per
            place((0, 0, 0), [(opened, n)], per)
            opened += n
    return np.array(plan, np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = 1024, max_docs: int | None = None, max_cost: float | None = None,
         rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6)) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ... any further columns) with ``sequence_id`` and ``offset``.

    Defaults leave documents and attention cost unbounding (a sequence of n
    tokens holds at most n pieces and costs at most n squared), so tokens alone
    decide; smaller values constrain them.  Offsets are gapless from 0 in each
    sequence.  Null ids and repeated (doc_id, piece) rows are pieces like any
    other.  An empty table gives an empty table.
    """
    max_docs = max_docs or capacity
    max_cost = max_cost or float(capacity) ** 2
    spark = pieces.sparkSession
    with text_batches(spark):
        pieces = settled(pieces, "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = spark.sparkContext.broadcast(best_fit_plan(counts, capacity, max_docs, max_cost, rule, weights))

    cell, local, base, rank = (temp_name(pieces, s) for s in ("cell", "local", "base", "rank"))
    cells = max(1, -(-sum(counts.values()) // CELL_ROWS))
    order = [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")] if "ids_crc32" in pieces.columns else [F.col("doc_id"), F.col("piece")]
    at = pieces.withColumn(cell, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(cells)))
    at = at.withColumn(local, F.row_number().over(Window.partitionBy(cell, "length").orderBy(*order)) - 1)
    sizes = pieces.groupBy(F.pmod(F.xxhash64("doc_id", "piece"), F.lit(cells)).alias(cell), "length").agg(F.count("*").alias(base))
    sizes = sizes.withColumn(base, F.sum(base).over(Window.partitionBy("length").orderBy(cell)) - F.col(base))
    ranked = at.join(sizes, [cell, "length"]).withColumn(rank, F.col(local) + F.col(base)).drop(cell, local, base)

    names = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        key = p[:, 0] * (1 << 44) + p[:, 1]  # lengths fall, ranks rise: sort by (length, first rank)
        by = np.argsort(key, kind="stable")
        key, p = key[by], p[by]
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            r = b.column(b.schema.get_field_index(rank)).to_numpy(zero_copy_only=False)
            row = p[np.searchsorted(key, length * (1 << 44) + r, "right") - 1] if len(r) else p[:0]
            nth = r - row[:, 1]
            seq = row[:, 4] + nth // np.maximum(row[:, 3], 1)
            offset = row[:, 5] + nth % np.maximum(row[:, 3], 1) * length
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in names], pa.array(seq), pa.array(offset)],
                                             names=[*names, "sequence_id", "offset"])

    return map_arrow(ranked, assign, schema + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves (needs the ``ids`` column): ids, document ids and document starts."""
    part = F.struct("offset", "doc_id", "piece", "ids")
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p"))  # at most capacity tokens a group
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))
