"""Corpus-wide totals of keyed counts, delivered back to the blocks that asked for them.

A block of documents counts its distinct 64-bit keys.  It sends them once, sorted
and packed, to slices of the key space; a slice adds up the counts of equal keys
and answers every block with the totals in the order in which the block sent its
keys, so the keys themselves travel one way only.  A key that every block holds
is one entry a block, like any other key, and the number of slices grows with the
number of keys, so no task holds more than a few slices' worth of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conflictlake.llm.common import map_arrow

SLICE_KEYS = 2_000_000  # keys of all blocks that one slice takes
REQUEST = "slice long, block long, keys binary, counts binary"
ANSWER = "block long, slice long, totals binary"
SUMMARY = -1  # block number of the rows that hold a slice's summary


def pack_numbers(values: np.ndarray) -> bytes:
    """Non-negative numbers as byte planes of the least width (high planes compress well)."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack_numbers(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys: the first, then the gaps in the least number of bytes that holds them all."""
    gaps = np.ascontiguousarray(np.diff(keys), "<u8")
    width = max(1, -(-int(gaps.max()).bit_length() // 8)) if len(gaps) else 1
    return keys[:1].astype("<u8").tobytes() + bytes([width]) + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    width = raw[8]
    gaps = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(gaps) + 1, 8), np.uint8)
    out[0] = np.frombuffer(raw, np.uint8, 8)
    out[1:, :width] = gaps
    return np.cumsum(out.view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


def slice_edges(keys: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """(slice numbers, edges) of sorted keys: ``keys[edges[i]:edges[i + 1]]`` belong to slice i."""
    at = ((keys >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    return at[first].astype(np.int64), np.append(first, len(at))


def request_rows(block: int, keys: np.ndarray, counts: np.ndarray, slices: int, base: int = 0) -> list[tuple]:
    """REQUEST rows of one block: sorted distinct ``keys`` and their counts; ``base`` shifts the slice numbers."""
    numbers, edges = slice_edges(keys, slices)
    return [(base + int(n), block, pack_sorted(keys[lo:hi]), pack_numbers(counts[lo:hi]))
            for n, lo, hi in zip(numbers, edges, edges[1:])]


def slices_for(keys: int) -> int:
    return max(1, -(-int(keys) // SLICE_KEYS))


def answers(requests: DataFrame, slices: int, summary: Callable[[int, np.ndarray, np.ndarray], bytes]) -> DataFrame:
    """ANSWER rows of every request, and a SUMMARY row per slice with ``summary(slice, keys, totals)``.

    ``slices`` is the number of slices of all orders; a task takes a few, one after the other.
    """

    def settle(number: int, rows: list[tuple]) -> Iterator[tuple]:
        keys = [unpack_sorted(k) for _, k, _ in rows]
        edges = np.cumsum([0, *map(len, keys)])
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([unpack_numbers(c) for _, _, c in rows])
        total = np.bincount(where, counts, len(every)).astype(np.uint64)
        for (block, _, _), lo, hi in zip(rows, edges, edges[1:]):
            yield block, number, pack_numbers(total[where[lo:hi]])
        yield SUMMARY, number, summary(number, every, total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, rows = None, []
        for b in batches:
            for number, block, keys, counts in zip(*(c.to_pylist() for c in b.columns)):
                if number != open_ and rows:
                    yield from _out(settle(open_, rows))
                    rows = []
                open_ = number
                rows.append((block, keys, counts))
        if rows:
            yield from _out(settle(open_, rows))

    return map_arrow(requests.repartition(-(-slices // 2), "slice").sortWithinPartitions("slice"), add, ANSWER)


def _out(rows: Iterator[tuple], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    kinds, names = (pa.int64(), pa.int64(), pa.binary()), ("block", "slice", "totals")
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2])
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held), kinds)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held), kinds)], names=names)


def by_block(answered: DataFrame) -> DataFrame:
    """(block, answered array<struct<slice, totals>>) in the order of the slices."""
    rows = answered.where(F.col("block") != SUMMARY)
    return rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("slice", "totals"))).alias("answered"))
