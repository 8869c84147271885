"""Reading tables, cutting lineage and Arrow plumbing shared by the operators."""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession

from conflictlake.session import ensure_checkpoint_dir

CHUNK_BYTES = 4 << 20
READ_ROWS = 4  # of a table of large rows, decoded at once
BATCH_BYTES = 2 << 20  # of large rows handed to Python at once (one row at least)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def map_arrow(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with this package sent to the executors once per application."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "conflictlake"), "zip", root, "conflictlake")
        sc.addPyFile(made)
        _shipped.add(sc.applicationId)
    return df.mapInArrow(fn, schema)


_kept: list = []  # functions whose results a worker keeps


def kept_by_worker(entries: int) -> Callable:
    """``lru_cache`` for what a worker loads once for many tasks (tokenizers); a lean pass lets go of it."""

    def keep(fn: Callable) -> Callable:
        _kept.append(lru_cache(maxsize=entries)(fn))
        return _kept[-1]

    return keep


def tidy() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def let_go() -> None:
    """Drops what other passes have left in this worker."""
    left = [f for f in _kept if f.cache_info().currsize]
    for f in left:
        f.cache_clear()
    if left:
        tidy()


def lean(fn: Callable) -> Callable:
    """``fn`` of a Python worker that starts without what other passes keep, and gives freed memory back to the system when it is done."""

    def over_batches(batches):
        let_go()
        yield from fn(batches)
        tidy()

    def over_group(group: pa.Table) -> pa.Table:
        let_go()
        out = fn(group)
        tidy()
        return out

    return over_group if next(iter(inspect.signature(fn).parameters)) != "batches" else over_batches


def map_arrow_lean(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``map_arrow`` for passes with large work arrays: workers live on between tasks."""
    return map_arrow(df, lean(fn), schema)


@contextlib.contextmanager
def _set_to(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def shuffles_dropped(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """What is written inside leaves no shuffle files behind: it is stored and needs none."""
    return _set_to(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def large_rows(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """What is run inside has rows of some MB: a task reads and hands to Python a few at a time, not thousands."""
    return _set_to(spark, {"spark.sql.parquet.columnarReaderBatchSize": str(READ_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)})


def text_batches(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """What is run inside hands texts to Python some MB at a time, not ten thousand rows."""
    return _set_to(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(CHUNK_BYTES)})


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again.

    Cuts the lineage: a lost executor costs a re-read, and readers that use the
    result twice see the same rows.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled_with(df: DataFrame, label: str, **told: Column) -> tuple[DataFrame, dict]:
    """``settled``, and aggregates over its rows that are taken as they are written, without a query of their own."""
    seen = Observation()
    return settled(df.observe(seen, *[c.alias(name) for name, c in told.items()]), label), seen.get


def refuse_clash(keep: list[str], *taken: str) -> None:
    """A column to carry along cannot have the name of a column that the operator makes."""
    clash = sorted({c for c in keep if c.lower() in {t.lower() for t in taken}})
    if clash:
        raise ValueError(f"rename before keeping, the operator makes columns of this name itself: {', '.join(clash)}")


def temp_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (column names compare without case)."""
    have, name = {c.lower() for c in df.columns}, stem
    while name.lower() in have:
        name = f"_{name}"
    return name


def byte_column(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is_null) of an Arrow string column; offsets have one more entry than rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64) \
        if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    null = np.asarray(col.is_null()) if len(col) else np.zeros(0, bool)
    return raw[off[0]:off[-1]], off - off[0], null


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes (a longer text is alone in its range)."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)
