"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Every dimension is a list of the candidates sorted by their component; a query
reads it from the end that its own component prefers.  After reading all lists to
some depth, a candidate's score lies between the sum of what was read plus the
worst values of the lists and the same sum plus the lists' heads.  Candidates
whose upper bound is below the k-th best lower bound are out.  Reading goes
deeper in steps that halve what is unread until few are left, whose scores are
then resolved from the rest of their components.

Queries and candidates are dealt in blocks; a task handles one pair of blocks of
bounded size, and Spark merges the best of all blocks.  Bounds of a pair of blocks
are matrix products (values cut off at the list heads), exact for integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conflictlake.llm.common import map_arrow, settled

QUERY_BLOCK, CANDIDATE_BLOCK = 512, 8192
FEW = 1 / 16  # share of candidates left, from which on the rest is resolved one by one


def quantised(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, dim, vector): components ``floor(scale * x)``, packed as little-endian 64-bit numbers.

    Rows with a null id, a null or empty vector, or a null, NaN or infinite
    component take no part, nor do rows with a component beyond 53 bits.
    """
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            off = v.offsets.to_numpy().astype(np.int64)
            flat = v.values.to_numpy(zero_copy_only=False)  # nulls become NaN
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(flat * float(scale))
            fine = np.isfinite(x) & (np.abs(np.nan_to_num(x)) < 2.0 ** 53)
            bad = np.concatenate([[0], np.cumsum(~fine)])
            ok = (bad[off[1:]] == bad[off[:-1]]) & (off[1:] > off[:-1])
            whole = np.where(fine, x, 0).astype("<i8")
            at = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array((off[1:] - off[:-1])[at].astype(np.int32)),
                                              pa.array([whole[off[i]:off[i + 1]].tobytes() for i in at], pa.binary())], names=["id", "dim", "vector"])

    return map_arrow(src, pack, "id long, dim int, vector binary")


def _exact(q: np.ndarray, c: np.ndarray) -> type:
    """A type in which inner products of these integers, and their parts, are exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    return np.float32 if most < 2 ** 24 else np.float64 if most < 2 ** 53 else object


def _steps(n: int) -> Iterator[int]:
    """How many entries of each list are read: a quarter, then half of what is left, in the end all."""
    left = n
    for share in (0.75, 0.5):
        left = int(share * n)
        yield n - left
    while left:
        left //= 2
        yield n - left


def survivors(q: np.ndarray, c: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, int]]:
    """(candidate rows, entries read of each list) by query: what may be among its k best; ``own`` marks what may not.

    Reading goes on until a query has few candidates left, if need be to the ends
    of the lists, where the bounds are the scores.  Integers whose products are
    beyond 53 bits get bounds that are wider by the rounding of the sums.
    """
    n, kind = len(c), _exact(q, c)
    if n <= 4 * k:
        return [(np.flatnonzero(~o), 0) for o in own]
    slip = 0.0
    if kind is object:
        kind = np.float64
        slip = float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] * (q.shape[1] + 4) * 2.0 ** -52
    q, c = q.astype(kind), c.astype(kind)
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    lists = np.sort(c, axis=0)
    low, high = lists[0], lists[-1]
    out: list = [None] * len(q)
    todo = np.arange(len(q))
    for read in _steps(n):
        top, bottom = lists[n - read], lists[read - 1]
        p, m = plus[todo], minus[todo]
        lower = p @ np.where(c >= top, c, low).T + m @ np.where(c <= bottom, c, high).T
        lower[own[todo]] = -np.inf
        at_least = np.partition(lower, n - k, axis=1)[:, n - k] - 2 * slip
        del lower
        alive = (p @ np.maximum(c, top).T + m @ np.minimum(c, bottom).T >= at_least[:, None]) & ~own[todo]
        done = (alive.sum(1) <= max(4 * k, FEW * n)) | (read == n)
        for i in np.flatnonzero(done):
            out[todo[i]] = np.flatnonzero(alive[i]), read
        todo = todo[~done]
        if not len(todo):
            break
    return out


def best(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, candidate rows, scores): the k best of each query, ties to smaller ids; a candidate with the query's id is out."""
    kind = _exact(q, c)
    left = survivors(q, c, q_ids[:, None] == c_ids[None, :], k)
    q, c = q.astype(kind), c.astype(kind)
    for r, (rows, _) in enumerate(left):
        score = c[rows] @ q[r]
        if len(rows) > k:
            cut = np.partition(score, len(rows) - k)[len(rows) - k] if kind is not object else np.sort(score)[len(rows) - k]
            rows, score = rows[score >= cut], score[score >= cut]
        if kind is object:
            order = sorted(range(len(rows)), key=lambda i: (-score[i], c_ids[rows[i]]))[:k]
        else:
            order = np.lexsort((c_ids[rows], -score))[:k]
        yield r, rows[order], score[order]


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) of all rows whose id is divisible by ``every`` against all others.

    Only vectors of the same dimension meet.  Repeated ids: every row is a
    candidate; the rows of a query's own id are not its candidates; a query id
    that is repeated is asked once, with its smallest vector.  Scores beyond 63
    bits are not representable and fail.  An empty table gives an empty table.
    """
    rows = settled(quantised(vectors, scale), "vectors")
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min(F.struct("dim", "vector")).alias("s")).select("id", "s.*")
    asked = settled(asked, "queries")
    n_c, n_q = max(1, -(-rows.count() // CANDIDATE_BLOCK)), max(1, -(-asked.count() // QUERY_BLOCK))
    serial = F.monotonically_increasing_id()
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cand = rows.select("id", "dim", "vector", F.pmod(serial, F.lit(n_c)).cast("int").alias("cb"), F.lit(False).alias("asks")).withColumn("qb", blocks(n_q))
    ask = asked.select("id", "dim", "vector", F.lit(True).alias("asks"), F.pmod(serial, F.lit(n_q)).cast("int").alias("qb")).withColumn("cb", blocks(n_c))

    def search(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids = t["id"].to_numpy()
        dim = t["dim"][0].as_py()
        x = np.frombuffer(b"".join(t["vector"].to_pylist()), "<i8").reshape(len(ids), dim)
        asks = t["asks"].to_numpy(zero_copy_only=False)
        out = [(np.full(len(at), ids[asks][r]), ids[~asks][at], np.array([int(s) for s in score], np.int64))
               for r, at, score in best(x[asks], ids[asks], x[~asks], ids[~asks], k)] if asks.any() and not asks.all() else []
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    found = cand.unionByName(ask).groupBy("dim", "qb", "cb").applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
