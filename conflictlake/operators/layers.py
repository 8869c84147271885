"""Reachability over a commit graph in a few rounds, however long its paths are.

A history lists children before parents, so its listing order is a topological
order.  Commits get their place in it (``at``, dense over all repositories) and
are cut into blocks of BLOCK consecutive places.  What happens inside a block one
task can settle in one pass over its edges.  Only commits with an edge into
another block, the *border*, matter outside; a block replaces its inside by
shortcuts between them (border to border, without edges that others imply).

The border commits with the shortcuts and the edges between blocks are a smaller
graph of the same kind.  Its blocks span several blocks of the level below, as
many as keep a block small, and so on until nothing crosses a block.  Values go up
the levels (inside commits to border commits), are settled at the top and come
down again.  A level is one shuffle, and there are about log(commits / BLOCK)
levels: a chain of thousands of nested merges takes as many rounds as a short one.

A history so wide that its border does not shrink any more is finished by plain
rounds over what is left.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conflictlake.operators.graph import fixpoint
from conflictlake.operators.rank import dense_index
from conflictlake.operators.shipped import ship
from conflictlake.operators.stored import Stored

KEY = "repository"
BLOCK = 1 << 14  # places of a block at the lowest level
SPANS = (64, 16, 8, 4, 2)  # blocks of one level that a block of the next may span
WORD = 62  # bits of a mask word
EDGE, BORDER, VALUE, ASKED = 0, 1, 2, 3  # kinds of the rows a block gets
ROWS = "block long, kind int, a long, b long, val long"


def shortcuts(edges: Iterable[tuple[int, int]], border: Iterable[int]) -> list[tuple[int, int]]:
    """Edges between border nodes that stand for the paths through the others; none that two of them imply.

    Numbers are a topological order.  A set of border nodes is an integer with a bit each.
    """
    before = defaultdict(list)
    for u, v in edges:
        before[v].append(u)
    names = sorted(border)
    bit = {node: i for i, node in enumerate(names)}
    reached: dict[int, int] = {}  # by node inside: border nodes with a path to it that meets no other
    above: dict[int, int] = {}  # by border node: all border nodes with a path to it
    out = []
    for node in sorted(before):
        met = 0
        for u in before[node]:
            met |= 1 << bit[u] if u in bit else reached.get(u, 0)
        if node not in bit:
            reached[node] = met
            continue
        every = 0
        while met:  # the latest first: what is above it is implied
            i = met.bit_length() - 1
            whole = 1 << i | above.get(i, 0)
            every |= whole
            met &= ~whole
            out.append((names[i], node))
        above[bit[node]] = every
    return out


def spread_inside(edges: Iterable[tuple[int, int]], values: Iterable[tuple[int, int]], how: str, backwards: bool) -> dict[int, int]:
    """Value of every node: its own and those of all nodes before it, combined (min, max or bitwise or)."""
    merge: Callable[[int, int], int] = {"min": min, "max": max, "or": int.__or__}[how]
    before = defaultdict(list)
    for u, v in edges:
        if backwards:
            u, v = v, u
        before[v].append(u)
    out: dict[int, int] = {}
    for node, x in values:
        out[node] = merge(out[node], x) if node in out else x
    for node in sorted(before, reverse=backwards):
        for u in before[node]:
            x = out.get(u)
            if x is not None:
                out[node] = merge(out[node], x) if node in out else x
    return out


def _column(t: pa.Table, kind: int, *names: str) -> list[list]:
    import pyarrow.compute as pc

    some = t.filter(pc.equal(t["kind"], kind))
    return [some[n].to_pylist() for n in names]


def _numbers(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})


def _contract_block(t: pa.Table) -> pa.Table:
    return _numbers(shortcuts(zip(*_column(t, EDGE, "a", "b")), _column(t, BORDER, "a")[0]), ("u", "v"))


def _spread_block(how: str, backwards: bool, limited: bool) -> Callable[[pa.Table], pa.Table]:
    """Values of a block; ``limited``: only those of its BORDER and ASKED nodes."""
    def run(t: pa.Table) -> pa.Table:
        at, word, val = _column(t, VALUE, "a", "b", "val")
        if how == "or":
            val = [x << WORD * w for x, w in zip(val, word)]
        got = spread_inside(zip(*_column(t, EDGE, "a", "b")), zip(at, val), how, backwards)
        if limited:
            got = {n: got[n] for kind in (BORDER, ASKED) for n in _column(t, kind, "a")[0] if n in got}
        if how != "or":
            return _numbers([(n, 0, x) for n, x in got.items()], ("at", "key", "val"))
        rows = []
        for n, x in got.items():
            w = 0
            while x:
                if part := x & ((1 << WORD) - 1):
                    rows.append((n, w, part))
                x, w = x >> WORD, w + 1
        return _numbers(rows, ("at", "key", "val"))
    return run


class Layers:
    """The levels of a commit table (repository, sha, parents, commit_ord), stored until ``delete``.

    ``commit_ord`` orders each repository with children before parents and
    (repository, sha) is a key; parents that are not in the table are ignored.
    ``numbered`` has the commits with their place ``at``.
    """

    def __init__(self, commits: DataFrame):
        spark = commits.sparkSession
        ship(spark)
        self.parts: list[Stored] = []
        order = dense_index(commits.select(KEY, "sha", "parents", "commit_ord"), [KEY, "commit_ord", "sha"], "at")
        self.numbered = self._store(order, "numbered")
        child = self.numbered.select(KEY, F.col("at").alias("u"), F.explode("parents").alias("sha"))
        edges = self._store(child.join(self.numbered.select(KEY, "sha", F.col("at").alias("v")), [KEY, "sha"]).select("u", "v").distinct(), "edges")
        if not edges.where("u >= v").isEmpty():
            raise ValueError("commit_ord does not list every child before its parents")
        self.levels: list[tuple[int, DataFrame, DataFrame | None]] = []  # span, edges, border (none at the top)
        self.wide = False
        span = BLOCK
        while True:
            cross = edges.where(F.expr(f"u div {span} <> v div {span}"))
            if cross.isEmpty():
                self.levels.append((span, edges, None))
                return
            border = self._store(cross.select(F.explode(F.array("u", "v")).alias("at")).distinct(), "border")
            wider = self._wider(border, span)
            if wider is None:
                self.wide = True
                self.levels.append((span, edges, None))
                return
            rows = self._edges(edges, span).unionByName(self._rows(border, span, BORDER))
            short = rows.groupBy("block").applyInArrow(_contract_block, "u long, v long")
            self.levels.append((span, edges, border))
            edges, span = self._store(short.unionByName(cross), "edges"), wider

    def _store(self, df: DataFrame, label: str) -> DataFrame:
        self.parts.append(Stored(df, label))
        return self.parts[-1].df

    @staticmethod
    def _wider(border: DataFrame, span: int) -> int | None:
        """The widest span whose blocks hold at most BLOCK border commits, none if even two blocks hold more."""
        counts = border.groupBy(F.expr(f"at div {span}").alias("block")).agg(F.count(F.lit(1)).alias("n"))
        whole = counts.agg(F.sum("n"), F.max("block")).first()
        if whole[0] <= BLOCK:
            return span * (whole[1] + 1)
        for times in SPANS:
            if counts.groupBy(F.expr(f"block div {times}")).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] <= BLOCK:
                return span * times
        return None

    @staticmethod
    def _rows(df: DataFrame, span: int, kind: int) -> DataFrame:
        more = [F.col("key").alias("b"), "val"] if kind == VALUE else [F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("val")]
        return df.select(F.expr(f"at div {span}").alias("block"), F.lit(kind).alias("kind"), F.col("at").alias("a"), *more)

    @staticmethod
    def _edges(edges: DataFrame, span: int) -> DataFrame:
        inner = edges.where(F.expr(f"u div {span} = v div {span}"))
        return inner.select(F.expr(f"u div {span}").alias("block"), F.lit(EDGE).alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"), F.lit(None).cast("long").alias("val"))

    def place(self, named: DataFrame, sha: str, at: str) -> DataFrame:
        """``named`` with the place of its commit (repository, ``sha``); rows of unknown commits go."""
        return named.join(self.numbered.select(KEY, F.col("sha").alias(sha), F.col("at").alias(at)), [KEY, sha])

    def spread(self, seeds: DataFrame, how: str, backwards: bool = False, wanted: DataFrame | None = None) -> DataFrame:
        """(at, key, val): every commit's value combined with those of the commits before it.

        ``seeds``: (at, key, val); ``how``: min, max (key 0) or "or" (val is word
        ``key`` of a bit mask, WORD bits each).  Values flow from children to
        parents, or to children if ``backwards``.  ``wanted`` (at) limits the
        answer.  Only values of border commits are stored; the answer is made
        when it is read.
        """
        def settle(level: int, *values: DataFrame, only: DataFrame | None = None, kind: int = BORDER) -> DataFrame:
            span, edges, _ = self.levels[level]
            rows = self._edges(edges, span)
            for p in values:
                rows = rows.unionByName(self._rows(p, span, VALUE))
            if only is not None:
                rows = rows.unionByName(self._rows(only, span, kind))
            return rows.groupBy("block").applyInArrow(_spread_block(how, backwards, only is not None), "at long, key long, val long")

        own = [seeds.select(F.col("at").cast("long"), F.col("key").cast("long"), F.col("val").cast("long"))]
        top = len(self.levels) - 1
        for level in range(top):
            own.append(self._store(settle(level, own[level], only=self.levels[level][2]), "up"))
        if self.wide:
            got = self._rounds(own[top], how, backwards)
            if wanted is not None and top == 0:
                got = got.join(wanted.select("at").distinct(), "at", "left_semi")
        else:
            got = settle(top, own[top], only=wanted if top == 0 else None, kind=ASKED)
        for level in range(top - 1, -1, -1):
            got = settle(level, own[level], self._store(got, "down"), only=wanted if level == 0 else None, kind=ASKED)
        return got

    def _rounds(self, seeds: DataFrame, how: str, backwards: bool) -> DataFrame:
        edges = self.levels[-1][1]
        if backwards:
            edges = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        merge = {"min": F.min, "max": F.max, "or": F.bit_or}[how]

        def step(changed: DataFrame) -> DataFrame:
            return changed.withColumnRenamed("at", "u").join(edges, "u").select(F.col("v").alias("at"), "key", "val")

        def gain(new: Column, old: Column) -> tuple[Column, Column]:
            if how == "or":
                fresh = new.bitwiseAND(F.bitwise_not(F.coalesce(old, F.lit(0).cast("long"))))
                return fresh, fresh != 0
            return new, old.isNull() | ((new < old) if how == "min" else (new > old))

        return fixpoint(seeds, ["at", "key"], step, merge, gain)

    def delete(self) -> None:
        for p in self.parts:
            p.delete()
