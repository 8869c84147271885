r"""Repair of conversation structure by cheapest edits, found by a checkpointed DP.

A conversation should be ``(system? (user assistant)+)?``.  Every row may be kept
(0), given another role (3) or deleted (4, required for blank rows and for
duplicates); an empty user or assistant row may be inserted anywhere (3); a row
that ends without ``.!?`` and is not deleted costs 3 more.  Of all cheapest edits
the one whose initials (D I K R) are least in ASCII order is taken.

The DP runs backwards: before each row there is a vector with the cheapest way on
from each of the four states of the wanted shape.  Vectors are kept at
checkpoints only, about a square root of the rows apart; walking forward, the
vectors of one stretch are computed again from its checkpoint, and the least tight
edit is emitted.  A step depends on the row's kind and on the differences inside
the vector, of which there are few, so each step is worked out once.

A conversation may be larger than a task.  Its rows are range-partitioned and cut
into segments of a few thousand rows.  A segment tells what it costs from state to
state (a 4 x 4 matrix); a backward scan over these matrices gives the vector at
each segment's end, the checkpoints between segments; every segment then walks its
rows from each state, and a forward scan picks the walk that is really taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conflictlake.llm.common import byte_column, map_arrow
from conflictlake.operators.stored import Stored

SEGMENT_ROWS, SEGMENT_BYTES = 4096, 4 << 20
SPACES = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
NEVER = 1 << 60
# states: nothing yet, after system, after user, after assistant
GROWN = (2, 2, 3, 2)  # by one user or assistant row
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
MUST, SHORT = 4, 8  # bits of a row's kind beside its initial
INITIALS = "sua"  # kinds 0, 1, 2; 3 is any other
ROLE = {2: "user", 3: "assistant"}


def _inserted(v: list[int]) -> list[int]:
    for _ in range(2):
        v = [min(v[q], v[GROWN[q]] + INSERT) for q in range(4)]
    return v


FINAL = tuple(_inserted([0, NEVER, NEVER, 0]))
_steps: dict[tuple, tuple] = {}


def step(kind: int, after: tuple) -> tuple[tuple, int, tuple]:
    """(vector before the row less its least cost, that cost, (edits, next state) of each state).

    ``after`` is the vector behind the row, less its own least cost.
    """
    known = _steps.get((kind, after))
    if known is not None:
        return known
    initial, extra = (INITIALS + "-")[kind & 3], CUT if kind & SHORT else 0
    ways = []  # of the row itself, by state, in ASCII order of their initials
    for q in range(4):
        own = [("D", DELETE + after[q], q)]
        if not kind & MUST:
            if initial in KEPT[q]:
                own.append(("K", extra + after[KEPT[q][initial]], KEPT[q][initial]))
            own.append(("R", extra + REROLE + after[GROWN[q]], GROWN[q]))
        ways.append(own)
    cost = _inserted([min(c for _, c, _ in own) for own in ways])
    moves = []
    for q in range(4):
        said, at = "", q
        while True:
            own = [w for w in ways[at] if w[1] == cost[at]]
            if own and own[0][0] == "D":
                break
            if cost[GROWN[at]] + INSERT == cost[at]:
                said, at = said + "I", GROWN[at]
                continue
            break
        moves.append((said + own[0][0], own[0][2]) if cost[q] < NEVER else ("", q))
    least = min(cost)
    out = tuple(min(c - least, NEVER) for c in cost), least, tuple(moves)
    if len(_steps) < 1 << 16:
        _steps[kind, after] = out
    return out


def _scaled(v: tuple) -> tuple[tuple, int]:
    least = min(v)
    return tuple(min(c - least, NEVER) for c in v), least


def backward(kinds: bytes, end: tuple) -> tuple[tuple, int]:
    """The vector before the first row (less its least cost, and that cost)."""
    v, total = _scaled(end)
    for kind in reversed(kinds):
        v, least, _ = step(kind, v)
        total += least
    return v, total


def tight_edits(kinds: bytes, end: tuple, state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least cheapest edits from ``state`` on, and the state they end in.

    ``last``: rows end here, so what the shape still wants is inserted.
    """
    n = len(kinds)
    width = isqrt(n) + 1
    v, marks = _scaled(end)[0], {}
    for i in range(n - 1, -1, -1):
        if (i + 1) % width == 0 or i + 1 == n:
            marks[i + 1] = v
        v = step(kinds[i], v)[0]
    out = []
    for lo in range(0, n, width):
        hi = min(lo + width, n)
        v, block = marks[hi], []
        for i in range(hi - 1, lo - 1, -1):
            made = step(kinds[i], v)
            v = made[0]
            block.append(made[2])
        for moves in reversed(block):
            said, state = moves[state]
            out.append(said)
    while last and state in (1, 2):
        out.append("I")
        state = GROWN[state]
    return "".join(out), state


def applied(edits: str, state: int, roles: list, texts: list) -> list[tuple[str, str, str]]:
    """(edit, role, text) of the rows that stay or come in."""
    out, at = [], 0
    for e in edits:
        if e == "I":
            state = GROWN[state]
            out.append((e, ROLE[state], ""))
            continue
        role, text, at = roles[at], texts[at], at + 1
        if e == "R":
            state = GROWN[state]
            out.append((e, ROLE[state], text))
        elif e == "K":
            state = KEPT[state][role[0]]
            out.append((e, role, text))
    return out


def damage(turns: DataFrame) -> DataFrame:
    """Rows with faults put in by the CRC-32 of ``conv_id:turn`` modulo 20 (a null is one space): 0 drops the row,
    1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it a user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    said = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", role.alias("role"), said.alias("text"), F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("n"))
    return rows.select("conv_id", "turn", "role", "text", F.explode("n").alias("n")).drop("n")


def _kind() -> Column:
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    short = F.when(F.right(body, F.lit(1)).isin(".", "!", "?"), 0).otherwise(SHORT)
    initial = F.substring("role", 1, 1)
    initial = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return (initial + F.when(body == "", MUST).otherwise(short)).cast("tinyint")


def segments(turns: DataFrame) -> DataFrame:
    """Rows of each conversation in order, cut into segments: conv_id, seg, turn, role, text, key, kind (arrays).

    Order: ``turn`` (nulls first), ties by role, the first 100 characters of the
    text and its digest; rows equal in all are the same.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    key = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    rows = rows.select("*", key.alias("key"), _kind().alias("kind"), F.substring("text", 1, 100).alias("head"), F.monotonically_increasing_id().alias("serial"))
    order = ["conv_id", "turn", "role", "head", "key", "serial"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "key", "kind")
    schema = "conv_id long, seg long, turn array<long>, role array<string>, text array<string>, key array<binary>, kind array<tinyint>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for b in batches:
            if not b.num_rows:
                continue
            conv, null = b.column(0).fill_null(0).to_numpy(), np.asarray(b.column(0).is_null())
            _, off, _ = byte_column(b.column(3))
            new = np.ones(b.num_rows, bool)
            size, rows = off[:-1] // SEGMENT_BYTES, np.arange(b.num_rows) // SEGMENT_ROWS
            new[1:] = (conv[1:] != conv[:-1]) | (null[1:] != null[:-1]) | (size[1:] != size[:-1]) | (rows[1:] != rows[:-1])
            first = np.flatnonzero(new)
            edge = pa.array(np.append(first, b.num_rows).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(first)), pa.array(number + np.arange(len(first))),
                                              *[pa.ListArray.from_arrays(edge, c) for c in b.columns[1:]]], names=[f.split()[0] for f in schema.split(", ")])
            number += len(first)

    return map_arrow(rows, cut, schema)


FACTS = ("conv_id long, seg long, kinds binary, ways array<long>, blank long, duplicate long, truncated long, illegal long, "
         "first int, last int, least long, most long, turns long, early long, late long")


def facts(cut: DataFrame) -> DataFrame:
    """What each segment is: its rows' kinds with duplicates marked, its cost matrix and its counts."""
    seen = cut.select("conv_id", "seg", F.posexplode(F.arrays_zip("key", "kind"))).where(F.col("col.kind").bitwiseAND(F.lit(MUST)) == 0)
    first = seen.groupBy("conv_id", "col.key").agg(F.min(F.struct("seg", "pos")).alias("at"))
    fresh = first.groupBy(F.col("at.seg").alias("seg")).agg(F.collect_list("at.pos").alias("fresh"))  # at most a segment's rows

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, seg, turn, kind, new in zip(*(c.to_pylist() for c in b.columns)):
                kinds, blank, again, short = bytearray(), 0, 0, 0
                new = set(new or ())
                for i, k in enumerate(kind):
                    if k & MUST:
                        blank += 1
                    elif i not in new:
                        again, k = again + 1, k & 3 | MUST
                    elif k & SHORT:
                        short += 1
                    kinds.append(k)
                bad = sum(not _fits(x, y) for x, y in zip(kinds, kinds[1:]))
                columns = [backward(kinds, tuple(0 if q == p else NEVER for q in range(4))) for p in range(4)]
                ways = [min(columns[p][0][q] + columns[p][1], NEVER) for q in range(4) for p in range(4)]
                said = [t for t in turn if t is not None]
                out.append((conv, seg, bytes(kinds), ways, blank, again, short, bad, kinds[0] & 3, kinds[-1] & 3,
                            *((said[0], said[-1], len(set(said)), said[0], said[-1]) if said else (None, None, 0, None, None))))
            yield _batch(out, FACTS)

    met = cut.select("conv_id", "seg", "turn", "kind").join(fresh, "seg", "left").select("conv_id", "seg", "turn", "kind", "fresh")
    return map_arrow(met, tell, FACTS)


def _fits(x: int, y: int) -> bool:
    return (x & 3, y & 3) in ((0, 1), (1, 2), (2, 1))


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(),
          "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _scan(df: DataFrame, backwards: bool, start: Callable[[], object], one: Callable, schema: str) -> DataFrame:
    """Segments of each conversation as a stream in order, with a state carried along: ``state, row = one(state, *columns)``."""
    way = F.desc("seg") if backwards else F.asc("seg")
    rows = df.repartition("conv_id").sortWithinPartitions("conv_id", way)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, conv, begun = None, None, False
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if not begun or row[0] != conv:
                    state, conv, begun = start(), row[0], True
                state, made = one(state, *row)
                out.append(made)
            yield _batch(out, schema)

    return map_arrow(rows, run, schema)


def checkpoints(told: DataFrame) -> DataFrame:
    """(seg, end, last, cost): the cost vector at each segment's end, and the cheapest repair from its first row on."""

    def back(state, conv, seg, ways):
        vector, last = state
        mine = tuple(min(ways[4 * q + p] + vector[p] for p in range(4)) for q in range(4))
        return (mine, False), (seg, list(vector), last, mine[0])

    return _scan(told.select("conv_id", "seg", "ways"), True, lambda: (FINAL, True), back, "seg long, end array<long>, last boolean, cost long")


def walks(told: DataFrame, ends: DataFrame) -> DataFrame:
    """(conv_id, seg, audits, exits): from each state a segment may be entered in, its edits and the state it is left in."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, seg, kinds, end, last, alone in zip(*(c.to_pylist() for c in b.columns)):
                made = [tight_edits(kinds, tuple(end), q, last) for q in ((0,) if alone else range(4))]
                out.append((conv, seg, [m[0] for m in made], [m[1] for m in made]))
            yield _batch(out, "conv_id long, seg long, audits array<string>, exits array<int>")

    first = told.groupBy("conv_id").agg(F.min("seg").alias("seg")).select("seg", F.lit(True).alias("alone"))
    met = told.select("conv_id", "seg", "kinds").join(ends.select("seg", "end", "last"), "seg").join(first, "seg", "left").select(
        "conv_id", "seg", "kinds", "end", "last", F.coalesce("alone", F.lit(False)).alias("alone"))
    return map_arrow(met, walk, "conv_id long, seg long, audits array<string>, exits array<int>")


class Repair:
    """The repair of all conversations of ``turns`` (conv_id, turn, role, text; a null role or text is one space).

    A null conv_id is a conversation, null turns come first, ties have the order of
    ``segments``; other columns are not read, whatever their names.  Empty tables
    give empty tables.  ``rows`` are the repaired rows, ``conversations`` the counts
    and edits.  ``delete`` drops what is stored.
    """

    def __init__(self, turns: DataFrame):
        self.cut = Stored(segments(turns), "repair-rows")
        self.told = Stored(facts(self.cut.df), "repair-facts")
        self.ends = Stored(checkpoints(self.told.df), "repair-ends")
        walked = walks(self.told.df, self.ends.df).join(self.told.df.select("seg", "first", "last", "early", "late"), "seg")

        def forward(state, conv, seg, audits, exits, first, last, early, late):
            q, before, turn = state
            entry = q if len(audits) > 1 else 0
            bad = int(before is not None and not _fits(before, first))
            again = int(early is not None and early == turn)
            after = (exits[entry], last, turn if late is None else late)
            return after, (conv, seg, entry, audits[entry], bad, again)

        self.taken = Stored(_scan(walked.select("conv_id", "seg", "audits", "exits", "first", "last", "early", "late"), False, lambda: (0, None, None), forward,
                                  "conv_id long, seg long, entry int, audit string, bad long, again long"), "repair-edits")

    def conversations(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation with rows."""
        whole = self.told.df.join(self.taken.df.drop("conv_id"), "seg").join(self.ends.df.select("seg", "cost"), "seg")
        total = whole.groupBy("conv_id").agg(
            *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.sum(F.col("illegal") + F.col("bad")).alias("illegal"),
            F.min("least").alias("least"), F.max("most").alias("most"), F.sum(F.col("turns") - F.col("again")).alias("turns"),
            F.min(F.struct("seg", "cost")).alias("begin"), F.array_sort(F.collect_list(F.struct("seg", "audit"))).alias("audits"))
        gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0))
        return total.select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("begin.cost").alias("cost"),
                            F.array_join("audits.audit", "").alias("audit"))

    def _pieces(self) -> DataFrame:
        schema = "conv_id long, seg long, edits array<string>, roles array<string>, texts array<string>"

        def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for i in range(b.num_rows):
                    conv, seg, roles, texts, entry, audit = (c[i].as_py() for c in b.columns)
                    out.append((conv, seg, *[list(x) for x in (zip(*applied(audit, entry, roles, texts)) if audit.strip("D") else ((), (), ()))]))
                yield _batch(out, schema)

        met = self.cut.df.select("conv_id", "seg", "role", "text").join(self.taken.df.select("seg", "entry", "audit"), "seg")
        return map_arrow(met.select("conv_id", "seg", "role", "text", "entry", "audit"), mend, schema)

    def rows(self) -> DataFrame:
        """conv_id, seg, place, edit, role, text: the repaired rows, in the order of (seg, place)."""
        rows = self._pieces().select("conv_id", "seg", F.posexplode(F.arrays_zip("edits", "roles", "texts")))
        return rows.select("conv_id", "seg", F.col("pos").alias("place"), F.col("col.edits").alias("edit"), F.col("col.roles").alias("role"), F.col("col.texts").alias("text"))

    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256) of the repaired ``role:text`` lines; conversations without any are left out.

        A digest is a sequence by nature: a conversation is a stream in one task, one batch in memory.
        """
        rows = self._pieces().where(F.size("roles") > 0).select("conv_id", "seg", "roles", "texts")
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "seg")

        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            conv, sha = None, None
            for b in batches:
                out = []
                for i in range(b.num_rows):
                    here = b.column(0)[i].as_py()
                    if sha is None or here != conv:
                        if sha is not None:
                            out.append((conv, sha.hexdigest()))
                        conv, sha = here, hashlib.sha256()
                    else:
                        sha.update(b"\n")
                    sha.update("\n".join(f"{r}:{t}" for r, t in zip(b.column(2)[i].as_py(), b.column(3)[i].as_py())).encode())
                yield _batch(out, "conv_id long, repaired_sha256 string")
            if sha is not None:
                yield _batch([(conv, sha.hexdigest())], "conv_id long, repaired_sha256 string")

        return map_arrow(rows, digest, "conv_id long, repaired_sha256 string")

    def delete(self) -> None:
        for stored in (self.cut, self.told, self.ends, self.taken):
            stored.delete()


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def audit(turns: DataFrame, wanted: DataFrame) -> DataFrame:
    """Counts, edits and digest for every conv_id of ``wanted`` (each once), stored; without rows zeros, no edits, the digest of nothing."""
    found = Repair(turns)
    ids = wanted.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("w")
    told, digest = found.conversations().alias("c"), found.digests().alias("d")
    out = ids.join(told, F.expr("w.conv_id <=> c.conv_id"), "left").join(digest, F.expr("w.conv_id <=> d.conv_id"), "left").select(
        "w.conv_id", *[F.coalesce(F.col(f"c.{c}"), F.lit(0)).cast("long").alias(c) for c in COLUMNS], F.coalesce("c.audit", F.lit("")).alias("audit"),
        F.coalesce("d.repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
    kept = Stored(out, "repair-audit")
    found.delete()
    return kept.df
