r"""Chat formatting in budgeted windows.

A turn is written ``### Role: text </turn>\n``; a backslash in front of a
character of the text or role makes it ordinary, so that texts holding control
strings are read back as they were.  Prefix sums of the turns' token counts cut a
conversation into turn-aligned windows of at most ``budget`` tokens.  Every
window begins with the conversation's system turns; windows after the first
repeat the last turns before them, as many as fit ``history`` tokens.  The loss
mask of a window covers the texts of its new assistant turns, so each target
counts once.  A turn that is larger than the budget stands in a window of its own
with the system turn, which then exceeds the budget: texts are never cut.

Spark sorts the turns by conversation; a task walks its partition as a stream and
holds one window at a time, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conflictlake.llm import bpe
from conflictlake.llm.common import map_arrow

END = "</turn>"
_TEXT = re.compile(r"\\|(?=###)#|<(?=/turn>)")
_ROLE = re.compile(r"[\\#:<\n]")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*) </turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)

WINDOWS = ("conv_id long, window int, text string, n_turns int, n_repeated int, n_tokens long, mask_starts array<int>, mask_ends array<int>")


def escaped(text: str) -> str:
    return _TEXT.sub(lambda m: "\\" + m[0], text)


def plain(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """The written turn, and where its text begins and ends in it."""
    head = f"### {_ROLE.sub(lambda m: chr(92) + m[0], role)}: "
    body = escaped(text)
    return f"{head}{body} {END}\n", len(head), len(head) + len(body)


def parse(window: str) -> list[tuple[str, str, int, int]]:
    """The turns of a window: role, text, and where the written text begins and ends."""
    return [(plain(m[1]), plain(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(window)]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


class _Window:
    def __init__(self, system: list, repeated: list):
        self.turns, self.n_repeated = system + repeated, len(system) + len(repeated)
        self.tokens = sum(t[4] for t in self.turns)

    def row(self, conv, number: int) -> tuple:
        at, starts, ends = 0, [], []
        for i, (_, written, lo, hi, _, target) in enumerate(self.turns):
            if target and i >= self.n_repeated:
                starts.append(at + lo)
                ends.append(at + hi)
            at += len(written)
        return (conv, number, "".join(t[1] for t in self.turns), len(self.turns), self.n_repeated, self.tokens, starts, ends)


def windows(turns: DataFrame, tokenizer: str, budget: int = 1024, history: int = 256) -> DataFrame:
    """The windows of all conversations (columns WINDOWS), each conversation's in order.

    Turns stand in the order of ``turn``, ties by role and text, null turns first.
    A null text or role is empty; a null conv_id is a conversation.  Repeated rows
    are turns like any other.  The system turns at a conversation's begin are kept
    in every window; later ones are ordinary turns.  ``n_repeated`` counts the
    turns of a window that an earlier window has already.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = bpe.load(tokenizer)
        names = [f.split()[0] for f in WINDOWS.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        out, size = [], 0
        conv, started = None, False
        system, window, number = [], None, 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)

        def close():
            nonlocal size
            out.append(window.row(conv, number))
            size += len(out[-1][2])

        for cid, role, text in _conversations(batches):
            if not started or cid != conv:
                if started:
                    close()
                conv, started, system, window, number = cid, True, [], _Window([], []), 0
            written, lo, hi = turn_text(role, text)
            turn = (role, written, lo, hi, tok.count(written), role == "assistant")
            leading = role == "system" and len(window.turns) == len(system) and number == 0
            if not leading and len(window.turns) > window.n_repeated + (len(system) if number == 0 else 0) and window.tokens + turn[4] > budget:
                close()
                past, keep, spent = window.turns[len(system):], [], 0
                room = min(history, budget - sum(t[4] for t in system) - turn[4])
                for t in reversed(past):  # prefix sums from the back
                    if spent + t[4] > room:
                        break
                    keep, spent = [t, *keep], spent + t[4]
                window, number = _Window(system, keep), number + 1
            window.turns.append(turn)
            window.tokens += turn[4]
            if leading:
                system = [*system, turn]
            if size > 1 << 20:
                yield batch()
                out, size = [], 0
        if started:
            close()
        if out:
            yield batch()

    return map_arrow(rows, form, WINDOWS)


def digests(formed: DataFrame) -> DataFrame:
    """What the windows say when read back, one row per conversation (needs the order that ``windows`` gives)."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        conv, state, out = None, None, []

        def done():
            return (conv, state["n"], state["all"].hexdigest(), state["loss"], state["sha"].hexdigest(), state["chars"], state["windows"])

        def batch():
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)

        for cid, number, text, _, repeated, _, starts, ends in _conversations(batches):
            if number == 0:
                if state:
                    out.append(done())
                conv, state = cid, {"n": 0, "all": hashlib.sha256(), "loss": 0, "sha": hashlib.sha256(), "chars": 0, "windows": 0}
            for role, said, _, _ in parse(text)[repeated:]:
                state["n"] += 1
                state["all"].update(f"{role}\n{said}\n".encode())
            for lo, hi in zip(starts, ends):
                target = plain(text[lo:hi])
                state["loss"] += len(target)
                state["sha"].update(target.encode())
            state["chars"] += len(text)
            state["windows"] += 1
            if len(out) > 5000:
                yield batch()
                out = []
        if state:
            out.append(done())
        if out:
            yield batch()

    return map_arrow(formed, read, schema)
