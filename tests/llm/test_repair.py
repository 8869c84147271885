"""Structure repair against a shortest-path search over whole edit strings, and segments of every size."""

import hashlib
import heapq
import random
import zlib

import pytest

from conflictlake.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def cheapest(rows):
    """(cost, least audit, repaired lines) by Dijkstra over (row, state) with the edit string as second key."""
    seen, kinds = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(SPACES)
        kind = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(kind)
    grown, kept = {0: 2, 1: 2, 2: 3, 3: 2}, {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, said, at, q, lines = heapq.heappop(heap)
        if (at, q) in done:
            continue
        done.add((at, q))
        if at == len(rows) and q in (0, 3):
            return cost, said, kinds, lines
        name = "user" if grown[q] == 2 else "assistant"
        heapq.heappush(heap, (cost + 3, said + "I", at, grown[q], (*lines, f"{name}:")))
        if at < len(rows):
            role, text = rows[at][2:]
            extra = 3 if kinds[at] == "truncated" else 0
            heapq.heappush(heap, (cost + 4, said + "D", at + 1, q, lines))
            if kinds[at] not in ("blank", "duplicate"):
                if (q, role[:1]) in kept:
                    heapq.heappush(heap, (cost + extra, said + "K", at + 1, kept[q, role[:1]], (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + extra + 3, said + "R", at + 1, grown[q], (*lines, f"{name}:{text}")))


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], [])
    for r in brute_damage(rows):
        groups[r[0]].append(r)
    out = {}
    for conv, mine in groups.items():
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:100].encode(), hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        cost, said, kinds, lines = cheapest(mine)
        turns = {r[1] for r in mine if r[1] is not None}
        first = [r[2][:1] for r in mine]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, said, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed, n=60, longest=9):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.randint(1, longest)):
            role = rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rnd.choice(["Yes.", "No!", "cut off", "", " \n", None, "Well ?\t", f"t{rnd.randint(0, 3)}.", "é…", "x" * 300 + "."])
            rows.append((None if c == 7 else c, rnd.choice([t, t, t, t + 2, None]), role, text))
    return rows


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", seg int, kind int").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in R.audit(R.damage(df), df).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_shortest_paths(spark, seed):
    check(spark, conversations(seed))


def test_conversation_of_many_segments(spark, monkeypatch):
    """One conversation that is cut into segments of five rows at most, copies of a row among them."""
    monkeypatch.setattr(R, "SEGMENT_ROWS", 5)
    rows = conversations(3, 8)
    rnd = random.Random(4)
    rows += [(100, i, rnd.choice(["user", "assistant", "system"]), rnd.choice([f"a{i}.", f"b{i}", "same.", ""])) for i in range(150)]
    rows += [(100, None, "user", "same.")] * 12
    check(spark, rows)


def test_rows_are_legal_and_edits_replay(spark):
    rows = conversations(5, 20)
    df = spark.createDataFrame(rows, SCHEMA)
    found = R.Repair(df)
    said = {}
    for r in found.rows().orderBy("seg", "place").collect():
        said.setdefault(r["conv_id"], []).append(r)
    for mine in said.values():
        roles = "".join(r["role"][0] for r in mine)
        assert roles.removeprefix("s") == "ua" * (len(roles.removeprefix("s")) // 2) and len(roles) > 1
        assert all(r["text"] == "" for r in mine if r["edit"] == "I")
    found.delete()


def test_checkpoints_do_not_change_the_edits():
    rnd = random.Random(6)
    for n in (0, 1, 2, 3, 4, 50, 1000):
        kinds = bytes(rnd.choice([0, 1, 2, 3, 5, 6, 9, 10]) for _ in range(n))
        v, after = R.FINAL, []
        for k in reversed(kinds):
            made = R.step(k, R._scaled(v)[0])
            after.append(made[2])
            v = made[0]
        state, said = 0, ""
        for moves in reversed(after):
            s, state = moves[state]
            said += s
        got, end = R.tight_edits(kinds, R.FINAL, 0, True)
        assert got.startswith(said) and set(got[len(said):]) <= {"I"} and end in (0, 3)
        assert R.backward(kinds, R.FINAL)[1] + R.backward(kinds, R.FINAL)[0][0] == sum(
            {"K": 0, "R": 3, "D": 4, "I": 3}[e] for e in got) + 3 * sum(1 for e, k in zip((e for e in got if e != "I"), kinds) if e != "D" and k & R.SHORT)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert R.audit(R.damage(df), df).collect() == []
