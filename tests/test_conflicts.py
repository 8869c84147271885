"""Golden cases F01-F15 (FIXTURES.md) and a property test against tests/model.py."""

import random

from conflictlake.operators.conflicts import extract_blocks
from golden import text
from model import blocks as model_blocks
from model import resolve as model_resolve

# (id, conflict file, merged file, [(start, end, status, resolution, snippet), ...])
GOLDEN = [
    ("F01", "a b H x M y E c d", "a b xy c d", [(2, 6, "ok", "xy", "a b xy c d")]),
    ("F02", "a H x B o M y E c", "a x c", [(1, 7, "ok", "x", "a x c")]),
    ("F03", "H x M y E c d", "y c d", [(0, 4, "ok", "", "c d")]),
    ("F04", "a b H x M y E", "a b y", [(2, 6, "ok", "", "a b")]),
    ("F05", "a b H x M y E", "a b", [(2, 6, "no_valid_after", None, None)]),
    ("F06", "H x M y E", "x y", [(0, 4, "ambiguous", None, None)]),
    ("F07", "a H x M y E m H p M q E z", "a x m q z",
     [(1, 5, "ok", "x", "a x m H p M q"), (7, 11, "ok", "q", "x M y E m q z")]),
    ("F08", "a H x M y E H p M q E z", "a x q z",
     [(1, 5, "ok", "", "a H p M q E"), (6, 10, "ok", "", "H x M y E z")]),
    ("F09", "a H x M y E c", "a k a y c", [(1, 5, "ok", "y", "a y c")]),
    ("F10", "a H x M y E c", "a x c a y c", [(1, 5, "ambiguous", None, None)]),
    ("F11", "a H x M y E c", "a x c k c", [(1, 5, "ok", "x", "a x c")]),
    ("F12", "a H x M y E c", "A x c", [(1, 5, "before_not_found", None, None)]),
    ("F13", "a H x M y E c H p M", "a y c", [(1, 5, "ok", "y", "a y c H p M")]),
    ("F14", "a H x M y E c", "c x a", [(1, 5, "no_valid_after", None, None)]),
]


def _tok(s):
    return "".join(text(x) for x in s.split()) if s else ""


def test_golden_blocks(spark):
    rows = [(i, 0, text(c), text(m)) for i, (_, c, m, _) in enumerate(GOLDEN)]
    rows.append((99, 0, text("a H x M y E c"), text("a x c", final_newline=False)))   # F15
    rows.append((98, 0, "", "a\n"))                                                  # empty conflict file
    rows.append((97, 0, text("a H x M y E c"), ""))                                  # empty merged file
    rows.append((96, 0, text("a H x M y E c"), None))                                # no merged file
    rows.append((95, 0, "a\r\n<<<<<<< L\r\nx\r\n========\r\ny\r\n>>>>>>> R\r\nc\r\n", "a\nx\nc\n"))
    rows.append((94, 0, "a\u2028<<<<<<< L\nx\n=======\ny\n>>>>>>> R\nc\x85", "a\u2028y\nc\x85"))
    rows.append((93, 0, text("a H H x M y E c"), "a y c\n".replace(" ", "\n")))       # second open ignored
    df = spark.createDataFrame(rows, "merge_idx long, file_no int, conflict_text string, merged_text string")
    got = {}
    for r in extract_blocks(df).collect():
        got.setdefault(r.merge_idx, []).append(r)
    for i, (fid, _, _, exp) in enumerate(GOLDEN):
        rs = sorted(got[i], key=lambda r: r.block_no)
        assert len(rs) == len(exp), fid
        for r, (s, e, st, res, snip) in zip(rs, exp):
            assert (r.start_line, r.end_line, r.status) == (s, e, st), fid
            if st == "ok":
                assert r.resolution == _tok(res), fid
                assert r.resolved == _tok(snip), fid
                assert r.coherent and r.contained, fid
    assert got[99][0].status == "after_not_found"
    assert 98 not in got
    assert got[97][0].status == "before_not_found"
    assert got[96][0].status == "no_merged_file"
    assert (got[95][0].status, got[95][0].resolution) == ("ok", "x\n")
    assert (got[94][0].status, got[94][0].resolution) == ("ok", "y\n")
    assert (got[93][0].start_line, got[93][0].end_line, got[93][0].resolution) == (1, 6, "y\n")


def _random_case(rnd):
    """A conflicted file of plain lines, well-formed blocks and stray markers,
    and a merged file that mostly keeps the plain lines and one side."""
    plain = ["a\n", "b\n", "c\n", "d\n"]
    cl, ml = [], []
    for _ in range(rnd.randint(0, 8)):
        r = rnd.random()
        if r < 0.35:
            left = [rnd.choice(plain) for _ in range(rnd.randint(0, 2))]
            right = [rnd.choice(plain) for _ in range(rnd.randint(0, 2))]
            base = ["||||||| B\n", rnd.choice(plain)] if rnd.random() < 0.3 else []
            cl += ["<<<<<<< L\n", *left, *base, "=======\n", *right, ">>>>>>> R\n"]
            ml += rnd.choice([left, right, left + right, []])
        elif r < 0.42:
            cl.append(rnd.choice(["<<<<<<< L\n", "=======\n", ">>>>>>> R\n"]))
        else:
            x = rnd.choice(plain)
            cl.append(x)
            if rnd.random() < 0.9:
                ml.append(x)
    if ml and rnd.random() < 0.2:
        ml[-1] = ml[-1].rstrip("\n")
    return "".join(cl), "".join(ml)


def test_property_against_model(spark):
    rnd = random.Random(3)
    cases = [_random_case(rnd) for _ in range(400)]
    df = spark.createDataFrame([(i, 0, c, m) for i, (c, m) in enumerate(cases)],
                               "merge_idx long, file_no int, conflict_text string, merged_text string")
    got = {}
    for r in extract_blocks(df).collect():
        got[(r.merge_idx, r.block_no)] = r
    n = 0
    for i, (c, m) in enumerate(cases):
        cl, ml = c.splitlines(keepends=True), m.splitlines(keepends=True)
        for k, (s, e) in enumerate(model_blocks(cl), start=1):
            r = got.pop((i, k))
            st, res = model_resolve(ml, cl, s, e)
            assert (r.start_line, r.end_line, r.status) == (s, e, st), (c, m)
            if st == "ok":
                assert r.resolution == "".join(res)
            n += 1
    assert not got and n > 100


def test_strip_final_newline_option(spark):
    df = spark.createDataFrame([(1, 0, text("a H x M y E c"), text("a x c"))],
                               "merge_idx long, file_no int, conflict_text string, merged_text string")
    assert extract_blocks(df).first().status == "ok"
    assert extract_blocks(df, strip_final_newline=True).first().status == "after_not_found"


def test_file_with_many_blocks(spark):
    """Marker positions are computed once per file: 300 blocks in one file
    resolve in seconds (nesting them inside the per-block lambdas made this
    cubic)."""
    import time
    k = 300
    conflict = "".join(f"c{i}a\nc{i}b\n<<<<<<< L\nx{i}\n=======\ny{i}\n>>>>>>> R\n" for i in range(k)) + "end\n"
    merged = "".join(f"c{i}a\nc{i}b\nx{i}\n" for i in range(k)) + "end\n"
    df = spark.createDataFrame([(1, 0, conflict, merged)],
                               "merge_idx long, file_no int, conflict_text string, merged_text string")
    t0 = time.time()
    rows = sorted(extract_blocks(df).collect(), key=lambda r: r.block_no)
    assert time.time() - t0 < 60
    assert [r.resolution for r in rows] == [f"x{i}\n" for i in range(k)]


def test_doubling_the_blocks_doubles_the_time(spark):
    import time
    took = {}
    for k in (200, 1000, 2000, 1000, 2000):
        conflict = "".join(f"c{i}a\nc{i}b\n<<<<<<< L\nx{i}\n=======\ny{i}\n>>>>>>> R\n" for i in range(k)) + "end\n"
        merged = "".join(f"c{i}a\nc{i}b\nx{i}\n" for i in range(k)) + "end\n"
        df = spark.createDataFrame([(1, 0, conflict, merged)], "merge_idx long, file_no int, conflict_text string, merged_text string")
        t0 = time.time()
        rows = extract_blocks(df).collect()
        took[k] = min(time.time() - t0, took.get(k, 1e9))
        assert len(rows) == k and {r.status for r in rows} == {"ok"}
    assert took[2000] < 2.6 * took[1000] + 1, took


def test_file_of_equal_lines(spark):
    """50,000 equal lines and 1000 blocks: no list of places is made, and every block is ambiguous but those near the ends."""
    import time
    gap = "same\n" * 50
    conflict = "".join(gap + "<<<<<<< L\nx\n=======\ny\n>>>>>>> R\n" for _ in range(1000)) + gap + "end\n"
    merged = "start\n" + "same\n" * 50_000 + "end\n"
    df = spark.createDataFrame([(1, 0, conflict, merged)], "merge_idx long, file_no int, conflict_text string, merged_text string")
    t0 = time.time()
    rows = extract_blocks(df).collect()
    assert time.time() - t0 < 30
    assert len(rows) == 1000 and {r.status for r in rows} == {"ambiguous"}


def test_repeated_contexts_nearest_places(spark):
    """Contexts that occur several times against the list of all places, with lines that repeat."""
    import random
    rnd = random.Random(8)
    cases = []
    for _ in range(150):
        line = lambda: rnd.choice(["a\n", "a\n", "b\n", "}\n", "\n", "ab\n"])
        body = [line() for _ in range(rnd.randint(0, 12))]
        at = rnd.randint(0, len(body))
        block = ["<<<<<<< L\n", "x\n", "=======\n", "y\n", ">>>>>>> R\n"]
        parts = [body[:at], body[at:], ["x\n"] * rnd.randint(0, 2), [line() for _ in range(rnd.randint(0, 4))]]
        merged = sum((rnd.choice(parts) for _ in range(rnd.randint(1, 6))), []) + rnd.choice([[], ["z\n"]])
        cases.append(("".join(body[:at] + block + body[at:]), "".join(merged)))
    df = spark.createDataFrame([(i, 0, c, m) for i, (c, m) in enumerate(cases)], "merge_idx long, file_no int, conflict_text string, merged_text string")
    got = {r.merge_idx: r for r in extract_blocks(df).collect()}
    seen = set()
    for i, (c, m) in enumerate(cases):
        cl, ml = c.splitlines(keepends=True), m.splitlines(keepends=True)
        (s, e), = model_blocks(cl)
        st, res = model_resolve(ml, cl, s, e)
        seen.add(st)
        assert got[i].status == st, (c, m)
        if st == "ok":
            assert got[i].resolution == "".join(res), (c, m)
    assert len(seen) >= 4
