"""CSV records across splits against the whole-file reader; row positions without moving rows."""

import csv
import os
import random
import tempfile

import pytest

from conflictlake.operators import repos as RP
from conflictlake.sources import io
from conflictlake.sources import records as R


def _file(path, rows, header=("a", "b", "c"), end="\n"):
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(header)
        w.writerows(rows)


def _rows(rnd, n):
    cell = lambda: rnd.choice(["", "x", 'say "hi"', "two\nlines", "\n", '"', 'a,b', "é\r\nü", "l\n" * rnd.randint(1, 60), " sp ", "\\", '\\"', "0"])
    return [[str(i), cell(), cell()] for i in range(n)]


@pytest.fixture
def splits_of(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def to(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield to
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end,size", [("\n", 300), ("\r\n", 700), ("\n", 10**7)])
def test_equals_the_whole_file_reader(spark, splits_of, end, size):
    d = tempfile.mkdtemp(prefix="csv-")
    rnd = random.Random(size)
    _file(os.path.join(d, "one.csv"), _rows(rnd, 300), end=end)
    _file(os.path.join(d, "two.csv"), _rows(rnd, 5), end=end)
    _file(os.path.join(d, "bare.csv"), [], end=end)
    schema = "a string, b string, c string"
    for keep in (False, True):
        r = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
        if keep:
            r = r.option("emptyValue", "").option("nullValue", "\u0000")
        want = sorted((tuple(x) for x in r.csv(d).collect()), key=str)
        splits_of(size)
        if size < 1000:
            assert R.file_lines(spark, d).rdd.getNumPartitions() > 5
        got = sorted((tuple(x) for x in io.read_csv(spark, d, schema, keep).collect()), key=str)
        assert got == want and len(got) == 305


def test_record_longer_than_splits(spark, splits_of):
    d = tempfile.mkdtemp(prefix="csv-")
    _file(os.path.join(d, "long.csv"), [["1", "line\n" * 500, "x"], ["2", "y", 'q"\n"'], ["3", "", "z"]])
    splits_of(200)
    got = {r["a"]: (r["b"], r["c"]) for r in io.read_csv(spark, d, "a int, b string, c string").collect()}
    assert got == {1: ("line\n" * 500, "x"), 2: ("y", 'q"\n"'), 3: (None, "z")}


def test_many_splits_are_joined(spark, splits_of, monkeypatch):
    """Beyond the size for a broadcast the table of splits is joined, with the same rows."""
    d = tempfile.mkdtemp(prefix="csv-")
    rows = _rows(random.Random(2), 200)
    _file(os.path.join(d, "one.csv"), rows)
    splits_of(400)
    want = sorted((tuple(r) for r in io.read_csv(spark, d, "a string, b string, c string").collect()), key=str)
    monkeypatch.setattr(R, "BROADCAST_SPLITS", 0)
    assert sorted((tuple(r) for r in io.read_csv(spark, d, "a string, b string, c string").collect()), key=str) == want


def test_directory_of_many_headers_in_one_scan(spark, splits_of):
    d = tempfile.mkdtemp(prefix="csv-")
    rnd = random.Random(5)
    want = []
    for i in range(12):
        names = rnd.sample(["repository", "stars", "no tes", "x.y", "tick`s"], rnd.randint(1, 5))
        os.makedirs(os.path.join(d, f"s{i % 3}"), exist_ok=True)
        rows = [[f"{i}-{k}-{c}\nmore" for c in names] for k in range(9)]
        _file(os.path.join(d, f"s{i % 3}", f"{i}.csv"), rows, names)
        want += [{n: v for n, v in zip(names, r)} for r in rows]
    open(os.path.join(d, "other.txt"), "w").write("repository\nno\n")
    splits_of(150)
    out = io.read_csv_dir(spark, d)
    got = [{k: v for k, v in r.asDict().items() if v is not None} for r in out.collect()]
    assert sorted(map(str, (sorted(x.items()) for x in got))) == sorted(map(str, (sorted(x.items()) for x in want)))
    assert out.columns == sorted(out.columns)
    with pytest.raises(Exception):
        io.read_csv_dir(spark, tempfile.mkdtemp(prefix="csv-"))


def test_row_positions_move_no_row(spark, splits_of):
    d = tempfile.mkdtemp(prefix="csv-")
    for k in range(3):
        with open(os.path.join(d, f"f{k}.csv"), "w") as f:
            f.write("repository\n" + "".join(f"r{k}{i:05d}\n" for i in range(3000)))
    splits_of(5000)
    raw = spark.read.schema("repository string").option("header", True).csv(d)
    out = RP.with_row_position(raw)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "SinglePartition" not in plan
    assert [r.repository for r in sorted(out.collect(), key=lambda r: r.idx)] == [f"r{k}{i:05d}" for k in range(3) for i in range(3000)]
    assert out.columns == ["repository", "idx"]
