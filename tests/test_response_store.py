"""Response store: latest rows over writes, a cut-off write, compaction of full buckets only."""

import datetime
import os
import tempfile

from conflictlake.functions.text import cache_key
from conflictlake.streaming.response_store import ResponseStore

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "model string, prompt string, result string, reasoning string, written_at timestamp"


def _rows(spark, ids, text, hours=0, model="m"):
    return spark.createDataFrame([(model, f"p{i}", f"{text}{i}", None, T0 + datetime.timedelta(hours=hours)) for i in ids], SCHEMA)


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def _latest(store):
    rows = [(r["model"], r["prompt"], r["result"]) for r in store.latest().collect()]
    assert len({(m, p) for m, p, _ in rows}) == len(rows)
    return {(m, p): t for m, p, t in rows}


def test_write_crash_rewrite_and_compact(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="responses-")
    store = ResponseStore(spark, path, buckets=6)
    assert _latest(store) == {}
    store.append(_rows(spark, range(40), "a"))
    store.append(_rows(spark, range(10), "late", -5))  # written earlier: does not win
    commit = ResponseStore._commit

    def lost(self, *a):
        raise RuntimeError("driver lost before the commit")

    monkeypatch.setattr(ResponseStore, "_commit", lost)
    try:
        store.append(_rows(spark, range(40), "never", 9))
    except RuntimeError:
        pass
    monkeypatch.setattr(ResponseStore, "_commit", commit)
    want = {("m", f"p{i}"): f"a{i}" for i in range(40)}
    assert _latest(store) == want
    for k in range(3):  # few keys, so few buckets grow
        store.append(_rows(spark, [0, 1], f"new{k}-", 10))
        want.update({("m", f"p{i}"): f"new{k}-{i}" for i in (0, 1)})  # same time: the later write wins
    assert _latest(store) == want
    full = {r["bucket"] for r in store.live().groupBy("bucket").count().where("count > 3").collect()}
    assert 1 <= len(full) < 6
    before = _files(os.path.join(path, "data"))
    assert store.compact(3) == len(full)
    after = _files(os.path.join(path, "data"))
    inside = lambda f: any(f"bucket={b}/" in f for b in full)
    assert {f: t for f, t in before.items() if not inside(f)} == {f: t for f, t in after.items() if not inside(f)}
    assert not {f for f in before if inside(f)} & after.keys()
    assert _latest(store) == want and store.compact(3) == 0
    store.append(_rows(spark, [0], "newest", 11))
    assert _latest(store)["m", "p0"] == "newest0"


def test_compaction_cut_off_before_its_commit(spark, monkeypatch):
    store = ResponseStore(spark, tempfile.mkdtemp(prefix="responses-"), buckets=2)
    for k in range(3):
        store.append(_rows(spark, range(8), f"v{k}-", k))
    want = _latest(store)
    commit = ResponseStore._commit
    monkeypatch.setattr(ResponseStore, "_commit", lambda self, *a: 1 / 0)
    try:
        store.compact(1)
    except ZeroDivisionError:
        pass
    monkeypatch.setattr(ResponseStore, "_commit", commit)
    assert _latest(store) == want
    assert store.compact(1) == 2 and _latest(store) == want
    assert len(_files(os.path.join(store.path, "data"))) == 2


def test_lookup_reads_its_buckets_only(spark):
    store = ResponseStore(spark, tempfile.mkdtemp(prefix="responses-"), buckets=16)
    store.append(_rows(spark, range(50), "a"))
    store.append(spark.createDataFrame([(None, "p1", "no model", None, None), ("m", None, "no prompt", None, None)], SCHEMA))
    asked = spark.createDataFrame([("p3",), ("nobody",), ("p3",)], "prompt string")
    out = store.lookup(asked, "m")
    assert "dynamicpruning" in out._jdf.queryExecution().toString()
    assert sorted((r["prompt"], r["result"]) for r in out.collect()) == sorted([("p3", "a3"), ("p3", "a3"), ("nobody", None)], key=str)
    key = spark.createDataFrame([("p3",)], "prompt string").select(cache_key("prompt").alias("k")).first()["k"]
    assert out.where("prompt = 'p3'").first()["cache_key"] == key
    assert store.latest().count() == 52


def test_empty_write(spark):
    store = ResponseStore(spark, tempfile.mkdtemp(prefix="responses-"))
    store.append(spark.createDataFrame([], SCHEMA))
    assert store.latest().count() == 0 and store.compact() == 0
