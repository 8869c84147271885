"""The three table jobs end to end (D5, C4, W4, W5, T14) and the small
operators without a query of their own (J6, J8, W6, E4, F11, P2, R2)."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conflictlake.functions import text as T
from conflictlake.operators import history as H
from conflictlake.operators import responses as RS
from conflictlake.operators.conflicts import status_counts
from conflictlake.plans import jobs
from conflictlake.sources import io
from conflictlake.streaming.incremental import append_responses
from golden import text


def test_jobs_end_to_end(spark):
    d = tempfile.mkdtemp(prefix="cl-jobs-")
    rows = [(i, 0, text("p q H x M y E r s"), text("p q x r s" if i % 2 else "p q y r s")) for i in range(10)]
    rows.append((10, 0, text("a H x M y E c"), None))
    files = spark.createDataFrame(rows, "merge_idx long, file_no int, conflict_text string, merged_text string")
    files.write.parquet(os.path.join(d, "files"))
    spark.createDataFrame([(i, f"o/r{i % 3}") for i in range(11)], "merge_idx long, repository string") \
        .write.parquet(os.path.join(d, "index"))
    jobs.extract_job(spark, os.path.join(d, "files"), os.path.join(d, "blocks"))
    jobs.metrics_job(spark, os.path.join(d, "blocks"), os.path.join(d, "metrics"), os.path.join(d, "selected"),
                     os.path.join(d, "summary"), os.path.join(d, "index"))
    jobs.build_job(spark, os.path.join(d, "selected"), os.path.join(d, "dataset"))
    blocks = spark.read.parquet(os.path.join(d, "blocks"))
    assert {r.status: r.blocks for r in status_counts(blocks).collect()} == {"ok": 10, "no_merged_file": 1}
    summary = spark.read.parquet(os.path.join(d, "summary")).collect()
    assert sum(r.total_conflicts for r in summary) == 10 and len(summary) == 3
    ds = spark.read.parquet(os.path.join(d, "dataset"))
    assert {r.split: r["count"] for r in ds.groupBy("split").count().collect()} == {"train": 8, "test": 2}
    q = ds.select("question", "prompt").first()
    assert q.question.endswith("\n```") and q.prompt[0].role == "user" and q.prompt[0].content == q.question
    empty = os.path.join(d, "none")
    spark.createDataFrame([], "conflict_id string, conflict string, resolved string").write.parquet(empty)
    with pytest.raises(ValueError):
        jobs.build_job(spark, empty, os.path.join(d, "ds2"))
    assert jobs.build_config(spark).count() == 12


def test_response_cache_ops(spark):
    cache = spark.createDataFrame([("m", "p1", "old", 1), ("m", "p1", "new", 2), ("m", "p2", "r2", 1)],
                                  "model string, prompt string, result string, written_at int")
    cache = cache.withColumn("cache_key", T.cache_key("prompt")).withColumn("reasoning", F.lit(None).cast("string"))
    fresh = cache.limit(0)
    latest = RS.latest_responses(append_responses(cache, fresh))
    req = spark.createDataFrame([("p1",), ("p3",)], "prompt string")
    hits = {r.prompt: r.result for r in RS.lookup(req, latest, model="m").collect()}
    assert hits == {"p1": "new", "p3": None}
    assert [r.prompt for r in RS.misses(req, latest, model="m").collect()] == ["p3"]


def test_cached_refs_and_keys(spark):
    cached = spark.createDataFrame([("r", "refs/heads/b", 0), ("r", "refs/heads/gone", 1)],
                                   "repository string, path string, ref_ord int")
    cur = spark.createDataFrame([("r", "refs/heads/b", "h1", 5), ("r", "refs/heads/new", "h2", 0)],
                                "repository string, path string, head_sha string, ref_ord int")
    got = [(r.path, r.head_sha, r.ref_ord) for r in H.reuse_cached_refs(cached, cur).collect()]
    assert got == [("refs/heads/b", "h1", 0)]
    import hashlib
    k = spark.createDataFrame([("refs/heads/main", "o/n")], "p string, s string") \
        .select(T.ref_key("p").alias("a"), T.slug_key("s").alias("b")).first()
    assert (k.a, k.b) == (hashlib.md5(b"refs/heads/main").hexdigest(), "o_n")


def test_strict_stars_cast_and_empty_notes(spark):
    from conflictlake.operators.repos import clean_catalogue
    bad = spark.createDataFrame([("o/a", "Java", "x1")], "repository string, language string, stars string")
    with pytest.raises(Exception):
        clean_catalogue(bad).collect()
    d = tempfile.mkdtemp(prefix="cl-csv-")
    with open(os.path.join(d, "m.csv"), "w") as f:
        f.write('merge_idx,repository,branch_name,merge_commit,parent_1,parent_2,notes\n0,o/a,b,m,p,q,""\n')
    r = io.read_csv(spark, d, io.MERGES_SCHEMA, keep_empty_strings=True).first()
    assert r.notes == ""


def test_history_and_files_jobs(spark):
    from conflictlake.plans.jobs import BuildOptions
    d = tempfile.mkdtemp(prefix="cl-hist-")
    commits = [("o/a", "m2", ["m1", "f2"], 0), ("o/a", "f2", ["b"], 1), ("o/a", "m1", ["b", "f1"], 2),
               ("o/a", "f1", ["b"], 3), ("o/a", "b", [], 4)]
    spark.createDataFrame(commits, "repository string, sha string, parents array<string>, commit_ord long") \
        .write.parquet(os.path.join(d, "commits"))
    spark.createDataFrame([("o/a", "refs/heads/main", "m2", 0)],
                          "repository string, path string, head_sha string, ref_ord int") \
        .write.parquet(os.path.join(d, "refs"))
    jobs.history_job(spark, os.path.join(d, "refs"), os.path.join(d, "commits"), os.path.join(d, "merges"),
                     opts=BuildOptions(max_num_merges=1))
    m = spark.read.parquet(os.path.join(d, "merges")).collect()
    assert [(r.merge_idx, r.merge_commit, r.notes) for r in m] == [(0, "m2", "")]
    # a second run with a higher cap keeps the known merge first and adds the next one
    jobs.history_job(spark, os.path.join(d, "refs"), os.path.join(d, "commits"), os.path.join(d, "merges2"),
                     os.path.join(d, "merges"), BuildOptions(max_num_merges=2))
    m2 = sorted((r.merge_idx, r.merge_commit) for r in spark.read.parquet(os.path.join(d, "merges2")).collect())
    assert m2 == [(0, "m1"), (1, "m2")]
    spark.createDataFrame([(0, "UU", "src/A.java"), (0, "UU", "src/b.py"), (0, "AA", "src/C.java"),
                           (0, "UU", "lib/Z.java")], "merge_idx long, xy string, path string") \
        .write.parquet(os.path.join(d, "status"))
    spark.createDataFrame([(0, "src/A.java", text("a H x M y E c")), (0, "lib/Z.java", "z\n")],
                          "merge_idx long, path string, text string").write.parquet(os.path.join(d, "wt"))
    spark.createDataFrame([(0, "src/A.java", text("a x c"))],
                          "merge_idx long, path string, text string").write.parquet(os.path.join(d, "final"))
    jobs.files_job(spark, os.path.join(d, "merges"), os.path.join(d, "status"), os.path.join(d, "wt"),
                   os.path.join(d, "final"), os.path.join(d, "files"), os.path.join(d, "index"))
    f = sorted((r.file_no, r.path, r.merged_text is None) for r in spark.read.parquet(os.path.join(d, "files")).collect())
    assert f == [(0, "lib/Z.java", True), (1, "src/A.java", False)]
    idx = sorted(r.conflict_id for r in spark.read.parquet(os.path.join(d, "index")).collect())
    assert idx == ["0-0", "0-1"]
    # the index lists found files only; a merge without any is not in it
    spark.createDataFrame([(0, "UU", "src/A.java"), (0, "UU", "gone/B.java"), (1, "UU", "gone/C.java")], "merge_idx long, xy string, path string") \
        .write.parquet(os.path.join(d, "status2"))
    jobs.files_job(spark, os.path.join(d, "merges2"), os.path.join(d, "status2"), os.path.join(d, "wt"),
                   os.path.join(d, "final"), os.path.join(d, "files2"), os.path.join(d, "index2"))
    assert [(r.merge_idx, r.conflict_id) for r in spark.read.parquet(os.path.join(d, "index2")).collect()] == [(0, "0-1")]


def test_history_job_reruns(spark):
    """A doubled key among the known merges is fatal; a lower cap keeps those collected first, not the smallest shas."""
    from conflictlake.plans.jobs import BuildOptions
    d = tempfile.mkdtemp(prefix="cl-rerun-")
    p = lambda n: os.path.join(d, n)
    commits = [("o/a", "z1", ["y1", "b"], 0), ("o/a", "y1", ["x1", "b"], 1), ("o/a", "x1", ["b", "c"], 2), ("o/a", "b", [], 3), ("o/a", "c", [], 4)]
    spark.createDataFrame(commits, "repository string, sha string, parents array<string>, commit_ord long").write.parquet(p("commits"))
    refs = spark.createDataFrame([("o/a", "refs/heads/main", "z1", 0)], "repository string, path string, head_sha string, ref_ord int")
    refs.write.parquet(p("refs"))
    refs.select("repository", "path", (F.col("ref_ord") + 7).alias("ref_ord")).write.parquet(p("stored"))
    jobs.history_job(spark, p("refs"), p("commits"), p("m1"), opts=BuildOptions(max_num_merges=3), stored_refs_path=p("stored"))
    first = spark.read.parquet(p("m1"))
    assert sorted(r.merge_commit for r in first.collect()) == ["x1", "y1", "z1"]
    jobs.history_job(spark, p("refs"), p("commits"), p("m2"), p("m1"), BuildOptions(max_num_merges=2))
    assert sorted(r.merge_commit for r in spark.read.parquet(p("m2")).collect()) == ["y1", "z1"]
    first.unionByName(first.limit(1)).write.parquet(p("twice"))
    with pytest.raises(ValueError):
        jobs.history_job(spark, p("refs"), p("commits"), p("m3"), p("twice"))


def test_response_without_write_time(spark):
    rows = [("m", "k1", "p1", "r1", None), ("m", "k2", "p2", "old", None), ("m", "k2", "p2", "new", 5)]
    cache = spark.createDataFrame(rows, "model string, cache_key string, prompt string, result string, written_at int")
    assert {r.cache_key: r.result for r in RS.latest_responses(cache).collect()} == {"k1": "r1", "k2": "new"}


def test_selection_job(spark):
    """Catalogue dump -> clean catalogue -> slice of one language by stars."""
    d = tempfile.mkdtemp(prefix="cl-select-")
    os.makedirs(os.path.join(d, "dump"))
    head = ",".join(io.CATALOGUE_COLUMNS)
    line = lambda name, lang, stars: f"{name},{lang}," + ",".join("1" if c != "stars" else str(stars) for c in io.CATALOGUE_COLUMNS[2:])
    rows = [line(f"o/r{i}", "Java", i) for i in range(12)] + [line("o/py", "Python", 99), line("o/none", "NA", 5), line("elastic/elasticsearch", "Java", 500)]
    with open(os.path.join(d, "dump", "a.csv"), "w") as f:
        f.write("\n".join([head, *rows]) + "\n")
    out, cut = os.path.join(d, "clean"), os.path.join(d, "slice")
    jobs.selection_job(spark, os.path.join(d, "dump"), out, cut, "Java", 2, 5)
    clean = spark.read.option("header", True).csv(out)
    assert clean.count() == 13 and {"o/none", "elastic/elasticsearch"}.isdisjoint({r.repository for r in clean.collect()})
    assert [r.repository for r in sorted(spark.read.option("header", True).csv(cut).collect(), key=lambda r: -float(r.stars))] == ["o/r9", "o/r8", "o/r7"]


def test_conflict_index_csv(spark):
    from conflictlake.operators.files import conflict_index_csv
    long = spark.createDataFrame([(3, "o/a", 1, "3-1"), (3, "o/a", 0, "3-0"), (5, "o/b", 0, "5-0")],
                                 "merge_idx long, repository string, file_no int, conflict_id string")
    got = {r.merge_idx: r.conflicts for r in conflict_index_csv(long).collect()}
    assert got == {3: "3-0;3-1", 5: "5-0"}


def test_cli_build(spark):
    from conflictlake.__main__ import main
    d = tempfile.mkdtemp(prefix="cl-cli-")
    rows = [(i, 0, text("p q H x M y E r s"), text("p q x r s")) for i in range(6)]
    spark.createDataFrame(rows, "merge_idx long, file_no int, conflict_text string, merged_text string") \
        .write.parquet(os.path.join(d, "files"))
    main(["--test-size", "0.5", "build", "--files", os.path.join(d, "files"), "--work", os.path.join(d, "w")])
    ds = spark.read.parquet(os.path.join(d, "w", "dataset"))
    assert {r.split: r["count"] for r in ds.groupBy("split").count().collect()} == {"train": 3, "test": 3}


def test_rollup_job(spark):
    d = tempfile.mkdtemp(prefix="cl-rollup-")
    p = lambda n: os.path.join(d, n)
    for lang, n in (("go", 2), ("c", 3)):
        spark.range(n).selectExpr("concat('o/', id) as repository").write.parquet(p(f"{lang}-index"))
        spark.range(n).selectExpr("id as total_conflicts", "id as selected_conflicts").write.parquet(p(f"{lang}-summary"))
        spark.range(10).selectExpr("if(id < 2, 'test', 'train') as split").write.parquet(p(f"{lang}-data"))
    jobs.rollup_job(spark, {x: (p(f"{x}-index"), p(f"{x}-summary"), p(f"{x}-data")) for x in ("go", "c")}, p("out"))
    got = {r.language: (r.repositories, r.contributing, r.selected, r.train, r.test) for r in spark.read.parquet(p("out")).collect()}
    assert got == {"go": (2, 1, 1, 8, 2), "c": (3, 2, 3, 8, 2), "ALL": (5, 3, 4, 16, 4)}
