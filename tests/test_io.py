"""Round trips through the file sources and sinks."""

import gzip
import json
import os
import tempfile

from pyspark.sql import functions as F

from conflictlake.operators import repos as RP
from conflictlake.sources import io


def _tmp():
    return tempfile.mkdtemp(prefix="cl-io-")


def test_catalogue_dump_roundtrip(spark):
    d = _tmp()
    head = ",".join(io.CATALOGUE_COLUMNS)
    rows = ["o/a,Java,1,2,1,0.5,3,4,1,10,0.1,350,0,1,0,1", "o/b,None,1,2,1,0.5,3,4,1,10,0.1,360,0,1,0,1",
            "elastic/elasticsearch,Java,1,2,1,0.5,3,4,1,10,0.1,400,0,1,0,1", "o/c,Java,,2,1,0.5,3,4,1,10,0.1,1,0,1,0,1",
            "o/d,Java,1,2,1,0.5,3,4,1,10,0.1,370,0,1,0,1"]
    with gzip.open(os.path.join(d, "dump.csv.gz"), "wt") as f:
        f.write(head + "\n" + "\n".join(rows) + "\n")
    raw = io.read_catalogue_dump(spark, d)
    assert [r.asDict() for r in RP.language_counts(raw).collect()] == [{"language": "Java", "repo_count": 4}]
    assert RP.language_totals(raw).first().asDict() == {"languages": 1, "repositories": 5}
    clean = io.cast_catalogue(RP.clean_catalogue(raw))
    got = sorted((r.idx, r.repository, r.stars) for r in clean.collect())
    assert got == [(0, "o/a", 350), (4, "o/d", 370)]
    out = os.path.join(d, "out")
    io.write_csv(clean, out)
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 2


def test_text_pairs_and_responses(spark):
    d = _tmp()
    for stem, c, m in (("3-0", "a\n<<<<<<< L\nx\n=======\ny\n>>>>>>> R\nc\n", "a\nx\nc\n"), ("3-1", "q\n", None)):
        with open(os.path.join(d, f"{stem}.conflict"), "w") as f:
            f.write(c)
        if m is not None:
            with open(os.path.join(d, f"{stem}.final_merged"), "w") as f:
                f.write(m)
    pairs = {r.stem: r for r in io.read_text_pairs(spark, d).collect()}
    assert pairs["3-0"].merged_text == "a\nx\nc\n" and pairs["3-1"].merged_text is None
    assert (pairs["3-0"].merge_idx, pairs["3-0"].file_no) == (3, 0)
    rd = os.path.join(d, "cache", "m1")
    os.makedirs(rd)
    with open(os.path.join(rd, "abc.json"), "w") as f:
        json.dump({"prompt": "p", "result": "r"}, f, indent=4)
    resp = io.read_responses(spark, os.path.join(d, "cache")).collect()
    assert [(r.model, r.cache_key, r.result, r.reasoning) for r in resp] == [("m1", "abc", "r", None)]
    from conflictlake.operators.responses import latest_responses
    assert resp[0].written_at is not None and latest_responses(io.read_responses(spark, os.path.join(d, "cache"))).first().result == "r"


def test_api_pages_cap_and_dir_union(spark):
    d = _tmp()
    with open(os.path.join(d, "p.json"), "w") as f:
        for p in range(3):
            items = [{"full_name": f"o/r{p}{i}", "stargazers_count": i, "archived": False} for i in range(600)]
            f.write(json.dumps({"total_count": 1800, "items": items}) + "\n")
    pages = io.read_api_pages(spark, d)
    items = io.api_items(pages)
    assert items.count() == 1000 and io.api_items(pages, 5000).count() == 1800
    # the cap holds for each search, not for all of them together
    two = spark.range(2).selectExpr("concat('s', id) as search", "id as page", "transform(sequence(1, 800), i -> named_struct('n', i)) as items")
    assert io.api_items(two, search="search").count() == 1600 and io.api_items(two, 500, "search").count() == 1000
    from pyspark.sql import Observation
    obs = Observation("archived")
    kept = RP.api_query_filter(RP.format_api_items(items).withColumn(
        "archived", F.col("stars") % 2 == 1), exclude_archived=True, observation=obs)
    assert kept.count() == 500 and obs.get["removed"] == 500
    rows = RP.format_api_items(items).where("stars >= 599").collect()
    assert {r.repository for r in rows} == {"o/r0599"} and rows[0].default_branch == "main"
    c = _tmp()
    os.makedirs(os.path.join(c, "x"))
    with open(os.path.join(c, "a.csv"), "w") as f:
        f.write("repository,stars\no/a,1\n")
    with open(os.path.join(c, "x", "b.csv"), "w") as f:
        f.write("repository,notes\no/b,n\n")
    u = io.read_csv_dir(spark, c)
    assert sorted(u.columns) == ["notes", "repository", "stars"] and u.count() == 2
    assert {(r.repository, r.stars, r.notes) for r in u.collect()} == {("o/a", "1", None), ("o/b", None, "n")}
    blocks = os.path.join(_tmp(), "conflict_blocks")
    os.makedirs(blocks)
    with open(os.path.join(blocks, "1-0-1.conflict"), "w") as f:
        f.write("x")
    assert io.read_text_pairs(spark, blocks).count() == 1
    assert io.read_text_pairs(spark, blocks, skip_component="conflict_blocks").count() == 0


def test_row_position_follows_file_order_across_splits(spark):
    d = _tmp()
    with open(os.path.join(d, "big.csv"), "w") as f:
        f.write("repository\n" + "".join(f"r{i:06d}\n" for i in range(60000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        raw = spark.read.schema("repository string").option("header", True).csv(d)
        assert raw.rdd.getNumPartitions() > 4
        rows = RP.with_row_position(raw).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 60000 and all(r.repository == f"r{r.idx:06d}" for r in rows)
