"""The pipeline's stages against brute force, each on what its predecessor kept."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from conflictlake.llm import packing, quality
from conflictlake.llm.common import settled, settled_with
from conftest import SF001
from test_mixing import shares
from test_ngram_join import brute
from test_quality import WORD


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(-1, None, None, None, None), (None, "", "en", "x", 0)], docs.schema))
    out = []
    for _, stage in corpus_pipeline.STAGES:
        out.append(settled(stage(spark, docs, SF001), "test-stage"))
        if len(out) < 4:
            assert out[-1].columns == docs.columns
        docs = out[-1]
    source = spark.read.parquet(f"{SF001}/documents.parquet")
    verdicts = {r["doc_id"]: r["kept"] for r in quality.judge(source.unionByName(source.limit(3)), keep=["doc_id"]).collect()}
    kept = [(r["doc_id"], r["text"]) for r in out[0].collect()]
    assert {d for d, _ in kept} == {d for d, k in verdicts.items() if k}
    groups = {c for _, n, c in brute(kept, 5, 80)}
    unique = out[1].collect()
    assert sorted(r["doc_id"] for r in unique) == sorted(groups)
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in unique}
    whole, most = Counter(), Counter()
    for r in unique:
        whole[r["source"]] += size[r["doc_id"]]
        most[r["source"]] = max(most[r["source"]], size[r["doc_id"]])
    mixed = out[2].collect()
    copies = Counter(r["doc_id"] for r in mixed)
    assert max(copies.values()) <= 2 and set(copies) <= groups
    for s, target in shares(whole, [5, 2, 1]).items():
        assert abs(sum(size[r["doc_id"]] for r in mixed if r["source"] == s) - target) <= 2 * most[s] + 1
    pieces = Counter(r["doc_id"] for r in out[3].collect() if r["piece"] == 0)
    assert pieces == copies
    used = Counter()
    for r in out[3].collect():
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024 and sum(used.values()) / 1024 > 0.9 * (len(used) - 1)
    assert packing.END_ID == 2


def test_empty(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = settled(stage(spark, docs, SF001), "test-stage")
        assert docs.count() == 0


def test_aggregates_are_taken_as_rows_are_written(spark):
    made = spark.range(1000).repartition(7)
    out, told = settled_with(made.where("id % 2 = 0").groupBy((F.col("id") % 10).alias("k")).agg(F.sum("id").alias("s")), "test-told", n=F.count("*"), s=F.sum("s"), odd=F.count_if(F.col("k") == 1))
    assert told == {"n": 5, "s": sum(range(0, 1000, 2)), "odd": 0} and out.columns == ["k", "s"] and out.count() == 5
    for nothing in (made.where("id < 0"), spark.createDataFrame([], "id long"), made.limit(0)):
        out, told = settled_with(nothing, "test-told", n=F.count("*"), s=F.sum("id"))
        assert told == {"n": 0, "s": None} and out.count() == 0


def queries_of(spark, stage, docs) -> int:
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = store.executionsCount()
    stage(spark, docs, SF001).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return store.executionsCount() - before


def test_stages_ask_few_queries_of_the_driver(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    asked = {name: queries_of(spark, stage, docs) for name, stage in corpus_pipeline.STAGES[:3]}
    assert asked["quality rules"] <= 13 and asked["n-gram Jaccard join"] <= 26 and asked["mixing sources to target weights"] <= 4, asked
