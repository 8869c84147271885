"""The response cache as an append-only store, compacted bucket by bucket.

A response belongs to a bucket by the hash of its key.  Every write adds files of a
batch of its own, ``data/bucket=<n>/batch=<id>``, and then one small commit: which
batch now holds which bucket's rows, and which earlier batches it replaces there.
A batch without a commit does not exist for readers, so a write that was cut off
leaves nothing behind but files that the next compaction of their bucket removes.

Compaction rewrites only buckets that have grown to more than ``max_batches``
batches: their latest responses become one new batch, one commit replaces the old
ones, and only then are the old files deleted.  All other buckets keep their files.

One writer at a time; readers need no lock.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conflictlake.functions.text import cache_key
from conflictlake.operators.stored import Stored, delete_path

ROWS = "model string, cache_key string, prompt string, result string, reasoning string, written_at timestamp, seq long, bucket int, batch string"
COMMITS = "seq long, bucket int, batch string, replaces array<string>"
RESPONSE = ["model", "cache_key", "prompt", "result", "reasoning", "written_at"]


class ResponseStore:
    """The store in ``path``, a folder that all executors share; ``buckets`` stays the same for its life.

    The latest response of a (model, cache_key) is the one with the greatest
    ``written_at`` (none is oldest), then of the latest write, then the greatest text.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _table(self, name: str, schema: str) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64("model", "cache_key"), F.lit(self.buckets)).cast("int")

    def live(self) -> DataFrame:
        """(bucket, batch, seq) of what readers see."""
        commits = self._table("commits", COMMITS)
        gone = commits.select("bucket", F.explode("replaces").alias("batch"))
        return commits.join(gone, ["bucket", "batch"], "left_anti").select("bucket", "batch", "seq")

    def _next(self) -> int:
        return (self._table("commits", COMMITS).agg(F.max("seq")).first()[0] or 0) + 1

    def _rows(self, live: DataFrame) -> DataFrame:
        # the filter lets the scan leave out other buckets' and batches' files
        return self._table("data", ROWS).join(live.where("bucket >= 0").select("bucket", "batch"), ["bucket", "batch"], "left_semi")

    def _write(self, rows: DataFrame, batch: str) -> None:
        out = rows.withColumn("batch", F.lit(batch)).hint("rebalance", "bucket")
        out.select(*[f.split()[0] for f in ROWS.split(", ")]).write.mode("append").partitionBy("bucket", "batch").parquet(f"{self.path}/data")

    def _commit(self, buckets: DataFrame, batch: str, seq: int, replaces: F.Column) -> None:
        buckets.select(F.lit(seq).cast("long").alias("seq"), "bucket", F.lit(batch).alias("batch"), replaces.alias("replaces")).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def append(self, responses: DataFrame) -> None:
        """Add responses (model, cache_key or prompt, result, reasoning, written_at; missing columns are null).

        A null model or key is a value like any other."""
        kinds = dict(f.split() for f in ROWS.split(", "))
        have = {c: F.col(c) for c in responses.columns}
        if "cache_key" not in have:
            have["cache_key"] = cache_key("prompt")
        seq, batch = self._next(), uuid.uuid4().hex
        rows = responses.select(*[have.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in RESPONSE], F.lit(seq).cast("long").alias("seq"))
        kept = Stored(rows.withColumn("bucket", self._bucket()), "responses")
        touched = Stored(kept.df.select("bucket").distinct(), "touched")
        if not touched.df.isEmpty():
            self._write(kept.df, batch)
            self._commit(touched.df, batch, seq, F.expr("CAST(array() AS array<string>)"))
        kept.delete()
        touched.delete()

    @staticmethod
    def _latest(rows: DataFrame, *more: str) -> DataFrame:
        order = ["written_at", "seq", "result", "reasoning", "prompt"]
        best = rows.groupBy("model", "cache_key", *more).agg(F.max(F.struct(*order)).alias("_r"))
        return best.select("model", "cache_key", *more, *[F.col(f"_r.{c}").alias(c) for c in order])

    def latest(self) -> DataFrame:
        """One row per (model, cache_key)."""
        return self._latest(self._rows(self.live())).select(*RESPONSE)

    def lookup(self, requests: DataFrame, model: str) -> DataFrame:
        """``requests`` (prompt) with ``cache_key`` and the latest result and reasoning of ``model``; only the buckets asked for are read."""
        asked = requests.withColumn("cache_key", cache_key("prompt")).withColumn("model", F.lit(model))
        buckets = Stored(asked.select(self._bucket().alias("bucket")).distinct(), "asked").df
        found = self._latest(self._rows(self.live().join(buckets, "bucket", "left_semi")))
        return asked.join(found.select("model", "cache_key", "result", "reasoning"), ["model", "cache_key"], "left")

    def compact(self, max_batches: int = 4) -> int:
        """Rewrite the buckets with more than ``max_batches`` batches to one batch each; how many there were."""
        live = Stored(self.live(), "live")
        per = live.df.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.collect_list("batch").alias("batches"), F.max("seq").alias("top"))
        full = Stored(per.where(F.col("n") > max_batches), "full")
        n = full.df.count()
        if n:
            batch = uuid.uuid4().hex
            rows = Stored(self._latest(self._rows(full.df.select("bucket", F.explode("batches").alias("batch"))), "bucket"), "compacted")
            self._write(rows.df, batch)
            self._commit(full.df, batch, self._next(), F.col("batches"))
            self._sweep(full.df)
            rows.delete()
        live.delete()
        full.delete()
        return n

    def _sweep(self, of: DataFrame) -> None:
        """Delete files of the buckets ``of`` that no commit makes visible (replaced batches, cut-off writes)."""
        there = self._table("data", ROWS).join(of.where("bucket >= 0").select("bucket"), "bucket", "left_semi").select("bucket", "batch").distinct()
        for r in there.join(self.live(), ["bucket", "batch"], "left_anti").toLocalIterator():  # a folder each
            delete_path(self.spark, f"{self.path}/data/bucket={r['bucket']}/batch={r['batch']}")
