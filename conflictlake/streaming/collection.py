"""H7: merges collected run after run, with stored state per repository.

Under one folder are three tables, all partitioned by repository:

* ``status``: one row per repository - digest of its kept refs, merges so far, cap,
  whether the collection is complete, and the runs whose rows count;
* ``labels``: every commit that an earlier run has seen from a ref, with the first
  ref that reached it then (repository, sha, ref_rank, branch_name, run);
* ``merges``: the merges collected so far with their place (``pos``, 0-based).

A run compares the refs with the stored digests and goes on with repositories that
can have something new only: new or moved refs, or a raised cap where merges had
been left out, and in either case fewer merges than the cap.  Of those it walks
only commits without a label - a labelled commit has labelled ancestors, so the
walk stops there.  Labels and merges are appended; the status rows of these
repositories are replaced last (dynamic partition overwrite).  Rows of a run that
did not get as far as its status do not count, and the next run takes its
repositories up again.  Other repositories' files are neither read nor written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conflictlake.operators import history as H
from conflictlake.operators.layers import Layers
from conflictlake.operators.stored import Stored

STATUS = "digest string, n_merges long, cap int, complete boolean, runs array<string>, repository string"
LABELS = "sha string, ref_rank long, branch_name string, run string, repository string"
MERGES = "branch_name string, merge_commit string, parent_1 string, parent_2 string, notes string, ref_rank long, commit_ord long, pos long, run string, repository string"


def ref_digests(ranked: DataFrame) -> DataFrame:
    """(repository, digest) of the kept refs with their heads and ranks."""
    one = F.concat_ws("\x00", F.col("ref_rank").cast("string"), "path", "head_sha")
    return ranked.groupBy("repository").agg(F.md5(F.array_join(F.array_sort(F.collect_list(one)), "\n")).alias("digest"))


class MergeStore:
    """The state in ``path``, a folder that all executors share.  A repository without a name is not collected."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _table(self, name: str, schema: str) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def status(self) -> DataFrame:
        """repository, digest, n_merges, cap, complete, runs of the last run that touched each repository."""
        return self._table("status", STATUS)

    def _counted(self, name: str, schema: str, of: DataFrame | None = None) -> DataFrame:
        """Rows of finished runs; ``of``: (repository, due, runs), only its due repositories are read."""
        runs = (self.status() if of is None else of.where("due = 1")).select("repository", F.explode("runs").alias("run"))
        return self._table(name, schema).join(runs, ["repository", "run"], "left_semi")

    def labels(self) -> DataFrame:
        return self._counted("labels", LABELS)

    def merges(self) -> DataFrame:
        """The merges collected so far; ``pos`` is their place in the repository."""
        return self._counted("merges", MERGES)

    def _append(self, df: DataFrame, name: str) -> None:
        df.hint("rebalance", "repository").write.mode("append").partitionBy("repository").parquet(f"{self.path}/{name}")

    def due(self, ranked: DataFrame, max_num_merges: int) -> DataFrame:
        """Every repository that has refs: new digest, what is stored of it, and ``due`` (1 or 0)."""
        now = ref_digests(ranked.where("repository <> ''"))
        old = self.status().withColumnRenamed("digest", "was")
        moved = F.col("was").isNull() | (F.col("was") != F.col("digest"))
        more = ~F.col("complete") & (F.col("cap") < max_num_merges)
        room = F.coalesce("n_merges", F.lit(0)) < max_num_merges
        return now.join(old, "repository", "left").select(
            "repository", "digest", F.coalesce("n_merges", F.lit(0)).alias("n_merges"), F.coalesce("complete", F.lit(False)).alias("complete"),
            F.coalesce("runs", F.expr("CAST(array() AS array<string>)")).alias("runs"),
            F.when((moved | F.coalesce(more, F.lit(False))) & room, 1).otherwise(0).alias("due"))

    def collect(self, refs: DataFrame, commits: DataFrame, max_num_merges: int = H.DEFAULT_MAX_MERGES,
                max_branches: int = H.DEFAULT_MAX_BRANCHES) -> int:
        """One run; how many repositories it took up.

        New merges come after those known, in the order of the rank that first
        labelled them, then newest first.  The result depends only on the tables
        of this run and the state.
        """
        ranked = Stored(H.branch_refs(refs, max_branches), "refs")
        plan = Stored(self.due(ranked.df, max_num_merges), "plan")
        todo = plan.df.where("due = 1")
        n = todo.count()
        if n:
            self._run(ranked.df, plan.df, todo, commits, max_num_merges)
        ranked.delete()
        plan.delete()
        return n

    def _run(self, ranked: DataFrame, plan: DataFrame, todo: DataFrame, commits: DataFrame, cap: int) -> None:
        run = uuid.uuid4().hex
        mine = Stored(commits.join(todo.select("repository"), "repository", "left_semi"), "touched")
        known = Stored(self._counted("labels", LABELS, plan).select("repository", "sha", "ref_rank", "branch_name"), "known")
        fresh = Stored(mine.df.join(known.df.select("repository", "sha"), ["repository", "sha"], "left_anti"), "fresh")
        walk = Layers(fresh.df)
        names = ranked.select("repository", "ref_rank", F.col("path").alias("branch_name"))
        new = H.first_reaching_ref(fresh.df, ranked, walk).join(names, ["repository", "ref_rank"])
        new = Stored(new.select("repository", "sha", F.col("ref_rank").cast("long").alias("ref_rank"), "branch_name"), "labels")

        # merges among new labels, and among old ones where an earlier cap had left some out
        open_ = todo.where("NOT complete").select("repository")
        labelled = new.df.unionByName(known.df.join(open_, "repository", "left_semi"))
        have = self._counted("merges", MERGES, plan).select("repository", F.col("merge_commit").alias("sha"))
        cand = H.merge_candidates(mine.df).join(labelled, ["repository", "sha"]).join(have, ["repository", "sha"], "left_anti")
        cand = Stored(cand.join(todo.select("repository", "n_merges"), "repository"), "candidates")
        order = Window.partitionBy("repository").orderBy("ref_rank", "commit_ord", "sha")
        taken = cand.df.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= cap).where(F.col("n_merges") + F.col("_rn") <= cap)
        taken = taken.select(
            "repository", "branch_name", F.col("sha").alias("merge_commit"), "parent_1", "parent_2", "ref_rank", "commit_ord", (F.col("n_merges") + F.col("_rn") - 1).cast("long").alias("pos"))
        taken = Stored(taken, "taken")
        if not known.df.isEmpty():  # else the walk has every commit
            walk.delete()
            walk = Layers(mine.df.join(taken.df.select("repository").distinct(), "repository", "left_semi"))
        noted = Stored(H.merge_notes(mine.df, taken.df, walk), "noted")
        walk.delete()

        added = noted.df.groupBy("repository").agg(F.count(F.lit(1)).alias("added"))
        offered = cand.df.groupBy("repository").agg(F.count(F.lit(1)).alias("offered"))
        row = todo.join(added, "repository", "left").join(offered, "repository", "left").select(
            "digest", (F.col("n_merges") + F.coalesce("added", F.lit(0))).alias("n_merges"), F.lit(cap).cast("int").alias("cap"),
            (F.coalesce("offered", F.lit(0)) == F.coalesce("added", F.lit(0))).alias("complete"), F.concat("runs", F.array(F.lit(run))).alias("runs"), "repository")
        status = Stored(row, "status")
        for name, schema, rows in (("labels", LABELS, new.df), ("merges", MERGES, noted.df)):
            self._append(rows.withColumn("run", F.lit(run)).select(*[f.split()[0] for f in schema.split(", ")]), name)
        status.df.hint("rebalance", "repository").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repository").parquet(f"{self.path}/status")
        for part in (mine, known, fresh, new, cand, taken, noted, status):
            part.delete()
