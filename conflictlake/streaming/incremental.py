"""Incremental merge collection, and W6 append."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conflictlake.operators.rank import rank_within


def combine_merges(existing: DataFrame, new: DataFrame, max_num_merges: int,
                   existing_order: str = "merge_idx", new_order: list | None = None) -> DataFrame:
    """Known merges first (in their stored order), then new ones not already
    known (J3 anti-join, U2 existing wins), at most ``max_num_merges`` per
    repository; only ``max - known`` new merges are taken (the known ones use
    up the cap).  Returns repository, merge_commit, source, pos (0-based).
    """
    new_order = new_order or ["commit_ord"]
    ex = existing.select("repository", "merge_commit", existing_order)
    ex = rank_within(ex, ["repository"], [existing_order, "merge_commit"], "pos").drop(existing_order)
    n_ex = ex.groupBy("repository").agg(F.count(F.lit(1)).alias("_nex"))
    nw = (new.select("repository", "merge_commit", *new_order)
          .join(ex.select("repository", "merge_commit"), ["repository", "merge_commit"], "left_anti"))
    w = Window.partitionBy("repository").orderBy(*new_order, "merge_commit")
    nw = nw.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_num_merges)
    nw = (nw.join(n_ex, "repository", "left")
          .withColumn("pos", (F.coalesce("_nex", F.lit(0)) + F.col("_rn") - 1).cast("long"))
          .where(F.col("pos") < max_num_merges))
    return (ex.where(F.col("pos") < max_num_merges).withColumn("source", F.lit("existing"))
            .select("repository", "merge_commit", "source", "pos")
            .unionByName(nw.withColumn("source", F.lit("new"))
                         .select("repository", "merge_commit", "source", "pos")))


def append_responses(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Append fresh responses to the cache table (the reader keeps the
    latest per key, see ``operators.responses.latest_responses``)."""
    return cache.unionByName(fresh, allowMissingColumns=True)
