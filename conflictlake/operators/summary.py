"""Repository summary.

The metrics rows are joined to the conflict index by merge id and aggregated
per repository.  Both sides are big tables in general, so the join is left to
Catalyst (sort-merge, or broadcast when AQE sees a small side); the aggregate
is a partial/final hash aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# --- fixed values -------------------------------------------------------------
ALL_REPOSITORIES = "ALL_REPOSITORIES"
# -----------------------------------------------------------------------------

SUMMARY_COLUMNS = ["repository", "total_conflicts", "selected_conflicts",
                   "filtered_out_conflicts", "failed_max_lines", "failed_token_count",
                   "failed_incoherent", "selection_rate"]


def merge_id_of(conflict_id) -> F.Column:
    """Text before the first '-' of a conflict id."""
    return F.substring_index(F.col(conflict_id) if isinstance(conflict_id, str) else conflict_id, "-", 1)


def _merge_map(index: DataFrame) -> DataFrame:
    """merge id (as text) -> repository, one row per id.  Duplicate ids keep
    the greatest repository name (a deterministic stand-in for 'last row')."""
    return (index.select(F.col("merge_idx").cast("string").alias("merge_id"), "repository")
            .groupBy("merge_id").agg(F.max("repository").alias("repository")))


def _agg(df: DataFrame) -> list:
    sel = F.sum(F.col("selected").cast("long"))
    tot = F.count(F.lit(1))
    return [
        tot.alias("total_conflicts"),
        sel.alias("selected_conflicts"),
        (tot - sel).alias("filtered_out_conflicts"),
        F.sum(F.col("fail_max_lines").cast("long")).alias("failed_max_lines"),
        F.sum(F.col("fail_token_count").cast("long")).alias("failed_token_count"),
        F.sum(F.col("fail_incoherent").cast("long")).alias("failed_incoherent"),
        F.when(tot > 0, sel / tot).otherwise(F.lit(0.0)).alias("selection_rate"),
    ]


def basic_summary(metrics_df: DataFrame) -> DataFrame:
    """A4: one row over all metrics, labelled ALL_REPOSITORIES (rate 0.0 on
    zero rows; the sums of an empty table are reported as 0)."""
    out = metrics_df.agg(*_agg(metrics_df))
    out = out.select(F.lit(ALL_REPOSITORIES).alias("repository"),
                     *[F.coalesce(F.col(c), F.lit(0)).alias(c) if c != "selection_rate" else F.col(c)
                       for c in SUMMARY_COLUMNS[1:]])
    return out


def with_repository(metrics_df: DataFrame, index: DataFrame) -> DataFrame:
    """P6 + J1: attach the repository of each conflict (null when unmapped)."""
    m = metrics_df.withColumn("merge_id", merge_id_of("conflict_id"))
    return m.join(_merge_map(index), "merge_id", "left")


def repository_summary(metrics_df: DataFrame, index: DataFrame | None) -> DataFrame:
    """A3 with the A4 fallback.

    Conflicts whose merge id is not in the index are left out (they are
    reported by ``unmapped_count``).  With no index, or when no conflict maps,
    the single ALL_REPOSITORIES row is returned instead.  The metrics are summed
    per merge id before they meet the index, then by repository and over all in
    one aggregate (grouping sets); the total knows how many conflicts mapped, so
    it is the answer exactly when none did.
    """
    if index is None:
        return basic_summary(metrics_df)
    sums = ("total_conflicts", "selected_conflicts", "failed_max_lines", "failed_token_count", "failed_incoherent")
    flags = metrics_df.select(merge_id_of("conflict_id").alias("merge_id"), F.lit(1).cast("long").alias("total_conflicts"),
                              *[F.col(c).cast("long").alias(n) for c, n in zip(("selected", "fail_max_lines", "fail_token_count", "fail_incoherent"), sums[1:])])
    per_merge = flags.groupBy("merge_id").agg(*[F.sum(c).alias(c) for c in sums])
    mapped = per_merge.join(_merge_map(index), "merge_id", "left").select("repository", *sums)
    zero = metrics_df.sparkSession.range(1).select(F.lit(None).cast("string").alias("repository"), *[F.lit(0).cast("long").alias(c) for c in sums])
    every = mapped.unionByName(zero).groupingSets([["repository"], []], "repository").agg(
        F.grouping_id().alias("_all"), F.sum(F.when(F.col("repository").isNotNull(), F.col("total_conflicts"))).alias("_mapped"),
        *[F.sum(c).alias(c) for c in sums])
    every = every.where(((F.col("_all") == 0) & F.col("repository").isNotNull()) | ((F.col("_all") == 1) & F.col("_mapped").isNull()))
    return every.select(
        F.when(F.col("_all") == 1, F.lit(ALL_REPOSITORIES)).otherwise(F.col("repository")).alias("repository"),
        "total_conflicts", "selected_conflicts", (F.col("total_conflicts") - F.col("selected_conflicts")).alias("filtered_out_conflicts"),
        "failed_max_lines", "failed_token_count", "failed_incoherent",
        F.when(F.col("total_conflicts") > 0, F.col("selected_conflicts") / F.col("total_conflicts")).otherwise(F.lit(0.0)).alias("selection_rate"))


def order_summary(summary: DataFrame) -> DataFrame:
    """Sink order, most selected first, ties by repository."""
    return summary.orderBy(F.desc("selected_conflicts"), F.asc("repository"))


def unmapped_count(metrics_df: DataFrame, index: DataFrame) -> DataFrame:
    """Conflicts without a repository (dropped by the per-repository groups)."""
    return (with_repository(metrics_df, index).where(F.col("repository").isNull())
            .agg(F.count(F.lit(1)).alias("unmapped_conflicts")))


def summary_totals(summary: DataFrame) -> DataFrame:
    """Repositories, repositories with a selected conflict, selected total."""
    return summary.agg(
        F.count(F.lit(1)).alias("total_repositories"),
        F.count_if(F.col("selected_conflicts") > 0).alias("contributing_repositories"),
        F.coalesce(F.sum("selected_conflicts"), F.lit(0)).alias("total_selected"),
    )


def id_overlap(metrics_df: DataFrame, index: DataFrame) -> DataFrame:
    """J2 + U3: how many extracted merge ids are in the index."""
    ext = (metrics_df.select(merge_id_of("conflict_id").alias("merge_id")).distinct()
           .withColumn("_e", F.lit(True)))
    avail = (index.select(F.col("merge_idx").cast("string").alias("merge_id")).distinct()
             .withColumn("_a", F.lit(True)))
    both = ext.join(avail, "merge_id", "full_outer")
    return both.agg(
        F.count("_e").alias("extracted_ids"),
        F.count("_a").alias("available_ids"),
        F.count_if(F.col("_e") & F.col("_a")).alias("overlap_ids"),
    )


def per_repository_counts(with_repo: DataFrame) -> DataFrame:
    """Conflicts per repository (null repository included)."""
    return with_repo.groupBy("repository").agg(F.count(F.lit(1)).alias("conflicts"))


def first_merge_ids(metrics_df: DataFrame, k: int = 10) -> DataFrame:
    """The first ``k`` distinct merge ids in string order (a top-k report)."""
    return (metrics_df.select(merge_id_of("conflict_id").alias("merge_id")).distinct()
            .orderBy("merge_id").limit(k))
