"""Jobs and build configuration.

Three table-to-table jobs replace the stage switches of the original build
script; each reads Parquet and writes Parquet, so every job is a restart
point.  ``build_config`` is the per-language configuration as a small static
table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conflictlake.operators import conflicts as X
from conflictlake.operators import dataset as D
from conflictlake.operators import metrics as M
from conflictlake.operators import summary as S
from conflictlake.operators.stored import Stored
from conflictlake.sources import io

# --- fixed values: per-language build settings --------------------------------
# (language, catalogue source, first row, last row, max merges per repository,
#  test share)
BUILD_CONFIG = [
    ("c", "reaper", 0, 1000, 5, 1.0),
    ("cpp", "reaper", 0, 1000, 8, 1.0),
    ("csharp", "reaper", 0, 1000, 10, 1.0),
    ("go", "github", 0, 1000, 5, 1.0),
    ("javascript", "github", 0, 1000, 12, 1.0),
    ("php", "reaper", 0, 1000, 7, 1.0),
    ("python", "reaper", 0, 1000, 9, 1.0),
    ("ruby", "reaper", 0, 1000, 20, 1.0),
    ("rust", "github", 0, 1000, 6, 1.0),
    ("typescript", "github", 0, 1000, 9, 1.0),
    ("java", "reaper", 1000, 1200, 100, 0.2),
    ("java", "reaper", 0, 1000, 100, 0.2),
]
DEFAULT_MAX_BRANCHES = 100
# -----------------------------------------------------------------------------


@dataclass
class BuildOptions:
    language: str = "java"
    test_size: float = 0.2
    seed: int = 42
    max_line_count: int = M.MAX_LINE_COUNT
    max_prompt_length: int = M.MAX_PROMPT_LENGTH
    context: int = X.SNIPPET_CONTEXT
    drop_trivial: bool = False
    dedupe: bool = False
    prompt: str = M.QUERY_PROMPT
    strip_final_newline: bool = False
    max_num_merges: int = 100
    max_branches: int = DEFAULT_MAX_BRANCHES


def build_config(spark: SparkSession) -> DataFrame:
    """T14 with the catalogue file name of each row."""
    from conflictlake.operators.repos import output_name
    rows = [(lang, output_name(src, lang if src == "github" else lang.capitalize(), a, b), n,
             DEFAULT_MAX_BRANCHES, ts) for lang, src, a, b, n, ts in BUILD_CONFIG]
    return spark.createDataFrame(rows, "language string, source_csv string, max_num_merges int, "
                                       "max_branches int, test_size double")


def selection_job(spark: SparkSession, dump_path: str, out_path: str, slice_path: str | None = None,
                  language: str = "Java", start: int = 0, end: int = 1000) -> None:
    """R1 -> R4, F1, W1: the catalogue dump without missing values and excluded
    repositories as CSV; with ``slice_path`` also rows ``start`` to ``end`` of a
    language by stars (F2, F3, S1, W2)."""
    from conflictlake.operators import repos as RP
    clean = RP.exclude_repositories(RP.drop_missing(io.read_catalogue_dump(spark, dump_path)))
    io.write_csv(io.cast_catalogue(clean), out_path)
    if slice_path:
        schema = ", ".join(f"{c} {t}" for c, t in clean.dtypes)
        io.write_csv(RP.top_n_slice(io.read_csv(spark, out_path, schema), language, start, end - start), slice_path)


MERGE_COLUMNS = ["repository", "branch_name", "merge_commit", "parent_1", "parent_2", "notes", "ref_rank", "commit_ord"]


def history_job(spark: SparkSession, refs_path: str, commits_path: str, merges_path: str,
                existing_path: str | None = None, opts: BuildOptions = BuildOptions(),
                stored_refs_path: str | None = None) -> None:
    """refs + commits (+ merges known from an earlier run) -> T5 with a dense
    ``merge_idx`` over (repository, merge_commit).

    A merge key that occurs twice is fatal, in the known merges as in the result
    (A10).  Known merges keep their place: they come first, in the order in which
    they were collected (``ref_rank``, ``commit_ord``).  ``stored_refs_path``: ref
    lists of an earlier run, used where the ref still exists (J8)."""
    from conflictlake.operators import history as H
    from conflictlake.streaming.incremental import combine_merges
    refs, commits = spark.read.parquet(refs_path), spark.read.parquet(commits_path)
    if stored_refs_path:
        stored = spark.read.parquet(stored_refs_path)
        listed = refs.join(stored.select("repository").distinct(), "repository", "left_anti")
        refs = H.reuse_cached_refs(stored, refs).unionByName(listed.select("repository", "path", "head_sha", "ref_ord"))
    existing = spark.read.parquet(existing_path) if existing_path else None
    if existing is not None:
        H.assert_unique_merges(existing)
    new = H.collect_merges(refs, commits, existing, opts.max_num_merges, opts.max_branches).select(*MERGE_COLUMNS)
    if existing is not None:
        known = existing.withColumn("_o", F.struct("ref_rank", "commit_ord"))
        keep = combine_merges(known, new.withColumn("_o", F.struct("ref_rank", "commit_ord")), opts.max_num_merges, "_o", ["_o"])
        fresh = new.join(existing, ["repository", "merge_commit"], "left_anti")
        merges = existing.select(*MERGE_COLUMNS).unionByName(fresh).join(
            keep.select("repository", "merge_commit"), ["repository", "merge_commit"], "left_semi")
    else:
        merges = new
    merges = Stored(merges, "collected").df
    H.assert_unique_merges(merges)
    io.write_table(H.number_merges(merges), merges_path)


def files_job(spark: SparkSession, merges_path: str, status_path: str, worktree_path: str,
              final_path: str, files_path: str, index_path: str, opts: BuildOptions = BuildOptions()) -> None:
    """merges + `git status` lines + file texts -> T7 (conflicted files with
    both texts) and T8 (the conflict index, merges with conflicts only)."""
    from conflictlake.operators import files as FI
    merges = spark.read.parquet(merges_path)
    files = FI.conflicted_files(spark.read.parquet(status_path), opts.language)
    texts = FI.pair_texts(files, spark.read.parquet(worktree_path), spark.read.parquet(final_path))
    io.write_table(texts, files_path)
    io.write_table(FI.conflict_index(merges, spark.read.parquet(files_path)), index_path)


def extract_job(spark: SparkSession, files_path: str, out_path: str, opts: BuildOptions = BuildOptions()) -> None:
    """T7 -> T9 (all blocks with their status)."""
    files = spark.read.parquet(files_path)
    io.write_table(X.extract_blocks(files, context=opts.context, strip_final_newline=opts.strip_final_newline), out_path)


def metrics_job(spark: SparkSession, blocks_path: str, metrics_path: str, selected_path: str,
                summary_path: str, index_path: str | None = None, opts: BuildOptions = BuildOptions()) -> None:
    """T9 -> T10 (+ selected pairs, W4) and T11."""
    blocks = spark.read.parquet(blocks_path)
    pairs = X.resolved_pairs(blocks)
    limits = {"max_line_count": opts.max_line_count, "max_prompt_length": opts.max_prompt_length, "prompt": opts.prompt}
    io.write_table(M.metrics(pairs, **limits).select(*M.METRIC_COLUMNS), metrics_path)
    chosen = M.selected(M.metrics(pairs, keep_cols=("conflict", "resolved"), **limits), opts.drop_trivial)
    io.write_table(chosen.select("conflict_id", "conflict", "resolved"), selected_path)
    metrics = spark.read.parquet(metrics_path)
    index = spark.read.parquet(index_path) if index_path else None
    io.write_table(S.order_summary(S.repository_summary(metrics, index)), summary_path)


def build_job(spark: SparkSession, selected_path: str, out_path: str, opts: BuildOptions = BuildOptions()) -> None:
    """Selected pairs -> T12 split into train/test (D1: raises on no pairs)."""
    pairs = spark.read.parquet(selected_path)
    if pairs.isEmpty():
        raise ValueError("No valid conflict/solution pairs found.")
    io.write_dataset(D.build_dataset(pairs, opts.test_size, opts.seed, opts.language, opts.prompt, opts.dedupe), out_path)


def rollup_job(spark: SparkSession, outputs: dict[str, tuple[str, str, str]], out_path: str) -> None:
    """A11 over the outputs of the builds: language -> (index, summary, dataset) tables."""
    rows = None
    for language, (index, summary, dataset) in sorted(outputs.items()):  # one plan per configured language
        found = spark.read.parquet(index).agg(F.countDistinct("repository").alias("repositories"))
        told = spark.read.parquet(summary).agg(F.count(F.when(F.col("total_conflicts") > 0, 1)).alias("contributing"),
                                               F.sum("selected_conflicts").alias("selected"))
        split = spark.read.parquet(dataset).agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"))
        parts = found.unionByName(told, allowMissingColumns=True).unionByName(split, allowMissingColumns=True)
        one = parts.agg(*[F.max(c).alias(c) for c in parts.columns]).withColumn("language", F.lit(language))
        rows = one if rows is None else rows.unionByName(one)
    io.write_table(language_rollup(rows.select("language", "repositories", "contributing", "selected", "train", "test")), out_path)


def language_rollup(per_language: DataFrame) -> DataFrame:
    """Per-language rows (language, repositories, contributing,
    selected, train, test) plus an ``ALL`` total; missing values stay null
    and are left out of the totals (sum ignores nulls)."""
    cols = [c for c in per_language.columns if c != "language"]
    total = per_language.agg(*[F.sum(c).alias(c) for c in cols]).withColumn("language", F.lit("ALL"))
    return per_language.unionByName(total.select("language", *cols))
