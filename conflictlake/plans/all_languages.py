"""D5 / T14 in one run: every row of the build configuration at once.

The configuration is a table of a few rows (build, source, language, first, last,
max_num_merges, max_branches, test_size).  A repository belongs to the builds in
whose slice it lies, and from there on every row carries its build: caps, file
extensions, the language of the prompt and the test share are values of the row, not
arguments of a run.  Each input table is read once, however many builds there are,
and each build comes out as a run of its own would make it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conflictlake.operators import conflicts as X
from conflictlake.operators import dataset as D
from conflictlake.operators import files as FI
from conflictlake.operators import history as H
from conflictlake.operators import metrics as M
from conflictlake.operators.rank import rank_within
from conflictlake.operators.stored import Stored

CONFIG = "build int, source string, language string, first long, last long, max_num_merges int, max_branches int, test_size double"
MERGE = ("build", "merge_idx")


def config_table(spark: SparkSession) -> DataFrame:
    """T14 as a table, builds numbered in its order."""
    from conflictlake.plans.jobs import BUILD_CONFIG, DEFAULT_MAX_BRANCHES
    return spark.createDataFrame([(i, src, lang, a, b, n, DEFAULT_MAX_BRANCHES, ts) for i, (lang, src, a, b, n, ts) in enumerate(BUILD_CONFIG)], CONFIG)


def chosen_repositories(catalogue: DataFrame, config: DataFrame) -> DataFrame:
    """The repositories of every build (S1 per row): ``catalogue`` (source, language, repository, stars)
    ranked by stars within its source and language, with the settings of the builds whose slice holds the rank."""
    c = catalogue.select("source", F.lower("language").alias("language"), "repository", F.expr("try_cast(stars AS DOUBLE)").alias("stars"))
    c = c.where("stars IS NOT NULL AND NOT isnan(stars) AND repository IS NOT NULL").withColumn("_down", -F.col("stars"))
    ranked = rank_within(c, ["source", "language"], ["_down", "repository"], "place")
    met = ranked.join(F.broadcast(config), ["source", "language"]).where("place >= first AND place < last")
    return met.select("build", "language", "repository", "place", "max_num_merges", "max_branches", "test_size")


def merges_of_builds(chosen: DataFrame, refs: DataFrame, commits: DataFrame) -> DataFrame:
    """T5 of every build, numbered 0.. within it (K3): a build sees its repositories as tables of their own."""
    own = chosen.withColumn("_key", F.concat_ws("\x00", F.col("build").cast("string"), "repository"))
    own = Stored(own, "chosen").df
    mine = lambda df: df.join(own.select("repository", "_key"), "repository").drop("repository").withColumnRenamed("_key", "repository")
    caps = own.select(F.col("_key").alias("repository"), "max_num_merges", "max_branches")
    merges = H.collect_merges(mine(refs), mine(commits), None, caps, caps)
    out = merges.withColumnRenamed("repository", "_key").join(own.select("_key", "build", "repository", "language", "test_size"), "_key").drop("_key")
    return rank_within(out, ["build"], ["repository", "merge_commit"], "merge_idx")


def files_of_builds(merges: DataFrame, status: DataFrame, worktree: DataFrame, final: DataFrame) -> DataFrame:
    """T7 of every build; ``status``, ``worktree`` and ``final`` are keyed by (repository, merge_commit)."""
    ids = merges.select("build", "merge_idx", "language", "repository", "merge_commit")
    named = lambda df, *c: df.join(ids.select("build", "merge_idx", "repository", "merge_commit", *c), ["repository", "merge_commit"])
    files = FI.conflicted_files(named(status, "language"), keys=MERGE, language_col="language")
    files = files.select("build", "merge_idx", "language", "file_no", "path")
    return FI.pair_texts(files, named(worktree), named(final), MERGE)


def dataset_of_builds(files: DataFrame, config: DataFrame, seed: int = D.DEFAULT_SEED, prompt: str = M.QUERY_PROMPT) -> DataFrame:
    """T12 of every build: extraction, metrics, selection and the split of its own test share."""
    blocks = X.resolved_pairs(X.extract_blocks(files))
    kept = M.selected(M.metrics(blocks, keep_cols=("build", "language", "conflict", "resolved"), prompt=prompt))
    q = M.build_question(F.col("conflict"), F.col("language"), prompt)
    rows = Stored(kept.select("build", "conflict_id", q.alias("question"), F.col("resolved").alias("answer"), D.to_conversation(q).alias("prompt")), "pairs").df
    test = F.lit(False)
    for r in config.select("build", "test_size").collect():  # a row per build of the configuration
        mine = F.col("build") == r["build"]
        test = F.when(mine, D.in_test(rows.where(mine), r["test_size"], seed)).otherwise(test)
    return rows.withColumn("split", F.when(test, "test").otherwise("train"))


def build_all(spark: SparkSession, config: DataFrame, tables: dict[str, str], out: str) -> None:
    """All builds from Parquet tables (catalogue, refs, commits, status, worktree, final) into
    ``out``/repositories, merges, files and dataset (partitioned by build, the dataset by build and split)."""
    t = {k: spark.read.parquet(p) for k, p in tables.items()}
    write = lambda df, name, *by: (df.write.mode("overwrite").partitionBy("build", *by).parquet(f"{out}/{name}"), spark.read.parquet(f"{out}/{name}"))[1]
    chosen = write(chosen_repositories(t["catalogue"], config), "repositories")
    merges = write(merges_of_builds(chosen, t["refs"], t["commits"]), "merges")
    files = write(files_of_builds(merges, t["status"], t["worktree"], t["final"]), "files")
    write(dataset_of_builds(files, config), "dataset", "split")
