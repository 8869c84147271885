"""Readers for the driver tables and the stand-in inputs built from them.

The driver tables hold no git data, so each operator runs on a stand-in that
Spark derives from a real table and that grows with it:

* conflicted files: every document becomes a file whose middle third (all of it
  below three lines) is wrapped in conflict markers (left = the lines, right =
  the same lines reversed, a base section when the line count is even); some
  have a second block in their last third.  The merged file depends on
  ``doc_id % 10``: the left side, the right side, a resolution by hand, a long
  one, an edit before or after the block, no merged file, every line twice, the
  last third moved to the front, and that with the first third repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conflictlake.functions.text import split_lines_keepends
from conflictlake.operators import barrier


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- fixed values of the stand-in (shared with the oracle SQL) ---------------
OPEN_LINE = "<<<<<<< ours\n"
SEP_LINE = "=======\n"
BASE_LINE = "||||||| base\n"
CLOSE_LINE = ">>>>>>> theirs\n"
HAND_LINE = "resolved by hand\n"
EDIT_LINE = "edited\n"
# -----------------------------------------------------------------------------


def built_conflict_files(docs: DataFrame) -> DataFrame:
    """documents -> T7 (merge_idx, file_no, path, conflict_text, merged_text)."""
    # kinds 8 and 9 move the last lines, so the file must end with a line end
    text = F.when(F.expr("pmod(doc_id, 10) >= 8"), F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    d = barrier(docs.select("doc_id", "source", split_lines_keepends(text).alias("l")))
    d = d.withColumns({"n": F.size("l"), "a": F.expr("size(l) div 3")})
    d = d.withColumns({"head": F.expr("slice(l, 1, a)"), "mid": F.expr("slice(l, a + 1, n - 2 * a)"),
                       "tail": F.expr("slice(l, n - a + 1, a)"), "none": F.expr("CAST(array() AS array<string>)"),
                       "kind": F.expr("pmod(doc_id, 10)")})
    second = (f"IF(pmod(doc_id, 4) = 1 AND a >= 4, concat(slice(tail, 1, 2), array('{_sql(OPEN_LINE)}'), slice(tail, 3, 1), "
              f"array('{_sql(SEP_LINE)}'), transform(slice(tail, 3, 1), x -> concat('other ', x)), array('{_sql(CLOSE_LINE)}'), "
              "slice(tail, 4, a - 3)), tail)")
    conflict = F.expr(
        f"array_join(concat(head, array('{_sql(OPEN_LINE)}'), mid, "
        f"IF(n % 2 = 0, concat(array('{_sql(BASE_LINE)}'), slice(mid, 1, 1)), none), "
        f"array('{_sql(SEP_LINE)}'), reverse(mid), array('{_sql(CLOSE_LINE)}'), {second}), '')")
    merged = F.expr(
        "array_join(CASE kind WHEN 1 THEN concat(head, reverse(mid), tail) "
        f"WHEN 2 THEN concat(head, array('{_sql(HAND_LINE)}'), tail) WHEN 3 THEN concat(head, mid, mid, mid, mid, tail) "
        f"WHEN 4 THEN concat(slice(head, 1, greatest(a - 1, 0)), array('{_sql(EDIT_LINE)}'), mid, tail) "
        f"WHEN 5 THEN concat(head, mid, array('{_sql(EDIT_LINE)}'), slice(tail, 2, greatest(a - 1, 0))) "
        "WHEN 6 THEN CAST(NULL AS array<string>) WHEN 7 THEN concat(l, l) WHEN 8 THEN concat(tail, head, mid) "
        "WHEN 9 THEN concat(tail, head, mid, head) ELSE l END, '')")
    return d.select(
        F.col("doc_id").alias("merge_idx"),
        F.lit(0).alias("file_no"),
        F.concat(F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".java")).alias("path"),
        conflict.alias("conflict_text"),
        merged.alias("merged_text"),
    )


def _sql(s: str) -> str:
    """Literal for a Spark SQL string (newline as an escape)."""
    return s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")


# --- commit graph stand-in ------------------------------------------------------
# repository = "n<nationkey>"; commit "c<custkey>"; i = position of the
# customer inside its nation by custkey (0-based); parents: the customers at
# positions i div 2 and i div 3 (in that order, when older than i), so most
# commits are two-parent merges and a few are degenerate (both parents equal);
# in nations with an even key position 1 has no parent (a second root);
# commit_ord = -custkey (newest first).
# refs: per (nation, segment) the newest commit, "refs/heads/<name>" with name
# main (BUILDING), maintenance (AUTOMOBILE) or the lower-cased segment,
# ref_ord = segment position; a remote ref "refs/remotes/origin/<segment>" to
# the newest commit with a positive balance (often the same head, for the
# head dedupe), ref_ord = 10 + position; HOUSEHOLD also gets a tag.

SEGMENT_ORD = {"AUTOMOBILE": 0, "BUILDING": 1, "FURNITURE": 2, "HOUSEHOLD": 3, "MACHINERY": 4}


def _positions(customer: DataFrame) -> DataFrame:
    from conflictlake.operators.rank import rank_within
    c = customer.select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    # used three times below: materialise once in the shared checkpoint folder
    return rank_within(c, ["c_nationkey"], ["c_custkey"], "i").checkpoint(eager=True)


def standin_commits(customer: DataFrame) -> DataFrame:
    c = _positions(customer).select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("repository"),
        F.col("c_custkey").alias("k"), "i")
    cand = c.select("repository", "k", F.explode(F.array(
        F.struct(F.lit(1).alias("pos"), F.expr("i div 2").alias("pi")),
        F.struct(F.lit(2).alias("pos"), F.expr("i div 3").alias("pi")))).alias("p"), "i"
    ).select("repository", "k", "p.pos", "p.pi", "i").where(
        (F.col("pi") < F.col("i")) & ~((F.col("i") == 1) & F.expr("cast(substr(repository, 2) as int) % 2 = 0"))).drop("i")
    edges = cand.join(c.select("repository", F.col("i").alias("pi"), F.col("k").alias("pk")),
                      ["repository", "pi"])
    par = (edges.groupBy("repository", "k")
           .agg(F.array_sort(F.collect_list(F.struct("pos", "pk"))).alias("ps"))
           .select("repository", "k", F.transform("ps", lambda x: F.concat(F.lit("c"), x["pk"].cast("string"))).alias("parents")))
    return (c.join(par, ["repository", "k"], "left")
            .select("repository", F.concat(F.lit("c"), F.col("k").cast("string")).alias("sha"),
                    F.coalesce("parents", F.expr("CAST(array() AS array<string>)")).alias("parents"),
                    (-F.col("k")).cast("long").alias("commit_ord")))


def standin_refs(customer: DataFrame) -> DataFrame:
    c = customer.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("repository"),
                        F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), "c_acctbal")
    segord = F.expr("CASE seg " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEGMENT_ORD.items()) + " END")
    heads = c.groupBy("repository", "seg").agg(
        F.max("k").alias("hk"), F.max(F.when(F.col("c_acctbal") > 0, F.col("k"))).alias("pk"))
    name = (F.when(F.col("seg") == "BUILDING", F.lit("main"))
            .when(F.col("seg") == "AUTOMOBILE", F.lit("maintenance"))
            .otherwise(F.lower("seg")))
    sha = lambda col: F.concat(F.lit("c"), F.col(col).cast("string"))
    a = heads.select("repository", F.concat(F.lit("refs/heads/"), name).alias("path"),
                     sha("hk").alias("head_sha"), segord.cast("int").alias("ref_ord"))
    b = heads.where(F.col("pk").isNotNull()).select(
        "repository", F.concat(F.lit("refs/remotes/origin/"), F.lower("seg")).alias("path"),
        sha("pk").alias("head_sha"), (segord + 10).cast("int").alias("ref_ord"))
    t = heads.where(F.col("seg") == "HOUSEHOLD").select(
        "repository", F.lit("refs/tags/v1").alias("path"), sha("hk").alias("head_sha"),
        F.lit(-1).alias("ref_ord"))
    return a.unionByName(b).unionByName(t)


STANDIN_MAX_BRANCHES = 3
STANDIN_MAX_MERGES = 15
