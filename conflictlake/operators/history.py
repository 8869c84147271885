"""Commit-history operators.

Input tables (the engine starts from data, not from clones):

* ``refs``: repository, path, head_sha, ref_ord (listing order)
* ``commits``: repository, sha, parents array<string>, commit_ord (ascending =
  newest first; every child comes before its parents)

Output (T5): repository, branch_name, merge_commit, parent_1, parent_2, notes.

Reachability is label propagation over the parent edges (see ``graph``), so a
repository of any size is spread over many tasks.  Per-repository caps use a
row_number filter, which Spark plans with a partial ``WindowGroupLimit`` before
the shuffle, so at most (partitions x cap) rows of one repository meet in a
task.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conflictlake.operators.layers import WORD, Layers
from conflictlake.operators.rank import dense_index, rank_within
from conflictlake.operators.stored import Stored

# --- fixed values -------------------------------------------------------------
# A ref whose lower-cased path contains any of these is kept first when a
# repository has more refs than the branch cap (a substring test, so
# "refs/heads/maintenance" counts as "refs/heads/main").
PRIORITY_REF_PATTERNS = (
    "refs/heads/main",
    "refs/heads/mainline",
    "refs/heads/master",
    "refs/heads/develop",
    "refs/heads/dev",
    "refs/remotes/origin/main",
    "refs/remotes/origin/master",
    "refs/remotes/origin/mainline",
    "refs/remotes/origin/develop",
    "refs/remotes/origin/dev",
)
BRANCH_PREFIXES = ("refs/heads/", "refs/remotes/")
NOTE_PARENT_IS_BASE = "a parent is the base"
NOTE_TWO_ROOTS = "two initial commits"
DEFAULT_MAX_MERGES = 100
DEFAULT_MAX_BRANCHES = 1000
# -----------------------------------------------------------------------------


def is_priority_ref(path) -> F.Column:
    p = F.lower(F.col(path) if isinstance(path, str) else path)
    return reduce(or_, [p.contains(x) for x in PRIORITY_REF_PATTERNS])


def branch_refs(refs: DataFrame, max_branches: int | DataFrame = DEFAULT_MAX_BRANCHES) -> DataFrame:
    """H1 = F7 + K1 + K2: branch refs, one per head commit, capped.

    F7 keeps ``refs/heads/`` and ``refs/remotes/``; K1 keeps the first ref (by
    ``ref_ord``) of each head commit; K2 applies only to a repository with more
    than ``max_branches`` refs: priority refs first, then the others in
    listing order, all priority refs kept even above the cap.  The cap may be a
    table (repository, max_branches); repositories without a row are left out.  Returns
    repository, path, head_sha, ref_ord, ref_rank (0-based processing order).
    """
    r = refs.where(F.col("path").startswith(BRANCH_PREFIXES[0])
                   | F.col("path").startswith(BRANCH_PREFIXES[1]))
    r = (r.groupBy("repository", "head_sha")
         .agg(F.min(F.struct("ref_ord", "path")).alias("_f"))
         .select("repository", F.col("_f.path").alias("path"), "head_sha",
                 F.col("_f.ref_ord").alias("ref_ord")))
    counts = r.groupBy("repository").agg(F.count(F.lit(1)).alias("_nrefs"))
    r = r.join(counts, "repository").withColumn("_prio", is_priority_ref("path"))
    if isinstance(max_branches, DataFrame):
        r, max_branches = r.join(max_branches.select("repository", F.col("max_branches").alias("_cap")), "repository"), F.col("_cap")
    capped = F.col("_nrefs") > max_branches
    r = r.withColumn("_k", F.when(capped & ~F.col("_prio"), 1).otherwise(0))
    r = rank_within(r, ["repository"], ["_k", "ref_ord", "path"], "ref_rank")
    # when capped, the kept refs are exactly the first max(#priority, cap) ranks
    keep = ~capped | F.col("_prio") | (F.col("ref_rank") < max_branches)
    return r.where(keep).select("repository", "path", "head_sha", "ref_ord", "ref_rank")


def parent_edges(commits: DataFrame) -> DataFrame:
    """One row per (child, parent) edge."""
    return commits.select("repository", F.col("sha").alias("child"),
                          F.explode("parents").alias("parent"))


def first_reaching_ref(commits: DataFrame, refs_ranked: DataFrame, layers: Layers | None = None) -> DataFrame:
    """H4 / K7: for every commit reachable from a kept ref, the smallest
    ``ref_rank`` that reaches it (the ref whose walk would claim it first)."""
    layers = layers or Layers(commits)
    heads = layers.place(refs_ranked.select("repository", "head_sha", "ref_rank"), "head_sha", "at")
    got = layers.spread(heads.select("at", F.lit(0).alias("key"), F.col("ref_rank").alias("val")), "min")
    return got.join(layers.numbered.select("at", "repository", "sha"), "at").select("repository", "sha", F.col("val").alias("ref_rank"))


def ref_commits(commits: DataFrame, refs_ranked: DataFrame, layers: Layers | None = None) -> DataFrame:
    """H2: the commits of every ref, as (repository, path, ref_rank, sha, commit_ord); the listing
    order of a ref is ``commit_ord``.

    A commit carries the set of refs that reach it as a bit mask, WORD refs to a
    word.  Masks are stored for commits at block borders only; those inside are
    made when the listing is read, and a mask becomes rows after the refs' names
    have met it, so what moves is a row per commit and word, not per ref and commit."""
    layers = layers or Layers(commits)
    r = refs_ranked.select("repository", "path", "head_sha", "ref_rank", F.expr(f"CAST(ref_rank div {WORD} AS long)").alias("key"),
                           F.expr(f"CAST(ref_rank % {WORD} AS int)").alias("bit"))
    seeds = layers.place(r, "head_sha", "at").groupBy("at", "key").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("val"))
    sets = layers.spread(seeds, "or").join(layers.numbered.select("at", "repository", "sha", "commit_ord"), "at")
    names = r.groupBy("repository", "key").agg(F.collect_list(F.struct("bit", "path", "ref_rank")).alias("refs"))  # at most WORD
    met = sets.join(names, ["repository", "key"])
    met = met.withColumn("ref", F.explode(F.filter("refs", lambda x: F.getbit("val", x["bit"]) == 1)))
    return met.select("repository", F.col("ref.path").alias("path"), F.col("ref.ref_rank").alias("ref_rank"), "sha", "commit_ord")


def merge_candidates(commits: DataFrame) -> DataFrame:
    """F8: commits with exactly two distinct parents."""
    return (commits.where((F.size("parents") == 2) & (F.col("parents")[0] != F.col("parents")[1]))
            .select("repository", "sha", "commit_ord",
                    F.col("parents")[0].alias("parent_1"), F.col("parents")[1].alias("parent_2")))


def capped_merges(commits: DataFrame, refs_ranked: DataFrame, existing: DataFrame | None = None,
                  max_num_merges: int | DataFrame = DEFAULT_MAX_MERGES, layers: Layers | None = None) -> DataFrame:
    """H3 / H5 without notes: merges in ref order, newest first inside a ref,
    at most ``max_num_merges`` per repository including the ``existing`` ones
    (J3: those are skipped and use up the cap).  The cap may be a table
    (repository, max_num_merges); repositories without a row have no merges."""
    first = first_reaching_ref(commits, refs_ranked, layers)
    m = merge_candidates(commits).join(first, ["repository", "sha"])
    if isinstance(max_num_merges, DataFrame):
        caps = max_num_merges.select("repository", F.col("max_num_merges").alias("_cap"))
        max_num_merges = caps.agg(F.max("_cap")).first()[0] or 0  # the greatest cap bounds every repository's rows
        m, allowed = m.join(caps, "repository"), F.col("_cap")
    else:
        allowed = F.lit(max_num_merges)
    if existing is not None:
        ex = existing.select("repository", F.col("merge_commit").alias("sha"))
        m = m.join(ex, ["repository", "sha"], "left_anti")
        n_ex = ex.groupBy("repository").agg(F.count(F.lit(1)).alias("_nex"))
        m = m.join(n_ex, "repository", "left")
        allowed = F.greatest(allowed - F.coalesce(F.col("_nex"), F.lit(0)), F.lit(0))
    w = Window.partitionBy("repository").orderBy("ref_rank", "commit_ord", "sha")
    m = m.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_num_merges)
    m = m.where(F.col("_rn") <= allowed)
    names = refs_ranked.select("repository", "ref_rank", F.col("path").alias("branch_name"))
    return (m.join(names, ["repository", "ref_rank"])
            .select("repository", "branch_name", F.col("sha").alias("merge_commit"),
                    "parent_1", "parent_2", "ref_rank", "commit_ord"))


def root_commits(commits: DataFrame) -> DataFrame:
    """(repository, sha, commit_ord) of the commits with no parent in the table."""
    edges = parent_edges(commits).join(commits.select("repository", F.col("sha").alias("parent")), ["repository", "parent"], "left_semi")
    inside = edges.select("repository", F.col("child").alias("sha")).distinct()
    return commits.select("repository", "sha", "commit_ord").join(inside, ["repository", "sha"], "left_anti")


def _roots(layers: Layers) -> DataFrame:
    """(at, repository) of the commits with no parent in the table."""
    child = layers.levels[0][1].select(F.col("u").alias("at")).distinct()
    return layers.numbered.select("at", "repository").join(child, "at", "left_anti")


def _oldest(layers: Layers, wanted: DataFrame | None) -> DataFrame:
    """(at, oldest): the greatest place among the ancestors (self included) of the commits ``wanted`` (at)."""
    got = layers.spread(_roots(layers).select("at", F.lit(0).alias("key"), F.col("at").alias("val")), "max", backwards=True, wanted=wanted)
    return got.select("at", F.col("val").alias("oldest"))


def oldest_ancestor(commits: DataFrame, wanted: DataFrame | None = None, layers: Layers | None = None) -> DataFrame:
    """(repository, sha, oldest): the ancestor (self included) with the greatest
    ``commit_ord``, the last commit a history walk from that commit would list.

    Children come before their parents, so that ancestor is a root, and only
    roots are seeds.  ``wanted`` (repository, sha) limits the answer to those
    commits (default: all)."""
    layers = layers or Layers(commits)
    asked = None if wanted is None else layers.place(wanted.select("repository", "sha").distinct(), "sha", "at").select("at")
    names = layers.numbered.select(F.col("at").alias("oldest"), F.col("sha").alias("name"))
    return (_oldest(layers, asked).join(names, "oldest").drop("oldest").withColumnRenamed("name", "oldest")
            .join(layers.numbered.select("at", "repository", "sha"), "at").select("repository", "sha", "oldest"))


def _ancestor_ids(layers: Layers, pairs: DataFrame) -> DataFrame:
    """(repository, pair_id) of the rows (repository, pair_id, start, target as places) whose target is an ancestor of the start.

    An ancestor has a later place; pairs that cannot be are answered at once.  The
    others get a bit each in the masks of their repository (merges per repository
    are capped, so a mask is a few words long)."""
    open_ = rank_within(pairs.where("target > start").select("repository", "pair_id", "start", "target"), ["repository"], ["pair_id"], "n")
    open_ = open_.withColumn("key", F.expr(f"n div {WORD}")).withColumn("bit", F.expr(f"CAST(n % {WORD} AS int)"))
    seeds = open_.groupBy(F.col("start").alias("at"), "key").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("val"))
    got = layers.spread(seeds, "or", wanted=open_.select(F.col("target").alias("at")).distinct())
    return (open_.join(got.withColumnRenamed("at", "target"), ["target", "key"])
            .where(F.getbit("val", "bit") == 1).select("repository", "pair_id"))


def ancestor_pairs(commits: DataFrame, pairs: DataFrame, layers: Layers | None = None) -> DataFrame:
    """For (repository, pair_id, start, target) rows: is ``target`` an ancestor
    of ``start`` (or equal)?"""
    layers = layers or Layers(commits)
    placed = layers.place(layers.place(pairs.withColumnsRenamed({"start": "_s", "target": "_t"}), "_s", "start"), "_t", "target")
    found = _ancestor_ids(layers, placed).withColumn("_yes", F.lit(True))
    return (pairs.join(found, ["repository", "pair_id"], "left")
            .select("repository", "pair_id", (F.col("start") == F.col("target")) | F.coalesce("_yes", F.lit(False)))
            .toDF("repository", "pair_id", "is_ancestor"))


def merge_notes(commits: DataFrame, merges: DataFrame, layers: Layers | None = None) -> DataFrame:
    """H6: the note of each merge: ``a parent is the base`` when one parent
    is an ancestor of the other; else ``two initial commits`` when the two
    parents' oldest ancestors differ; else empty.

    Only the older parent can be an ancestor of the other.  A parent that is not
    in the table has no ancestor.  Both questions are answered by one walk from the
    parents to what is above them: each has a bit in the masks of its repository
    (merges per repository are capped, so a mask is a few words long)."""
    layers = layers or Layers(commits)
    places = layers.numbered.select("repository", "sha", "at")
    for i in (1, 2):
        merges = merges.join(places.select("repository", F.col("sha").alias(f"parent_{i}"), F.col("at").alias(f"_a{i}")), ["repository", f"parent_{i}"], "left")
    merges = layers._store(merges, "merges")
    pairs = merges.where("_a1 <> _a2").select("repository", "merge_commit",
                                              F.least("_a1", "_a2").alias("at"), F.greatest("_a1", "_a2").alias("target")).distinct()
    asked = merges.select("repository", F.explode(F.array("_a1", "_a2")).alias("at")).where("at IS NOT NULL").distinct()
    marks = layers._store(rank_within(asked, ["repository"], ["at"], "n").select(
        "repository", "at", F.expr(f"CAST(n div {WORD} AS long)").alias("key"), F.expr(f"CAST(n % {WORD} AS int)").alias("bit")), "marks")
    roots = layers._store(_roots(layers), "roots")
    reached = layers.spread(marks.select("at", "key", F.expr("shiftleft(1L, bit)").alias("val")), "or",
                            wanted=roots.select("at").unionByName(pairs.select(F.col("target").alias("at"))).distinct())
    reached = layers._store(reached, "reached")
    met = reached.select(F.col("at").alias("target"), "key", "val")
    anc = (pairs.join(marks.select("at", "key", "bit"), "at").join(met, ["target", "key"]).where(F.getbit("val", "bit") == 1)
           .select("repository", "merge_commit", F.lit(True).alias("_anc")))
    ends = reached.join(roots.select("at", "repository"), "at").select("repository", "key", "val", F.col("at").alias("oldest"))
    old = layers._store(ends.join(marks, ["repository", "key"]).where(F.getbit("val", "bit") == 1).groupBy("at").agg(F.max("oldest").alias("oldest")), "oldest")
    out = merges.join(anc, ["repository", "merge_commit"], "left")
    for i in (1, 2):
        out = out.join(old.select(F.col("at").alias(f"_a{i}"), F.col("oldest").alias(f"_o{i}")), f"_a{i}", "left")
    note = F.when(F.col("_anc"), F.lit(NOTE_PARENT_IS_BASE)).when(~F.col("_o1").eqNullSafe(F.col("_o2")), F.lit(NOTE_TWO_ROOTS)).otherwise(F.lit(""))
    return out.withColumn("notes", note).drop("_anc", "_a1", "_a2", "_o1", "_o2")


def collect_merges(refs: DataFrame, commits: DataFrame, existing: DataFrame | None = None,
                   max_num_merges: int | DataFrame = DEFAULT_MAX_MERGES,
                   max_branches: int | DataFrame = DEFAULT_MAX_BRANCHES) -> DataFrame:
    """H5: refs + commits -> new merges (T5 columns plus ref_rank, commit_ord)."""
    layers = Layers(commits)
    ranked = Stored(branch_refs(refs, max_branches), "refs")
    m = Stored(capped_merges(commits, ranked.df, existing, max_num_merges, layers), "capped")
    out = Stored(merge_notes(commits, m.df, layers), "collected")
    for part in (layers, ranked, m):
        part.delete()
    return out.df


def duplicate_merge_keys(merges: DataFrame) -> DataFrame:
    """A10: (repository, merge_commit) keys that occur more than once."""
    return (merges.groupBy("repository", "merge_commit").agg(F.count(F.lit(1)).alias("n"))
            .where("n > 1"))


def assert_unique_merges(merges: DataFrame) -> None:
    """A10, fatal: raise when a merge key repeats (one driver-side bit)."""
    if not duplicate_merge_keys(merges).isEmpty():
        raise ValueError("duplicate (repository, merge_commit) in merges")


def number_merges(merges: DataFrame) -> DataFrame:
    """K3 + S5: ``merge_idx`` 0..n-1 over (repository, merge_commit)."""
    return dense_index(merges, ["repository", "merge_commit"], "merge_idx")


def reuse_cached_refs(cached: DataFrame, current: DataFrame) -> DataFrame:
    """A stored ref list (repository, path, ref_ord) kept only where the
    ref still exists (semi-join on repository and path), in the stored order,
    with today's head commit."""
    heads = current.select("repository", "path", "head_sha")
    return (cached.join(heads.select("repository", "path"), ["repository", "path"], "left_semi")
            .join(heads, ["repository", "path"]).select("repository", "path", "head_sha", "ref_ord"))
