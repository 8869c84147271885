"""Conflicted-file operators.

Input ``merge_status`` (T6): merge_idx, xy (two-letter status), path.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conflictlake.functions.text import py_strip
from conflictlake.operators.rank import rank_within

# --- fixed values -------------------------------------------------------------
# File extensions per language; unknown languages fall back to Java.
LANGUAGE_EXTENSIONS = {
    "java": (".java",),
    "python": (".py",),
    "javascript": (".js",),
    "typescript": (".ts", ".tsx"),
    "cpp": (".cpp", ".cc", ".cxx", ".h", ".hpp"),
    "csharp": (".cs",),
    "php": (".php",),
    "ruby": (".rb",),
    "c": (".c", ".h"),
    "go": (".go",),
    "rust": (".rs",),
}
BOTH_MODIFIED = "UU"
# -----------------------------------------------------------------------------


def file_extensions(language: str) -> tuple:
    """Extensions of a language (case-insensitive), ``.java`` when unknown."""
    return LANGUAGE_EXTENSIONS.get(language.lower(), (".java",))


def extensions_of(language: str) -> F.Column:
    """P8 of a column of languages, as an array."""
    known = [x for name, exts in LANGUAGE_EXTENSIONS.items() for x in (F.lit(name), F.array(*map(F.lit, exts)))]
    return F.coalesce(F.try_element_at(F.create_map(*known), F.lower(language)), F.array(F.lit(".java")))


def conflicted_files(status: DataFrame, language: str = "java", keys: tuple = ("merge_idx",), language_col: str | None = None) -> DataFrame:
    """C1 = F6 + K5: both-modified files with a wanted extension, numbered
    0.. per merge in path order (paths compare component by component).
    ``keys`` names a merge; ``language_col`` gives each row its own language."""
    path = py_strip("path")
    f = status.where(F.col("xy") == BOTH_MODIFIED).withColumn("path", path)
    if language_col:
        f = f.where(F.exists(extensions_of(language_col), lambda e: F.col("path").endswith(e)))
    else:
        f = f.where(reduce(or_, [F.col("path").endswith(e) for e in file_extensions(language)]))
    f = f.withColumn("_parts", F.split("path", "/"))
    f = rank_within(f, list(keys), ["_parts", "path"], "file_no").drop("_parts")
    return f.withColumn("file_no", F.col("file_no").cast("int")).withColumn(
        "conflict_id", F.concat_ws("-", F.col("merge_idx").cast("string"), F.col("file_no").cast("string")))


def pair_texts(files: DataFrame, worktree: DataFrame, final: DataFrame, keys: tuple = ("merge_idx",)) -> DataFrame:
    """C2 + J4: attach the conflicted text (inner: a file missing from the
    working tree is dropped, its number stays used) and the merged text (left:
    null when the merged commit lacks the file)."""
    w = worktree.select(*keys, "path", F.col("text").alias("conflict_text"))
    m = final.select(*keys, "path", F.col("text").alias("merged_text"))
    return files.join(w, [*keys, "path"]).join(m, [*keys, "path"], "left")


def conflict_index(merges: DataFrame, files: DataFrame) -> DataFrame:
    """C3 + F9, long form: one row per (merge, conflict id) of the files that were
    found (the result of ``pair_texts``); merges without one are dropped, so ``merge_idx`` (numbered before) has gaps."""
    return merges.join(files.select("merge_idx", "file_no", "conflict_id"), "merge_idx")


def conflict_index_csv(index_long: DataFrame) -> DataFrame:
    """The CSV form, ids of a merge joined by ';' in file order.  One
    merge's list is bounded by the files changed in that merge."""
    key = [c for c in index_long.columns if c not in ("file_no", "conflict_id")]
    return (index_long.groupBy(*key)
            .agg(F.array_sort(F.collect_list(F.struct("file_no", "conflict_id"))).alias("_c"))
            .withColumn("conflicts", F.array_join(F.transform("_c", lambda x: x["conflict_id"]), ";"))
            .drop("_c"))
