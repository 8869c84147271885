"""Repository catalogue operators.

All are scans, filters, projections and aggregates.  A slice of the order by stars
is a ``TakeOrderedAndProject`` near the top; far down only the rows between the
ranks of its two ends are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conflictlake.operators.select import nth, rank_slice
from conflictlake.operators.stored import Stored
from conflictlake.sources.records import SPLIT, running, with_split

# --- fixed values -------------------------------------------------------------
# Repositories left out of the catalogue because their test setups failed.
EXCLUDED_REPOSITORIES = (
    "elastic/elasticsearch",
    "wasabeef/RecyclerViewAnimators",
    "android/platform_frameworks_base",
    "elasticsearch/elasticsearch",
)
# Cells a pandas CSV read treats as missing by default (pandas documentation),
# which includes the literal "None" the catalogue step also removes.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# Most results a code-search API query returns.
API_RESULT_CAP = 1000
# -----------------------------------------------------------------------------
TOP_ROWS = 100_000  # a slice that ends further down is found by ranks


def _na(col: str) -> F.Column:
    """A text cell with a missing-value token read as null."""
    return F.when(F.col(col).isin(*NA_TOKENS), None).otherwise(F.col(col))


def language_counts(repos: DataFrame, top: int = 15, lang_col: str = "language") -> DataFrame:
    """A1: repositories per language, most common first (ties by name), top
    ``top`` rows; a missing language (null or NA token) is not counted."""
    lang = _na(lang_col)
    return (repos.where(lang.isNotNull())
            .groupBy(lang.alias("language")).agg(F.count(F.lit(1)).alias("repo_count"))
            .orderBy(F.desc("repo_count"), F.asc("language")).limit(top))


def language_totals(repos: DataFrame, lang_col: str = "language") -> DataFrame:
    """A1: number of languages and of repositories (before null handling)."""
    return repos.agg(F.count_distinct(_na(lang_col)).alias("languages"),
                     F.count(F.lit(1)).alias("repositories"))


def drop_missing(repos: DataFrame, columns: list | None = None) -> DataFrame:
    """The token ``None`` (and the reader's NA tokens) count as missing in
    any string column; rows with any missing value are dropped."""
    cols = columns or repos.columns
    types = dict(repos.dtypes)
    out = repos
    for c in cols:
        if types[c] == "string":
            out = out.withColumn(c, F.when(F.col(c).isin(*NA_TOKENS), None).otherwise(F.col(c)))
    return out.na.drop("any", subset=cols)


def exclude_repositories(repos: DataFrame, names=EXCLUDED_REPOSITORIES,
                         repo_col: str = "repository") -> DataFrame:
    """drop listed repositories (a literal IN list; pass a DataFrame of
    names for a table-sized list, which becomes an anti-join)."""
    if isinstance(names, DataFrame):
        return repos.join(names.select(F.col(names.columns[0]).alias(repo_col)), repo_col, "left_anti")
    return repos.where(~F.col(repo_col).isin(*names))


def clean_catalogue(raw: DataFrame, names=EXCLUDED_REPOSITORIES) -> DataFrame:
    """R4 + P2 + F1: catalogue from the raw dump (``idx`` must already be set,
    K8).  ``stars`` is cast strictly (ANSI mode raises on bad values)."""
    return exclude_repositories(drop_missing(raw), names).withColumn("stars", F.col("stars").cast("int"))


def with_row_position(df: DataFrame, index_col: str = "idx") -> DataFrame:
    """K8: 0-based row position in the source order (before any filter).

    Rows are ordered by file, then by the byte offset where their split
    starts, then by their order inside the split.  A narrow count of each split
    gives its first position, and a second narrow pass adds the place inside the
    split: no row is moved.  ``df`` must be a file scan.
    """
    rows = df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("blk"),
                     F.monotonically_increasing_id().alias("pos"))
    counts = rows.groupBy(*SPLIT).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    splits = Stored(running(counts, "n", over_files=True).select(*SPLIT, "first", "before"), "splits").df
    at = (F.col("pos") - F.col("first") + F.col("before")).cast("long")
    return with_split(rows, splits).withColumn(index_col, at).drop("file", "blk", "pos", "first", "before")


def top_n_slice(repos: DataFrame, language: str, start: int, n: int,
                stars_col: str = "stars", repo_col: str = "repository",
                lang_col: str = "language") -> DataFrame:
    """F2 + P3 + F3 + S1: rows ``start .. start+n-1`` of one language ordered
    by stars (descending), ties broken by repository name.  Stars that do not
    parse as numbers are dropped.

    A slice near the top is a top-k; one far down (beyond TOP_ROWS) is found by the
    ranks of its two ends, so no task holds the rows above it."""
    d = (repos.where(F.col(lang_col) == language)
         .withColumn(stars_col, F.expr(f"try_cast(`{stars_col}` AS DOUBLE)"))
         .where(F.col(stars_col).isNotNull()))
    d = d.where(~F.isnan(stars_col))
    if start + n > TOP_ROWS:
        named = d.withColumn("_named", F.col(repo_col).isNotNull().cast("int")).withColumn("_name", F.coalesce(repo_col, F.lit("")))
        return rank_slice(named, [(stars_col, True), ("_named", False), ("_name", False)], start, n).drop("_named", "_name")
    return d.orderBy(F.desc(stars_col), F.asc(repo_col)).offset(start).limit(n)


def star_stats(repos: DataFrame, stars_col: str = "stars", exact_median: bool = True) -> DataFrame:
    """A2: count, min, max, mean and median of the stars.

    The exact median is the mean of the values at the two middle ranks, which are
    found without a sort (``select.nth``); with ``exact_median=False`` it is
    ``percentile_approx``.
    """
    s = repos.select(F.col(stars_col).cast("double").alias("v")).where(F.col("v").isNotNull())
    aggs = [F.count(F.lit(1)).alias("n"), F.min("v").alias("min_stars"),
            F.max("v").alias("max_stars"), F.avg("v").alias("mean_stars")]
    if not exact_median:
        return s.agg(*aggs, F.percentile_approx("v", 0.5).alias("median_stars"))
    kept = Stored(s, "stars")
    n = kept.df.count()
    lower = nth(kept.df, [("v", False)], (n - 1) // 2)
    upper = lower if n % 2 else nth(kept.df, [("v", False)], n // 2)
    kept.delete()
    median = (lower[0][0] + upper[0][0]) / 2 if n else None
    return s.agg(*aggs).withColumn("median_stars", F.lit(median).cast("double"))


def format_api_items(items: DataFrame) -> DataFrame:
    """Code-search API items -> catalogue columns.  Missing keys get the
    defaults (``language`` "", ``default_branch`` "main", ``description`` "",
    ``archived``/``disabled`` false); the quality metrics of the other
    catalogue are placeholders 1.0; ``license`` is 1.0 when present."""
    one = F.lit(1.0)
    return items.select(
        F.col("full_name").alias("repository"),
        F.col("stargazers_count").alias("stars"),
        F.coalesce(F.col("language"), F.lit("")).alias("language"),
        "created_at", "updated_at",
        F.col("forks_count").alias("forks"),
        F.col("open_issues_count").alias("open_issues"),
        "size",
        F.coalesce(F.col("default_branch"), F.lit("main")).alias("default_branch"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        F.col("html_url").alias("url"),
        "clone_url",
        F.coalesce(F.col("archived"), F.lit(False)).alias("archived"),
        F.coalesce(F.col("disabled"), F.lit(False)).alias("disabled"),
        one.alias("architecture"), one.alias("community"), one.alias("continuous_integration"),
        one.alias("documentation"), one.alias("history"), one.alias("issues"),
        F.when(F.col("license").isNotNull(), one).otherwise(F.lit(0.0)).alias("license"),
        one.alias("size_metric"), one.alias("unit_test"),
    )


def api_query_filter(repos: DataFrame, language: str | None = None, min_stars: int = 0,
                     exclude_archived: bool = False, observation=None) -> DataFrame:
    """F5 (+F4): the search query as predicates over landed results:
    language, ``stars >= min_stars`` (0 disables) and, when asked, neither
    archived nor disabled.  With a ``pyspark.sql.Observation`` the number of
    archived/disabled rows removed is collected as ``removed`` while the
    query runs (no extra pass)."""
    d = repos
    if exclude_archived and observation is not None:
        d = d.observe(observation, F.count_if(F.col("archived") | F.col("disabled")).alias("removed"))
    if language is not None:
        d = d.where(F.lower(F.col("language")) == language.lower())
    if min_stars:
        d = d.where(F.col("stars") >= min_stars)
    if exclude_archived:
        d = d.where(~F.col("archived") & ~F.col("disabled"))
    return d


def sort_by_stars(repos: DataFrame) -> DataFrame:
    """Stars descending, ties by name."""
    return repos.orderBy(F.desc("stars"), F.asc("repository"))


def top_by_stars(repos: DataFrame, k: int = 10) -> DataFrame:
    """S3: the ``k`` most starred (a top-k report)."""
    return sort_by_stars(repos).limit(k)


def output_name(source: str, language: str, start: int, end: int) -> str:
    """``repos_<source>_<Language>_<start>_<end>.csv``; the API variant
    capitalises the language."""
    lang = language.capitalize() if source == "github" else language
    return f"repos_{source}_{lang}_{start}_{end}.csv"
