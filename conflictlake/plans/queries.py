"""Registered queries: each operator of the inventory run on the driver tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame over whole
tables (no id subsets or row caps); the column names equal those of the oracle
SQL in ``conflictlake.plans.oracle``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conflictlake.functions.text import split_lines, split_lines_keepends
from conflictlake.operators import barrier, spread
from conflictlake.operators import conflicts as X
from conflictlake.operators import dataset as D
from conflictlake.operators import metrics as M
from conflictlake.operators import summary as S
from conflictlake.operators import history as H
from conflictlake.operators import repos as RP
from conflictlake.session import ensure_checkpoint_dir
from conflictlake.plans.inputs import (STANDIN_MAX_BRANCHES, STANDIN_MAX_MERGES, built_conflict_files,
                                       standin_commits, standin_refs, table)


# --- conflict text -------------------------------------------------------------

def q_conflict_lines(spark: SparkSession, sf: str) -> DataFrame:
    """X1, X2 on every document."""
    d = barrier(spread(table(spark, sf, "documents")).select(
        "doc_id", split_lines_keepends("text").alias("L"), split_lines("text").alias("P")))
    return d.select(
        "doc_id",
        F.size("L").cast("long").alias("n_lines"),
        F.size("P").cast("long").alias("n_lines_plain"),
        F.expr("get(P, 0)").alias("first_line"),
        F.expr("get(L, size(L) - 1)").alias("last_line"),
        F.expr("aggregate(P, 0L, (acc, x) -> acc + length(x))").alias("chars_plain"),
        F.expr("size(filter(P, x -> x = ''))").cast("long").alias("n_blank"),
    )


def _files(spark, sf):
    return built_conflict_files(spread(table(spark, sf, "documents")))


def _blocks(spark, sf):
    return X.extract_blocks(_files(spark, sf))


def q_conflict_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """X3, K6."""
    b = X.split_files(_files(spark, sf))
    return b.select(
        F.concat_ws("-", F.col("merge_idx").cast("string"), F.col("file_no").cast("string"),
                    F.col("block_no").cast("string")).alias("conflict_id"),
        F.col("merge_idx").cast("long").alias("merge_idx"),
        F.col("block_no").cast("long").alias("block_no"),
        F.col("start_line").cast("long").alias("start_line"),
        F.col("end_line").cast("long").alias("end_line"),
    )


def q_conflict_context(spark: SparkSession, sf: str) -> DataFrame:
    """X4, X5."""
    b = X.block_contexts(_files(spark, sf))
    return b.select(
        F.concat_ws("-", F.col("merge_idx").cast("string"), F.col("file_no").cast("string"),
                    F.col("block_no").cast("string")).alias("conflict_id"),
        F.size("before").cast("long").alias("before_lines"),
        F.size("after").cast("long").alias("after_lines"),
        F.array_join("before", "").alias("before_text"),
        F.array_join("after", "").alias("after_text"),
        F.array_join("before5", "").alias("before5_text"),
        F.array_join("after5", "").alias("after5_text"),
        "conflict",
    )


def q_conflict_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """X6-X11 (flagship)."""
    b = _blocks(spark, sf)
    return b.select(
        "conflict_id",
        F.col("merge_idx").cast("long").alias("merge_idx"),
        F.col("block_no").cast("long").alias("block_no"),
        F.col("start_line").cast("long").alias("start_line"),
        F.col("end_line").cast("long").alias("end_line"),
        "status", "conflict", "resolution", "resolved", "empty_context", "coherent", "contained",
    )


# --- metrics, selection, summary ---------------------------------------------------

def _metrics(spark, sf):
    return M.metrics(X.resolved_pairs(_blocks(spark, sf)))


def q_conflict_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """M1-M10."""
    return _metrics(spark, sf)


def _selected(spark, sf):
    """F10 + W4: metrics computed with the pair texts carried along, so the
    selection is a filter (J5's join back to the blocks is not needed)."""
    m = M.metrics(X.resolved_pairs(_blocks(spark, sf)), keep_cols=("conflict", "resolved"))
    return M.selected(m)


def q_select_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """F10, W4, J5."""
    return _selected(spark, sf).select("conflict_id", "conflict", "resolved")


def _index(spark, sf):
    """Conflict index stand-in: labelled documents, source as repository."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    lab = table(spark, sf, "labels").select("doc_id")
    return (docs.join(lab, "doc_id", "left_semi")
            .select(F.col("doc_id").alias("merge_idx"), F.col("source").alias("repository")))


def q_repo_summary(spark: SparkSession, sf: str) -> DataFrame:
    """P6, J1, A3 (S6 is the sink order)."""
    return S.repository_summary(_metrics(spark, sf), _index(spark, sf))


def q_repo_summary_basic(spark: SparkSession, sf: str) -> DataFrame:
    """A4: no index -> one ALL_REPOSITORIES row."""
    return S.repository_summary(_metrics(spark, sf), None)


def q_id_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """J2, U3."""
    return S.id_overlap(_metrics(spark, sf), _index(spark, sf))


def q_dataset_split(spark: SparkSession, sf: str) -> DataFrame:
    """D1-D4 (A12 from the split column)."""
    ds = D.build_dataset(_selected(spark, sf))
    return ds.select("conflict_id", "split", F.md5("question").alias("question_md5"),
                     F.md5("answer").alias("answer_md5"),
                     F.expr("prompt[0].role").alias("prompt_role"))


# --- repository selection -----------------------------------------------------------

def _catalogue(spark, sf):
    """documents as a catalogue: source = repository, lang = language,
    n_chars = stars (as text, the way a CSV scan delivers it)."""
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("idx"), F.col("source").alias("repository"),
                    F.col("lang").alias("language"), F.col("n_chars").cast("string").alias("stars"))


def q_repo_language_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A1 (top-15 report)."""
    return RP.language_counts(_catalogue(spark, sf))


STANDIN_EXCLUDED = ("src3", "src7")


def q_repo_clean(spark: SparkSession, sf: str) -> DataFrame:
    """R4, F1, P2."""
    return RP.clean_catalogue(_catalogue(spark, sf), STANDIN_EXCLUDED)


def q_top_n_slice(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as repositories, segment = language,
    account balance = stars; rows 10..109 of one segment."""
    c = table(spark, sf, "customer").select(
        F.col("c_name").alias("repository"), F.col("c_mktsegment").alias("language"),
        F.col("c_acctbal").cast("string").alias("stars"))
    return RP.top_n_slice(c, "BUILDING", 10, 100)


def q_star_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A2: order prices as stars."""
    o = table(spark, sf, "orders").select(F.col("o_totalprice").alias("stars"))
    s = RP.star_stats(o)
    return s.select(F.col("n").cast("long").alias("n"), "min_stars", "max_stars",
                    F.round("mean_stars", 6).alias("mean_stars"), F.round("median_stars", 6).alias("median_stars"))


# --- commit history ------------------------------------------------------------------

def _graph(spark, sf):
    cust = table(spark, sf, "customer")
    return standin_refs(cust), standin_commits(cust)


def q_ref_dedupe_cap(spark: SparkSession, sf: str) -> DataFrame:
    """F7, K1, K2 (H1)."""
    refs, _ = _graph(spark, sf)
    r = H.branch_refs(refs, STANDIN_MAX_BRANCHES)
    return r.select("repository", "path", "head_sha", F.col("ref_ord").cast("long").alias("ref_ord"),
                    F.col("ref_rank").cast("long").alias("ref_rank"))


def q_merge_first_ref_cap(spark: SparkSession, sf: str) -> DataFrame:
    """H4, F8, K4, K7."""
    refs, commits = _graph(spark, sf)
    m = H.capped_merges(commits, H.branch_refs(refs, STANDIN_MAX_BRANCHES), None, STANDIN_MAX_MERGES)
    return m.select("repository", "branch_name", "merge_commit", "parent_1", "parent_2",
                    F.col("ref_rank").cast("long").alias("ref_rank"), "commit_ord")


def q_merge_notes(spark: SparkSession, sf: str) -> DataFrame:
    """H6 (H5)."""
    refs, commits = _graph(spark, sf)
    m = H.collect_merges(refs, commits, None, STANDIN_MAX_MERGES, STANDIN_MAX_BRANCHES)
    return m.select("repository", "merge_commit", "notes")


def q_ref_commits(spark: SparkSession, sf: str) -> DataFrame:
    """H2: the commits of every branch ref (no cap on refs)."""
    refs, commits = _graph(spark, sf)
    out = H.ref_commits(commits, H.branch_refs(refs))
    return out.select("repository", "path", F.col("ref_rank").cast("long").alias("ref_rank"), "sha", "commit_ord")


def q_merge_store_runs(spark: SparkSession, sf: str) -> DataFrame:
    """H7: a first run that sees the local branches only and takes 15 merges of a
    repository, then a run over all branches with a cap of 40 on the stored state."""
    from conflictlake.streaming.collection import MergeStore
    refs, commits = _graph(spark, sf)
    commits = commits.checkpoint(eager=True)
    store = MergeStore(spark, f"{ensure_checkpoint_dir(spark)}/merge-store-{uuid.uuid4().hex}")
    store.collect(refs.where(F.col("path").startswith("refs/heads/")), commits, 15)
    first = store.status().select("repository", F.col("runs")[0].alias("first")).checkpoint(eager=True)
    store.collect(refs, commits, 40)
    state = store.status().select("repository", "complete", "n_merges").join(first, "repository", "left")
    return store.merges().join(state, "repository").select(
        "repository", "merge_commit", "branch_name", "notes", "pos", F.when(F.col("run").eqNullSafe(F.col("first")), 1).otherwise(2).cast("long").alias("run"), "complete", "n_merges")


def q_merges_of_builds(spark: SparkSession, sf: str) -> DataFrame:
    """Four builds over three languages in one run; nations as repositories, the
    language by key modulo 3, the key as stars, every build with its own slice and cap."""
    from conflictlake.plans import all_languages as A
    refs, commits = _graph(spark, sf)
    n = table(spark, sf, "nation")
    catalogue = n.select(F.lit("reaper").alias("source"), F.element_at(F.array(*map(F.lit, ("Java", "Go", "Rust"))), (F.col("n_nationkey") % 3 + 1).cast("int")).alias("language"),
                         F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("repository"), F.col("n_nationkey").cast("string").alias("stars"))
    rows = [(0, "reaper", "java", 0, 5, 5), (1, "reaper", "java", 5, 20, 12), (2, "reaper", "go", 0, 4, 8), (3, "reaper", "rust", 2, 6, 3)]
    config = spark.createDataFrame([(*r, 100, 1.0) for r in rows], A.CONFIG)
    m = A.merges_of_builds(A.chosen_repositories(catalogue, config), refs, commits)
    return m.select(F.col("build").cast("long").alias("build"), "repository", "merge_commit", "branch_name", "language", "merge_idx")


def _order_merges(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderpriority").alias("repository"),
                    F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("merge_commit"),
                    "o_orderkey", "o_orderdate", "o_orderstatus")


def q_merge_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """J3, U2, S7 (H7): pending orders are the merges known from an earlier
    run (stored order = order key); all orders are the new collection, newest
    first; cap 100 per repository."""
    from conflictlake.streaming.incremental import combine_merges
    m = _order_merges(spark, sf)
    existing = m.where(F.col("o_orderstatus") == "P").select("repository", "merge_commit",
                                                           F.col("o_orderkey").alias("merge_idx"))
    new = m.select("repository", "merge_commit", (-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("t"),
                   (-F.col("o_orderkey")).alias("k"))
    return combine_merges(existing, new, 100, "merge_idx", ["t", "k"])


def q_merge_dense_index(spark: SparkSession, sf: str) -> DataFrame:
    """merge_idx over (repository, merge_commit)."""
    m = _order_merges(spark, sf).select("repository", "merge_commit")
    return H.number_merges(m).select("merge_idx", "repository", "merge_commit")


def q_duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A10: line items as merges keyed by (flags, part)."""
    li = table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("repository"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("merge_commit"))
    return H.duplicate_merge_keys(li).select("repository", "merge_commit", F.col("n").cast("long").alias("n"))


def _merge_status(spark, sf, *more):
    """pages as `git status` lines: host = merge, https -> both modified
    (UU), http -> added by both (AA); path = URL path + an extension by page
    language (en .java, fr .py, else .ts)."""
    p = table(spark, sf, "pages")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    lang = F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]+)/", 1)
    ext = F.when(lang == "en", ".java").when(lang == "fr", ".py").otherwise(".ts")
    path = F.concat(F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1), ext)
    xy = F.when(F.col("url").startswith("https"), "UU").otherwise("AA")
    return p.select(host.alias("host"), xy.alias("xy"), path.alias("path"), *more)


def q_conflict_file_select(spark: SparkSession, sf: str) -> DataFrame:
    """C1, C3, F6, F9, P8, K5 (A9 is the CSV form of this index)."""
    from conflictlake.operators import files as FI
    from conflictlake.operators.rank import dense_index
    st = _merge_status(spark, sf)
    merges = dense_index(st.select(F.col("host").alias("repository")).distinct(), ["repository"], "merge_idx")
    status = st.join(merges.withColumnRenamed("repository", "host"), "host").select("merge_idx", "xy", "path")
    files = FI.conflicted_files(status, "java")
    idx = FI.conflict_index(merges, files)
    return idx.select("merge_idx", "repository", F.col("file_no").cast("long").alias("file_no"), "conflict_id")


# --- dataset form, caches, code text -----------------------------------------------------

def _turn_pairs(spark, sf):
    c = table(spark, sf, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("q"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    return u.join(a, ["conv_id", "turn"], "left")


def q_conversation_format(spark: SparkSession, sf: str) -> DataFrame:
    """Each user turn as a fenced question, the assistant's
    next turn as the answer, in conversation form."""
    t = _turn_pairs(spark, sf).where(F.col("a").isNotNull())
    q = M.build_question(F.col("q"), "java")
    conv = D.to_conversation(q)
    return t.select("conv_id", "turn", F.md5(q).alias("question_md5"), F.col("a").alias("answer"),
                    conv[0]["role"].alias("prompt_role"),
                    F.length(conv[0]["content"]).cast("long").alias("prompt_len"))


def q_response_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns are cached responses to the preceding user
    text (latest write per key wins); every user turn is looked up."""
    from conflictlake.operators import responses as RS
    t = _turn_pairs(spark, sf)
    cache = (t.where(F.col("a").isNotNull())
             .select(F.lit("m1").alias("model"), F.md5("q").alias("cache_key"), F.col("q").alias("prompt"),
                     F.col("a").alias("result"), F.lit(None).cast("string").alias("reasoning"),
                     F.struct("conv_id", "turn").alias("written_at")))
    latest = RS.latest_responses(cache)
    req = t.select("conv_id", "turn", F.col("q").alias("prompt"))
    out = RS.lookup(req, latest, model="m1")
    return out.select("conv_id", "turn", "cache_key", F.col("result").isNotNull().alias("hit"), "result")


def q_code_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """E1, E5 on page sources."""
    from conflictlake.functions.text import normalize_code
    p = barrier(spread(table(spark, sf, "pages")).select("page_id", normalize_code("html").alias("c")))
    return p.select("page_id", F.md5("c").alias("norm_md5"), F.length("c").cast("long").alias("norm_len"))


def q_code_block(spark: SparkSession, sf: str) -> DataFrame:
    """Each document wrapped in a fence named by its language (en as
    java); the java block is extracted and stripped, null otherwise."""
    from conflictlake.functions.text import extract_code_block
    d = spread(table(spark, sf, "documents"))
    fence = F.when(F.col("lang") == "en", F.lit("java")).otherwise(F.col("lang"))
    wrapped = F.concat(F.lit("Answer:\n```"), fence, F.lit("\n"), F.col("text"), F.lit("\n```\ndone"))
    c = barrier(d.select("doc_id", extract_code_block(wrapped, "java").alias("c")))
    return c.select("doc_id", F.md5("c").alias("code_md5"), F.length("c").cast("long").alias("code_len"))


def q_dedupe_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as (question = text, answer = language) pairs."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("conflict_id"),
                                             F.col("text").alias("question"), F.col("lang").alias("answer"))
    return D.dedupe_exact(d).select("conflict_id")


def q_language_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Per-language rows and totals, plus the all-language total."""
    d = table(spark, sf, "documents")
    r = d.rollup("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"),
                             F.grouping("lang").alias("_g"))
    return r.select(F.when(F.col("_g") == 1, F.lit("TOTAL")).otherwise(F.col("lang")).alias("language"),
                    F.col("n_docs").cast("long").alias("n_docs"), F.col("n_chars").cast("long").alias("n_chars"))


def q_api_pages_project(spark: SparkSession, sf: str) -> DataFrame:
    """Events as search-API items, a search per day, 100 per page;
    a search is capped at the API's 1000 items, then archived/disabled ones are
    dropped."""
    rows = RP.api_query_filter(RP.format_api_items(_api_items(spark, sf)), exclude_archived=True)
    return rows.select("repository", "stars", "language", "created_at", "default_branch", "license",
                       "architecture", "archived", "disabled")


def _api_items(spark, sf):
    from conflictlake.sources.io import api_items
    e = table(spark, sf, "events")
    item = F.struct(
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("full_name"),
        F.get_json_object("props", "$.k").cast("long").alias("stargazers_count"),
        F.col("event_type").alias("language"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"),
        F.lit(0).cast("long").alias("forks_count"), F.lit(0).cast("long").alias("open_issues_count"),
        F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("default_branch"),
        F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("html_url"),
        F.lit(None).cast("string").alias("clone_url"),
        (F.col("event_type") == "error").alias("archived"), (F.col("value") < 2.0).alias("disabled"),
        F.lit(None).cast("struct<key:string>").alias("license"),
        F.col("event_id").alias("_order"))
    pages = (e.groupBy(F.to_date("ts").alias("search"), (F.col("event_id") / 100).cast("long").alias("page"))
             .agg(F.array_sort(F.collect_list(item), lambda a, b: F.when(a["_order"] < b["_order"], -1)
                               .when(a["_order"] > b["_order"], 1).otherwise(0)).alias("items")))
    return api_items(pages, 1000, "search")


def q_api_search(spark: SparkSession, sf: str) -> DataFrame:
    """the search query's predicates: one language, a least number of stars."""
    rows = RP.api_query_filter(RP.format_api_items(_api_items(spark, sf)), language="Click", min_stars=50)
    return rows.select("repository", "stars", "language", "created_at", "archived", "disabled")


# --- reports and rejects -------------------------------------------------------------------

def _pairs(spark, sf):
    return X.resolved_pairs(_blocks(spark, sf))


def q_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    """blocks by status."""
    return X.status_counts(_blocks(spark, sf)).select("status", F.col("blocks").cast("long").alias("n"))


def q_metric_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """whole documents as snippets: none holds a start marker, so all are rejected with that reason."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("conflict_id"), F.col("text").alias("conflict"), F.col("text").alias("resolved"))
    return M.metric_rejects(d)


def q_fail_percentages(spark: SparkSession, sf: str) -> DataFrame:
    """A5."""
    out = M.fail_percentages(M.metrics(_pairs(spark, sf)))
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def q_summary_totals(spark: SparkSession, sf: str) -> DataFrame:
    """A6 over the ordered summary."""
    return S.summary_totals(S.order_summary(q_repo_summary(spark, sf)))


def q_per_repository_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A7."""
    index = table(spark, sf, "documents").select(F.col("doc_id").alias("merge_idx"), F.col("source").alias("repository"))
    return S.per_repository_counts(S.with_repository(M.metrics(_pairs(spark, sf)), index))


def q_first_merge_ids(spark: SparkSession, sf: str) -> DataFrame:
    """A8 (top-10 report)."""
    return S.first_merge_ids(M.metrics(_pairs(spark, sf)))


def q_select_pairs_join(spark: SparkSession, sf: str) -> DataFrame:
    """Selected pairs of a stored metrics table, without trivial ones."""
    blocks = _blocks(spark, sf)
    out = M.select_pairs(M.metrics(X.resolved_pairs(blocks)), blocks, drop_trivial=True)
    return out.select("conflict_id", F.md5("conflict").alias("conflict_md5"), F.md5("resolved").alias("resolved_md5"))


def q_dedupe_split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Exact duplicates go before the split, whose sizes are exact."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("conflict_id"), F.col("text").alias("conflict"), F.col("lang").alias("resolved"))
    return D.split_sizes(D.build_dataset(d, 0.2, 42, dedupe=True)).select("split", F.col("rows").cast("long").alias("n_rows"))


def q_file_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Files found in the working tree (pages without a query
    string) with their merged text (pages without a fragment), and the index of
    the found ones."""
    from conflictlake.operators import files as FI
    from conflictlake.operators.rank import dense_index
    st = _merge_status(spark, sf).distinct()
    merges = dense_index(st.select(F.col("host").alias("repository")).distinct(), ["repository"], "merge_idx").checkpoint(eager=True)
    ids = merges.withColumnRenamed("repository", "host")
    p = _merge_status(spark, sf, "url", "page_id").join(ids, "host")

    def texts(mark):
        return p.where(~F.col("url").contains(mark)).groupBy("merge_idx", "path").agg(F.max("page_id").cast("string").alias("text"))

    files = FI.conflicted_files(st.join(ids, "host").select("merge_idx", "xy", "path"), "java")
    found = FI.pair_texts(files, texts("?"), texts("#"))
    index = FI.conflict_index_csv(FI.conflict_index(merges, found))
    counts = found.groupBy("merge_idx").agg(F.count("merged_text").alias("n_merged"), F.sum(F.col("conflict_text").cast("long")).alias("text_sum"))
    return index.join(counts, "merge_idx").select("merge_idx", "repository", "conflicts", "n_merged", "text_sum")


def q_stored_refs(spark: SparkSession, sf: str) -> DataFrame:
    """The refs with a positive balance's head as the stored list; those
    that still exist, with today's head and their keys."""
    refs, _ = _graph(spark, sf)
    stored = refs.where(F.col("ref_ord") >= 0).select("repository", F.regexp_replace("path", "maintenance$", "gone").alias("path"), (F.col("ref_ord") + 100).alias("ref_ord"))
    out = H.reuse_cached_refs(stored, refs)
    from conflictlake.functions.text import ref_key, slug_key
    return out.select("repository", "path", "head_sha", F.col("ref_ord").cast("long").alias("ref_ord"), ref_key("path").alias("ref_key"),
                      slug_key(F.concat_ws("/", "repository", "path")).alias("slug"))


def q_merge_existing_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Merges of the newest commits' repositories known from before use up the cap."""
    refs, commits = _graph(spark, sf)
    known = H.merge_candidates(commits).where(F.col("sha").endswith("3")).select("repository", F.col("sha").alias("merge_commit"))
    m = H.capped_merges(commits, H.branch_refs(refs, STANDIN_MAX_BRANCHES), known, STANDIN_MAX_MERGES)
    return m.select("repository", "merge_commit")


def q_response_misses(spark: SparkSession, sf: str) -> DataFrame:
    """Answers to opening turns are imported without a write time, later
    ones are appended with one; the requests that stay without an answer."""
    from conflictlake.operators import responses as RS
    from conflictlake.streaming.incremental import append_responses
    t = _turn_pairs(spark, sf)
    rows = t.where(F.col("a").isNotNull()).select("turn", F.lit("m1").alias("model"), F.md5("q").alias("cache_key"), F.col("q").alias("prompt"), F.col("a").alias("result"),
                                                  F.lit(None).cast("string").alias("reasoning"), F.struct("conv_id", "turn").alias("written_at"))
    first = F.col("turn") <= 1
    cache = append_responses(rows.where(first).drop("turn", "written_at"), rows.where(~first).drop("turn"))
    return RS.misses(t.select("conv_id", "turn", F.col("q").alias("prompt")), RS.latest_responses(cache).where("result IS NOT NULL"), model="m1").select("conv_id", "turn", "cache_key")


def q_response_store(spark: SparkSession, sf: str) -> DataFrame:
    """Answers written in three batches by turn (0, 1 to 2, later), each with the turn as its
    time, compacted after the second; the latest answer of every prompt."""
    from conflictlake.streaming.response_store import ResponseStore
    t = _turn_pairs(spark, sf).where(F.col("a").isNotNull())
    rows = t.select("turn", F.lit("m1").alias("model"), F.col("q").alias("prompt"), F.col("a").alias("result"), F.timestamp_seconds("turn").alias("written_at"))
    store = ResponseStore(spark, f"{ensure_checkpoint_dir(spark)}/responses-{uuid.uuid4().hex}", buckets=8)
    store.append(rows.where("turn < 1"))
    store.append(rows.where("turn BETWEEN 1 AND 2"))
    store.compact(1)
    store.append(rows.where("turn > 2"))
    return store.latest().select("model", "cache_key", F.md5("result").alias("result_md5"), F.unix_timestamp("written_at").alias("turn"))


def q_top_by_stars(spark: SparkSession, sf: str) -> DataFrame:
    """S2, S3 (top-10 report): customers by account balance."""
    c = table(spark, sf, "customer").select(F.col("c_name").alias("repository"), F.col("c_acctbal").alias("stars"))
    return RP.top_by_stars(c)


def q_language_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The roll-up of the jobs over per-language rows, a language without a split among them."""
    from conflictlake.plans.jobs import language_rollup
    d = table(spark, sf, "documents")
    per = d.groupBy(F.col("lang").alias("language")).agg(F.countDistinct("source").alias("repositories"), F.count("*").alias("selected"))
    return language_rollup(per.withColumn("train", F.when(F.col("language") != "fr", F.col("selected") - 1)))


REGISTRY = {
    "conflict_lines": q_conflict_lines,
    "conflict_blocks": q_conflict_blocks,
    "conflict_context": q_conflict_context,
    "conflict_resolve": q_conflict_resolve,
    "conflict_metrics": q_conflict_metrics,
    "select_conflicts": q_select_conflicts,
    "repo_summary": q_repo_summary,
    "repo_summary_basic": q_repo_summary_basic,
    "id_overlap": q_id_overlap,
    "dataset_split": q_dataset_split,
    "repo_language_counts": q_repo_language_counts,
    "repo_clean": q_repo_clean,
    "top_n_slice": q_top_n_slice,
    "star_stats": q_star_stats,
    "ref_dedupe_cap": q_ref_dedupe_cap,
    "merge_first_ref_cap": q_merge_first_ref_cap,
    "merge_notes": q_merge_notes,
    "ref_commits": q_ref_commits,
    "merge_store_runs": q_merge_store_runs,
    "merges_of_builds": q_merges_of_builds,
    "merge_incremental": q_merge_incremental,
    "merge_dense_index": q_merge_dense_index,
    "duplicate_keys": q_duplicate_keys,
    "conflict_file_select": q_conflict_file_select,
    "conversation_format": q_conversation_format,
    "response_cache": q_response_cache,
    "code_normalise": q_code_normalise,
    "code_block": q_code_block,
    "dedupe_exact": q_dedupe_exact,
    "language_rollup": q_language_rollup,
    "api_pages_project": q_api_pages_project,
    "api_search": q_api_search,
    "status_counts": q_status_counts,
    "metric_rejects": q_metric_rejects,
    "fail_percentages": q_fail_percentages,
    "summary_totals": q_summary_totals,
    "per_repository_counts": q_per_repository_counts,
    "first_merge_ids": q_first_merge_ids,
    "select_pairs_join": q_select_pairs_join,
    "dedupe_split_sizes": q_dedupe_split_sizes,
    "file_pairs": q_file_pairs,
    "stored_refs": q_stored_refs,
    "merge_existing_cap": q_merge_existing_cap,
    "response_misses": q_response_misses,
    "response_store": q_response_store,
    "top_by_stars": q_top_by_stars,
    "language_totals": q_language_totals,
}
