"""Oracle SQL (DuckDB) for the registered queries.

Each statement is an independent formulation of the operator in plain SQL with
list functions and recursive CTEs (DuckDB's ``lambda x: ...`` syntax); it is
not generated from the Spark plans.  Patterns are written out
here once more, in RE2's terms, so that an error in the code under test shows.
"""

from __future__ import annotations

from conflictlake.operators.metrics import QUERY_PROMPT
from conflictlake.plans.inputs import BASE_LINE, CLOSE_LINE, EDIT_LINE, HAND_LINE, OPEN_LINE, SEP_LINE


# --- fixed values: line ends and white space of Python text, tokens of the proxy ----
_BREAKS = r"\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
LINE_RE = "[^" + _BREAKS + "]*[" + _BREAKS + "]|[^" + _BREAKS + "]+"
LINE_END_RE = "[" + _BREAKS + r"]\z"
TOKEN_RE = r"\w+|[^\w\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# ------------------------------------------------------------------------------------


def _lit(s: str) -> str:
    """DuckDB string literal (no backslash escapes in standard strings)."""
    return "'" + s.replace("'", "''") + "'"


NL = "chr(10)"


def _lines(expr: str) -> str:
    return f"regexp_extract_all(regexp_replace({expr}, '\\r\\n?', {NL}, 'g'), {_lit(LINE_RE)})"


def _plain(expr: str) -> str:
    return f"list_transform({_lines(expr)}, lambda x: regexp_replace(x, {_lit(LINE_END_RE)}, ''))"


def _nl(s: str) -> str:
    """Literal for a string ending in a newline."""
    assert s.endswith("\n")
    return f"({_lit(s[:-1])} || {NL})"


# --- CTE fragments ---------------------------------------------------------------

CTE_FILES = f"""
docs AS (SELECT doc_id, source, {_lines("CASE WHEN doc_id % 10 >= 8 THEN text || chr(10) ELSE text END")} AS l FROM documents),
third AS (
  SELECT *, len(l) AS n, len(l) // 3 AS a, l[1 : len(l) // 3] AS head, l[len(l) // 3 + 1 : len(l) - len(l) // 3] AS mid,
         l[len(l) - len(l) // 3 + 1 : len(l)] AS tail FROM docs),
built AS (
  SELECT doc_id AS merge_idx, 0 AS file_no,
         array_to_string(CASE doc_id % 10
           WHEN 1 THEN head || list_reverse(mid) || tail
           WHEN 2 THEN head || [{_nl(HAND_LINE)}] || tail
           WHEN 3 THEN head || mid || mid || mid || mid || tail
           WHEN 4 THEN head[1 : greatest(a - 1, 0)] || [{_nl(EDIT_LINE)}] || mid || tail
           WHEN 5 THEN head || mid || [{_nl(EDIT_LINE)}] || tail[2 : len(tail)]
           WHEN 6 THEN NULL WHEN 7 THEN l || l WHEN 8 THEN tail || head || mid
           WHEN 9 THEN tail || head || mid || head ELSE l END, '') AS merged_text,
         array_to_string(
           head || [{_nl(OPEN_LINE)}] || mid
           || (CASE WHEN n % 2 = 0 THEN [{_nl(BASE_LINE)}] || mid[1:1] ELSE []::VARCHAR[] END)
           || [{_nl(SEP_LINE)}] || list_reverse(mid) || [{_nl(CLOSE_LINE)}]
           || (CASE WHEN doc_id % 4 = 1 AND a >= 4
                    THEN tail[1:2] || [{_nl(OPEN_LINE)}] || tail[3:3] || [{_nl(SEP_LINE)}]
                         || list_transform(tail[3:3], lambda x: 'other ' || x) || [{_nl(CLOSE_LINE)}] || tail[4:len(tail)]
                    ELSE tail END), '') AS conflict_text
  FROM third),
files AS (
  SELECT merge_idx, file_no, {_lines('conflict_text')} AS cl, {_lines('merged_text')} AS ml FROM built),
mk AS (
  SELECT *, len(cl) AS n, len(ml) AS nm,
    list_filter(range(len(cl)), lambda i: starts_with(cl[i + 1], '<<<<<<<')) AS opens,
    list_filter(range(len(cl)), lambda i: starts_with(cl[i + 1], '=======')) AS seps,
    list_filter(range(len(cl)), lambda i: starts_with(cl[i + 1], '>>>>>>>')) AS closes,
    list_filter(range(len(cl)), lambda i: starts_with(cl[i + 1], '<<<<<<<')
      OR starts_with(cl[i + 1], '=======') OR starts_with(cl[i + 1], '>>>>>>>')) AS marks
  FROM files)"""

# Blocks by recursion: the first opening marker, its separator and closing
# marker; then the next opening marker after that closing marker.
CTE_BLOCKS = """
blk(merge_idx, file_no, block_no, s, e) AS (
  SELECT merge_idx, file_no, 1, s,
         list_min(list_filter(closes, lambda j: j > list_min(list_filter(seps, lambda k: k > s))))
  FROM (SELECT *, list_min(opens) AS s FROM mk) q0 WHERE s IS NOT NULL
  UNION ALL
  SELECT q.merge_idx, q.file_no, q.block_no, q.s,
         list_min(list_filter(q.closes, lambda j: j > list_min(list_filter(q.seps, lambda k: k > q.s))))
  FROM (SELECT m.merge_idx, m.file_no, m.closes, m.seps, b.block_no + 1 AS block_no,
               list_min(list_filter(m.opens, lambda o: o > b.e)) AS s
        FROM blk b JOIN mk m ON m.merge_idx = b.merge_idx AND m.file_no = b.file_no
        WHERE b.e IS NOT NULL) q
  WHERE q.s IS NOT NULL),
blocks AS (SELECT * FROM blk WHERE e IS NOT NULL)"""

CTE_CONTEXT = """
ctx0 AS (
  SELECT k.merge_idx, k.file_no, k.block_no, k.s, k.e, m.cl, m.ml, m.n, m.nm,
    greatest(k.s - 20, coalesce(list_max(list_filter(m.marks, lambda j: j < k.s)) + 1, 0)) AS b0,
    least(k.e + 21, coalesce(list_min(list_filter(m.marks, lambda j: j > k.e)), m.n)) AS a1,
    greatest(k.s - 5, 0) AS c0, least(m.n, k.e + 6) AS c1
  FROM blocks k JOIN mk m ON m.merge_idx = k.merge_idx AND m.file_no = k.file_no),
ctx AS (
  SELECT *, cl[b0 + 1 : s] AS bef, cl[e + 2 : a1] AS aft, cl[c0 + 1 : s] AS bef5,
         cl[e + 2 : c1] AS aft5, array_to_string(cl[c0 + 1 : c1], '') AS conflict,
         merge_idx || '-' || file_no || '-' || block_no AS conflict_id
  FROM ctx0)"""

CTE_RESOLVE = """
mt AS (
  SELECT *, len(bef) AS nb, len(aft) AS na,
    CASE WHEN len(bef) = 0 THEN range(nm)
         ELSE list_filter(range(greatest(nm - len(bef) + 1, 0)),
                          lambda i: ml[i + 1] = bef[1] AND ml[i + 1 : i + len(bef)] = bef) END AS bm,
    CASE WHEN len(aft) = 0 THEN range(nm)
         ELSE list_filter(range(greatest(nm - len(aft) + 1, 0)),
                          lambda i: ml[i + 1] = aft[1] AND ml[i + 1 : i + len(aft)] = aft) END AS am
  FROM ctx),
dec AS (
  SELECT *,
    CASE WHEN len(bm) = 1 THEN bm[1]
         WHEN len(am) = 1 THEN list_max(list_filter(bm, lambda p: p + nb <= am[1])) END AS i1,
    CASE WHEN len(bm) = 1 THEN list_min(list_filter(am, lambda p: p >= bm[1] + nb))
         WHEN len(am) = 1 THEN am[1] END AS i2
  FROM mt),
st AS (
  SELECT *,
    CASE WHEN ml IS NULL THEN 'no_merged_file'
         WHEN len(bm) = 0 THEN 'before_not_found'
         WHEN len(am) = 0 THEN 'after_not_found'
         WHEN len(bm) > 1 AND len(am) > 1 THEN 'ambiguous'
         WHEN len(bm) = 1 THEN (CASE WHEN i2 IS NULL THEN 'no_valid_after' ELSE 'ok' END)
         ELSE (CASE WHEN i1 IS NULL THEN 'no_valid_before' ELSE 'ok' END) END AS status
  FROM dec),
res AS (
  SELECT *,
    CASE WHEN status = 'ok' THEN array_to_string(ml[i1 + nb + 1 : i2], '') END AS resolution,
    CASE WHEN status = 'ok' THEN array_to_string(bef5, '') || array_to_string(ml[i1 + nb + 1 : i2], '')
                                 || array_to_string(aft5, '') END AS resolved,
    (nb = 0 OR na = 0) AS empty_context,
    CASE WHEN status = 'ok' THEN
      (least(len(bef5), nb) = 0 OR bef5[len(bef5) - least(len(bef5), nb) + 1 : len(bef5)]
                                   = ml[i1 + nb - least(len(bef5), nb) + 1 : i1 + nb])
      AND (least(len(aft5), na) = 0 OR aft5[1 : least(len(aft5), na)] = ml[i2 + 1 : i2 + least(len(aft5), na)])
    END AS coherent,
    CASE WHEN status = 'ok' THEN
      contains(array_to_string(ml, ''), array_to_string(ml[i1 + nb + 1 : i2], '')) END AS contained
  FROM st)"""

_Q = _lit(QUERY_PROMPT + "```java") + f" || {NL}"

# Metrics: the block is cut by the first start marker and the first end marker
# at or after it; each block line is assigned to left / base / right by the
# last base or separator marker before it.
CTE_METRICS = f"""
pairs AS (SELECT conflict_id, conflict, resolved FROM res WHERE status = 'ok'),
m0 AS (SELECT conflict_id, {_plain('conflict')} AS L, {_plain('resolved')} AS R FROM pairs),
m1 AS (SELECT *, list_min(list_filter(range(len(L)), lambda i: starts_with(L[i + 1], '<<<<<<<'))) AS st
       FROM m0),
m2 AS (SELECT *, list_min(list_filter(range(len(L)), lambda i: i >= st AND starts_with(L[i + 1], '>>>>>>>'))) AS en
       FROM m1),
m3 AS (SELECT *, L[st + 1 : en + 1] AS blk, st AS nb, len(L) - en - 1 AS na FROM m2
       WHERE st IS NOT NULL AND en IS NOT NULL),
m4 AS (SELECT *,
    list_filter(range(1, len(blk) + 1), lambda j: starts_with(blk[j], '|||||||')) AS bpos,
    list_filter(range(1, len(blk) + 1), lambda j: starts_with(blk[j], '=======')) AS spos
  FROM m3),
m5 AS (SELECT *,
    list_transform(range(1, len(blk) + 1), lambda j:
      CASE WHEN starts_with(blk[j], '<<<<<<<') OR starts_with(blk[j], '>>>>>>>')
             OR starts_with(blk[j], '|||||||') OR starts_with(blk[j], '=======') THEN 'X'
           WHEN coalesce(list_max(list_filter(bpos, lambda p: p < j)), -1) = -1
            AND coalesce(list_max(list_filter(spos, lambda p: p < j)), -1) = -1 THEN 'L'
           WHEN coalesce(list_max(list_filter(bpos, lambda p: p < j)), -1)
              > coalesce(list_max(list_filter(spos, lambda p: p < j)), -1) THEN 'B'
           ELSE 'R' END) AS side
  FROM m4),
m6 AS (SELECT *,
    list_filter(blk, lambda x, j: side[j] = 'L') AS lft,
    list_filter(blk, lambda x, j: side[j] = 'B') AS bas,
    list_filter(blk, lambda x, j: side[j] = 'R') AS rgt,
    R[nb + 1 : greatest(len(R) - na, 0)] AS rs,
    len(regexp_extract_all({_Q} || array_to_string(L, {NL}) || {NL} || '```', {_lit(TOKEN_RE)}))
      AS num_tokens_query
  FROM m5),
metrics AS (
  SELECT conflict_id,
    len(L) > 20 AS fail_max_lines,
    num_tokens_query > 512 AS fail_token_count,
    len(L) + 2 < len(R) AS fail_incoherent,
    CAST(len(L) AS BIGINT) AS full_conflict_lines,
    CAST(nb AS BIGINT) AS context_before_lines,
    CAST(len(blk) AS BIGINT) AS conflict_lines,
    CAST(na AS BIGINT) AS context_after_lines,
    CAST(len(R) AS BIGINT) AS full_resolution_lines,
    CAST(len(rs) AS BIGINT) AS resolution_lines,
    CAST(len(lft) AS BIGINT) AS parent1_lines,
    CAST(len(rgt) AS BIGINT) AS parent2_lines,
    CAST(CASE WHEN len(bpos) > 0 THEN len(bas) ELSE -1 END AS BIGINT) AS base_lines,
    CAST(num_tokens_query AS BIGINT) AS num_tokens_query,
    (replace(replace(array_to_string(rs, ''), ' ', ''), chr(9), '')
       = replace(replace(array_to_string(lft, ''), ' ', ''), chr(9), '')
     OR replace(replace(array_to_string(rs, ''), ' ', ''), chr(9), '')
       = replace(replace(array_to_string(rgt, ''), ' ', ''), chr(9), '')) AS resolution_in_left_or_right,
    len(L) + 2 < len(R) AS incoherent_resolution_size,
    NOT (len(L) > 20 OR num_tokens_query > 512 OR len(L) + 2 < len(R)) AS selected
  FROM m6)"""

CTE_INDEX = """
idx AS (SELECT d.doc_id AS merge_idx, d.source AS repository FROM documents d
        WHERE d.doc_id IN (SELECT doc_id FROM labels))"""

SUM_COLS = """
    count(*) AS total_conflicts,
    sum(CAST(selected AS BIGINT)) AS selected_conflicts,
    count(*) - sum(CAST(selected AS BIGINT)) AS filtered_out_conflicts,
    sum(CAST(fail_max_lines AS BIGINT)) AS failed_max_lines,
    sum(CAST(fail_token_count AS BIGINT)) AS failed_token_count,
    sum(CAST(fail_incoherent AS BIGINT)) AS failed_incoherent,
    CASE WHEN count(*) > 0 THEN sum(CAST(selected AS BIGINT)) / count(*) ELSE 0.0 END AS selection_rate"""


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes)


SQL = {}

SQL["conflict_lines"] = f"""
WITH d AS (SELECT doc_id, {_lines('text')} AS L, {_plain('text')} AS P FROM documents)
SELECT doc_id,
  CAST(len(L) AS BIGINT) AS n_lines,
  CAST(len(P) AS BIGINT) AS n_lines_plain,
  P[1] AS first_line,
  L[len(L)] AS last_line,
  CAST(coalesce(list_sum(list_transform(P, lambda x: length(x))), 0) AS BIGINT) AS chars_plain,
  CAST(len(list_filter(P, lambda x: x = '')) AS BIGINT) AS n_blank
FROM d"""

SQL["conflict_blocks"] = _with(CTE_FILES, CTE_BLOCKS) + """
SELECT merge_idx || '-' || file_no || '-' || block_no AS conflict_id,
  CAST(merge_idx AS BIGINT) AS merge_idx, CAST(block_no AS BIGINT) AS block_no,
  CAST(s AS BIGINT) AS start_line, CAST(e AS BIGINT) AS end_line
FROM blocks"""

SQL["conflict_context"] = _with(CTE_FILES, CTE_BLOCKS, CTE_CONTEXT) + """
SELECT conflict_id, CAST(len(bef) AS BIGINT) AS before_lines, CAST(len(aft) AS BIGINT) AS after_lines,
  array_to_string(bef, '') AS before_text, array_to_string(aft, '') AS after_text,
  array_to_string(bef5, '') AS before5_text, array_to_string(aft5, '') AS after5_text, conflict
FROM ctx"""

SQL["conflict_resolve"] = _with(CTE_FILES, CTE_BLOCKS, CTE_CONTEXT, CTE_RESOLVE) + """
SELECT conflict_id, CAST(merge_idx AS BIGINT) AS merge_idx, CAST(block_no AS BIGINT) AS block_no,
  CAST(s AS BIGINT) AS start_line, CAST(e AS BIGINT) AS end_line,
  status, conflict, resolution, resolved, empty_context, coherent, contained
FROM res"""

SQL["conflict_metrics"] = _with(CTE_FILES, CTE_BLOCKS, CTE_CONTEXT, CTE_RESOLVE, CTE_METRICS) + """
SELECT * FROM metrics"""

SQL["select_conflicts"] = _with(CTE_FILES, CTE_BLOCKS, CTE_CONTEXT, CTE_RESOLVE, CTE_METRICS) + """
SELECT r.conflict_id, r.conflict, r.resolved FROM res r
WHERE r.conflict_id IN (SELECT conflict_id FROM metrics WHERE selected)"""

SQL["repo_summary"] = _with(CTE_FILES, CTE_BLOCKS, CTE_CONTEXT, CTE_RESOLVE, CTE_METRICS, CTE_INDEX) + f""",
mapped AS (
  SELECT m.*, i.repository FROM metrics m
  JOIN (SELECT CAST(merge_idx AS VARCHAR) AS merge_id, max(repository) AS repository
        FROM idx GROUP BY 1) i
    ON split_part(m.conflict_id, '-', 1) = i.merge_id),
grouped AS (SELECT repository, {SUM_COLS} FROM mapped GROUP BY repository)
SELECT * FROM grouped
UNION ALL
SELECT * FROM (SELECT 'ALL_REPOSITORIES' AS repository, {SUM_COLS} FROM metrics) b
WHERE NOT EXISTS (SELECT 1 FROM grouped)"""

SQL["repo_summary_basic"] = _with(CTE_FILES, CTE_BLOCKS, CTE_CONTEXT, CTE_RESOLVE, CTE_METRICS) + f"""
SELECT 'ALL_REPOSITORIES' AS repository, {SUM_COLS} FROM metrics"""

SQL["id_overlap"] = _with(CTE_FILES, CTE_BLOCKS, CTE_CONTEXT, CTE_RESOLVE, CTE_METRICS, CTE_INDEX) + """,
e AS (SELECT DISTINCT split_part(conflict_id, '-', 1) AS merge_id FROM metrics),
a AS (SELECT DISTINCT CAST(merge_idx AS VARCHAR) AS merge_id FROM idx)
SELECT (SELECT count(*) FROM e) AS extracted_ids,
       (SELECT count(*) FROM a) AS available_ids,
       (SELECT count(*) FROM e WHERE merge_id IN (SELECT merge_id FROM a)) AS overlap_ids"""

SQL["dataset_split"] = _with(CTE_FILES, CTE_BLOCKS, CTE_CONTEXT, CTE_RESOLVE, CTE_METRICS) + f""",
sel AS (SELECT r.conflict_id, r.conflict, r.resolved FROM res r
        WHERE r.conflict_id IN (SELECT conflict_id FROM metrics WHERE selected)),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY md5('42:' || conflict_id), conflict_id) - 1 AS rk,
         count(*) OVER () AS n FROM sel)
SELECT conflict_id,
  CASE WHEN rk < ceil(CAST(0.2 AS DOUBLE) * CAST(n AS DOUBLE)) THEN 'test' ELSE 'train' END AS split,
  md5({_lit(QUERY_PROMPT + "```java")} || {NL} || conflict || {NL} || '```') AS question_md5,
  md5(resolved) AS answer_md5,
  'user' AS prompt_role
FROM ordered"""

# --- repository selection ---------------------------------------------------------------

SQL["repo_language_counts"] = """
SELECT lang AS language, count(*) AS repo_count FROM documents WHERE lang IS NOT NULL
GROUP BY lang ORDER BY repo_count DESC, language LIMIT 15"""

SQL["repo_clean"] = """
WITH c AS (SELECT doc_id AS idx, source AS repository, lang AS language,
                  CAST(n_chars AS VARCHAR) AS stars FROM documents)
SELECT idx, repository, language, CAST(stars AS INTEGER) AS stars FROM c
WHERE idx IS NOT NULL
  AND repository IS NOT NULL AND repository NOT IN ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')
  AND language IS NOT NULL AND language NOT IN ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')
  AND stars IS NOT NULL AND stars NOT IN ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')
  AND repository NOT IN ('src3', 'src7')"""

SQL["top_n_slice"] = """
SELECT c_name AS repository, c_mktsegment AS language,
       TRY_CAST(CAST(c_acctbal AS VARCHAR) AS DOUBLE) AS stars
FROM customer
WHERE c_mktsegment = 'BUILDING' AND TRY_CAST(CAST(c_acctbal AS VARCHAR) AS DOUBLE) IS NOT NULL
ORDER BY stars DESC, repository LIMIT 100 OFFSET 10"""

SQL["star_stats"] = """
SELECT count(*) AS n, min(o_totalprice) AS min_stars, max(o_totalprice) AS max_stars,
       round(avg(o_totalprice), 6) AS mean_stars, round(median(o_totalprice), 6) AS median_stars
FROM orders"""

# --- commit history -------------------------------------------------------------------------

# --- fixed values: refs kept first ---
_PRIO = " OR ".join(f"contains(lower(path), '{p}')" for p in (
    "refs/heads/main", "refs/heads/mainline", "refs/heads/master", "refs/heads/develop",
    "refs/heads/dev", "refs/remotes/origin/main", "refs/remotes/origin/master",
    "refs/remotes/origin/mainline", "refs/remotes/origin/develop", "refs/remotes/origin/dev"))
# -------------------------------------

CTE_GRAPH = f"""
cust AS (SELECT 'n' || c_nationkey AS repository, c_custkey AS k, c_mktsegment AS seg, c_acctbal, c_nationkey % 2 = 0 AS second,
                row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i
         FROM customer),
e0 AS (SELECT repository, k, 1 AS pos, i // 2 AS pi FROM cust WHERE i // 2 < i AND NOT (i = 1 AND second)
       UNION ALL SELECT repository, k, 2 AS pos, i // 3 AS pi FROM cust WHERE i // 3 < i AND NOT (i = 1 AND second)),
e1 AS (SELECT e.repository, e.k, e.pos, c.k AS pk FROM e0 e JOIN cust c ON c.repository = e.repository AND c.i = e.pi),
commits AS (
  SELECT c.repository, 'c' || c.k AS sha, -c.k AS commit_ord,
         coalesce((SELECT list('c' || e.pk ORDER BY e.pos) FROM e1 e
                   WHERE e.repository = c.repository AND e.k = c.k), []::VARCHAR[]) AS parents
  FROM cust c),
pe AS (SELECT repository, sha, unnest(parents) AS parent FROM commits),
segs AS (SELECT * FROM (VALUES ('AUTOMOBILE', 0), ('BUILDING', 1), ('FURNITURE', 2), ('HOUSEHOLD', 3),
                               ('MACHINERY', 4)) v(seg, so)),
heads AS (SELECT c.repository, c.seg, s.so, max(c.k) AS hk, max(CASE WHEN c.c_acctbal > 0 THEN c.k END) AS pk
          FROM cust c JOIN segs s ON s.seg = c.seg GROUP BY c.repository, c.seg, s.so),
refs AS (
  SELECT repository, 'refs/heads/' || CASE seg WHEN 'BUILDING' THEN 'main' WHEN 'AUTOMOBILE' THEN 'maintenance'
                                      ELSE lower(seg) END AS path, 'c' || hk AS head_sha, so AS ref_ord FROM heads
  UNION ALL
  SELECT repository, 'refs/remotes/origin/' || lower(seg), 'c' || pk, 10 + so FROM heads WHERE pk IS NOT NULL
  UNION ALL
  SELECT repository, 'refs/tags/v1', 'c' || hk, -1 FROM heads WHERE seg = 'HOUSEHOLD'),
f7 AS (SELECT * FROM refs WHERE starts_with(path, 'refs/heads/') OR starts_with(path, 'refs/remotes/')),
k1 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY repository, head_sha ORDER BY ref_ord) AS rn
                                    FROM f7) WHERE rn = 1),
k2a AS (SELECT *, count(*) OVER (PARTITION BY repository) AS nrefs, ({_PRIO}) AS prio FROM k1),
k2 AS (SELECT *, row_number() OVER (PARTITION BY repository
                 ORDER BY CASE WHEN nrefs > 3 AND NOT prio THEN 1 ELSE 0 END, ref_ord, path) - 1 AS ref_rank
       FROM k2a),
ranked AS (SELECT repository, path, head_sha, ref_ord, ref_rank FROM k2
           WHERE nrefs <= 3 OR prio OR ref_rank < 3),
reach(repository, sha, ref_rank) AS (
  SELECT repository, head_sha, ref_rank FROM ranked
  UNION
  SELECT r.repository, p.parent, r.ref_rank FROM reach r JOIN pe p ON p.repository = r.repository AND p.sha = r.sha),
firstref AS (SELECT repository, sha, min(ref_rank) AS ref_rank FROM reach GROUP BY repository, sha),
cand AS (SELECT repository, sha, commit_ord, parents[1] AS parent_1, parents[2] AS parent_2 FROM commits
         WHERE len(parents) = 2 AND parents[1] <> parents[2]),
capped AS (
  SELECT * FROM (SELECT c.*, f.ref_rank,
                        row_number() OVER (PARTITION BY c.repository ORDER BY f.ref_rank, c.commit_ord, c.sha) AS rn
                 FROM cand c JOIN firstref f ON f.repository = c.repository AND f.sha = c.sha)
  WHERE rn <= 15)"""

SQL["ref_dedupe_cap"] = _with(CTE_GRAPH) + """
SELECT repository, path, head_sha, CAST(ref_ord AS BIGINT) AS ref_ord, CAST(ref_rank AS BIGINT) AS ref_rank
FROM ranked"""

SQL["merge_first_ref_cap"] = _with(CTE_GRAPH) + """
SELECT c.repository, r.path AS branch_name, c.sha AS merge_commit, c.parent_1, c.parent_2,
       CAST(c.ref_rank AS BIGINT) AS ref_rank, CAST(c.commit_ord AS BIGINT) AS commit_ord
FROM capped c JOIN ranked r ON r.repository = c.repository AND r.ref_rank = c.ref_rank"""

# Notes from full ancestor sets: one parent among the other's ancestors, else
# compare the oldest ancestors (largest commit_ord) of the two parents.
CTE_ANCESTORS = """
anc(repository, sha, a) AS (
  SELECT repository, sha, sha FROM commits
  UNION
  SELECT x.repository, x.sha, p.parent FROM anc x JOIN pe p ON p.repository = x.repository AND p.sha = x.a),
oldest AS (SELECT x.repository, x.sha, arg_max(x.a, c.commit_ord) AS o FROM anc x
           JOIN commits c ON c.repository = x.repository AND c.sha = x.a GROUP BY x.repository, x.sha)"""

NOTE = """CASE WHEN EXISTS (SELECT 1 FROM anc x WHERE x.repository = m.repository AND x.sha = m.parent_1 AND x.a = m.parent_2)
         OR EXISTS (SELECT 1 FROM anc x WHERE x.repository = m.repository AND x.sha = m.parent_2 AND x.a = m.parent_1)
       THEN 'a parent is the base'
       WHEN o1.o IS DISTINCT FROM o2.o THEN 'two initial commits'
       ELSE '' END AS notes"""

SQL["merge_notes"] = _with(CTE_GRAPH, CTE_ANCESTORS) + f"""
SELECT m.repository, m.sha AS merge_commit, {NOTE}
FROM capped m
LEFT JOIN oldest o1 ON o1.repository = m.repository AND o1.sha = m.parent_1
LEFT JOIN oldest o2 ON o2.repository = m.repository AND o2.sha = m.parent_2"""

# all branch refs, no cap on their number
CTE_ALL_REFS = """
ranked2 AS (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY ref_ord, path) - 1 AS ref_rank FROM k1),
reach2(repository, sha, ref_rank) AS (
  SELECT repository, head_sha, ref_rank FROM ranked2
  UNION
  SELECT r.repository, p.parent, r.ref_rank FROM reach2 r JOIN pe p ON p.repository = r.repository AND p.sha = r.sha)"""

SQL["ref_commits"] = _with(CTE_GRAPH, CTE_ALL_REFS) + """
SELECT r.repository, k.path, r.ref_rank, r.sha, CAST(c.commit_ord AS BIGINT) AS commit_ord
FROM reach2 r JOIN ranked2 k ON k.repository = r.repository AND k.ref_rank = r.ref_rank
JOIN commits c ON c.repository = r.repository AND c.sha = r.sha"""

SQL["merge_store_runs"] = _with(CTE_GRAPH, CTE_ALL_REFS, CTE_ANCESTORS) + f""",
local AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY repository, head_sha ORDER BY ref_ord) AS rn
                                       FROM f7 WHERE starts_with(path, 'refs/heads/')) WHERE rn = 1),
ranked1 AS (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY ref_ord, path) - 1 AS ref_rank FROM local),
reach1(repository, sha, ref_rank) AS (
  SELECT repository, head_sha, ref_rank FROM ranked1
  UNION
  SELECT r.repository, p.parent, r.ref_rank FROM reach1 r JOIN pe p ON p.repository = r.repository AND p.sha = r.sha),
label1 AS (SELECT repository, sha, min(ref_rank) AS ref_rank FROM reach1 GROUP BY ALL),
label2 AS (SELECT repository, sha, min(ref_rank) AS ref_rank FROM reach2 r GROUP BY ALL),
run1 AS (SELECT * FROM (SELECT c.*, l.ref_rank, row_number() OVER (PARTITION BY c.repository ORDER BY l.ref_rank, c.commit_ord, c.sha) AS rn
                        FROM cand c JOIN label1 l USING (repository, sha)) WHERE rn <= 15),
n1 AS (SELECT repository, count(*) AS n FROM run1 GROUP BY repository),
left_ AS (SELECT c.*, coalesce(a.ref_rank, b.ref_rank) AS ref_rank, a.sha IS NOT NULL AS old
          FROM cand c LEFT JOIN label1 a USING (repository, sha) LEFT JOIN label2 b USING (repository, sha)
          WHERE coalesce(a.ref_rank, b.ref_rank) IS NOT NULL AND NOT EXISTS (SELECT 1 FROM run1 r WHERE r.repository = c.repository AND r.sha = c.sha)),
run2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY ref_rank, commit_ord, sha) AS rn,
                               count(*) OVER (PARTITION BY repository) AS offered FROM left_)),
taken AS (
  SELECT r.repository, r.sha, r.parent_1, r.parent_2, k.path AS branch_name, r.rn - 1 AS pos, 1 AS run
  FROM run1 r JOIN ranked1 k USING (repository, ref_rank)
  UNION ALL
  SELECT r.repository, r.sha, r.parent_1, r.parent_2, CASE WHEN old THEN a.path ELSE b.path END, coalesce(n, 0) + rn - 1, 2
  FROM run2 r LEFT JOIN ranked1 a USING (repository, ref_rank) LEFT JOIN ranked2 b USING (repository, ref_rank)
  LEFT JOIN n1 USING (repository) WHERE coalesce(n, 0) + rn <= 40),
total AS (SELECT repository, count(*) AS n FROM taken GROUP BY repository),
offers AS (SELECT repository, max(offered) + coalesce(max(n), 0) AS n FROM run2 LEFT JOIN n1 USING (repository) GROUP BY repository)
SELECT m.repository, m.sha AS merge_commit, m.branch_name, {NOTE}, CAST(m.pos AS BIGINT) AS pos, CAST(m.run AS BIGINT) AS run,
       coalesce(o.n, t.n) = t.n AS complete, t.n AS n_merges
FROM taken m JOIN total t ON t.repository = m.repository LEFT JOIN offers o ON o.repository = m.repository
LEFT JOIN oldest o1 ON o1.repository = m.repository AND o1.sha = m.parent_1
LEFT JOIN oldest o2 ON o2.repository = m.repository AND o2.sha = m.parent_2"""

SQL["merges_of_builds"] = _with(CTE_GRAPH, CTE_ALL_REFS) + """,
place AS (SELECT ['java', 'go', 'rust'][n_nationkey % 3 + 1] AS language, 'n' || n_nationkey AS repository,
                 row_number() OVER (PARTITION BY n_nationkey % 3 ORDER BY n_nationkey DESC) - 1 AS place FROM nation),
conf AS (SELECT * FROM (VALUES (0, 'java', 0, 5, 5), (1, 'java', 5, 20, 12), (2, 'go', 0, 4, 8), (3, 'rust', 2, 6, 3)) v(build, language, a, b, cap)),
chosen AS (SELECT build, language, repository, cap FROM place JOIN conf USING (language) WHERE place >= a AND place < b),
label2 AS (SELECT repository, sha, min(ref_rank) AS ref_rank FROM reach2 GROUP BY ALL),
m AS (SELECT h.build, h.language, h.cap, c.repository, c.sha, l.ref_rank,
             row_number() OVER (PARTITION BY h.build, c.repository ORDER BY l.ref_rank, c.commit_ord, c.sha) AS rn
      FROM chosen h JOIN cand c ON c.repository = h.repository JOIN label2 l ON l.repository = c.repository AND l.sha = c.sha)
SELECT CAST(m.build AS BIGINT) AS build, m.repository, m.sha AS merge_commit, k.path AS branch_name, m.language,
       row_number() OVER (PARTITION BY m.build ORDER BY m.repository, m.sha) - 1 AS merge_idx
FROM m JOIN ranked2 k ON k.repository = m.repository AND k.ref_rank = m.ref_rank WHERE m.rn <= m.cap"""

# --- incremental, index, duplicates, files ----------------------------------------------------

SQL["merge_incremental"] = """
WITH m AS (SELECT o_orderpriority AS repository, 'o' || o_orderkey AS merge_commit, o_orderkey, o_orderdate,
                  o_orderstatus FROM orders),
ex AS (SELECT repository, merge_commit,
              row_number() OVER (PARTITION BY repository ORDER BY o_orderkey, merge_commit) - 1 AS pos
       FROM m WHERE o_orderstatus = 'P'),
nex AS (SELECT repository, count(*) AS c FROM ex GROUP BY repository),
nw AS (SELECT m.repository, m.merge_commit,
              row_number() OVER (PARTITION BY m.repository ORDER BY m.o_orderdate DESC, m.o_orderkey DESC,
                                 m.merge_commit) AS rn
       FROM m WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.repository = m.repository
                                AND ex.merge_commit = m.merge_commit))
SELECT repository, merge_commit, 'existing' AS source, CAST(pos AS BIGINT) AS pos FROM ex WHERE pos < 100
UNION ALL
SELECT nw.repository, nw.merge_commit, 'new' AS source, CAST(coalesce(nex.c, 0) + nw.rn - 1 AS BIGINT) AS pos
FROM nw LEFT JOIN nex ON nex.repository = nw.repository
WHERE coalesce(nex.c, 0) + nw.rn - 1 < 100"""

SQL["merge_dense_index"] = """
SELECT row_number() OVER (ORDER BY o_orderpriority, 'o' || o_orderkey) - 1 AS merge_idx,
       o_orderpriority AS repository, 'o' || o_orderkey AS merge_commit
FROM orders"""

SQL["duplicate_keys"] = """
SELECT l_returnflag || l_linestatus AS repository, 'p' || l_partkey AS merge_commit, count(*) AS n
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"""

SQL["conflict_file_select"] = """
WITH st AS (
  SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
         CASE WHEN starts_with(url, 'https') THEN 'UU' ELSE 'AA' END AS xy,
         regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)
           || CASE regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) WHEN 'en' THEN '.java'
                   WHEN 'fr' THEN '.py' ELSE '.ts' END AS path
  FROM pages),
mg AS (SELECT host AS repository, row_number() OVER (ORDER BY host) - 1 AS merge_idx
       FROM (SELECT DISTINCT host FROM st) h),
f AS (SELECT mg.merge_idx, mg.repository, st.path FROM st JOIN mg ON mg.repository = st.host
      WHERE st.xy = 'UU' AND ends_with(st.path, '.java')),
k AS (SELECT *, row_number() OVER (PARTITION BY merge_idx ORDER BY string_split(path, '/'), path) - 1 AS file_no
      FROM f)
SELECT merge_idx, repository, CAST(file_no AS BIGINT) AS file_no, merge_idx || '-' || file_no AS conflict_id
FROM k"""

# --- conversations, caches, code text -----------------------------------------------------------

CTE_TURNS = """
u AS (SELECT conv_id, turn, text AS q FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, text AS a FROM conversations WHERE role = 'assistant'),
t AS (SELECT u.conv_id, u.turn, u.q, a.a FROM u LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn)"""

_QJ = _lit(QUERY_PROMPT + "```java") + f" || {NL} || q || {NL} || '```'"

SQL["conversation_format"] = "WITH " + CTE_TURNS + f"""
SELECT conv_id, turn, md5({_QJ}) AS question_md5, a AS answer, 'user' AS prompt_role,
       CAST(length({_QJ}) AS BIGINT) AS prompt_len
FROM t WHERE a IS NOT NULL"""

SQL["response_cache"] = "WITH " + CTE_TURNS + """,
cache AS (SELECT md5(q) AS cache_key, a AS result, conv_id, turn FROM t WHERE a IS NOT NULL),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY conv_id DESC, turn DESC) AS rn
                          FROM cache) c WHERE rn = 1)
SELECT t.conv_id, t.turn, md5(t.q) AS cache_key, l.result IS NOT NULL AS hit, l.result
FROM t LEFT JOIN latest l ON l.cache_key = md5(t.q)"""

_WS = "[" + r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}" + "]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {_lit('^' + _WS + '+|' + _WS + '+' + chr(92) + 'z')}, '', 'g')"


SQL["code_normalise"] = f"""
WITH p AS (
  SELECT page_id,
    {_strip(f"regexp_replace(regexp_replace(regexp_replace(html, {_lit('(?s)/[*].*?[*]/')}, '', 'g'), '//.*', '', 'g'), {_lit(_WS + '+')}, ' ', 'g')")} AS c
  FROM pages)
SELECT page_id, md5(c) AS norm_md5, CAST(length(c) AS BIGINT) AS norm_len FROM p"""

_FENCE = "(?s)```java\n(.*?)\n```"

SQL["code_block"] = f"""
WITH d AS (SELECT doc_id, 'Answer:' || {NL} || '```' || CASE WHEN lang = 'en' THEN 'java' ELSE lang END || {NL}
                          || text || {NL} || '```' || {NL} || 'done' AS w FROM documents),
c AS (SELECT doc_id, CASE WHEN regexp_matches(w, {_lit(_FENCE)})
                          THEN {_strip(f"regexp_extract(w, {_lit(_FENCE)}, 1)")} END AS c FROM d)
SELECT doc_id, md5(c) AS code_md5, CAST(length(c) AS BIGINT) AS code_len FROM c"""

SQL["dedupe_exact"] = """
SELECT min(CAST(doc_id AS VARCHAR)) AS conflict_id FROM documents GROUP BY md5(text), md5(lang)"""

SQL["language_rollup"] = """
SELECT CASE WHEN grouping(lang) = 1 THEN 'TOTAL' ELSE lang END AS language,
       CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars
FROM documents GROUP BY ROLLUP (lang)"""

SQL["api_pages_project"] = """
WITH it AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) <= 1000)
SELECT 'user' || user_id || '/' || event_type AS repository,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS stars, event_type AS language,
       strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created_at, 'main' AS default_branch,
       CAST(0.0 AS DOUBLE) AS license, CAST(1.0 AS DOUBLE) AS architecture,
       event_type = 'error' AS archived, value < 2.0 AS disabled
FROM it WHERE NOT (event_type = 'error') AND NOT (value < 2.0)"""

SQL["api_search"] = """
WITH it AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) <= 1000)
SELECT 'user' || user_id || '/' || event_type AS repository, CAST(json_extract_string(props, '$.k') AS BIGINT) AS stars, event_type AS language,
       strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created_at, event_type = 'error' AS archived, value < 2.0 AS disabled
FROM it WHERE event_type = 'click' AND CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50"""

_RES = (CTE_FILES, CTE_BLOCKS, CTE_CONTEXT, CTE_RESOLVE)

SQL["status_counts"] = _with(*_RES) + " SELECT status, count(*) AS n FROM res GROUP BY status"

SQL["metric_rejects"] = """
SELECT CAST(doc_id AS VARCHAR) AS conflict_id, 'no_start_marker' AS reject_reason FROM documents"""

SQL["fail_percentages"] = _with(*_RES, CTE_METRICS) + """
SELECT count(*) AS n, round(100 * avg(CAST(fail_max_lines AS DOUBLE)), 6) AS pct_fail_max_lines,
       round(100 * avg(CAST(fail_token_count AS DOUBLE)), 6) AS pct_fail_token_count,
       round(100 * avg(CAST(fail_incoherent AS DOUBLE)), 6) AS pct_fail_incoherent FROM metrics HAVING count(*) > 0"""

SQL["summary_totals"] = "WITH s AS (" + SQL["repo_summary"] + """)
SELECT count(*) AS total_repositories, count(*) FILTER (WHERE selected_conflicts > 0) AS contributing_repositories,
       CAST(coalesce(sum(selected_conflicts), 0) AS BIGINT) AS total_selected FROM s"""

SQL["per_repository_counts"] = _with(*_RES, CTE_METRICS) + """
SELECT d.source AS repository, count(*) AS conflicts
FROM metrics m LEFT JOIN documents d ON CAST(d.doc_id AS VARCHAR) = split_part(m.conflict_id, '-', 1) GROUP BY 1"""

SQL["first_merge_ids"] = _with(*_RES, CTE_METRICS) + """
SELECT DISTINCT split_part(conflict_id, '-', 1) AS merge_id FROM metrics ORDER BY 1 LIMIT 10"""

SQL["select_pairs_join"] = _with(*_RES, CTE_METRICS) + """
SELECT r.conflict_id, md5(r.conflict) AS conflict_md5, md5(r.resolved) AS resolved_md5 FROM res r
JOIN metrics m ON m.conflict_id = r.conflict_id WHERE m.selected AND NOT m.resolution_in_left_or_right"""

SQL["dedupe_split_sizes"] = """
WITH d AS (SELECT count(DISTINCT (md5(text), md5(lang))) AS n FROM documents),
t AS (SELECT n, CAST(ceil(CAST(0.2 AS DOUBLE) * n) AS BIGINT) AS k FROM d)
SELECT * FROM (SELECT 'test' AS split, k AS n_rows FROM t UNION ALL SELECT 'train', n - k FROM t) WHERE n_rows > 0"""

SQL["file_pairs"] = """
WITH st AS (
  SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, CASE WHEN starts_with(url, 'https') THEN 'UU' ELSE 'AA' END AS xy,
         regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) || CASE regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1)
           WHEN 'en' THEN '.java' WHEN 'fr' THEN '.py' ELSE '.ts' END AS path FROM pages),
mg AS (SELECT host AS repository, row_number() OVER (ORDER BY host) - 1 AS merge_idx FROM (SELECT DISTINCT host FROM st) h),
k AS (SELECT merge_idx, repository, path, row_number() OVER (PARTITION BY merge_idx ORDER BY string_split(path, '/'), path) - 1 AS file_no
      FROM (SELECT DISTINCT host, path FROM st WHERE xy = 'UU' AND ends_with(path, '.java')) s JOIN mg ON mg.repository = s.host),
w AS (SELECT host, path, max(page_id) AS t FROM st WHERE NOT contains(url, '?') GROUP BY ALL),
f AS (SELECT host, path, max(page_id) AS t FROM st WHERE NOT contains(url, '#') GROUP BY ALL)
SELECT merge_idx, repository, string_agg(merge_idx || '-' || file_no, ';' ORDER BY file_no) AS conflicts, count(f.t) AS n_merged, CAST(sum(w.t) AS BIGINT) AS text_sum
FROM k JOIN w ON w.host = k.repository AND w.path = k.path LEFT JOIN f ON f.host = k.repository AND f.path = k.path GROUP BY merge_idx, repository"""

SQL["stored_refs"] = _with(CTE_GRAPH) + """
SELECT repository, path, head_sha, CAST(ref_ord + 100 AS BIGINT) AS ref_ord, md5(path) AS ref_key, replace(repository || '/' || path, '/', '_') AS slug
FROM refs WHERE ref_ord >= 0 AND path <> 'refs/heads/maintenance'"""

SQL["merge_existing_cap"] = _with(CTE_GRAPH) + """,
known AS (SELECT repository, sha FROM cand WHERE ends_with(sha, '3')),
kn AS (SELECT repository, count(*) AS n FROM known GROUP BY repository),
fresh AS (SELECT c.repository, c.sha, row_number() OVER (PARTITION BY c.repository ORDER BY f.ref_rank, c.commit_ord, c.sha) AS rn
          FROM cand c JOIN firstref f ON f.repository = c.repository AND f.sha = c.sha
          WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.repository = c.repository AND k.sha = c.sha))
SELECT f.repository, f.sha AS merge_commit FROM fresh f LEFT JOIN kn ON kn.repository = f.repository WHERE rn <= 15 - coalesce(n, 0)"""

SQL["response_misses"] = "WITH " + CTE_TURNS + """
SELECT conv_id, turn, md5(q) AS cache_key FROM t WHERE md5(q) NOT IN (SELECT md5(q) FROM t WHERE a IS NOT NULL)"""

SQL["response_store"] = "WITH " + CTE_TURNS + """,
best AS (SELECT q, a, turn, row_number() OVER (PARTITION BY q ORDER BY turn DESC, a DESC) AS rn FROM t WHERE a IS NOT NULL)
SELECT 'm1' AS model, md5(q) AS cache_key, md5(a) AS result_md5, CAST(turn AS BIGINT) AS turn FROM best WHERE rn = 1"""

SQL["top_by_stars"] = """
SELECT c_name AS repository, c_acctbal AS stars FROM customer ORDER BY stars DESC, repository LIMIT 10"""

SQL["language_totals"] = """
WITH p AS (SELECT lang AS language, count(DISTINCT source) AS repositories, count(*) AS selected FROM documents GROUP BY lang),
r AS (SELECT *, CASE WHEN language <> 'fr' THEN selected - 1 END AS train FROM p)
SELECT language, repositories, selected, train FROM r
UNION ALL SELECT 'ALL', CAST(sum(repositories) AS BIGINT), CAST(sum(selected) AS BIGINT), CAST(sum(train) AS BIGINT) FROM r"""
