"""Conflict-text operators (X1-X11): conflicted file pairs -> conflict blocks.

Input (T7): one row per conflicted file with key columns, ``conflict_text``
(the file with conflict markers) and ``merged_text`` (the file as the human
merged it, nullable).  Output (T9): one row per conflict block with the
conflict snippet, the recovered resolution and a ``status``.

The whole stage is row-local: a file and its merged version travel in one row,
lines are arrays inside that row, and all per-block work (contexts, matching,
resolution) is a ``transform`` over the file's array of blocks; only the small
per-block results are exploded, so a file with many conflicts is not copied
once per block.  There is no exchange, so the stage scales with the number of
files and splits like a scan.  All logic is built-in array / higher-order SQL
functions.

Between the heavy steps the rows pass through ``_barrier`` (an ``inline`` of a
one-element array).  The Generate node stops Catalyst from collapsing the
projections into each other and from pushing later filters below them, which
would otherwise copy the matching expressions many times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conflictlake.functions.text import split_lines_keepends
from conflictlake.operators import barrier

# --- fixed values: conflict markers (line prefixes) --------------------------
MARK_OPEN = "<<<<<<<"
MARK_SEP = "======="
MARK_CLOSE = ">>>>>>>"
MARK_BASE = "|||||||"
# Lines of marker-free context used to find a block in the merged file, and
# lines of context kept around a block in the snippet.
MATCH_CONTEXT = 20
SNIPPET_CONTEXT = 5
# -----------------------------------------------------------------------------

STATUSES = ("ok", "no_merged_file", "before_not_found", "after_not_found",
            "ambiguous", "no_valid_after", "no_valid_before")


_barrier = barrier


def _positions(arr: str, *prefixes: str) -> str:
    cond = " OR ".join(f"startswith(x, '{p}')" for p in prefixes)
    return f"array_compact(transform({arr}, (x, i) -> IF({cond}, i, NULL)))"


def marker_columns(lines: str = "cl") -> dict:
    """Positions of the marker lines, as expressions to materialise once per
    file (behind a barrier) before the per-block steps use them."""
    return {
        "marks": _positions(lines, MARK_OPEN, MARK_SEP, MARK_CLOSE),
    }


def block_spans_expr(lines: str = "cl", marks: str = "marks") -> str:
    """X3 as a SQL expression over the marker positions: array<struct<s:int,e:int,ms:int,me:int>>
    of (start, end) line indices, markers included, and their places among the markers.

    A block opens at a ``<<<<<<<`` line, takes the first ``=======`` after it
    and the first ``>>>>>>>`` after that; scanning resumes after the block, so
    an opening marker inside a block is ignored.  An unfinished block ends the
    scan and keeps the blocks found before it.  One fold over the markers in
    file order: looking for an opening, a separator, an end.
    """
    kinds = f"transform({marks}, (j, k) -> named_struct('i', j, 'k', substring({lines}[j], 1, 1), 'm', k))"
    state = "named_struct('want', '{want}', 's', {s}, 'ms', {ms}, 'b', {b})"
    block = "concat(acc.b, array(named_struct('s', acc.s, 'e', c.i, 'ms', acc.ms, 'me', c.m)))"
    return (
        f"aggregate({kinds}, {state.format(want='<', s=0, ms=0, b='CAST(array() AS array<struct<s:int,e:int,ms:int,me:int>>)')}, "
        "(acc, c) -> CASE WHEN c.k <> acc.want THEN acc "
        f"WHEN c.k = '<' THEN {state.format(want='=', s='c.i', ms='c.m', b='acc.b')} "
        f"WHEN c.k = '=' THEN {state.format(want='>', s='acc.s', ms='acc.ms', b='acc.b')} "
        f"ELSE {state.format(want='<', s='acc.s', ms='acc.ms', b=block)} END, "
        "acc -> acc.b)"
    )


def split_files(files: DataFrame, conflict_col: str = "conflict_text",
                merged_col: str = "merged_text") -> DataFrame:
    """X1 + X3 + K6: one row per block span (select the columns you need;
    the line arrays ``cl``/``ml`` are pruned when unused)."""
    keep = [c for c in files.columns if c not in (conflict_col, merged_col)]
    df = _barrier(files.select(
        *keep,
        split_lines_keepends(F.col(conflict_col)).alias("cl"),
        split_lines_keepends(F.col(merged_col)).alias("ml"),
    ))
    df = _barrier(df.select(*keep, "cl", "ml", *[F.expr(v).alias(k) for k, v in marker_columns("cl").items()]))
    df = df.select(*keep, "cl", "ml", F.expr(block_spans_expr()).alias("spans"))
    df = df.select(*keep, "cl", "ml", F.posexplode("spans").alias("pos", "span"))
    return df.select(
        *keep, "cl", "ml",
        (F.col("pos") + 1).alias("block_no"),
        F.col("span.s").alias("start_line"),
        F.col("span.e").alias("end_line"),
    )


def _extend(arr: str, keep: list, new: dict) -> str:
    """``transform`` an array of block structs, keeping ``keep`` fields and
    adding ``new`` ones (SQL expressions over ``b``, the block)."""
    parts = [f"'{f}', b.{f}" for f in keep] + [f"'{k}', {v}" for k, v in new.items()]
    return f"transform({arr}, b -> named_struct({', '.join(parts)}))"


def _file_rows(files: DataFrame, conflict_col: str, merged_col: str, context: int,
               match_context: int) -> tuple:
    """X1 + X3 + X4 + X5 inside each file row: ``blk`` is an array with one
    struct per block (number, span, both contexts, the snippet).  The line
    arrays stay once per file instead of being copied into every block row."""
    keep = [c for c in files.columns if c not in (conflict_col, merged_col)]
    df = _barrier(files.select(
        *keep,
        split_lines_keepends(F.col(conflict_col)).alias("cl"),
        split_lines_keepends(F.col(merged_col)).alias("ml"),
    ))
    df = _barrier(df.select(
        *keep, "cl", "ml", F.expr("size(cl)").alias("n"), F.expr("size(ml)").alias("nm"),
        F.expr(_codes("cl")).alias("codes"), F.expr(f"array_join({_codes('ml')}, '')").alias("mcode"),
        *[F.expr(v).alias(k) for k, v in marker_columns("cl").items()]))
    df = _barrier(df.select(*keep, "cl", "ml", "n", "nm", "codes", "mcode", F.reverse("mcode").alias("rcode"), "marks", F.expr(block_spans_expr()).alias("spans")))
    spans = (
        "transform(spans, (x, i) -> named_struct('block_no', i + 1, 's', x.s, 'e', x.e, "
        f"'b0', greatest(x.s - {match_context}, coalesce(get(marks, x.ms - 1) + 1, 0)), "
        f"'a1', least(x.e + 1 + {match_context}, coalesce(get(marks, x.me + 1), n)), "
        f"'c0', greatest(x.s - {context}, 0), 'c1', least(n, x.e + 1 + {context})))")
    df = _barrier(df.select(*keep, "cl", "ml", "nm", "codes", "mcode", "rcode", F.expr(spans).alias("blk")))
    ctx = _extend("blk", ["block_no", "s", "e"], {
        "before": "slice(cl, b.b0 + 1, b.s - b.b0)",
        "after": "slice(cl, b.e + 2, b.a1 - b.e - 1)",
        "before5": "slice(cl, b.c0 + 1, b.s - b.c0)",
        "after5": "slice(cl, b.e + 2, b.c1 - b.e - 1)",
        "conflict": "array_join(slice(cl, b.c0 + 1, b.c1 - b.c0), '')",
        "code_b": "array_join(slice(codes, b.b0 + 1, b.s - b.b0), '')",
        "code_a": "array_join(slice(codes, b.e + 2, b.a1 - b.e - 1), '')",
    })
    # the merged text joined once per file (for the containment check)
    return _barrier(df.select(*keep, "ml", "nm", "mcode", "rcode", F.expr("array_join(ml, '')").alias("mtext"),
                              F.expr(ctx).alias("blk"))), keep


CTX_FIELDS = ["block_no", "s", "e", "before", "after", "before5", "after5", "conflict"]


def block_contexts(files: DataFrame, conflict_col: str = "conflict_text", merged_col: str = "merged_text",
                   context: int = SNIPPET_CONTEXT, match_context: int = MATCH_CONTEXT) -> DataFrame:
    """X4 + X5 per block: one row per block with the matching contexts, the
    snippet contexts and the snippet."""
    df, keep = _file_rows(files, conflict_col, merged_col, context, match_context)
    return (df.select(*keep, F.inline("blk")).drop("code_b", "code_a")
            .withColumnRenamed("s", "start_line").withColumnRenamed("e", "end_line"))


WIDTH = 17  # characters of a line's code


def _codes(lines: str) -> str:
    """The lines as codes of WIDTH characters: a bar and 64 bits of hash.  A code begins
    with the only bar in it, so text found in joined codes always begins at a line."""
    return f"transform({lines}, x -> concat('|', lpad(hex(xxhash64(x)), 16, '0')))"


def _line(at: str) -> str:
    """The line of a place in the joined codes (1-based; 0 is none)."""
    return f"IF({at} = 0, NULL, CAST(({at} - 1) / {WIDTH} AS int))"


def extract_blocks(files: DataFrame, *, id_cols=("merge_idx", "file_no"),
                   conflict_col: str = "conflict_text", merged_col: str = "merged_text",
                   context: int = SNIPPET_CONTEXT,
                   match_context: int = MATCH_CONTEXT,
                   strip_final_newline: bool = False) -> DataFrame:
    """X11: conflicted files (T7) -> conflict blocks (T9), one row per block.

    X6-X10 run inside each file row over the array of its blocks, and only the
    small per-block results are exploded.  Status table (b/a = contexts, B/A =
    their match positions): no B -> before_not_found; no A -> after_not_found;
    both >1 -> ambiguous; one B -> nearest A at or after B0+len(b), else
    no_valid_after; else one A -> nearest B ending at or before A0, else
    no_valid_before.  ``conflict_id`` is ``<id_cols...>-<block_no>``.  Blocks
    that cannot be resolved are kept with their ``status``.

    ``strip_final_newline=True`` drops one trailing newline of the merged
    text first, as the merged files of the original pipeline were written
    (its git client strips it); a context that reaches the end of the file
    then no longer matches.
    """
    if strip_final_newline:
        files = files.withColumn(merged_col, F.regexp_replace(F.col(merged_col), r"\n\z", ""))
    df, keep = _file_rows(files, conflict_col, merged_col, context, match_context)
    f1 = ["block_no", "s", "e", "before", "after", "before5", "after5", "conflict", "code_b", "code_a"]
    # A context is looked for as text in the joined codes, one scan that ends at the first
    # match.  Nobody needs all its places (of equal lines there is one per line and block), only
    # whether there is a second one, and the nearest to the other context's only place.
    df = _barrier(df.select(*keep, "ml", "nm", "mtext", "mcode", "rcode", F.expr(_extend("blk", f1, {
        "nb": "size(b.before)", "na": "size(b.after)", "hit_b": "locate(b.code_b, mcode)", "hit_a": "locate(b.code_a, mcode)",
    })).alias("blk")))
    # an empty context is found at every line
    count = "IF(b.n{c} = 0, nm, CASE WHEN b.hit_{c} = 0 THEN 0 WHEN locate(b.code_{c}, mcode, b.hit_{c} + 1) = 0 THEN 1 ELSE 2 END)"
    f2 = f1 + ["nb", "na"]
    df = _barrier(df.select(*keep, "ml", "nm", "mtext", "mcode", "rcode", F.expr(_extend("blk", f2, {
        "cnt_b": count.format(c="b"), "cnt_a": count.format(c="a"),
        "first_b": f"IF(b.nb = 0, 0, {_line('b.hit_b')})", "first_a": f"IF(b.na = 0, 0, {_line('b.hit_a')})",
    })).alias("blk")))
    f3 = f2 + ["cnt_b", "cnt_a", "first_b", "first_a"]
    # nearest after-context at or after x; nearest before-context start at or before y, a search in the reversed codes
    x, y = "(b.first_b + b.nb)", "(b.first_a - b.nb)"
    df = _barrier(df.select(*keep, "ml", "nm", "mtext", F.expr(_extend("blk", f3, {
        "next_a": f"IF(b.cnt_b = 1 AND b.na > 0, locate(b.code_a, mcode, {WIDTH} * {x} + 1), 0)",
        "last_b": f"IF(b.cnt_b <> 1 AND b.cnt_a = 1 AND b.nb > 0 AND {y} >= 0, locate(reverse(b.code_b), rcode, greatest({WIDTH} * (nm - b.first_a), 0) + 1), 0)",
    })).alias("blk")))
    a_ge = f"IF(b.na = 0, IF({x} <= nm - 1, {x}, NULL), {_line('b.next_a')})"
    b_le = f"IF(b.nb = 0, IF({y} >= 0 AND nm > 0, least({y}, nm - 1), NULL), nm - b.nb - {_line('b.last_b')})"
    df = _barrier(df.select(*keep, "ml", "nm", "mtext", F.expr(_extend("blk", f3 + ["next_a", "last_b"], {
        "i1": f"CASE WHEN b.cnt_b = 1 THEN b.first_b WHEN b.cnt_a = 1 THEN {b_le} END",
        "i2": f"CASE WHEN b.cnt_b = 1 THEN {a_ge} WHEN b.cnt_a = 1 THEN b.first_a END",
    })).alias("blk")))
    f4 = f3 + ["i1", "i2"]
    status = ("CASE WHEN ml IS NULL THEN 'no_merged_file' "
              "WHEN b.cnt_b = 0 THEN 'before_not_found' WHEN b.cnt_a = 0 THEN 'after_not_found' "
              "WHEN b.cnt_b > 1 AND b.cnt_a > 1 THEN 'ambiguous' "
              "WHEN b.cnt_b = 1 THEN IF(b.i2 IS NULL, 'no_valid_after', 'ok') "
              "ELSE IF(b.i1 IS NULL, 'no_valid_before', 'ok') END")
    df = df.select(*keep, "ml", "mtext", F.expr(_extend("blk", f4, {"status": status})).alias("blk"))
    f5 = f4 + ["status"]
    df = (df.select(*keep, "ml", "mtext", F.expr(_extend("blk", f5, {
        "res": "CASE WHEN b.status = 'ok' THEN slice(ml, b.i1 + b.nb + 1, b.i2 - b.i1 - b.nb) END",
    })).alias("blk")))
    cb = "least(size(b.before5), b.nb)"
    ca = "least(size(b.after5), b.na)"
    out = _extend("blk", ["block_no", "s", "e", "status", "conflict"], {
        "resolution": "array_join(b.res, '')",
        "resolved": "CASE WHEN b.status = 'ok' THEN concat(array_join(b.before5, ''), "
                    "array_join(b.res, ''), array_join(b.after5, '')) END",
        "empty_context": "b.nb = 0 OR b.na = 0",
        "coherent": (f"CASE WHEN b.status = 'ok' THEN ({cb} = 0 OR slice(b.before5, size(b.before5) - {cb} + 1, {cb})"
                     f" = slice(ml, b.i1 + b.nb - {cb} + 1, {cb})) AND ({ca} = 0 OR slice(b.after5, 1, {ca})"
                     f" = slice(ml, b.i2 + 1, {ca})) END"),
        "contained": "CASE WHEN b.status = 'ok' THEN contains(mtext, array_join(b.res, '')) END",
    })
    rows = df.select(*keep, F.inline(F.expr(out)))
    rows = rows.withColumnRenamed("s", "start_line").withColumnRenamed("e", "end_line")
    cid = F.concat_ws("-", *[F.col(c).cast("string") for c in id_cols], F.col("block_no").cast("string"))
    return rows.select(cid.alias("conflict_id"), *keep, "block_no", "start_line", "end_line", "status",
                       "conflict", "resolution", "resolved", "empty_context", "coherent", "contained")


def resolved_pairs(blocks: DataFrame) -> DataFrame:
    """The (conflict, resolved) pairs the extraction step writes out."""
    return blocks.where(F.col("status") == "ok")


def status_counts(blocks: DataFrame) -> DataFrame:
    """F11 report: blocks per status (a partial aggregate)."""
    return blocks.groupBy("status").agg(F.count(F.lit(1)).alias("blocks"))
