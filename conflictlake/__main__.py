"""Command line for the table jobs.

    python -m conflictlake select   --dump CSV --out CATALOGUE [--slice OUT --start 0 --end 1000]
    python -m conflictlake history  --refs R --commits C --out MERGES [--existing M] [--stored-refs R] [--max-num-merges 100]
    python -m conflictlake files    --merges M --status S --worktree W --final F --out FILES --index INDEX
    python -m conflictlake extract  --files FILES --out BLOCKS
    python -m conflictlake metrics  --blocks BLOCKS --out METRICS --selected SEL --summary SUM [--index INDEX]
    python -m conflictlake dataset  --selected SEL --out DATASET [--test-size 0.2] [--seed 42]
    python -m conflictlake build    --files FILES --work DIR [--index INDEX] [--extract] [--metrics] [--dataset]

All paths are Parquet tables (folders); ``build`` runs the chosen stages in
order under DIR (``blocks``, ``metrics``, ``selected``, ``summary``,
``dataset``), all stages when none is chosen.  The Spark master and resources
come from spark-submit.
"""

from __future__ import annotations

import argparse
import os

from conflictlake.operators import conflicts as X
from conflictlake.operators import metrics as M
from conflictlake.plans import jobs
from conflictlake.session import get_spark


def _opts(a) -> jobs.BuildOptions:
    return jobs.BuildOptions(language=a.language, test_size=a.test_size, seed=a.seed,
                             max_line_count=a.max_line_count, drop_trivial=a.drop_trivial,
                             max_prompt_length=a.max_prompt_length, context=a.context, prompt=a.prompt,
                             strip_final_newline=a.strip_final_newline,
                             dedupe=a.dedupe, max_num_merges=a.max_num_merges, max_branches=a.max_branches)


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="conflictlake")
    p.add_argument("--language", default="java")
    p.add_argument("--test-size", type=float, default=0.2)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--max-line-count", type=int, default=20)
    p.add_argument("--max-prompt-length", type=int, default=M.MAX_PROMPT_LENGTH)
    p.add_argument("--context", type=int, default=X.SNIPPET_CONTEXT)
    p.add_argument("--prompt", default=M.QUERY_PROMPT)
    p.add_argument("--strip-final-newline", action="store_true")
    p.add_argument("--max-num-merges", type=int, default=100)
    p.add_argument("--max-branches", type=int, default=jobs.DEFAULT_MAX_BRANCHES)
    p.add_argument("--drop-trivial", action="store_true")
    p.add_argument("--dedupe", action="store_true")
    sub = p.add_subparsers(dest="cmd", required=True)
    h = sub.add_parser("history")
    h.add_argument("--refs", required=True)
    h.add_argument("--commits", required=True)
    h.add_argument("--out", required=True)
    h.add_argument("--existing")
    h.add_argument("--stored-refs")
    c = sub.add_parser("select")
    c.add_argument("--dump", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--slice")
    c.add_argument("--start", type=int, default=0)
    c.add_argument("--end", type=int, default=1000)
    f = sub.add_parser("files")
    for k in ("merges", "status", "worktree", "final", "out", "index"):
        f.add_argument(f"--{k}", required=True)
    e = sub.add_parser("extract")
    e.add_argument("--files", required=True)
    e.add_argument("--out", required=True)
    m = sub.add_parser("metrics")
    for k in ("blocks", "out", "selected", "summary"):
        m.add_argument(f"--{k}", required=True)
    m.add_argument("--index")
    d = sub.add_parser("dataset")
    d.add_argument("--selected", required=True)
    d.add_argument("--out", required=True)
    b = sub.add_parser("build")
    b.add_argument("--files", required=True)
    b.add_argument("--work", required=True)
    b.add_argument("--index")
    for k in ("extract", "metrics", "dataset"):
        b.add_argument(f"--{k}", action="store_true")
    t = sub.add_parser("all")
    for k in ("catalogue", "refs", "commits", "status", "worktree", "final", "out"):
        t.add_argument(f"--{k}", required=True)
    a = p.parse_args(argv)
    spark = get_spark()
    o = _opts(a)
    if a.cmd == "select":
        jobs.selection_job(spark, a.dump, a.out, a.slice, a.language.capitalize(), a.start, a.end)
    elif a.cmd == "history":
        jobs.history_job(spark, a.refs, a.commits, a.out, a.existing, o, a.stored_refs)
    elif a.cmd == "all":
        from conflictlake.plans import all_languages as A
        tables = {k: getattr(a, k) for k in ("catalogue", "refs", "commits", "status", "worktree", "final")}
        A.build_all(spark, A.config_table(spark), tables, a.out)
    elif a.cmd == "files":
        jobs.files_job(spark, a.merges, a.status, a.worktree, a.final, a.out, a.index, o)
    elif a.cmd == "extract":
        jobs.extract_job(spark, a.files, a.out, o)
    elif a.cmd == "metrics":
        jobs.metrics_job(spark, a.blocks, a.out, a.selected, a.summary, a.index, o)
    elif a.cmd == "dataset":
        jobs.build_job(spark, a.selected, a.out, o)
    else:
        run_all = not (a.extract or a.metrics or a.dataset)
        w = lambda n: os.path.join(a.work, n)
        if run_all or a.extract:
            jobs.extract_job(spark, a.files, w("blocks"), o)
        if run_all or a.metrics:
            jobs.metrics_job(spark, w("blocks"), w("metrics"), w("selected"), w("summary"), a.index, o)
        if run_all or a.dataset:
            jobs.build_job(spark, w("selected"), w("dataset"), o)


if __name__ == "__main__":
    main()
