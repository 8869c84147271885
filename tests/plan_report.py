"""Write PLANS.md: the physical-plan shape of every registered query.

Counts operators in the executed plan (AQE initial plan) at one scale factor.
Usage: python tests/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

OPS = [("Exchange hashpartitioning", r"Exchange hashpartitioning"),
       ("Exchange rangepartitioning", r"Exchange rangepartitioning"),
       ("Exchange RoundRobin", r"Exchange RoundRobinPartitioning"),
       ("Exchange single", r"Exchange SinglePartition"),
       ("BroadcastExchange", r"BroadcastExchange"),
       ("SortMergeJoin", r"SortMergeJoin"),
       ("BroadcastHashJoin", r"BroadcastHashJoin"),
       ("HashAggregate", r"HashAggregate|ObjectHashAggregate|SortAggregate"),
       ("WindowGroupLimit", r"WindowGroupLimit"),
       ("Window", r"\bWindow\b"),
       ("Generate", r"\bGenerate\b"),
       ("TakeOrderedAndProject", r"TakeOrderedAndProject"),
       ("Python eval", r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas"),
       ("checkpoint scans", r"Scan ExistingRDD|LogicalRDD|ExistingRDD")]


def main() -> None:
    from conflictlake.session import get_spark
    import __spark_entry__ as E
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    print("# PLANS\n")
    print(f"Physical-plan shape of each registered query (`tests/plan_report.py`, {sf}, local[8]).")
    print("Counts are operator occurrences in the executed plan before adaptive re-planning;")
    print("`checkpoint scans` are reads of checkpointed data (dense index, graph rounds), so")
    print("the plan shown is the last stage after the iterative parts ran.  ReadSchema shows")
    print("the columns read from each table.\n")
    print("| query | " + " | ".join(o for o, _ in OPS) + " | ReadSchema |")
    print("| --- | " + " | ".join("---" for _ in OPS) + " | --- |")
    for name, fn in E.queries().items():
        df = fn(spark, sf)
        qe = df._jdf.queryExecution()
        plan = qe.executedPlan().toString()
        full = qe.toString()
        counts = [str(len(re.findall(p, plan))) for _, p in OPS]
        schemas = sorted(set(m.group(1) for m in re.finditer(r"ReadSchema: (struct<[^>]*>)", full)))
        print(f"| {name} | " + " | ".join(c if c != "0" else "" for c in counts) + " | "
              + "<br>".join(s.replace("|", "\\|") for s in schemas) + " |")


if __name__ == "__main__":
    main()
