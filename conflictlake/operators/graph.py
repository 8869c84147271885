"""Fixed points of values that flow along edges, a round at a time.

Each round takes only the values that changed, aggregates the candidates per node
(a partial aggregate, so a hub is combined map-side) and writes only what changed
again.  Every round is stored in the shared folder; parts are merged every few
rounds and what they replace is deleted.  ``layers`` uses this for what is left of
a very wide graph.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conflictlake.operators.stored import Stored

MERGE_EVERY = 8  # parts of a fixed point that are read together before they are merged into one


def fixpoint(seeds: DataFrame, keys: list[str], step: Callable[[DataFrame], DataFrame], merge: Callable[[str], Column],
             gain: Callable[[Column, Column], tuple[Column, Column]]) -> DataFrame:
    """Values (keys, val) that no round of ``step`` improves any more.

    ``step`` turns the rows that changed into candidates (keys, val); ``merge``
    aggregates values of a key; ``gain(new, old)`` gives the value to keep of a
    candidate and whether it changes anything (``old`` is null for a new key).
    """
    parts = [Stored(seeds.groupBy(*keys).agg(merge("val").alias("val")), "values")]
    changed = parts[0]

    def every() -> DataFrame:
        return reduce(DataFrame.unionByName, [p.df for p in parts])

    while True:
        cand = step(changed.df).groupBy(*keys).agg(merge("val").alias("val"))
        old = every().withColumnRenamed("val", "_old")
        met = cand.join(old, keys, "left").groupBy(*keys, "val").agg(merge("_old").alias("_old"))
        value, better = gain(F.col("val"), F.col("_old"))
        fresh = Stored(met.where(better).select(*keys, value.alias("val")), "values")
        if fresh.df.isEmpty():
            fresh.delete()
            return every().groupBy(*keys).agg(merge("val").alias("val"))
        if len(parts) >= MERGE_EVERY:
            whole = Stored(every().groupBy(*keys).agg(merge("val").alias("val")), "values")
            for p in parts:
                p.delete()
            parts = [whole]
        parts.append(fresh)
        changed = fresh
