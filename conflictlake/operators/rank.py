"""K3: a dense 0-based index over a global order, computed in parallel.

``row_number()`` over an unpartitioned window would pull every row into one
task.  Instead the rows are range-partitioned and sorted on the key, each row
gets its position inside its partition, the per-partition counts (one row per
partition, so their size is bounded by the partition count) are turned into
running offsets, broadcast, and added.  The ranged data is checkpointed to the
shared checkpoint folder between the two passes: range sampling could choose
other bounds if the plan ran twice, and the checkpoint also cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conflictlake.session import ensure_checkpoint_dir


def dense_index(df: DataFrame, order_cols: list, index_col: str = "idx",
                num_partitions: int | None = None, total_col: str | None = None) -> DataFrame:
    """Add ``index_col`` = position of each row in ``order_cols`` order
    (ascending Column expressions allowed).  The order must be unique: append
    a tie-break column when it is not.  ``total_col`` also adds the row count
    of the whole table (taken from the same per-partition counts)."""
    ensure_checkpoint_dir(df.sparkSession)
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    # materialise the input once: range sampling and partitioning both read it
    df = df.checkpoint(eager=True)
    ranged = (df.repartitionByRange(num_partitions, *cols) if num_partitions
              else df.repartitionByRange(*cols))
    ranged = (ranged.sortWithinPartitions(*cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = ranged.checkpoint(eager=True)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"),
                                         F.min("_mid").alias("_m0"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", "_m0",
                            F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"),
                            F.sum("_cnt").over(Window.partitionBy()).alias("_tot"))
    out = ranged.join(F.broadcast(offsets), "_pid")
    out = out.withColumn(index_col, (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("long"))
    if total_col:
        out = out.withColumn(total_col, F.col("_tot").cast("long"))
    return out.drop("_pid", "_mid", "_m0", "_off", "_tot")


def rank_within(df: DataFrame, group_cols: list, order_cols: list, rank_col: str = "rank") -> DataFrame:
    """0-based position of each row inside its group, in ``order_cols`` order.

    A window partitioned by the group would put a whole group into one task;
    a group may hold a large share of all rows (one big repository), so the
    position comes from the parallel dense index over (group, order) minus the
    first index of the group (a partial min aggregate, one row per group).
    ``group_cols + order_cols`` must be unique per row.
    """
    idx = dense_index(df, [*group_cols, *order_cols], "_gi")
    first = idx.groupBy(*group_cols).agg(F.min("_gi").alias("_g0"))
    return (idx.join(first, list(group_cols))
            .withColumn(rank_col, (F.col("_gi") - F.col("_g0")).cast("long"))
            .drop("_gi", "_g0"))
