"""DataFrame -> DataFrame operators of the conflict-dataset pipeline."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def barrier(df: DataFrame) -> DataFrame:
    """Pass all columns through a Generate (``inline`` of a one-element array).

    Catalyst collapses adjacent projections and inlines an expression into
    every place that references it, and pushes filters below projections; for
    the expensive array expressions of this engine (line splitting, context
    matching) that would evaluate them many times per row.  A Generate node is
    opaque to both rules, so each expression above it is computed once.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


SPREAD = "spark.conflictlake.spread"


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as the session setting ``spark.conflictlake.spread`` says.

    For row-local work on tables whose files have fewer splits than the cluster
    has cores (a single Parquet row group is one task).  Unset, the scan stays as
    it is and nothing is shuffled; the plan never depends on the data.
    """
    n = int(df.sparkSession.conf.get(SPREAD, "0"))
    return df.repartition(n) if n else df
