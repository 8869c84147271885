"""Mixing sources to target weights by systematic sampling.

Sources share ``total_percent`` of all sizes by weight, but none gets more than
``max_copies`` times its size; what is cut off is shared again by weight.  Within
a source every document expects ``target / source_size`` copies.  The documents
stand in a line in order of size, each as long as its expected copies; the line
is shifted by one random offset, and a document is emitted once per integer that
lies in its stretch.  Neighbours in that line have like sizes, so the words taken
come near the target, and no document gets more copies than the expectation
rounded up.

The line is a prefix sum.  It is made of sums by cell - (source, size, hash
bucket) - so that no task holds a source, or all documents of one size, whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conflictlake.llm.common import refuse_clash, settled, settled_with, temp_name

UNIT = 1 << 24  # expected copies are whole multiples of 1 / UNIT: exact sums in any order
CELL_ROWS = 8192


def word_count(text: str) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: list[float], total_percent: int = 150, max_copies: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source, null a source too.

    Weights repeat along the sources by code point, null last.  The shares are
    ``min(max_copies * size, level * weight)``: in order of size / weight, the
    sources that stop at their cap are a prefix of the list.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sources.withColumn("w", w).withColumn("cap", (max_copies * F.col("source_size")).cast("double"))
    every = Window.partitionBy()
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    done = up.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("total", F.sum("source_size").over(every) * total_percent / 100.0)
    t = t.withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(done), F.lit(0.0)))
    t = t.withColumn("open", F.sum("w").over(every) - F.coalesce(F.sum("w").over(done), F.lit(0.0)))
    level = F.min(F.when(F.col("cap") / F.col("w") * F.col("open") >= F.col("rest"), F.struct(F.col("cap") / F.col("w"), F.col("rest") / F.col("open")))).over(every)
    t = t.withColumn("level", level["col2"])
    share = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w")))
    return t.select("source", "source_size", F.when(F.col("source_size") > 0, share).otherwise(0.0).alias("target"))


def mix(docs: DataFrame, weights: list[float], size: Column | None = None, seed: int = 0, total_percent: int = 150, max_copies: int = 2,
        source_col: str = "source", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, and ``keep``.

    ``size`` defaults to the words of ``text``.  Documents of size 0 line up
    first; they get copies like the others, which take nothing.  A source
    without words has target 0 and no copies.  Null sources are one source, null
    ids and repeated rows are documents like any other (rows that are equal in
    all that decides may swap their copies).  Reruns agree: order and offset
    depend on the rows and ``seed`` alone.  A ``keep`` column of a name that is made
    here is refused (ValueError).
    """
    keep = keep or []
    refuse_clash(keep, "doc_id", "source", "size", "source_size", "target", "copies", "taken", "__h", "cell", "local", "ahead", "step", "shift", "s", "z", "c")
    text_hash = F.xxhash64(F.col("text").cast("string")) if "text" in [c.lower() for c in docs.columns] else F.lit(0)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       (size if size is not None else word_count("text")).alias("size"), text_hash.alias("__h"), *[F.col(c) for c in keep])
    base = settled(base, "sizes")
    per_size, told = settled_with(base.groupBy("source", "size").agg(F.count("*").alias("n")), "sources", n=F.sum("n"))
    n = told["n"] or 0
    wanted = targets(per_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, total_percent, max_copies)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = settled(wanted.withColumn("step", F.round(ratio * UNIT).cast("long")).withColumn(
        "shift", F.pmod(F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("\0"))), F.lit(UNIT)))
        .withColumnRenamed("source", "s"), "targets")

    cells = max(1, -(-n // CELL_ROWS))
    cell = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "__h"), F.lit(cells))
    placed = base.withColumn("cell", cell).withColumn("local", F.row_number().over(
        Window.partitionBy("source", "size", "cell").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "__h"), "doc_id", "__h")) - 1)
    in_cell = base.withColumn("cell", cell).groupBy("source", "size", "cell").agg(F.count("*").alias("m"))
    sized = per_size.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("size")) - F.col("n")).drop("n")
    offsets = in_cell.withColumn("first", F.sum("m").over(Window.partitionBy("source", "size").orderBy("cell")) - F.col("m"))
    offsets = offsets.withColumnsRenamed({"source": "s", "size": "z", "cell": "c"}).drop("m")
    sized = sized.withColumnsRenamed({"source": "s2", "size": "z2"})
    offsets = offsets.join(sized, offsets.s.eqNullSafe(sized.s2) & (offsets.z == sized.z2)).join(
        wanted.withColumnRenamed("s", "s3"), F.col("s").eqNullSafe(F.col("s3"))).select(
        "s", "z", "c", (F.col("before") + F.col("first")).alias("ahead"), "source_size", "target", "step", "shift")
    at = placed.join(offsets, placed.source.eqNullSafe(offsets.s) & (placed.size == offsets.z) & (placed.cell == offsets.c))
    rank = F.col("ahead") + F.col("local")
    end = (rank + 1) * F.col("step") + F.col("shift")
    copies = F.shiftright(end, 24) - F.shiftright(end - F.col("step"), 24)  # whole numbers up to here, divided by UNIT
    return at.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *keep)


def mixed_documents(docs: DataFrame, weights: list[float], seed: int = 0, total_percent: int = 150, max_copies: int = 2) -> DataFrame:
    """``docs`` with every row as often as the mix takes it (same columns).

    The mix itself runs without the texts; rows meet their copies by a key, equal
    rows as one row with all their copies.
    """
    d, h, n, k, first = (temp_name(docs, x) for x in ("mix_id", "mix_hash", "mix_copies", "mix_of", "mix_row"))
    keyed = docs.withColumn(h, F.xxhash64(*docs.columns)).withColumn(d, F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    plan = mix(keyed, weights, seed=seed, total_percent=total_percent, max_copies=max_copies, keep=[h, d])
    plan = plan.groupBy(d, h).agg(F.sum("copies").alias(n)).where(F.col(n) > 0)
    one = keyed.withColumn(first, F.row_number().over(Window.partitionBy(d, h).orderBy(d))).where(F.col(first) == 1)
    return one.join(plan, [d, h]).withColumn(k, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*docs.columns)
