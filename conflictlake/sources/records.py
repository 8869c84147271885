"""CSV records of any file, read by many tasks however large the file is.

A line is a record unless a quoted field holds line breaks.  Whether a line stands
inside quotes follows from the number of quotes before it in the file, and of that
only the parity counts.  So a first narrow pass takes the quotes and lines of each
split, a running sum over the splits of a file (a row each) says in what state a
split begins, and a second narrow pass over the lines puts records together.  What
crosses a split's edge is left as fragments, at most two a split, and only those
are joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conflictlake.operators.shipped import ship

BROADCAST_SPLITS = 100_000  # rows of the table of splits up to which every task gets it
WHOLE, HEAD, TAIL = 0, 1, 2  # a record; the end of one that began before the split; the begin of one that ends behind it
RECORDS = "file string, blk long, n long, crlf boolean, part int, text string"
SPLIT = ["file", "blk"]


def file_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """(file, blk, pos, line): the lines of text files, with their split's start and their order in it."""
    return spark.read.options(lineSep="\n", **options).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("blk"),
        F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


def running(per_split: DataFrame, value: str, over_files: bool = False) -> DataFrame:
    """The sum of ``value`` over the splits before each one, in its file or over all files in order.

    The table has a row per split, not per row."""
    w = Window.orderBy("file", "blk") if over_files else Window.partitionBy("file").orderBy("blk")
    before = F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per_split.withColumn("before", before)


def with_split(rows: DataFrame, splits: DataFrame, order: str = "pos") -> DataFrame:
    """``rows`` with the columns of their split; a row of an unknown split is an error.

    A table of splits of a checked size goes to every task, so rows stay where they
    are; a larger one is joined, and the rows of a split are put in order again."""
    known = splits.withColumn("_known", F.lit(True))
    if splits.count() <= BROADCAST_SPLITS:
        out = rows.join(F.broadcast(known), SPLIT, "left")
    else:
        out = rows.join(known, SPLIT, "left").repartition(*SPLIT).sortWithinPartitions(*SPLIT, order)
    # the two scans must have cut the files alike
    ok = F.when(F.col("_known"), F.lit(True)).otherwise(F.raise_error(F.lit("the splits of the files changed between two scans")).cast("boolean"))
    return out.where(ok).drop("_known")


def _quotes(line: str = "line") -> Column:
    return F.length(line) - F.length(F.replace(F.col(line), F.lit('"'), F.lit("")))


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = [f.split()[0] for f in RECORDS.split(", ")], [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string()]
    key, crlf, held, odd, head, n = None, False, [], False, False, 0
    rows: list[tuple] = []

    def end():
        nonlocal held
        if held:  # the split ends inside a record
            rows.append((*key, n, crlf, HEAD if head else TAIL, "\n".join(held)))
            held = []

    for b in batches:
        for file, blk, line, quotes, open_, crlf_ in zip(*(c.to_pylist() for c in b.columns)):
            if (file, blk) != key:
                end()
                key, crlf, odd, head, n = (file, blk), crlf_, bool(open_), bool(open_), 0
            if quotes % 2:
                odd = not odd
            if held or head or odd:
                held.append(line)
                if not odd:
                    rows.append((*key, n, crlf, HEAD if head else WHOLE, "\n".join(held)))
                    held, head, n = [], False, n + 1
            elif line.strip("\r"):
                rows.append((*key, n, crlf, WHOLE, line))
                n += 1
        if len(rows) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)
            rows = []
    end()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)


def records(lines: DataFrame) -> DataFrame:
    """(file, text, header): the records of ``file_lines``; ``header`` marks the first of each file.

    Quotes inside a field are doubled.  Empty lines between records are none.  In a
    file whose first line ends in a carriage return, line breaks inside quotes
    lose theirs, as they do for a whole-file reader."""
    ship(lines.sparkSession)
    first = F.min_by(F.col("line").endswith("\r"), "pos")
    per_split = lines.groupBy(*SPLIT).agg((F.sum(_quotes()) % 2).alias("odd"), F.when(F.col("blk") == 0, first).otherwise(False).alias("begins"))
    splits = running(per_split, "odd").withColumn("crlf", F.max("begins").over(Window.partitionBy("file")))
    splits = splits.select(*SPLIT, (F.col("before") % 2).alias("open"), "crlf")
    rows = with_split(lines.select(*SPLIT, "pos", "line", _quotes().alias("quotes")), splits)
    parts = rows.select(*SPLIT, "line", "quotes", "open", "crlf").mapInArrow(_assemble, RECORDS)
    whole = parts.where(F.col("part") == WHOLE).select("file", "text", "crlf", ((F.col("blk") == 0) & (F.col("n") == 0)).alias("header"))
    order = Window.partitionBy("file").orderBy("blk", "n")
    crossing = parts.where(F.col("part") != WHOLE).withColumn("chain", F.max(F.when(F.col("part") == TAIL, F.col("blk"))).over(order))
    joined = crossing.groupBy("file", "chain").agg(F.array_sort(F.collect_list(F.struct("blk", "n", "text"))).alias("p"), F.max("crlf").alias("crlf"))
    joined = joined.select("file", F.array_join("p.text", "\n").alias("text"), "crlf", ((F.col("p")[0]["blk"] == 0) & (F.col("p")[0]["n"] == 0)).alias("header"))
    text = F.regexp_replace("text", r"\r\z", "")
    return whole.unionByName(joined).select("file", F.when(F.col("crlf"), F.replace(text, F.lit("\r\n"), F.lit("\n"))).otherwise(text).alias("text"), "header")


def parsed(rows: DataFrame, schema: str, options: dict) -> Column:
    """The cells of each record's text as a struct."""
    return F.from_csv(F.col("text"), schema, {"multiLine": "true", "escape": '"', **options})
