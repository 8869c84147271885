"""Sharding by extendible hashing: a directory of hash prefixes whose buckets split until each fits its byte limit.

A row's address is a string of hash bits.  All rows start in one bucket; a bucket
above the limit splits on the next bit, others stay as they are.  Splits depend
on byte sums alone, so ROUND_BITS levels are decided at a time: Spark sums the
bytes of every prefix of those levels, and each directory slot (a prefix of the
full width) points to the shortest of its prefixes that fits.  Rows find their
shard by an equi-join with the directory.  Only rows of buckets that are still
too large enter the next round.

The first 60 bits come from the key.  Rows that share a key share them, and a
group of such rows can exceed a shard, so their next bits come from the row's
size and content and then from its serial number in the input: a hot key splits
like any other bucket, and only a single row larger than the limit stays
oversized.

DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conflictlake.llm.common import settled

ROUND_BITS = 10
WORD_BITS = 60  # of each of the three address words
ROUNDS = 3 * WORD_BITS // ROUND_BITS


def text_bytes(col: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(col).cast("string")), F.lit(0)).cast("long")


def directory(sums: DataFrame, limit: int) -> DataFrame:
    """(bucket, slot, depth, prefix, shard_bytes, shard_rows, fits): where each slot of each bucket points.

    ``sums`` has (bucket, slot, bytes, rows).  A prefix never weighs more than a
    shorter one, so the shortest that fits is the bucket at which splitting ends.
    """
    up = sums.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(ROUND_BITS)))).withColumn(
        "prefix", F.expr(f"shiftright(slot, {ROUND_BITS} - depth)"))
    node = up.groupBy("bucket", "depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
    node = node.withColumn("fits", (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
    ends = F.min(F.when(F.col("fits") | (F.col("depth") == ROUND_BITS), F.struct("depth", "prefix", "shard_bytes", "shard_rows", "fits")))
    return up.select("bucket", "slot", "depth", "prefix").join(node, ["bucket", "depth", "prefix"]).groupBy("bucket", "slot").agg(ends.alias("to")).select("bucket", "slot", "to.*")


def shards(docs: DataFrame, limit: int, key_col: str = "doc_id", size: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, n_bytes, shard (its bits), shard_depth, shard_bytes, shard_rows for every row.

    ``size`` defaults to the bytes of ``text`` (null: 0).  A null key hashes like
    any key.  Repeated rows are rows of their own.  An empty table has no shard.
    """
    keep = keep or [key_col]
    n_bytes = size if size is not None else text_bytes()
    content = F.xxhash64(*[c for c in docs.columns if c.lower() in ("text", key_col.lower())])
    first = F.conv(F.substring(F.md5(F.coalesce(F.col(key_col).cast("string"), F.lit("null"))), 1, WORD_BITS // 4), 16, 10).cast("long")
    rows = docs.select(F.struct(*keep).alias("kept"), n_bytes.alias("bytes"), first.alias("w0"), F.shiftrightunsigned(content, 4).alias("w1"),
                       F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 4).alias("w2"), F.lit("").alias("bucket"))
    rows = settled(rows, "addresses")
    done = []
    for r in range(ROUNDS):
        word, at = f"w{r * ROUND_BITS // WORD_BITS}", r * ROUND_BITS % WORD_BITS
        slot = F.shiftright(word, WORD_BITS - ROUND_BITS - at).bitwiseAND(F.lit((1 << ROUND_BITS) - 1)).cast("int")
        rows = rows.withColumn("slot", slot)
        to = directory(rows.groupBy("bucket", "slot").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")), limit)
        placed = settled(rows.join(to, ["bucket", "slot"]).withColumn("bucket", F.concat("bucket", F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))), f"round{r}")
        last = r == ROUNDS - 1
        ready = placed if last else placed.where("fits")
        done.append(ready.select("kept.*", F.col("bytes").alias("n_bytes"), F.col("bucket").alias("shard"), F.length("bucket").alias("shard_depth"), "shard_bytes", "shard_rows"))
        rows = placed.where("not fits").select("kept", "bytes", "w0", "w1", "w2", "bucket")
        if rows.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


SQL = """
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes,
                  ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT AS a FROM documents),
n AS (SELECT depth, a >> (60 - depth) AS prefix, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows FROM d, range(0, 41) t(depth) GROUP BY ALL),
p AS (SELECT doc_id, n_bytes, n.*, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS nth FROM d, n
      WHERE d.a >> (60 - depth) = prefix AND (shard_bytes <= 1048576 OR shard_rows = 1) QUALIFY nth = 1)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INTEGER), '0') END AS shard, CAST(depth AS INTEGER) AS shard_depth,
       CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_rows FROM p
"""
