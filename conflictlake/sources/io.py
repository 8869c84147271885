"""Sources and sinks.

Columnar Parquet is the native format between jobs; the CSV / JSON / text
readers import the file layouts the original pipeline produces.  Schemas are
always given, never inferred.
"""

from __future__ import annotations

import csv

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conflictlake.operators.repos import API_RESULT_CAP, with_row_position
from conflictlake.operators.stored import Stored
from conflictlake.sources import records as R

# T1 without idx, as read from the dump: every column text first (R1); the
# catalogue cast happens after the missing-value handling.
CATALOGUE_COLUMNS = ["repository", "language", "architecture", "community", "continuous_integration",
                     "documentation", "history", "issues", "license", "size", "unit_test", "stars",
                     "scorebased_org", "randomforest_org", "scorebased_utl", "randomforest_utl"]
CATALOGUE_TYPES = {"architecture": "double", "community": "int", "continuous_integration": "int",
                   "documentation": "double", "history": "double", "issues": "double", "license": "int",
                   "size": "int", "unit_test": "double", "stars": "int", "scorebased_org": "int",
                   "randomforest_org": "int", "scorebased_utl": "int", "randomforest_utl": "int"}

MERGES_SCHEMA = T.StructType([
    T.StructField("merge_idx", T.LongType()), T.StructField("repository", T.StringType()),
    T.StructField("branch_name", T.StringType()), T.StructField("merge_commit", T.StringType()),
    T.StructField("parent_1", T.StringType()), T.StructField("parent_2", T.StringType()),
    T.StructField("notes", T.StringType()),
])

API_ITEM = T.StructType([
    T.StructField("full_name", T.StringType()), T.StructField("stargazers_count", T.LongType()),
    T.StructField("language", T.StringType()), T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()), T.StructField("forks_count", T.LongType()),
    T.StructField("open_issues_count", T.LongType()), T.StructField("size", T.LongType()),
    T.StructField("default_branch", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("html_url", T.StringType()), T.StructField("clone_url", T.StringType()),
    T.StructField("archived", T.BooleanType()), T.StructField("disabled", T.BooleanType()),
    T.StructField("license", T.StructType([T.StructField("key", T.StringType())])),
])
API_PAGE = T.StructType([T.StructField("total_count", T.LongType()),
                         T.StructField("items", T.ArrayType(API_ITEM))])

RESPONSE_SCHEMA = T.StructType([T.StructField("prompt", T.StringType()),
                                T.StructField("reasoning", T.StringType()),
                                T.StructField("result", T.StringType())])


def read_catalogue_dump(spark: SparkSession, path: str) -> DataFrame:
    """R1 + K8: the (gzip) CSV dump as text columns with a 0-based ``idx``
    row position assigned right after the scan (before any filter)."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in CATALOGUE_COLUMNS])
    raw = spark.read.schema(schema).option("header", True).csv(path)
    return with_row_position(raw, "idx").select("idx", *CATALOGUE_COLUMNS)


def cast_catalogue(df: DataFrame) -> DataFrame:
    """T1 types after R4 (strict casts: a bad value raises under ANSI mode)."""
    return df.select(*[F.col(c).cast(CATALOGUE_TYPES[c]).alias(c) if c in CATALOGUE_TYPES else F.col(c)
                       for c in df.columns])


def _ddl(schema) -> str:
    if isinstance(schema, str):
        return schema
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def read_csv(spark: SparkSession, path: str, schema, keep_empty_strings: bool = False) -> DataFrame:
    """R2: CSV with header, quoted multi-line fields.  With
    ``keep_empty_strings`` an empty quoted field stays "" instead of null.

    A file is read by as many tasks as it has splits (``sources.records``), with
    the rows that a whole-file reader gives; columns are taken by position."""
    rows = R.records(R.file_lines(spark, path)).where("NOT header")
    options = {"emptyValue": "", "nullValue": "\u0000"} if keep_empty_strings else {}
    return rows.select(R.parsed(rows, _ddl(schema), options).alias("r")).select("r.*")


def read_csv_dir(spark: SparkSession, path: str) -> DataFrame:
    """Every ``*.csv`` below ``path``; files with different headers are
    unioned by name (missing columns null).  Raises when there is none.

    All files are read in one scan, whatever headers they have: the cells of a
    record are taken by position and named by the header of its own file.  Only
    the column names come to the driver."""
    lines = R.file_lines(spark, path, recursiveFileLookup=True, pathGlobFilter="*.csv")
    rows = R.records(lines)

    def split(batches):
        for b in batches:
            cells = [next(csv.reader([t.lstrip("\ufeff")], strict=False)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells, pa.list_(pa.string()))], names=["file", "names"])

    headers = Stored(rows.where("header").select("file", "text").mapInArrow(split, "file string, names array<string>"), "headers").df
    found = headers.agg(F.max(F.size("names")).alias("width")).first()
    if found["width"] is None:
        raise ValueError(f"No CSV files found in {path}")
    names = sorted(r[0] for r in headers.select(F.explode("names")).distinct().collect())
    schema = ", ".join(f"c{i} string" for i in range(found["width"]))
    body = rows.where("NOT header")
    body = body.select("file", R.parsed(body, schema, {}).alias("r"))
    body = body.select("file", F.array(*[F.col(f"r.c{i}") for i in range(found["width"])]).alias("cells"))
    small = headers.count() <= R.BROADCAST_SPLITS
    body = body.join(F.broadcast(headers) if small else headers, "file")
    cell = lambda c: F.get("cells", (F.array_position("names", c) - 1).cast("int"))
    return body.select(*[F.when(F.array_contains("names", c), cell(c)).alias(c) for c in names])


def read_api_pages(spark: SparkSession, path: str) -> DataFrame:
    """R5 input: landed search-API pages, one JSON object per line; ``page``
    orders them as stored (file, split offset, line)."""
    pages = spark.read.schema(API_PAGE).json(path)
    return pages.withColumn("page", F.struct(F.col("_metadata.file_path").alias("file"),
                                             F.col("_metadata.file_block_start").alias("offset"),
                                             F.monotonically_increasing_id().alias("line")))


def api_items(pages: DataFrame, max_results: int = API_RESULT_CAP, search: str | None = None) -> DataFrame:
    """Items of the pages in (page, position) order, at most ``max_results``
    per search.

    ``search`` names the column that tells the searches apart (None: all pages
    are of one search).  The default is what the API returns for one search."""
    key = [search] if search else []
    items = pages.select(*key, "page", F.posexplode("items").alias("pos", "item"))
    w = Window.partitionBy(*key).orderBy("page", "pos")
    return items.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_results).select("item.*")


def read_text_pairs(spark: SparkSession, path: str, first_suffix: str = ".conflict",
                    second_suffix: str = ".final_merged", first_col: str = "conflict_text",
                    second_col: str = "merged_text", skip_component: str | None = None) -> DataFrame:
    """``<stem><first_suffix>`` files joined with their sibling
    ``<stem><second_suffix>`` (left join: null when missing).  The stem
    ``<merge_idx>-<file_no>[-<block_no>]`` is split into key columns.  Text
    is read whole per file.  With ``skip_component`` (the extraction stage gives
    ``conflict_blocks``) what lies below a directory of that name is left out."""
    def scan(suffix):
        d = (spark.read.option("recursiveFileLookup", True)
             .option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True)
             .select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("fp")))
        if skip_component:
            d = d.where(~F.col("fp").contains(f"/{skip_component}/"))
        dirn = F.regexp_extract("fp", r"^(.*)/[^/]*$", 1)
        stem = F.regexp_extract("fp", r"([^/]*)" + suffix.replace(".", r"\.") + "$", 1)
        return d.select(dirn.alias("dir"), stem.alias("stem"), "text")
    a = scan(first_suffix).withColumnRenamed("text", first_col)
    b = scan(second_suffix).withColumnRenamed("text", second_col)
    out = a.join(b, ["dir", "stem"], "left")
    return out.select(
        "stem",
        F.expr("try_cast(get(split(stem, '-'), 0) AS BIGINT)").alias("merge_idx"),
        F.expr("try_cast(get(split(stem, '-'), 1) AS INT)").alias("file_no"),
        F.expr("try_cast(get(split(stem, '-'), 2) AS INT)").alias("block_no"),
        first_col, second_col,
    )


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Cached responses ``<path>/<model>/<md5>.json`` -> T13 rows; a
    response was written when its file was."""
    d = (spark.read.schema(RESPONSE_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True)
         .option("pathGlobFilter", "*.json").json(path)
         .withColumn("fp", F.col("_metadata.file_path")))
    return d.select(F.regexp_extract("fp", r"([^/]+)/[^/]+\.json$", 1).alias("model"),
                    F.regexp_extract("fp", r"([^/]+)\.json$", 1).alias("cache_key"),
                    "prompt", "result", "reasoning", F.col("_metadata.file_modification_time").alias("written_at"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header, output directory replaced."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_table(df: DataFrame, path: str, partition_by: list | None = None, mode: str = "overwrite") -> None:
    """Parquet table (``partition_by=["split"]`` for the dataset)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_dataset(dataset: DataFrame, path: str, jsonl: bool = False) -> None:
    """The dataset split into ``split=train`` / ``split=test``."""
    write_table(dataset, path, ["split"])
    if jsonl:
        dataset.write.mode("overwrite").partitionBy("split").json(path + "_jsonl")
