"""Response cache (E3, J6, W6): prompts joined to cached model responses.

The cache (T13) is a table keyed by (model, md5(prompt)); lookups are a left
join, the misses an anti-join (the work list for whatever calls the model).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conflictlake.functions.text import cache_key


def latest_responses(cache: DataFrame, order_col: str = "written_at") -> DataFrame:
    """One row per (model, cache_key), the latest write wins (a max
    aggregate, combined map-side); a response without a write time counts as
    older than any other."""
    cols = [c for c in cache.columns if c not in ("model", "cache_key", order_col)]
    return (cache.groupBy("model", "cache_key")
            .agg(F.max(F.struct(order_col, *cols)).alias("_r"))  # nulls are smallest
            .select("model", "cache_key", *[F.col(f"_r.{c}").alias(c) for c in cols]))


def lookup(requests: DataFrame, cache: DataFrame, model: str | None = None) -> DataFrame:
    """Requests (model?, prompt) + cache -> result/reasoning or null."""
    r = requests.withColumn("cache_key", cache_key("prompt"))
    if model is not None:
        r = r.withColumn("model", F.lit(model))
    c = cache.select("model", "cache_key", "result", "reasoning")
    return r.join(c, ["model", "cache_key"], "left")


def misses(requests: DataFrame, cache: DataFrame, model: str | None = None) -> DataFrame:
    """The requests without a cached response."""
    r = requests.withColumn("cache_key", cache_key("prompt"))
    if model is not None:
        r = r.withColumn("model", F.lit(model))
    return r.join(cache.select("model", "cache_key"), ["model", "cache_key"], "left_anti")
