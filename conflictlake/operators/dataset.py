"""Dataset operators (P4, P5, D1-D4, D6, A12): selected pairs -> train/test."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conflictlake.operators.metrics import QUERY_PROMPT, build_question
from conflictlake.operators.select import nth
from conflictlake.operators.stored import Stored

DEFAULT_TEST_SIZE = 0.2
DEFAULT_SEED = 42


def to_conversation(question) -> F.Column:
    """P5: one user turn, no system turn."""
    q = F.col(question) if isinstance(question, str) else question
    return F.array(F.struct(F.lit("user").alias("role"), q.alias("content")))


def question_answer(pairs: DataFrame, language: str = "java",
                    prompt: str = QUERY_PROMPT) -> DataFrame:
    """D1 + D2 + D3: question (instruction + fenced conflict snippet), answer
    (the resolved snippet as is) and the conversation form."""
    q = build_question(F.col("conflict"), language, prompt)
    return pairs.select("conflict_id", q.alias("question"), F.col("resolved").alias("answer"),
                        to_conversation(q).alias("prompt"))


def split_key(id_col: str = "conflict_id", seed: int = DEFAULT_SEED) -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col)))


def in_test(df: DataFrame, test_size: float = DEFAULT_TEST_SIZE, seed: int = DEFAULT_SEED, id_col: str = "conflict_id") -> F.Column:
    """Whether a row of ``df`` is in the test split.

    test_size 0 -> none, 1 -> all; otherwise rows are ordered by md5("<seed>:<id>")
    (id as tie-break) and the first ceil(test_size * n) are the test split.  The
    last key of the test split is found by its rank without a sort
    (``select.nth``); each row then compares its key with that one, so no row is
    moved.  Ids must be unique.  The result depends only on the ids, not on
    partitioning.
    """
    if test_size in (0, 1):
        return F.lit(bool(test_size))
    keys = Stored(df.select(split_key(id_col, seed).alias("_key"), F.col(id_col).cast("string").alias("_id")), "split-keys")
    n_test = math.ceil(float(test_size) * keys.df.count())
    found = nth(keys.df, [("_key", False), ("_id", False)], n_test - 1)
    keys.delete()
    if found is None:
        return F.lit(False)
    key, bound = split_key(id_col, seed), F.lit(found[0]["_key"])
    return (key < bound) | ((key == bound) & (F.col(id_col).cast("string") <= F.lit(found[0]["_id"])))


def assign_split(df: DataFrame, test_size: float = DEFAULT_TEST_SIZE, seed: int = DEFAULT_SEED,
                 id_col: str = "conflict_id") -> DataFrame:
    """Deterministic split with exact sizes (see ``in_test``)."""
    return df.withColumn("split", F.when(in_test(df, test_size or 0, seed, id_col), "test").otherwise("train"))


def build_dataset(pairs: DataFrame, test_size: float = DEFAULT_TEST_SIZE,
                  seed: int = DEFAULT_SEED, language: str = "java", prompt: str = QUERY_PROMPT,
                  dedupe: bool = False) -> DataFrame:
    """T12 rows (conflict_id, question, answer, prompt, split); with
    ``dedupe`` exact duplicates go before the split (D6), so its sizes are exact.
    The pairs are made once and stored: the keys of the split and the rows are two reads."""
    if dedupe or (test_size or 0) not in (0, 1):
        pairs = Stored(pairs.select("conflict_id", "conflict", "resolved"), "pairs").df
    rows = question_answer(pairs, language, prompt)
    return assign_split(dedupe_exact(rows) if dedupe else rows, test_size, seed)


def split_sizes(dataset: DataFrame) -> DataFrame:
    """Rows per split."""
    return dataset.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def dedupe_exact(dataset: DataFrame) -> DataFrame:
    """D6 (optional): drop exact duplicate (question, answer) pairs, keeping
    the smallest conflict id.  The group key is a pair of hashes and the
    aggregate is a min, so a hot duplicate group is combined map-side."""
    keys = [F.md5("question").alias("_hq"), F.md5("answer").alias("_ha")]
    keep = (dataset.groupBy(*keys).agg(F.min("conflict_id").alias("conflict_id"))
            .select("conflict_id"))
    return dataset.join(keep, "conflict_id", "left_semi")
