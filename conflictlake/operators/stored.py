"""Iteration state as Parquet in the shared checkpoint folder.

A round's result is written and read again, so the lineage ends there and a lost
executor only repeats the round; a superseded round is deleted by the code that
wrote it, so the folder holds what is still read and nothing else.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from conflictlake.session import ensure_checkpoint_dir


class Stored:
    """A DataFrame in a folder of its own."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{ensure_checkpoint_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def delete(self) -> None:
        delete_path(self.spark, self.path)


class Rounds:
    """One folder that several rounds add their rows to; it is read as one table, however many the rounds."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.schema = spark, None
        self.path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def delete(self) -> None:
        delete_path(self.spark, self.path)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
