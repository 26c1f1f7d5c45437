"""Whole files as values, and tables stored from queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_read(spark: SparkSession, path: str, charset: str | None = None) -> DataFrame:
    """One row per file: ``path`` and ``content``, binary, or text when a charset is given."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files if charset is None else files.withColumn("content", F.decode("content", charset))


def file_write(df: DataFrame, column: str, path: str) -> None:
    """The values of a column as lines of text files, one file per task."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def create_table_as(df: DataFrame, path: str, sorted_by: Sequence[str] = ()) -> DataFrame:
    """Stores a query and reads it back; ``sorted_by`` clusters the rows for later range filters."""
    if sorted_by:
        df = df.repartitionByRange(*sorted_by).sortWithinPartitions(*sorted_by)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
