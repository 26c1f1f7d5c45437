"""Replaying a stored log as a stream, slice of time by slice of time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.log import epoch_ms


def replay_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """The stream that meets the slices as they are written. The folder gets an empty file first:
    a file source needs it to exist."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/slice=none")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def replay(df: DataFrame, ts_col: str, path: str, after_slice: Callable[[], object], slices: int = 3) -> None:
    """Writes the log in ``slices`` steps of rising time and calls ``after_slice`` after each.

    A slice is written by all tasks at once, and the consumer works it off as one
    micro-batch, so events of later slices never overtake.
    """
    ms = epoch_ms(df, ts_col)
    lo, hi = df.agg(F.min(ms), F.max(ms)).first()
    width = ((hi or 0) - (lo or 0)) // slices + 1
    for i in range(slices):
        at = F.lit((lo or 0) + i * width)
        df.filter((ms >= at) & (ms < at + width)).write.mode("overwrite").parquet(f"{path}/slice={i}")
        after_slice()
