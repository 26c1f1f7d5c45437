"""The mining operators over a log given as SQL text.

The query yields case, label, timestamp by position, with any names; any other width gives
an empty relation. The mining itself is the DataFrame operator of the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators import controller as _controller
from eventloom.operators import follows as _follows
from eventloom.operators import recurrent as _recurrent
from eventloom.operators.log import as_log


def log_of(df: DataFrame) -> DataFrame | None:
    if len(df.columns) != 3:
        return None
    named = df.toDF("case_id", "activity", "at")
    return as_log(named, "case_id", "activity", "at")


def _relation(spark: SparkSession, sql: str, op: Callable[[DataFrame], DataFrame]) -> DataFrame:
    df = spark.sql(sql)
    log = log_of(df)
    if log is None:
        blank = df.sparkSession.range(0).select(F.lit(0).alias("c"), F.lit("").alias("l"), F.lit(0).alias("t"))
        return op(log_of(blank))
    return op(log)


def follows(spark: SparkSession, sql: str) -> DataFrame:
    return _relation(spark, sql, _follows.weakly_follows)


def directlyfollows(spark: SparkSession, sql: str) -> DataFrame:
    return _relation(spark, sql, _follows.directly_follows)


def controller(spark: SparkSession, sql: str) -> DataFrame:
    return _relation(spark, sql, _controller.controller)


def autofollows(spark: SparkSession, select: str, source: str, where: str | None, date_from: str, date_to: str,
                interval_ms: int) -> _recurrent.Recurrent:
    """First load of the sliding-window relation: the select list, table and condition as text, the
    period (both ends included) as timestamp texts. ``streaming.recurrent`` takes over from there."""
    df = spark.sql(f"SELECT {select} FROM {source}" + (f" WHERE {where}" if where else "")).toDF("case_id", "activity", "at")
    kind = df.schema["at"].dataType
    df = df.filter((F.col("at") >= F.lit(date_from).cast(kind)) & (F.col("at") <= F.lit(date_to).cast(kind)))
    return _recurrent.bootstrap(as_log(df, "case_id", "activity", "at"), interval_ms)
