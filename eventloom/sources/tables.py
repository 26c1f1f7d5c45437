"""Tables from ranges, literals and arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def system_range(spark: SparkSession, low: int, high: int, step: int = 1) -> DataFrame:
    """Column ``X`` from low to high, both included; the step may be negative."""
    if step == 0:
        raise ValueError("the step of a range cannot be zero")
    return spark.range(low, high + (1 if step > 0 else -1), step).withColumnRenamed("id", "X")


def range_over(df: DataFrame, low: Column, high: Column, step: int = 1, out: str = "X") -> DataFrame:
    """The range between two aggregates of a table, e.g. all days from the first to the last.

    The numbers are made in slabs of 100,000, spread over the tasks.
    """
    slab = 100_000 * step
    ends = df.agg(low.cast("bigint").alias("lo"), high.cast("bigint").alias("hi")).filter(
        F.col("lo").isNotNull() & ((F.col("lo") <= F.col("hi")) if step > 0 else (F.col("lo") >= F.col("hi"))))
    slabs = ends.select("hi", F.explode(F.sequence("lo", "hi", F.lit(slab).cast("bigint"))).alias("at")).repartition("at")
    last = F.least(F.col("hi"), F.col("at") + (slab - step)) if step > 0 else F.greatest(F.col("hi"), F.col("at") + (slab - step))
    return slabs.select(F.explode(F.sequence("at", last, F.lit(step).cast("bigint"))).alias(out))


def values(spark: SparkSession, rows: Sequence[Sequence]) -> DataFrame:
    """``VALUES (...), (...)`` with columns C1..Cn."""
    widths = {len(r) for r in rows}
    if len(widths) != 1:
        raise ValueError("all rows of VALUES must have the same number of columns")
    return spark.createDataFrame([tuple(r) for r in rows], [f"C{i + 1}" for i in range(widths.pop())])


def unnest(df: DataFrame, *arrays: str, distinct: bool = False) -> DataFrame:
    """Arrays to rows, zipped by position; shorter arrays are filled with NULL. Other columns repeat."""
    rest = [c for c in df.columns if c not in arrays]
    rows = df.select(*rest, F.explode(F.arrays_zip(*arrays)).alias("__z")).select(*rest, *[f"__z.{a}" for a in arrays])
    return rows.distinct() if distinct else rows


def table_of(spark: SparkSession, **arrays: Sequence) -> DataFrame:
    """``TABLE(x INT=(1, 2), y INT=(3))``."""
    one = spark.range(1).select(*[F.array(*[F.lit(v) for v in a]).alias(n) for n, a in arrays.items()])
    return unnest(one, *arrays)
