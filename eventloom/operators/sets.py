"""Set operations read left to right, and recursive queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.session import scratch_path


def chain(first: DataFrame, *steps: tuple[str, DataFrame]) -> DataFrame:
    """``a UNION b INTERSECT c ...`` with equal precedence, from left to right.

    (SQL proper, and Spark, bind INTERSECT tighter.) Columns are matched by position.
    """
    how = {"union all": lambda a, b: a.unionAll(b), "union": lambda a, b: a.union(b).distinct(),
           "intersect": lambda a, b: a.intersect(b), "except": lambda a, b: a.subtract(b),
           "minus": lambda a, b: a.subtract(b)}
    return reduce(lambda acc, s: how[s[0].lower()](acc, s[1]), steps, first)


def recursive(base: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = False,
              max_rounds: int | None = None) -> DataFrame:
    """Applies ``step`` to the last delta until it is empty; all rounds together are the result.

    Rows are not de-duplicated across rounds; with ``distinct`` they are within one. Each round is written once, to a
    folder of its own in the shared folder; the next one reads it, and the result is one scan of all of them, whatever their number.
    ``max_rounds`` guards against a recursion without end; by default there is no limit.
    """
    spark, path, schema = base.sparkSession, scratch_path(base.sparkSession, "rounds"), base.schema

    def keep(df: DataFrame, number: int) -> DataFrame:
        # columns are matched by place, and have the types of the first round
        df = df.toDF(*schema.names).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema.fields])
        (df.distinct() if distinct else df).write.parquet(f"{path}/round={number}")
        return spark.read.schema(schema).parquet(f"{path}/round={number}")

    delta, rounds = keep(base, 0), 1
    while not delta.isEmpty():
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError(f"no end after {max_rounds} rounds")
        delta, rounds = keep(step(delta), rounds), rounds + 1
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def recursive_sql(spark: SparkSession, name: str, base: str, step: str, distinct: bool = False, max_rounds: int | None = None) -> DataFrame:
    """``WITH RECURSIVE name AS (base UNION ALL step)`` without a limit of rows or levels; ``step`` reads the last round as ``name``."""
    def run(delta: DataFrame) -> DataFrame:
        delta.createOrReplaceTempView(name)
        return spark.sql(step)

    return recursive(spark.sql(base), run, distinct, max_rounds)
