"""Helpers shared by the operators: stored intermediate tables, checked broadcasts, components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.session import cut_lineage, scratch_path

#: Rows up to which a counted table is sent to every executor; a longer one is joined by key.
BROADCAST_ROWS = 200_000


#: Frees the shuffle files of a query when it has ended. Nothing reads them later: what is kept is in the written table.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths written within each open :func:`scratch` block.
_SCRATCH: list[list[str]] = []


def stored(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read again, so lost executors cost nothing.

    Within a :func:`scratch` block the table goes with the block, with ``keep`` with the block around it, if any.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if len(_SCRATCH) > keep:
        _SCRATCH[-1 - keep].append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables :func:`stored` inside it; what is used later is stored with ``keep``."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for name in _SCRATCH.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows; else as it is, for a join by key.

    ``df`` must be cheap to count (stored or checkpointed).
    """
    return F.broadcast(df) if df.count() <= limit else df


def text_key(text: str = "text") -> Column:
    """128 bits that stand for a text; null for null."""
    return F.when(F.col(text).isNotNull(), F.md5(F.col(text).cast("binary")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges``; ``root`` is the smallest node reachable.

    Alternates the large-star and small-star steps until the edges stay the same. Minima
    are aggregated on the map side and joined back, so a hub is no hot group. The edges of
    each round are cut off by a reliable checkpoint; only a count and a checksum reach the driver.
    """
    def star(pairs: DataFrame) -> DataFrame:
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return pairs.join(low, "u")

    def state(e: DataFrame):
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    now = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                      .where("u <> v").distinct())
    before = None
    while True:
        seen = state(now)
        if seen == before or not seen[0]:
            break
        before = seen
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        joined = star(large)
        small = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = cut_lineage(small)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
