"""Tables of another database through Spark's JDBC source.

Filters, column selection, limits and aggregates are pushed down by Spark. A large table
needs ``partition_column`` with bounds, or it is read by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def options(url: str, user: str | None = None, password: str | None = None, driver: str | None = None,
            fetch_size: int = 10_000) -> dict[str, str]:
    given = {"url": url, "user": user, "password": password, "driver": driver, "fetchsize": str(fetch_size)}
    return {k: v for k, v in given.items() if v is not None}


def linked_table(spark: SparkSession, table: str, url: str, user: str | None = None, password: str | None = None,
                 driver: str | None = None, partition_column: str | None = None, lower: object = None, upper: object = None,
                 partitions: int | None = None) -> DataFrame:
    reader = spark.read.format("jdbc").options(**options(url, user, password, driver)).option("dbtable", table)
    if partition_column is not None:
        if lower is None or upper is None or not partitions:
            raise ValueError("a partition column needs bounds and a number of partitions")
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", str(lower))
                  .option("upperBound", str(upper)).option("numPartitions", str(partitions)))
    return reader.load()


def write_linked(df: DataFrame, table: str, url: str, user: str | None = None, password: str | None = None,
                 driver: str | None = None, mode: str = "append", batch_size: int = 10_000) -> None:
    (df.write.format("jdbc").options(**options(url, user, password, driver)).option("dbtable", table)
     .option("batchsize", str(batch_size)).mode(mode).save())


def link_schema(spark: SparkSession, url: str, source_schema: str, user: str | None = None, password: str | None = None,
                driver: str | None = None, prefix: str = "") -> list[str]:
    """Registers every table of a schema as a temporary view; returns the view names.

    Only table names come to the driver.
    """
    quoted = source_schema.replace("'", "''")
    names = linked_table(
        spark, f"(SELECT table_name FROM information_schema.tables WHERE table_schema = '{quoted}') t",
        url, user, password, driver)
    views = []
    for row in names.toLocalIterator():
        view = f"{prefix}{row[0]}"
        linked_table(spark, f"{source_schema}.{row[0]}", url, user, password, driver).createOrReplaceTempView(view)
        views.append(view)
    return views
