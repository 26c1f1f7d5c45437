"""Tables that a stream keeps up to date by micro-batch, and counts that are merged instead of counted anew.

Each micro-batch writes a folder of its own, ``batch=<id>``; a replayed one overwrites it. Counts are a base, which
sums up all batches up to its number, and the folders of the batches after it. Once FAN of those have gathered, the
next micro-batch writes a new base from the old one and them. What is read is thus one base and at most FAN
small folders, however long the stream has run. A base only takes in batches before the running one: those are
committed and never replayed. A folder without its mark of completion does not count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders of single batches beside a base, about.
FAN = 8


class Folders:
    """The numbered folders below a path, by Hadoop's file system, so any store that Spark reaches will do."""

    def __init__(self, spark: SparkSession, path: str, kind: str):
        self.spark, self.path, self.kind = spark, path, kind

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def of(self, number: int) -> str:
        return f"{self.path}/{self.kind}={number}"

    def numbers(self) -> list[int]:
        """Numbers of the folders that were written to their end, rising."""
        at, fs = self._fs(self.path)
        if not fs.exists(at):
            return []
        found = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith(f"{self.kind}=")]
        done = [p for p in found if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def has(self, number: int) -> bool:
        at, fs = self._fs(f"{self.of(number)}/_SUCCESS")
        return fs.exists(at)

    def drop(self, number: int) -> None:
        at, fs = self._fs(self.of(number))
        fs.delete(at, True)

    def read(self, numbers: Sequence[int], schema: T.StructType) -> DataFrame:
        """The rows of these folders, without a column for the number."""
        if not numbers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self.of(n) for n in numbers])


class Counts:
    """Sums per key, added to by micro-batches."""

    def __init__(self, spark: SparkSession, path: str, keys: T.StructType, value: str = "n"):
        self.keys, self.value = keys.names, value
        self.schema = T.StructType([*keys.fields, T.StructField(value, T.LongType())])
        self.bases, self.parts = Folders(spark, path, "upto"), Folders(spark, path, "batch")

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(F.sum(self.value).cast("bigint").alias(self.value)).where(F.col(self.value) != 0)

    def _open(self, before: int | None = None) -> tuple[int | None, list[int]]:
        """The newest base and the batches it lacks."""
        base = max(self.bases.numbers(), default=None)
        return base, [n for n in self.parts.numbers() if (base is None or n > base) and (before is None or n < before)]

    def add(self, batch_id: int, rows: DataFrame) -> None:
        """Adds the ``rows`` (keys and value) of one micro-batch; the same batch again replaces them."""
        base, parts = self._open(batch_id)
        if len(parts) >= FAN:
            self._summed(self._rows(base, parts)).write.mode("overwrite").parquet(self.bases.of(parts[-1]))
            if base is not None:  # the base before stays, with its batches, for whoever reads them now
                for folders, last in ((self.parts, base), (self.bases, base - 1)):
                    for n in folders.numbers():
                        if n <= last:
                            folders.drop(n)
        self._summed(rows.select(*self.schema.names)).write.mode("overwrite").parquet(self.parts.of(batch_id))

    def _rows(self, base: int | None, parts: list[int]) -> DataFrame:
        rows = self.parts.read(parts, self.schema)
        return rows if base is None else rows.unionByName(self.bases.read([base], self.schema))

    def read(self) -> DataFrame:
        """All sums that are not 0."""
        return self._summed(self._rows(*self._open()))

    def folders(self) -> int:
        """How many folders a read opens."""
        base, parts = self._open()
        return len(parts) + (base is not None)


class Clock:
    """A time that never goes back, by micro-batch."""

    schema = T.StructType([T.StructField("ms", T.LongType())])

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.steps = spark, Folders(spark, path, "batch")

    def before(self, batch_id: int | None = None) -> int | None:
        known = [n for n in self.steps.numbers() if batch_id is None or n < batch_id]
        row = self.steps.read(known[-1:], self.schema).first()
        return row.ms if row else None

    def set(self, batch_id: int, *candidates: int | None) -> int | None:
        """The latest of the candidates and of what was set before."""
        now = max([c for c in (self.before(batch_id), *candidates) if c is not None], default=None)
        self.spark.range(1).select(F.lit(now).cast("bigint").alias("ms")).where("ms is not null").write.mode("overwrite").parquet(self.steps.of(batch_id))
        for n in self.steps.numbers()[:-FAN]:
            self.steps.drop(n)
        return now


class Reorder:
    """Hands on events in the order of their time, as far as ``lateness_ms`` allows.

    The clock of the stream is the latest time seen less the allowed lateness. An event before the clock of the last
    micro-batch comes too late and is set apart. The others wait in a table until the clock has passed
    them. What one micro-batch hands on therefore lies wholly after what all earlier ones did, whatever the
    order of arrival. The table holds the last ``lateness_ms`` of the stream; batch operators work on it,
    so a case may hold most of it.
    """

    def __init__(self, spark: SparkSession, path: str, lateness_ms: int, schema: T.StructType):
        self.lateness_ms, self.schema, self.clock = lateness_ms, schema, Clock(spark, f"{path}/clock")
        self.waiting, self.late = Folders(spark, f"{path}/waiting", "batch"), Folders(spark, f"{path}/late", "batch")

    def take(self, batch_id: int, log: DataFrame | None) -> DataFrame:
        """The events that are in order now, of this micro-batch and of what waited; without a micro-batch, all that wait."""
        passed_ms, earlier = self.clock.before(batch_id), [n for n in self.waiting.numbers() if n < batch_id]
        held = self.waiting.read(earlier[-1:], self.schema)
        if log is None:
            last = held.agg(F.max("ms")).first()[0]
            now = self.clock.set(batch_id, None if last is None else last + 1)
        else:
            passed = F.lit(False) if passed_ms is None else F.col("ms") < passed_ms
            seen, late = log.agg(F.max("ms"), F.count_if(passed)).first()
            if late:
                log.where(passed).write.mode("overwrite").parquet(self.late.of(batch_id))
            held = log.where(~passed).unionByName(held)
            now = self.clock.set(batch_id, None if seen is None else seen - self.lateness_ms)
        ready = F.lit(False) if now is None else F.col("ms") < now
        held.where(~ready).write.mode("overwrite").parquet(self.waiting.of(batch_id))
        for n in earlier[:-1]:
            self.waiting.drop(n)
        return held.where(ready)

    def too_late(self) -> DataFrame:
        return self.late.read(self.late.numbers(), self.schema)
