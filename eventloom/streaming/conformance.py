"""Counting rules checked while events arrive.

Stage one takes each micro-batch alone, with the batch operators: the balance of every rule after every event that
tries one, counted from the start of the micro-batch, and the totals of every case. Stage two keeps the totals of a case as
state and hands each micro-batch the balances it starts from; it sees one row per case and micro-batch, however
many events a case has. Its output meets the balances of the same micro-batches only, which gives the violations in
them. Stage three keeps the rules reported of each case as state and hands on those that are new: the violations
are the output of the stream, each once and never taken back.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eventloom.operators.log import as_log
from eventloom.operators.rules import Rule, reported, rule_states, totals
from eventloom.session import scratch_path
from eventloom.streaming.maintained import Folders


def _group_rows(frames: Iterable[pd.DataFrame], *columns: str) -> list[tuple]:
    """The rows of a group, which are few, as tuples ordered by the first column. Work on frames would cost more than the rows."""
    return sorted((r for f in frames for r in zip(*(f[c].tolist() for c in columns))), key=lambda r: r[0])


def _carry_totals(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    sums, events, last = state.get if state.exists else (None, 0, -1)
    out = []
    for batch, totals_of, events_of in _group_rows(frames, "batch", "totals", "events"):
        if batch <= last:
            continue  # a replayed micro-batch
        added = [int(t) for t in totals_of]
        sums = [0] * len(added) if sums is None else list(sums)
        out.append((key[0], sums, int(events), int(batch)))
        sums, events, last = [a + b for a, b in zip(sums, added)], events + int(events_of), int(batch)
    if out:
        state.update((sums, int(events), int(last)))
        yield pd.DataFrame(out, columns=["case_id", "totals", "events", "batch"])


def _only_new(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known = set(state.get[0]) if state.exists else set()
    new = {}
    for idx, rule_id in _group_rows(frames, "idx", "rule_id"):
        if rule_id not in known:
            new.setdefault(int(rule_id), int(idx))
    if new:
        state.update((sorted(known | set(new)),))
        yield pd.DataFrame({"case_id": [key[0]] * len(new), "idx": list(new.values()), "rule_id": list(new)})


class ConformanceStream:
    """Runs the stages over a streaming DataFrame; ``violations`` is what they have put out."""

    def __init__(self, spark: SparkSession, source: DataFrame, case_col: str, activity_col: str, ts_col: str, tiebreak,
                 rules: Iterable[Rule], root: str | None = None):
        self.spark, self.source, self.rules = spark, source, list(rules)
        self.log_args = (case_col, activity_col, ts_col, tiebreak)
        self.root = root or scratch_path(spark, "rules")
        field, number = T.StructField, T.LongType()
        case = field("case_id", source.schema[case_col].dataType)
        self.totals_schema = T.StructType([case, field("totals", T.ArrayType(number)), field("events", number), field("batch", number)])
        self.checks_schema = T.StructType([case, field("label", T.StringType()), field("idx", number), field("balances", T.ArrayType(number))])
        self.found_schema = T.StructType([case, field("idx", number), field("rule_id", T.IntegerType())])
        folders = lambda name: Folders(spark, f"{self.root}/{name}", "batch")
        self.checks, self.totals, self.found, self.output = folders("checks"), folders("totals"), folders("found"), folders("violations")

    def _summarise(self, batch: DataFrame, batch_id: int) -> None:
        if self.totals.has(batch_id):
            return  # replayed after all was written
        log = as_log(batch, *self.log_args).persist()
        tried = sorted({label for r in self.rules for label in r.attached})
        states = rule_states(log, self.rules).where(F.col("label").isin(tried))
        states.select(F.col("case.id").alias("case_id"), "label", "idx", "balances").write.mode("overwrite").parquet(self.checks.of(batch_id))
        (totals(log, self.rules, "case").select(F.col("case.id").alias("case_id"), "totals", "events")
         .write.mode("overwrite").parquet(self.totals.of(batch_id)))
        log.unpersist()

    def _compare(self, bases: DataFrame, batch_id: int) -> None:
        """The violations of the micro-batches that ``bases`` has the starting balances of."""
        bases = bases.persist()
        parts = [self.checks.read([r.batch], self.checks_schema).withColumn("batch", F.lit(r.batch)) for r in bases.select("batch").distinct().collect()]
        empty = self.checks.read([], self.checks_schema).withColumn("batch", F.lit(0).cast("bigint"))
        checks = empty
        for p in parts:
            checks = checks.unionByName(p)
        key = [F.struct(F.col("case_id").alias("id")).alias("case"), F.col("batch").cast("bigint").alias("batch")]
        at = checks.select(*key, "label", "idx", "balances").join(bases.select(*key, F.col("totals").alias("base"), F.col("events").alias("before")), ["case", "batch"])
        states = at.select("case", "label", (F.col("idx") + F.col("before")).alias("idx"), F.zip_with("balances", "base", lambda a, b: a + b).alias("balances"))
        (reported(states, self.rules).groupBy("case", "rule_id").agg(F.min("idx").alias("idx"))
         .select(F.col("case.id").alias("case_id"), "idx", "rule_id").write.mode("overwrite").parquet(self.found.of(batch_id)))
        bases.unpersist()

    def _stages(self):
        def stateful(df: DataFrame, work, schema: T.StructType, state: str) -> DataFrame:
            return df.groupBy("case_id").applyInPandasWithState(work, schema, state, "append", GroupStateTimeout.NoTimeout)

        def query(df: DataFrame, each, name: str):
            return df.writeStream.foreachBatch(each).option("checkpointLocation", f"{self.root}/state/{name}")

        yield query(self.source, self._summarise, "checks")
        sums = self.spark.readStream.schema(self.totals_schema).parquet(f"{self.root}/totals")
        yield query(stateful(sums, _carry_totals, self.totals_schema, "totals array<bigint>, events bigint, batch bigint"), self._compare, "bases")
        found = self.spark.readStream.schema(self.found_schema).parquet(f"{self.root}/found")
        yield query(stateful(found, _only_new, self.found_schema, "rules array<int>"),
                    lambda rows, batch_id: rows.write.mode("overwrite").parquet(self.output.of(batch_id)), "violations")

    def run_available(self) -> "ConformanceStream":
        """Works off everything that has arrived, then stops."""
        for stage in self._stages():
            stage.trigger(availableNow=True).start().awaitTermination()
        return self

    def start(self, interval: str = "5 seconds"):
        """Keeps the stages running; returns the queries."""
        return [stage.trigger(processingTime=interval).start() for stage in self._stages()]

    def violations(self) -> DataFrame:
        """``case_id, idx, rule_id``: each rule's first violation in each case, as put out so far."""
        return self.output.read(self.output.numbers(), self.found_schema)
