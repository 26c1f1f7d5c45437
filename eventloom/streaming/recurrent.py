"""The directly-follows relation kept up to date while events arrive.

Two stages, cut like the batch operators. Stage one looks at each micro-batch alone: the
adjacent pairs inside it, and one row with the first and last event of every case in it. Stage two
keeps the last event of every case as state and joins it to the first event of the
case in the next micro-batch. State therefore sees one row per case and micro-batch,
however many events a case has.

Both stages write rows that are keyed by the micro-batch and never changed, and add what
they found to counts that are merged as they grow (``streaming.maintained``): reading the relation or the
graph opens a bounded number of folders, whatever the history.

Without ``lateness_ms`` an event that is older than the last one of its case counts as newest, as in
arrival order. With it events wait until the clock of the stream has passed them, so they are
paired by their time however they arrive; what comes later than that is set apart (``too_late``). ``close``
hands on what still waits.

With ``expire`` a pair is only formed while its first event is inside the window
(``ms_s < ms_p + interval``); otherwise the second event opens a new sequence. State leaves as soon as the
clock is past that moment. ``vacuum`` deletes the rows of micro-batches whose pairs are all dead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eventloom.operators.dfg import END, START
from eventloom.operators.log import as_log
from eventloom.operators.recurrent import Recurrent, live_events, live_pairs, pair_counts
from eventloom.operators.sequence import neighbours
from eventloom.session import scratch_path
from eventloom.streaming.maintained import Clock, Counts, Folders, Reorder


def pairs_inside(log: DataFrame) -> DataFrame:
    """Stage one on one micro-batch: its adjacent pairs."""
    steps = neighbours(log, F.struct("label", "ms"))
    return steps.select(F.col("case.id").alias("case_id"), F.col("prev.v.label").alias("p"), F.col("prev.v.ms").alias("p_ms"),
                        F.col("next.v.label").alias("s"), F.col("next.v.ms").alias("s_ms"))


def ends_of(log: DataFrame, clock_ms: int | None) -> DataFrame:
    """Stage one on one micro-batch: the first and the last event of each case, and the clock of the stream."""
    event, at = F.struct("label", "ms"), F.struct("ms", "tie")
    return (log.groupBy("case").agg(F.min_by(event, at).alias("first"), F.max_by(event, at).alias("last"))
            .select(F.col("case.id").alias("case_id"), F.col("first.label").alias("head"), F.col("first.ms").alias("head_ms"),
                    F.col("last.label").alias("tail"), F.col("last.ms").alias("tail_ms"), F.lit(clock_ms).cast("bigint").alias("clock")))


def _stitcher(interval_ms: int, expire: bool):
    taken = ["batch", "head", "head_ms", "tail", "tail_ms"]
    columns = ["case_id", "kind", "p", "p_ms", "s", "s_ms"]

    def stitch(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        out = []
        # a group has a row or two: work on frames would cost more than all else
        rows = (r for f in frames for r in zip(*(f[c].tolist() for c in taken)))
        for batch, head, head_ms, tail, tail_ms in sorted(rows, key=lambda r: r[0]):
            if last is not None and batch <= last[2]:
                continue  # a replayed micro-batch
            head_ms = int(head_ms)
            if last is None or (expire and head_ms >= last[1] + interval_ms):
                out.append((key[0], "start", None, None, head, head_ms))
            else:
                out.append((key[0], "pair", last[0], last[1], head, head_ms))
            last = (tail, int(tail_ms), int(batch))
        if last is not None:
            state.update(last)
            if expire:
                if last[1] + interval_ms > state.getCurrentWatermarkMs():
                    state.setTimeoutTimestamp(last[1] + interval_ms)
                else:
                    state.remove()
        if out:
            # a missing number must not turn the others into floats
            yield pd.DataFrame({c: pd.Series(v, dtype=object) if c.endswith("_ms") else list(v) for c, v in zip(columns, zip(*out))})

    return stitch


class FollowsStream:
    """Runs both stages and reads the tables they leave.

    ``source`` is a streaming DataFrame; ``root`` a folder all executors share (a fresh one
    below the checkpoint folder by default).
    """

    def __init__(self, spark: SparkSession, source: DataFrame, case_col: str, activity_col: str, ts_col: str,
                 tiebreak=None, interval_ms: int = 7000, expire: bool = False, root: str | None = None, lateness_ms: int | None = None):
        self.spark, self.source = spark, source
        self.log_args = (case_col, activity_col, ts_col, tiebreak)
        self.interval_ms, self.expire = interval_ms, expire
        self.root = root or scratch_path(spark, "follows")
        field = lambda name, kind: T.StructField(name, kind)
        text, number = T.StringType(), T.LongType()
        case = field("case_id", source.schema[case_col].dataType)
        pair = [case, field("p", text), field("p_ms", number), field("s", text), field("s_ms", number)]
        self.pair_schema = T.StructType(pair)
        self.stitched_schema = T.StructType([case, field("kind", text), *pair[1:]])
        self.ends_schema = T.StructType([case, field("head", text), field("head_ms", number), field("tail", text), field("tail_ms", number),
                                         field("clock", number)])
        folders = lambda name: Folders(spark, f"{self.root}/{name}", "batch")
        self.inside, self.ends, self.stitched = folders("inside"), folders("ends"), folders("stitched")
        edge = T.StructType([field("event_label_p", text), field("event_label_s", text), field("edge", text), field("batch", number), field("newest", number)])
        self.counts = [Counts(spark, f"{self.root}/counts/{name}", edge) for name in ("inside", "stitched")]
        self.reorder = None
        self.clock = Clock(spark, f"{self.root}/clock")
        if lateness_ms is not None:
            log = as_log(spark.createDataFrame([], source.schema), *self.log_args)
            self.reorder = Reorder(spark, f"{self.root}/order", lateness_ms, log.schema)
            self.clock = self.reorder.clock

    # -- running ---------------------------------------------------------------------

    def _dead(self):
        """Pairs whose second event came after the first had left the window."""
        return (F.col("s_ms") >= F.col("p_ms") + self.interval_ms) if self.expire else F.lit(False)

    def _changes(self, number: int, rows: DataFrame, opened: DataFrame | None, closed: DataFrame | None) -> DataFrame:
        """Changes of relation and graph (``edge``: pair, start, end), and the newest first event of the micro-batch's pairs."""
        none, long = F.lit(None).cast("string"), F.lit(None).cast("bigint")

        def row(df, p, s, edge, n):
            return df.select(p.alias("event_label_p"), s.alias("event_label_s"), F.lit(edge).alias("edge"), long.alias("batch"), long.alias("newest"),
                             F.lit(n).cast("bigint").alias("n"))

        live, cut = rows.where(~self._dead()), rows.where(self._dead())
        parts = [row(live, F.col("p"), F.col("s"), "pair", 1)]
        if self.expire:
            parts += [row(cut, F.col("p"), none, "end", 1), row(cut, none, F.col("s"), "start", 1)]
        if closed is not None:
            parts.append(row(closed, F.col("tail"), none, "end", 1))
        if opened is not None:
            # the end of a case moves on with every micro-batch that extends it
            parts += [row(opened, none, F.col("s"), "start", 1), row(live, F.col("p"), none, "end", -1)]
        parts.append(rows.agg(F.max("p_ms").alias("newest")).where("newest is not null").select(
            none.alias("event_label_p"), none.alias("event_label_s"), F.lit("newest").alias("edge"), F.lit(number).cast("bigint").alias("batch"),
            "newest", F.lit(1).cast("bigint").alias("n")))
        return reduce(DataFrame.unionByName, parts)

    def _first(self, number: int, log: DataFrame | None) -> None:
        if self.ends.has(number):
            return  # replayed after all was written
        if self.reorder:
            log = self.reorder.take(number, log)
            now = self.clock.before(number + 1)
        else:
            now = self.clock.set(number, log.agg(F.max("ms")).first()[0]) if self.expire else None
        pairs_inside(log).write.mode("overwrite").parquet(self.inside.of(number))
        ends = ends_of(log, now).persist()
        self.counts[0].add(number, self._changes(number, self.inside.read([number], self.pair_schema), None, ends))
        ends.write.mode("overwrite").parquet(self.ends.of(number))
        ends.unpersist()

    def _first_stage(self):
        def summarise(batch: DataFrame, batch_id: int) -> None:
            batch = batch.persist()
            self._first(2 * batch_id, as_log(batch, *self.log_args))
            batch.unpersist()

        return (self.source.writeStream.foreachBatch(summarise)
                .option("checkpointLocation", f"{self.root}/state/steps"))

    def _second_stage(self):
        kind = T.StructType([*self.ends_schema.fields, T.StructField("batch", T.LongType())])
        ends = self.spark.readStream.schema(kind).parquet(f"{self.root}/ends")
        timeout = GroupStateTimeout.NoTimeout
        if self.expire:
            # all rows of a micro-batch bear its clock, which never goes back, so none is late
            ends = ends.withColumn("at", F.timestamp_millis("clock")).withWatermark("at", "1 millisecond")
            timeout = GroupStateTimeout.EventTimeTimeout
        joined = ends.groupBy("case_id").applyInPandasWithState(
            _stitcher(self.interval_ms, self.expire), self.stitched_schema, "label string, ms bigint, batch bigint", "append", timeout)

        def keep(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(self.stitched.of(batch_id))
            rows = self.stitched.read([batch_id], self.stitched_schema)
            self.counts[1].add(batch_id, self._changes(batch_id, rows.where("kind = 'pair'"), rows.where("kind = 'start'"), None))

        return joined.writeStream.foreachBatch(keep).option("checkpointLocation", f"{self.root}/state/stitched")

    def run_available(self) -> "FollowsStream":
        """Works off everything that has arrived, then stops."""
        self._first_stage().trigger(availableNow=True).start().awaitTermination()
        self._second_stage().trigger(availableNow=True).start().awaitTermination()
        return self

    def close(self) -> "FollowsStream":
        """Hands on the events that wait for later ones, as if the clock were past them; the stream may go on after it."""
        if self.reorder:
            self._first(max(self.ends.numbers(), default=-2) // 2 * 2 + 1, None)
            self._second_stage().trigger(availableNow=True).start().awaitTermination()
        return self

    def start(self, interval: str = "5 seconds"):
        """Keeps both stages running; returns the two queries."""
        first = self._first_stage().trigger(processingTime=interval).start()
        second = self._second_stage().trigger(processingTime=interval).start()
        return first, second

    def vacuum(self, now_ms: int) -> int:
        """Deletes the pairs of micro-batches that are all dead at ``now_ms``; counts stay. Returns the number of folders."""
        dropped = 0
        for which, folder in enumerate((self.inside, self.stitched)):
            dead = {r.batch for r in self._newest(which).where(F.col("newest") + self.interval_ms <= now_ms).collect()} & set(folder.numbers())
            for n in dead:
                folder.drop(n)
            dropped += len(dead)
        return dropped

    # -- reading ---------------------------------------------------------------------

    def _newest(self, which: int) -> DataFrame:
        return self.counts[which].read().where("edge = 'newest'").select("batch", "newest")

    def _folders(self, which: int, folder: Folders, now_ms: int | None) -> list[int]:
        """Micro-batches that may hold live pairs: their number follows the window, not the history."""
        there = folder.numbers()
        if now_ms is None:
            return there
        live = self._newest(which).where(F.col("newest") + self.interval_ms > now_ms)
        return sorted({r.batch for r in live.collect()} & set(there))

    def _all_pairs(self, now_ms: int | None = None) -> DataFrame:
        inside = self.inside.read(self._folders(0, self.inside, now_ms), self.pair_schema)
        stitched = self.stitched.read(self._folders(1, self.stitched, now_ms), self.stitched_schema).where("kind = 'pair'").drop("kind")
        return inside.unionByName(stitched)

    def pairs(self, now_ms: int | None = None) -> DataFrame:
        """All pairs with the moments they expire; those alive at ``now_ms`` if it is given."""
        rows = self._all_pairs(now_ms).where(~self._dead())
        out = rows.select(F.col("case_id").alias("caseid"), F.col("p").alias("event_label_p"), F.col("s").alias("event_label_s"),
                          (F.col("p_ms") + self.interval_ms).alias("delete_time_p"), (F.col("s_ms") + self.interval_ms).alias("delete_time_s"))
        return out if now_ms is None else live_pairs(out, now_ms)

    def starts(self) -> DataFrame:
        """Events that opened a sequence."""
        opened = self.stitched.read(self.stitched.numbers(), self.stitched_schema).where("kind = 'start'").select("case_id", "s", "s_ms")
        opened = opened.unionByName(self._all_pairs().where(self._dead()).select("case_id", "s", "s_ms"))
        return opened.select(F.col("case_id").alias("caseid"), F.col("s").alias("event_label"),
                             (F.col("s_ms") + self.interval_ms).alias("delete_time"))

    def last_events(self) -> DataFrame:
        ends = self.spark.read.schema(T.StructType([*self.ends_schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{self.root}/ends")
        return (ends.groupBy("case_id").agg(F.max_by(F.struct("tail", "tail_ms"), "batch").alias("e"))
                .select(F.col("case_id").alias("caseid"), F.col("e.tail").alias("event_label"),
                        (F.col("e.tail_ms") + self.interval_ms).alias("delete_time")))

    def too_late(self) -> DataFrame:
        """Events that came later than allowed, as a log."""
        if not self.reorder:
            raise ValueError("without lateness_ms no event is too late")
        return self.reorder.too_late()

    def _sums(self) -> DataFrame:
        return self.counts[0].read().unionByName(self.counts[1].read())

    def relation(self) -> DataFrame:
        """``event_label_p, event_label_s, frequency`` of all pairs so far, from the merged counts alone."""
        pairs = self._sums().where("edge = 'pair'")
        return pairs.groupBy("event_label_p", "event_label_s").agg(F.sum("n").alias("frequency")).where("frequency <> 0")

    def snapshot(self, now_ms: int | None = None) -> Recurrent:
        """The relation and its tables, as of ``now_ms`` when given."""
        pairs, starts, lasts = self.pairs(now_ms), self.starts(), self.last_events()
        if now_ms is None:
            return Recurrent(self.relation(), starts, lasts, pairs)
        return Recurrent(pair_counts(pairs), live_events(starts, now_ms), live_events(lasts, now_ms), pairs)

    def graph(self) -> DataFrame:
        """Relation with start and end edges, from the merged counts alone."""
        side = lambda edge, name, label: F.when(F.col("edge") == edge, F.lit(name)).otherwise(F.col(label)).alias(label)
        return (self._sums().where("edge <> 'newest'").groupBy(side("start", START, "event_label_p"), side("end", END, "event_label_s"))
                .agg(F.sum("n").alias("frequency")).where("frequency <> 0"))


def sliding_counts(pairs: DataFrame, ms_col: str, window: str, slide: str, watermark: str | None = None) -> DataFrame:
    """Pair counts per sliding window of event time; works on a static or streaming frame.

    On a stream the watermark bounds how late a pair may be, and windows behind it leave
    the state.
    """
    timed = pairs.withColumn("at", F.timestamp_millis(F.col(ms_col)))
    if watermark:
        timed = timed.withWatermark("at", watermark)
    return (timed.groupBy(F.window("at", window, slide).alias("w"), "event_label_p", "event_label_s")
            .agg(F.count(F.lit(1)).alias("frequency"))
            .select(F.unix_millis("w.start").alias("window_start"), "event_label_p", "event_label_s", "frequency"))
