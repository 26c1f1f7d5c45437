"""Directly-follows relation over a sliding window of time: load, expiry, refresh.

A pair lives from its arrival until ``time of its first event + interval``; it is dead
as soon as that moment is <= now. ``now`` is always a parameter. Where the incremental
side (``streaming.recurrent``) appends pairs, the relation is derived from the pairs and
never updated in place, so replaying a batch cannot count it twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.sequence import Hot, neighbours


class Recurrent(NamedTuple):
    dfr: DataFrame
    start_event: DataFrame
    last_event: DataFrame
    to_delete_event: DataFrame


def between(log: DataFrame, from_ms: int | None, to_ms: int | None) -> DataFrame:
    """Events of a period, both ends included."""
    if from_ms is not None:
        log = log.filter(F.col("ms") >= from_ms)
    if to_ms is not None:
        log = log.filter(F.col("ms") <= to_ms)
    return log


def pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("event_label_p", "event_label_s").agg(F.count(F.lit(1)).alias("frequency"))


def bootstrap(log: DataFrame, interval_ms: int, from_ms: int | None = None, to_ms: int | None = None,
              hot: Hot = None) -> Recurrent:
    """The four tables of a first load over the period."""
    log = between(log, from_ms, to_ms)
    steps = neighbours(log, F.struct("label", "ms"), hot=hot)
    pairs = steps.select(F.col("case.id").alias("caseid"),
                         F.col("prev.v.label").alias("event_label_p"), F.col("next.v.label").alias("event_label_s"),
                         (F.col("prev.v.ms") + interval_ms).alias("delete_time_p"),
                         (F.col("next.v.ms") + interval_ms).alias("delete_time_s"))
    at = F.struct("ms", "tie")

    def edge(pick):
        return (log.groupBy(F.col("case.id").alias("caseid")).agg(pick(F.struct("label", "ms"), at).alias("e"))
                .select("caseid", F.col("e.label").alias("event_label"), (F.col("e.ms") + interval_ms).alias("delete_time")))

    return Recurrent(pair_counts(pairs), edge(F.min_by), edge(F.max_by), pairs)


def live_pairs(pairs: DataFrame, now_ms: int) -> DataFrame:
    return pairs.filter(F.col("delete_time_p") > now_ms)


def live_events(events: DataFrame, now_ms: int) -> DataFrame:
    """First or last events that are still inside the window."""
    return events.filter(F.col("delete_time") > now_ms)


def refresh_starts(start_event: DataFrame, pairs: DataFrame, now_ms: int) -> DataFrame:
    """The oldest live event of each case becomes its start event.

    Divergence: the trigger-based original takes the newest one. Cases without a live pair
    keep their start event as long as it lives.
    """
    oldest = (pairs.filter(F.col("delete_time_s") > now_ms)
              .select("caseid", F.explode(F.array(
                  F.struct(F.col("delete_time_p").alias("t"), F.col("event_label_p").alias("l")),
                  F.struct(F.col("delete_time_s").alias("t"), F.col("event_label_s").alias("l")))).alias("e"))
              .filter(F.col("e.t") > now_ms)
              .groupBy(F.struct(F.col("caseid").alias("id")).alias("k")).agg(F.min("e").alias("e")))
    keyed = live_events(start_event, now_ms).select(F.struct(F.col("caseid").alias("id")).alias("k"), "event_label", "delete_time")
    return (keyed.join(oldest, "k", "full")
            .select(F.col("k.id").alias("caseid"),
                    F.coalesce(F.col("e.l"), F.col("event_label")).alias("event_label"),
                    F.coalesce(F.col("e.t"), F.col("delete_time")).alias("delete_time")))


def expire(state: Recurrent, now_ms: int) -> Recurrent:
    """The four tables as they stand after expiry at ``now_ms``."""
    pairs = live_pairs(state.to_delete_event, now_ms)
    return Recurrent(pair_counts(pairs), refresh_starts(state.start_event, state.to_delete_event, now_ms),
                     live_events(state.last_event, now_ms), pairs)
