"""Weakly-follows relations: what happens in the next batch of a case.

A batch is the set of events of one case with the same millisecond. P is followed
by S when P is in one batch and S in the next one; there are no pairs inside a batch.

Batches are collapsed to (label, count) before they are paired, so thousands of
simultaneous events cost one entry per label. A NULL label stays NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.sequence import Hot, neighbours_hot, neighbours_ordinary, split_hot


def _batch_pairs(log: DataFrame, hot: Hot) -> DataFrame:
    """One row per antecedent label x consequent label x neighbouring batches of a case."""
    cold, warm = split_hot(log, hot)
    count = lambda df: df.groupBy("case", "ms", "label").agg(F.count(F.lit(1)).alias("n"))
    # One array entry per distinct label of the batch, never one per event.
    how = {"payload": F.col("batch"), "order": ("ms",), "batch_of": F.collect_list(F.struct("label", "n"))}
    # Ordinary cases are counted after their one shuffle. A hot case is counted before it,
    # on the map side: it may have any number of events at one time.
    steps = neighbours_ordinary(count(cold), **how)
    if warm is not None:
        steps = steps.unionByName(neighbours_hot(count(warm), **how))
    return (steps.select(F.explode("prev.v").alias("p"), F.col("next.v").alias("s"))
                 .select("p", F.explode("s").alias("s")))


def weakly_follows(log: DataFrame, hot: Hot = None) -> DataFrame:
    """The set of pairs: ``event_label_p, event_label_s``."""
    return (_batch_pairs(log, hot)
            .select(F.col("p.label").alias("event_label_p"), F.col("s.label").alias("event_label_s"))
            .distinct())


def directly_follows(log: DataFrame, hot: Hot = None) -> DataFrame:
    """The bag of pairs: every antecedent x consequent combination counts one."""
    return (_batch_pairs(log, hot)
            .groupBy(F.col("p.label").alias("event_label_p"), F.col("s.label").alias("event_label_s"))
            .agg(F.sum(F.col("p.n") * F.col("s.n")).alias("frequency")))


def follows_by_sequence(df: DataFrame, case_col: str, activity_col: str, seq_col: str) -> DataFrame:
    """Pairs by an explicit position column: S is at the position after P.

    (case, position) is the join key, so the largest case is spread like any other.
    """
    side = df.select(F.struct(F.col(case_col).alias("id")).alias("case"),
                     F.col(activity_col).alias("label"), F.col(seq_col).cast("bigint").alias("seq"))
    later = side.select("case", F.col("label").alias("event_label_s"), (F.col("seq") - 1).alias("seq"))
    return (side.withColumnRenamed("label", "event_label_p").join(later, ["case", "seq"])
            .groupBy("event_label_p", "event_label_s").agg(F.count(F.lit(1)).alias("frequency")))
