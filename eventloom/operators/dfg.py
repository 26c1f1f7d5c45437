"""Directly-follows graph: adjacent events by sequence, with start and end edges.

Simultaneous events are ordered by the tiebreak of the log; contrast ``follows``,
which treats them as one batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.sequence import Hot, followers, neighbours, neighbours_hot, split_hot

# The pseudo-labels of the relation.
START, END = "START", "END"


def dfg(log: DataFrame, with_endpoints: bool = True, start_for_singletons: bool = True,
        start: str = START, end: str = END, hot: Hot = None) -> DataFrame:
    """``event_label_p, event_label_s, frequency``.

    ``start_for_singletons=False`` gives the variant in which a case of one event has an
    end edge only.
    """
    if not with_endpoints:
        steps = neighbours(log, F.col("label"), hot=hot)
        return (steps.groupBy(F.col("prev.v").alias("event_label_p"), F.col("next.v").alias("event_label_s"))
                .agg(F.count(F.lit(1)).alias("frequency")))
    cold, warm = split_hot(log, hot)
    counted = _count_ordinary(cold)
    if warm is not None:
        counted = counted.unionByName(_count_hot(warm))
    if not start_for_singletons:
        counted = counted.filter(~(F.col("alone") & F.col("opens")))
    return (counted.groupBy(F.when(F.col("opens"), F.lit(start)).otherwise(F.col("p")).alias("event_label_p"),
                            F.when(F.col("closes"), F.lit(end)).otherwise(F.col("s")).alias("event_label_s"))
            .agg(F.sum("n").alias("frequency")))


def _count_ordinary(log: DataFrame) -> DataFrame:
    """Edges counted first; the start edges are then read off the counts, not off the events."""
    steps = followers(log, F.col("label"))
    ends = F.col("next").isNull()
    counted = (steps.groupBy(F.col("prev.v").alias("p"), F.col("next.v").alias("s"), ends.alias("closes"), "first")
               .agg(F.count(F.lit(1)).alias("n")))
    alone = F.col("first") & F.col("closes")
    edge = F.struct("p", "s", F.lit(False).alias("opens"), "closes", alone.alias("alone"))
    opening = F.struct(F.lit(None).cast("string").alias("p"), F.col("p").alias("s"), F.lit(True).alias("opens"),
                       F.lit(False).alias("closes"), alone.alias("alone"))
    return counted.select("n", F.explode(F.when(F.col("first"), F.array(edge, opening)).otherwise(F.array(edge))).alias("e")).select("n", "e.*")


def _count_hot(log: DataFrame) -> DataFrame:
    steps = neighbours_hot(log, F.col("label"), endpoints=True)
    return (steps.groupBy(F.col("prev.v").alias("p"), F.col("next.v").alias("s"), F.col("prev").isNull().alias("opens"),
                          F.col("next").isNull().alias("closes"), "alone").agg(F.count(F.lit(1)).alias("n")))
