"""Declare-style constraint counts, seven measures in one relation.

For events x and labels y != x of a log:

=================  ==========================================================
OCCURRENCE         events x (row (x, x))
NO FOLLOWING       x events with no later y in the case
NO PRECEDING       x events with no earlier y in the case
NO COOCCURRING     x events in cases without any y
DIRECTLY FOLLOWS   adjacent pairs by sequence
REPETITION         x events whose next event among {x, y} is x, with a y later on
REPETITION BACK    x events whose previous event among {x, y} is x, with a y earlier
=================  ==========================================================

Two plans give the same rows. With few labels, every event gets one column per label (where that label was seen last,
first and finally in the case) from a single pass over the sorted case. With many labels, events are joined
to the labels of their case instead. Either way events are only paired with labels present in their case; for the others the
count follows from the total: ``no y at all = occurrences - events sharing a case
with y``. Zero counts give no row. Events without a label are left out. The order of
events (ms, tie) has to be unique within a case.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.dfg import dfg
from eventloom.operators.sequence import Hot, hot_cases, split_hot, with_parts

# The measure names of the relation.
OCCURRENCE = "OCCURRENCE"
NO_FOLLOWING = "NO FOLLOWING"
NO_PRECEDING = "NO PRECEDING"
NO_COOCCURRING = "NO COOCCURRING"
DIRECTLY_FOLLOWS = "DIRECTLY FOLLOWS"
REPETITION = "REPETITION"
REPETITION_BACK = "REPETITION BACK"


#: Up to this many labels get a column each.
MAX_LABEL_COLUMNS = 64

_KEYS = ["case", "lo", "hi"]


def _one(c: Column) -> Column:
    return F.when(c, 1).otherwise(0).cast("bigint")


def _beside_labels(events: DataFrame, spans: DataFrame, on: list[str]) -> DataFrame:
    """Each event x beside every other label y of its case, with y's first and last place."""
    return (events.withColumnRenamed("label", "x").join(spans, on).filter(F.col("x") != F.col("y"))
            .withColumn("lo", F.least("x", "y")).withColumn("hi", F.greatest("x", "y")))


def _spans(events: DataFrame) -> DataFrame:
    return events.groupBy("case", F.col("label").alias("y")).agg(F.min("at").alias("f"), F.max("at").alias("l"))


def _counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("at")
    nx, pv = F.lead("x").over(w), F.lag("x").over(w)
    return rows.select(
        "x", "y", F.lit(1).cast("bigint").alias("co"), _one(F.col("l") < F.col("at")).alias("nf"), _one(F.col("f") > F.col("at")).alias("np"),
        _one((nx == F.col("x")) & (F.col("l") > F.col("at"))).alias("rp"),
        _one((pv == F.col("x")) & (F.col("f") < F.col("at"))).alias("rb"))


def _ordinary_cases(log: DataFrame) -> DataFrame:
    """All steps are partitioned by the case: one shuffle, of the events themselves."""
    w = Window.partitionBy("case").orderBy("ms", "tie")
    events = log.select("case", "label", F.row_number().over(w).cast("bigint").alias("at"))
    return _counts(_beside_labels(events, _spans(events), ["case"]), _KEYS)


def _hot_cases(log: DataFrame) -> DataFrame:
    """As above inside time slices, plus the neighbours that sit in different slices."""
    w = Window.partitionBy("case", "slice").orderBy("ms", "tie")
    # Place in the case as one number: the slice, then the place within it.
    at = F.shiftleft("slice", 32) + F.row_number().over(w)
    events = with_parts(log, ["case", "ms", "tie"]).repartition("case", "slice").select("case", "slice", "label", at.alias("at"))
    # The label spans are laid out per slice, so that the wide join has the key (case, slice).
    per_slice = events.select("case", "slice").distinct().join(_spans(events), "case")
    rows = _beside_labels(events, per_slice, ["case", "slice"])
    inner = _counts(rows, [*_KEYS, "slice"])
    edge = F.struct("x", "y", (F.col("l") > F.col("at")).alias("y_later"), (F.col("f") < F.col("at")).alias("y_before"))
    ends = rows.groupBy(*_KEYS, "slice").agg(F.min_by(edge, "at").alias("head"), F.max_by(edge, "at").alias("tail"))
    across = Window.partitionBy(*_KEYS).orderBy("slice")
    ends = ends.select("head", "tail", F.lead("head").over(across).alias("after"), F.lag("tail").over(across).alias("before"))
    zero = F.lit(0).cast("bigint")

    def stitched(me, other, flag, to):
        hit = _one((F.col(f"{me}.x") == F.col(f"{other}.x")) & F.col(f"{me}.{flag}"))
        return F.struct(F.col(f"{me}.x").alias("x"), F.col(f"{me}.y").alias("y"),
                        *[(hit if c == to else zero).alias(c) for c in ("co", "nf", "np", "rp", "rb")])

    outer = (ends.select(F.explode(F.array(stitched("tail", "after", "y_later", "rp"), stitched("head", "before", "y_before", "rb"))).alias("e"))
             .select("e.*").filter((F.col("rp") > 0) | (F.col("rb") > 0)))
    return inner.unionByName(outer)


def _occurrences(log: DataFrame) -> tuple[DataFrame, list[str] | None]:
    """``x, n`` of every label; and the labels, unless there are too many for one column each."""
    counted = log.groupBy(F.col("label").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    rows = counted.limit(MAX_LABEL_COLUMNS + 1).collect()
    if len(rows) > MAX_LABEL_COLUMNS:
        return counted, None
    return log.sparkSession.createDataFrame(rows, counted.schema), sorted(r.x for r in rows)


def _grid(occ: DataFrame) -> DataFrame:
    """Every ordered pair of labels, as the result has a row for each: the alphabet is unrolled beside each label."""
    labels = occ.agg(F.collect_list("x")).scalar()
    return occ.withColumn("y", F.explode(labels)).where(F.col("x") != F.col("y"))


def _at_label(labels: list[str]) -> list[Column]:
    return [F.when(F.col("label") == y, F.col("at")) for y in labels]


def _from_columns(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Counts from p (last place before the event), f and l (first and last place in the case) of every label.

    Adjacent x of the {x, y} projection are the events whose own label was seen after y: those with a y
    before them are REPETITION BACK. For REPETITION, add the ones before the first y and take off
    the ones after the last.
    """
    own = F.coalesce(*[F.when(F.col("label") == y, F.col(f"p{j}")) for j, y in enumerate(labels)])
    per_label = F.array(*[F.struct(F.lit(y).alias("y"), F.col(f"p{j}").alias("p"), F.col(f"f{j}").alias("f"), F.col(f"l{j}").alias("l"))
                          for j, y in enumerate(labels)])
    wide = (rows.select(F.col("label").alias("x"), "at", own.alias("own"), F.explode(per_label).alias("e")).select("x", "at", "own", "e.*")
            .filter(F.col("l").isNotNull() & (F.col("x") != F.col("y"))))
    back = _one(F.col("own") > F.col("p"))
    before_y = _one((F.col("f") > F.col("at")) & F.col("own").isNotNull())
    after_y = _one(F.col("own") > F.col("l"))
    return wide.select("x", "y", F.lit(1).cast("bigint").alias("co"), _one(F.col("l") < F.col("at")).alias("nf"),
                       _one(F.col("f") > F.col("at")).alias("np"), (back + before_y - after_y).alias("rp"), back.alias("rb"))


def _columns_ordinary(log: DataFrame, labels: list[str]) -> DataFrame:
    w = Window.partitionBy("case").orderBy("ms", "tie")
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    events = log.withColumn("at", F.row_number().over(w).cast("bigint"))
    here = _at_label(labels)
    return events.select("label", "at", *[F.max(c).over(so_far).alias(f"p{j}") for j, c in enumerate(here)],
                         *[F.min(c).over(whole).alias(f"f{j}") for j, c in enumerate(here)],
                         *[F.max(c).over(whole).alias(f"l{j}") for j, c in enumerate(here)])


def _columns_hot(log: DataFrame, labels: list[str]) -> DataFrame:
    """As above inside time slices; what earlier slices and the whole case add comes from one row per slice."""
    w = Window.partitionBy("case", "slice").orderBy("ms", "tie")
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    events = with_parts(log, ["case", "ms", "tie"]).repartition("case", "slice").withColumn("at", F.shiftleft("slice", 32) + F.row_number().over(w))
    here, n = _at_label(labels), range(len(labels))
    ends = events.groupBy("case", "slice").agg(*[F.min(c).alias(f"lo{j}") for j, c in enumerate(here)],
                                               *[F.max(c).alias(f"hi{j}") for j, c in enumerate(here)])
    order = Window.partitionBy("case").orderBy("slice")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("case", "slice", *[F.max(f"hi{j}").over(earlier).alias(f"c{j}") for j in n],
                       *[F.min(f"lo{j}").over(whole).alias(f"f{j}") for j in n], *[F.max(f"hi{j}").over(whole).alias(f"l{j}") for j in n])
    inside = events.select("case", "slice", "label", "at", *[F.max(c).over(so_far).alias(f"q{j}") for j, c in enumerate(here)])
    return inside.join(ends, ["case", "slice"]).select(
        "label", "at", *[F.greatest(f"q{j}", f"c{j}").alias(f"p{j}") for j in n], *[f"f{j}" for j in n], *[f"l{j}" for j in n])


def _pair_counts(log: DataFrame, labels: list[str] | None, hot: Hot) -> DataFrame:
    """Per (x, y): shared events, and the four counts that depend on places."""
    cold, warm = split_hot(log, hot)
    if labels:
        rows = _columns_ordinary(cold, labels)
        if warm is not None:
            rows = rows.unionByName(_columns_hot(warm, labels))
        rows = _from_columns(rows, labels)
    else:
        rows = _ordinary_cases(cold)
        if warm is not None:
            rows = rows.unionByName(_hot_cases(warm))
    return rows.groupBy("x", "y").agg(*[F.sum(c).alias(c) for c in ("co", "nf", "np", "rp", "rb")])


def controller(log: DataFrame, hot: Hot = None) -> DataFrame:
    """``type, event_label_p, event_label_s, frequency``."""
    log = log.filter(F.col("label").isNotNull())
    hot = hot_cases(log) if hot is None else hot
    occ, labels = _occurrences(log)
    pairs = _pair_counts(log, labels, hot)
    full = _grid(occ).join(pairs, ["x", "y"], "left").fillna(0, ["co", "nf", "np", "rp", "rb"])
    alone = F.col("n") - F.col("co")
    kinds = F.array(*[F.struct(F.lit(k).alias("type"), v.alias("frequency")) for k, v in (
        (NO_FOLLOWING, alone + F.col("nf")), (NO_PRECEDING, alone + F.col("np")), (NO_COOCCURRING, alone),
        (REPETITION, F.col("rp")), (REPETITION_BACK, F.col("rb")))])
    measures = (full.select("x", "y", F.explode(kinds).alias("k"))
                .select("k.type", F.col("x").alias("event_label_p"), F.col("y").alias("event_label_s"), "k.frequency")
                .filter(F.col("frequency") != 0))
    counts = occ.select(F.lit(OCCURRENCE).alias("type"), F.col("x").alias("event_label_p"),
                        F.col("x").alias("event_label_s"), F.col("n").alias("frequency"))
    steps = dfg(log, with_endpoints=False, hot=hot).select(
        F.lit(DIRECTLY_FOLLOWS).alias("type"), "event_label_p", "event_label_s", "frequency")
    return counts.unionByName(steps).unionByName(measures)
