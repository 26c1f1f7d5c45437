"""Order-dependent building blocks that survive a case of any size.

Cases of ordinary size are handled by a window over the case: one shuffle. A case that
holds a large share of the log would put all its rows into one task that way, so large cases
take a second route, a prefix scan: their events are range-partitioned in the order of (case, time, tie),
so every part holds about the same number however dense the time is; each part is worked on alone and
leaves one carry row per case; the carry rows are stitched in the order of the parts.

Which cases are large is counted, not estimated. The counting is cheap where there is none: rows are first
counted by a hash of the case, combined on the map side, and a hash with few rows holds no large case.
Both routes give the same rows, and every row takes one of them. The same count says into how many
tasks the ordinary cases are dealt, so a task holds about as many rows however long the log is. The parts are written down before
they are used, so a recomputed task always sees the same cut.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import cut_lineage

EVENT_ORDER = ("ms", "tie")

#: A case is large from this many rows on; parts of large cases have about PART_ROWS. Both set the route, never the result.
LARGE_ROWS = 1_000_000
PART_ROWS = 250_000
#: Rows of ordinary cases that a task gets, about.
TASK_ROWS = 200_000
#: Hashes that rows are counted by first.
HASHES = 1 << 16
#: Large cases up to which their list is sent to every task; a longer one is joined by key.
SENT_CASES = 100_000


class Large(NamedTuple):
    """The large cases of a log, None if it has none; and the rows of the whole log."""
    keys: DataFrame | None
    sent: bool
    rows: int


#: What callers pass on: the large cases, an empty list for none, or None to have them counted.
Hot = Large | Sequence | None


def hot_cases(df: DataFrame, by: Sequence[str] = ("case",), rows: int | None = None) -> Large:
    """The groups of at least ``rows`` rows, as a table of ``by``; and the number of all rows."""
    rows, by = rows or LARGE_ROWS, list(by)
    h = F.pmod(F.xxhash64(*by), F.lit(HASHES))
    counted = df.groupBy(h.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    found = counted.agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("n") >= rows, F.col("h"))).alias("full")).first()
    full, total = found.full, found.n or 0
    if not full:
        return Large(None, True, total)
    some = df if len(full) > 1000 else df.filter(h.isin(full))
    keys = cut_lineage(some.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= rows).select(F.struct(*by).alias("__k")))
    count = keys.count()
    return Large(keys if count else None, count <= SENT_CASES, total)


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``df`` partitioned by ``keys`` in tasks of about TASK_ROWS, as it has ``rows`` rows or fewer.

    Left to the session the number of tasks is fixed or follows the bytes of the shuffle, which a log has few of.
    """
    return df.repartition(1 + rows // TASK_ROWS, *keys)


def split_hot(df: DataFrame, hot: Hot = None, by: Sequence[str] = ("case",)) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ordinary groups, partitioned by ``by``, and those of large groups if there are any."""
    hot = hot_cases(df, by) if hot is None else hot
    if not isinstance(hot, Large) or hot.keys is None:
        return dealt(df, by, hot.rows if isinstance(hot, Large) else df.count()), None
    # the keys are fields of a struct, so that a NULL key equals itself
    keys = F.broadcast(hot.keys) if hot.sent else hot.keys
    keyed = df.withColumn("__k", F.struct(*by))
    return dealt(keyed.join(keys, "__k", "left_anti").drop("__k"), by, hot.rows), keyed.join(keys, "__k", "left_semi").drop("__k")


def with_parts(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` cut into parts of about PART_ROWS along ``order``: ``slice`` rises with it. Written down."""
    parts = max(1, -(-df.count() // PART_ROWS))
    return cut_lineage(df.repartitionByRange(parts, *order).withColumn("slice", F.spark_partition_id().cast("bigint")))


def neighbours(df: DataFrame, payload: Column, keys: Sequence[str] = ("case",), order: Sequence[str] = EVENT_ORDER,
               endpoints: bool = False, hot: Hot = None, batch_of: Column | None = None) -> DataFrame:
    """Adjacent rows of every group: ``keys, prev.v, next.v``.

    With ``endpoints`` the first row of a group also appears with a NULL ``prev`` and the last
    one with a NULL ``next``, and ``alone`` tells whether the group has that single row only.
    ``batch_of`` is an aggregate: rows of equal order are first folded into one, and
    ``payload`` may refer to it as ``batch``.
    """
    cold, warm = split_hot(df, hot, keys)
    res = neighbours_ordinary(cold, payload, keys, order, endpoints, batch_of)
    return res if warm is None else res.unionByName(neighbours_hot(warm, payload, keys, order, endpoints, batch_of))


def followers(df: DataFrame, payload: Column, keys: Sequence[str] = ("case",), order: Sequence[str] = EVENT_ORDER) -> DataFrame:
    """Ordinary groups only, as ``split_hot`` gives them, one row for each: ``prev.v``, ``next.v`` (``next`` is NULL at the end), ``first``."""
    rows = _within(df, payload, list(keys), order, None)
    w = Window.partitionBy(*keys).orderBy(*_order_of(rows))
    return rows.select(*keys, F.col("item").alias("prev"), F.lead("item").over(w).alias("next"), (F.row_number().over(w) == 1).alias("first"))


def neighbours_ordinary(df: DataFrame, payload: Column, keys: Sequence[str] = ("case",), order: Sequence[str] = EVENT_ORDER,
                        endpoints: bool = False, batch_of: Column | None = None) -> DataFrame:
    """Ordinary groups only, as ``split_hot`` gives them."""
    keys = list(keys)
    return _plain(_within(df, payload, keys, order, batch_of), keys, endpoints)


def neighbours_hot(df: DataFrame, payload: Column, keys: Sequence[str] = ("case",), order: Sequence[str] = EVENT_ORDER,
                   endpoints: bool = False, batch_of: Column | None = None) -> DataFrame:
    keys = list(keys)
    sliced = with_parts(df, [*keys, *order]).repartition(*keys, "slice")
    return _sliced(_within(sliced, payload, [*keys, "slice"], order, batch_of), keys, endpoints)


def _within(parts: DataFrame, payload: Column, keys: list[str], order: Sequence[str], batch_of: Column | None) -> DataFrame:
    # Grouping by more than the partitioning keys needs no shuffle of its own.
    if batch_of is not None:
        parts = parts.groupBy(*keys, *order).agg(batch_of.alias("batch"))
    return parts.select(*keys, *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.struct(payload.alias("v")).alias("item"))


def _order_of(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c[0] == "o" and c[1:].isdigit()]


def _edges(rows: DataFrame, keys: list[str], head: str, tail: str, after: Column, first: Column, alone: Column) -> DataFrame:
    edge = F.struct(F.col(tail).alias("prev"), after.alias("next"), alone.alias("alone"))
    start = F.struct(F.when(F.lit(False), F.col(head)).alias("prev"), F.col(head).alias("next"), alone.alias("alone"))
    e = rows.select(*keys, F.explode(F.when(first, F.array(start, edge)).otherwise(F.array(edge))).alias("e"))
    return e.select(*keys, "e.prev", "e.next", "e.alone")


def _plain(rows: DataFrame, keys: list[str], endpoints: bool) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*_order_of(rows))
    rows = rows.select(*keys, F.col("item").alias("prev"), F.lead("item").over(w).alias("next"), F.row_number().over(w).alias("rn"))
    if not endpoints:
        return rows.filter(F.col("next").isNotNull()).select(*keys, "prev", "next", F.lit(False).alias("alone"))
    first = F.col("rn") == 1
    return _edges(rows, keys, "prev", "prev", F.col("next"), first, first & F.col("next").isNull())


def _sliced(rows: DataFrame, keys: list[str], endpoints: bool) -> DataFrame:
    order = _order_of(rows)
    inner = (rows.select(*keys, F.col("item").alias("prev"),
                         F.lead("item").over(Window.partitionBy(*keys, "slice").orderBy(*order)).alias("next"))
             .filter(F.col("next").isNotNull()).withColumn("alone", F.lit(False)))
    at = F.struct(*order)
    ends = rows.groupBy(*keys, "slice").agg(F.min_by("item", at).alias("head"), F.max_by("item", at).alias("tail"),
                                            F.count(F.lit(1)).alias("n"))
    across = Window.partitionBy(*keys).orderBy("slice")
    ends = ends.select(*keys, "head", "tail", "n", F.lead("head").over(across).alias("after"), F.row_number().over(across).alias("rn"))
    if endpoints:
        first = F.col("rn") == 1
        outer = _edges(ends, keys, "head", "tail", F.col("after"), first, first & F.col("after").isNull() & (F.col("n") == 1))
    else:
        outer = (ends.filter(F.col("after").isNotNull())
                 .select(*keys, F.col("tail").alias("prev"), F.col("after").alias("next"), F.lit(False).alias("alone")))
    return inner.unionByName(outer)


def running_total(df: DataFrame, value: Column, out: str, keys: Sequence[str] = ("case",), order: Sequence[str] = EVENT_ORDER,
                  exclusive: bool = False, hot: Hot = None, by: Sequence[str] = ("case",)) -> DataFrame:
    """Running sum per group of ``keys``, added to every row as ``out``. ``by`` are the keys that
    may be hot, and that the rows are partitioned on.

    Second route: the sum inside the part, plus the totals of earlier parts of the group. The
    join of the two has the key (keys, part), so no group gathers in one task.
    """
    keys, by = list(keys), list(by)
    until = lambda k: Window.partitionBy(*k).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cold, warm = split_hot(df.withColumn("__v", value), hot, by)
    less = F.col("__v") if exclusive else F.lit(0)
    res = cold.withColumn(out, F.sum("__v").over(until(keys)) - less).drop("__v")
    if warm is None:
        return res
    parts = with_parts(warm, [*by, *order]).repartition(*by, "slice")
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = (parts.groupBy(*keys, "slice").agg(F.sum("__v").alias("__t"))
              .select(*keys, "slice", F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__before")))
    summed = (parts.withColumn("__in", F.sum("__v").over(until([*keys, "slice"]))).join(before, [*keys, "slice"])
              .withColumn(out, F.col("__in") + F.col("__before") - less).drop("__v", "__in", "__before", "slice"))
    return res.unionByName(summed)


def positions(df: DataFrame, out: str = "idx", hot: Hot = None) -> DataFrame:
    """0-based position of every event in its case."""
    return running_total(df, F.lit(1).cast("bigint"), out, exclusive=True, hot=hot)
