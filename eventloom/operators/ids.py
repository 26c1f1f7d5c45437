"""Gap-free numbers over a whole table, without one task seeing all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import cut_lineage


def assign_ids(df: DataFrame, order: Sequence[Column | str], out: str = "id", start: int = 1, step: int = 1) -> DataFrame:
    """``start, start + step, ...`` in the given order.

    The rows are range-partitioned and sorted, so a hot key is no hot partition as long as
    ``order`` is selective. The partitions are then fixed with a checkpoint (their row
    counts and the numbering must see the same cut), and only one count per partition
    is summed up: that table is as long as the shuffle is wide, and is broadcast.
    """
    placed = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("__at", F.monotonically_increasing_id()))
    placed = cut_lineage(placed).withColumn("__part", F.shiftright("__at", 33))
    running = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
               .select("__part", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("__before")))
    index = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return (placed.join(F.broadcast(offsets), "__part")
            .withColumn(out, F.lit(start) + index * F.lit(step)).drop("__at", "__part", "__before"))


def row_numbers(df: DataFrame, order: Sequence[Column | str], out: str = "rn") -> DataFrame:
    """``ROW_NUMBER() OVER ()``: numbers the rows of the whole table from 1."""
    return assign_ids(df, order, out)


class Sequencer:
    """A sequence with start, increment, bounds and cycling.

    ``next_values`` numbers a table and moves on; ``current`` repeats the last number.
    """

    def __init__(self, start: int = 1, increment: int = 1, minimum: int | None = None,
                 maximum: int | None = None, cycle: bool = False):
        if increment == 0:
            raise ValueError("the increment of a sequence cannot be zero")
        self.start, self.increment, self.cycle = start, increment, cycle
        self.minimum = minimum if minimum is not None else (1 if increment > 0 else -(1 << 63))
        self.maximum = maximum if maximum is not None else ((1 << 63) - 1 if increment > 0 else -1)
        self._next = start
        self.current: int | None = None

    def next_values(self, df: DataFrame, order: Sequence[Column | str], out: str = "id") -> DataFrame:
        numbered = assign_ids(df, order, "__k", 0, 1)
        count = numbered.count()
        first, inc = self._next, self.increment
        low, high = (self.minimum, self.maximum)
        room = (high - first) // inc + 1 if inc > 0 else (first - low) // -inc + 1
        if count > room and not self.cycle:
            raise OverflowError("the sequence has run out of numbers")
        again, per_round = (low, (high - low) // inc + 1) if inc > 0 else (high, (high - low) // -inc + 1)

        def value(k):
            return first + k * inc if k < room else again + ((k - room) % per_round) * inc

        k = F.col("__k")
        expr = F.lit(first) + k * inc
        if count > room:
            expr = F.when(k < room, expr).otherwise(F.lit(again) + F.pmod(k - F.lit(room), F.lit(per_round)) * inc)
        if count:
            self.current, self._next = value(count - 1), value(count)
            if not self.cycle and count == room:
                self._next = first + count * inc
        return numbered.withColumn(out, expr).drop("__k")
