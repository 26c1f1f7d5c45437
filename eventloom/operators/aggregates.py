"""Aggregates whose results differ from Spark's own, and column profiles."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sum_exact(x: Column) -> Column:
    """SUM of BIGINT without overflow."""
    return F.sum(x.cast("decimal(38,0)"))


def sum_true(x: Column) -> Column:
    """SUM of BOOLEAN counts TRUE; NULL when there is no value."""
    return F.sum(x.cast("int")).cast("bigint")


def avg_same_type(x: Column, kind: str = "int") -> Column:
    """AVG in the type of its argument: of whole numbers it is cut toward zero."""
    total, n = F.sum(x.cast("decimal(38,0)")), F.count(x)
    rest = total % n
    return F.when(n > 0, ((total - rest) / n)).cast(kind)


class Descending(NamedTuple):
    """An order from large to small, of any type that can be compared."""
    by: Column


def descending(by: Column | str) -> Descending:
    return Descending(F.col(by) if isinstance(by, str) else by)


def _compare(orders: Sequence[Column | Descending]):
    """-1, 0 or 1 of two rows by their fields o0, o1, ...; NULL is smaller than every value."""
    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for i in reversed(range(len(orders))):
            x, y = a[f"o{i}"], b[f"o{i}"]
            less, sign = F.coalesce(x < y, x.isNull() & y.isNotNull()), -1 if isinstance(orders[i], Descending) else 1
            more = F.coalesce(x > y, x.isNotNull() & y.isNull())
            out = F.when(less, -sign).when(more, sign).otherwise(out)
        return out
    return compare


def group_concat(x: Column, separator: str = ",", order: Sequence[Column | Descending] | None = None, distinct: bool = False) -> Column:
    """Texts of a group joined in order; NULLs are skipped; NULL when nothing is left. Orders rise unless ``descending``.

    The result is one text per group, so the group has to fit one row by definition.
    """
    if distinct and not order:
        parts = F.array_sort(F.collect_set(x))
    elif order:
        by = [o.by if isinstance(o, Descending) else o for o in order]
        rows = F.collect_list(F.when(x.isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(by)], x.alias("x"))))
        rows = F.array_sort(rows, _compare(order)) if any(isinstance(o, Descending) for o in order) else F.array_sort(rows)
        parts = F.transform(rows, lambda r: r["x"])
        if distinct:  # each text where it comes first
            parts = F.array_distinct(parts)
    else:
        parts = F.array_sort(F.collect_list(x))
    return F.when(F.size(parts) > 0, F.array_join(parts, separator))


def histogram_rows(df: DataFrame, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, value, count), NULL included. Combined map-side; no value list is built."""
    return df.groupBy(*keys, F.col(x).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def histogram(df: DataFrame, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """One array of (value, count) per group, sorted by value. Its length is the number of distinct values."""
    rows = histogram_rows(df, x, keys)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("value", "count"))).alias("histogram"))


def _as_percent(distinct: Column, rows: Column) -> Column:
    s = F.floor(distinct * 100 / F.greatest(rows, F.lit(1)))
    return F.when(rows == 0, 0).otherwise(F.least(F.greatest(s, F.lit(1)), F.lit(100))).cast("int")


def selectivity(x: str, exact: bool = False) -> Column:
    """Distinct values per hundred rows, 1..100, 0 without rows; NULL is a value.

    Approximate by default, with a sketch of fixed size per group.
    """
    c = F.col(x)
    has_null = F.max(c.isNull().cast("int"))
    n = (F.count_distinct(c) if exact else F.approx_count_distinct(c)) + F.coalesce(has_null, F.lit(0))
    return _as_percent(n, F.count(F.lit(1)))


def profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row per column: selectivity, NULLs, smallest and largest value (as text).

    With sketches all columns share one pass; the exact form is for small tables.
    """
    aggs, fields = [], []
    for i, f in enumerate(df.schema.fields):
        ordered = isinstance(f.dataType, T.AtomicType)
        aggs += [selectivity(f.name, exact).alias(f"s{i}"), F.count_if(F.col(f.name).isNull()).alias(f"n{i}"),
                 (F.min(f.name).cast("string") if ordered else F.lit(None).cast("string")).alias(f"lo{i}"),
                 (F.max(f.name).cast("string") if ordered else F.lit(None).cast("string")).alias(f"hi{i}")]
        fields.append(F.struct(F.lit(f.name).alias("column_name"), F.col(f"s{i}").alias("selectivity"),
                               F.col(f"n{i}").alias("nulls"), F.col(f"lo{i}").alias("low"), F.col(f"hi{i}").alias("high")))
    return df.agg(*aggs).select(F.explode(F.array(*fields)).alias("r")).select("r.*")
