"""Conditional, row-value and array functions whose results differ from Spark's own."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def decode(x: Column, *args) -> Column:
    """``DECODE(x, s1, r1, ..., [default])``; NULL matches NULL."""
    default = _c(args[-1]) if len(args) % 2 else F.lit(None)
    out = None
    for s, r in zip(args[0::2], args[1::2]):
        hit = x.eqNullSafe(_c(s))
        out = F.when(hit, _c(r)) if out is None else out.when(hit, _c(r))
    return out.otherwise(default) if out is not None else default


def casewhen(cond: Column, a, b) -> Column:
    return F.when(cond, _c(a)).otherwise(_c(b))


def is_in(x: Column, values: Iterable) -> Column:
    """IN over a list; the empty list is FALSE, also for NULL."""
    values = list(values)
    return x.isin(*values) if values else F.lit(False)


def nvl2(x: Column, a, b) -> Column:
    return F.nvl2(x, _c(a), _c(b))


def nullif(a: Column, b) -> Column:
    return F.nullif(a, _c(b))


def array_get(a: Column, i) -> Column:
    """1-based; NULL outside the array."""
    i = _c(i)
    return F.when(i >= 1, F.try_element_at(a, F.greatest(i, F.lit(1))))


def subscript(a: Column, i) -> Column:
    """``a[i]``, 0-based; NULL outside the array."""
    return F.get(a, _c(i))


def array_length(a: Column) -> Column:
    return F.when(a.isNotNull(), F.size(a))


def array_contains(a: Column, x) -> Column:
    """Never NULL: a missing value is FALSE."""
    return F.coalesce(F.array_contains(a, _c(x)), F.lit(False))


def row_equals(left: Iterable[Column], right: Iterable) -> Column:
    """``(a, b) = (c, d)``."""
    return F.struct(*left) == F.struct(*[_c(v) for v in right])


def row_in(left: Iterable[Column], rows: Iterable[Iterable]) -> Column:
    left = list(left)
    out = F.lit(False)
    for r in rows:
        out = out | row_equals(left, r)
    return out
