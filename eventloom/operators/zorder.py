"""Z-order: several whole-number dimensions interleaved into one, and box queries on it."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bits_per_dimension(dims: int) -> int:
    if not 2 <= dims <= 32:
        raise ValueError("two to 32 dimensions")
    return min(31, 64 // dims)


def interleave(*cols: Column) -> Column:
    """Bit i of dimension j becomes bit ``i * dims + j`` of the result."""
    dims, bits = len(cols), bits_per_dimension(len(cols))
    terms = []
    for j, c in enumerate(cols):
        v = c.cast("bigint")
        checked = F.when((v < 0) | (v >= 1 << bits), F.raise_error(F.lit(f"value outside 0..2^{bits}-1"))).otherwise(v)
        terms.append(_spread(checked, dims, bits, j))
    return reduce(lambda a, b: a.bitwiseOR(b), terms)


def _spread(v: Column, dims: int, bits: int, offset: int) -> Column:
    one = F.lit(1).cast("bigint")
    picked = [F.shiftleft(F.shiftright(v, i).bitwiseAND(one), i * dims + offset) for i in range(bits)]
    return reduce(lambda a, b: a.bitwiseOR(b), picked)


def deinterleave(z: Column, dims: int, j: int) -> Column:
    """Dimension ``j`` of an interleaved value."""
    one = F.lit(1).cast("bigint")
    picked = [F.shiftleft(F.shiftrightunsigned(z, i * dims + j).bitwiseAND(one), i) for i in range(bits_per_dimension(dims))]
    return reduce(lambda a, b: a.bitwiseOR(b), picked)


def _interleave_int(values: Sequence[int]) -> int:
    dims = len(values)
    return sum(((v >> i) & 1) << (i * dims + j) for j, v in enumerate(values) for i in range(bits_per_dimension(dims)))


def box_ranges(low: Sequence[int], high: Sequence[int], max_ranges: int = 64) -> list[tuple[int, int]]:
    """At most ``max_ranges`` scalar ranges that together cover a box (both corners inclusive).

    A cell is a stretch of the z-curve, and halving it halves one dimension. The cell that covers most outside the box
    is halved first; halves that miss the box go. The ranges may cover more than the box, so keep the box filter.
    """
    dims = len(low)
    bits = bits_per_dimension(dims)
    if any(lo > hi for lo, hi in zip(low, high)):
        return []

    def cell(corner: tuple[int, ...], width: tuple[int, ...], level: int):
        """(excess, start on the curve, level, corner, width of each dimension in bits); None when it misses the box."""
        size = met = 1
        for c, w, lo, hi in zip(corner, width, low, high):
            size <<= w
            met *= max(0, min(c + (1 << w) - 1, hi) - max(c, lo) + 1)
        return (met - size, _interleave_int(corner), level, corner, width) if met else None

    first = cell((0,) * dims, (bits,) * dims, bits * dims)
    open_, done = ([first] if first else []), []
    while open_ and len(open_) + len(done) < max_ranges:
        worst = heapq.heappop(open_)
        excess, start, level, corner, width = worst
        if not excess:
            done.append(worst)
            continue
        j = (level - 1) % dims
        narrow = tuple(w - (i == j) for i, w in enumerate(width))
        upper = tuple(c + (1 << narrow[j]) * (i == j) for i, c in enumerate(corner))
        for half in (cell(corner, narrow, level - 1), cell(upper, narrow, level - 1)):
            if half:
                heapq.heappush(open_, half)
    merged: list[tuple[int, int]] = []
    for a, b in sorted((start, start + (1 << level) - 1) for _, start, level, _, _ in [*done, *open_]):
        if merged and a <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def _as_long(ranges: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of 64-bit values as signed numbers; one across the sign is cut in two."""
    top, out = 1 << 63, []
    for a, b in ranges:
        out += [(a, b)] if b < top else [(a - 2 * top, b - 2 * top)] if a >= top else [(a, top - 1), (-top, b - 2 * top)]
    return out


def box_filter(z: str, cols: Sequence[str], low: Sequence[int], high: Sequence[int], max_ranges: int = 64) -> Column:
    """Rows inside a box: ranges on the z column (which reach the file statistics of a
    z-ordered table) and the box itself."""
    ranges = _as_long(box_ranges(low, high, max_ranges))
    on_curve = reduce(lambda a, b: a | b, [F.col(z).between(a, b) for a, b in ranges]) if ranges else F.lit(False)
    return reduce(lambda a, b: a & b, [F.col(c).between(lo, hi) for c, lo, hi in zip(cols, low, high)], on_curve)


def write_zordered(df: DataFrame, cols: Sequence[str], path: str, z: str = "z") -> None:
    """Stores a table clustered by the z value of its columns."""
    (df.withColumn(z, interleave(*[F.col(c) for c in cols])).repartitionByRange(z).sortWithinPartitions(z)
     .write.mode("overwrite").parquet(path))
