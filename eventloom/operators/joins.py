"""Joins on ranges and boxes as equi-joins on cells, and quantified comparisons.

Cells come in levels: an interval of length d lives on the smallest level whose cell is
at least d wide, so it touches two cells there at most, however long it is. Nothing is
replicated by its length, and no pair is found twice. Cells with many rows are cut into blocks,
which are dealt over as many tasks as the pairs to be compared need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.sequence import running_total

#: The level of intervals whose length is no finite number; it has one cell.
_OPEN = 4096

#: Rows of one side that a block has, about.
BLOCK = 2048
#: Pairs that a task compares, and rows that it reads, about.
TASK_PAIRS, TASK_ROWS = 32_000_000, 500_000


def _level(extent: Column, unit: float) -> Column:
    """Smallest k >= 0 with ``unit * 2^k >= extent``; never less, however long the interval."""
    k = F.ceil(F.log2(F.greatest(extent, F.lit(unit))) - F.log2(F.lit(float(unit)))).cast("int")
    # One step up when rounding in the logarithm fell short.
    k = F.greatest(F.when(F.pow(F.lit(2.0), k) * unit < extent, k + 1).otherwise(k), F.lit(0))
    return F.when(F.isnan(extent) | (extent == float("inf")), F.lit(_OPEN)).otherwise(k)


def _cell(x: Column, level: Column, unit: float) -> Column:
    return F.when(level >= _OPEN, F.lit(0).cast("bigint")).otherwise(
        F.floor(x / (F.pow(F.lit(2.0), level) * unit)).cast("bigint"))


def _row_hash(df: DataFrame) -> Column:
    """A hash of the row; maps have none and are left out."""
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64("*") if len(plain) == len(df.columns) else F.xxhash64(*[F.col(f"`{c}`") for c in plain])


def _meet(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``a JOIN b USING (keys)`` for keys that hold any number of rows on both sides.

    The rows of a key are dealt by their hash into blocks of about BLOCK rows, and each block of one side meets
    each of the other: a block is a join key of its own, and a row is copied once per block of
    the other side. Rows and pairs are counted first, and the number of tasks follows them.
    """
    keys = list(keys)
    size = lambda df, out: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    cells = size(a, "__na").join(size(b, "__nb"), keys, "full").fillna(0, ["__na", "__nb"])
    count = cells.agg(F.sum(F.col("__na") + F.col("__nb")).alias("rows"), F.sum(F.col("__na").cast("double") * F.col("__nb")).alias("pairs")).first()
    tasks = 1 + int(count.pairs or 0) // TASK_PAIRS + int(count.rows or 0) // TASK_ROWS
    in_blocks = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.lit(1)).cast("int")
    # keys with more than BLOCK rows on a side: few beside the rows
    full = F.broadcast(cells.where((F.least("__na", "__nb") > 0) & (F.greatest("__na", "__nb") > BLOCK))
                       .select(*keys, in_blocks("__na").alias("__ba"), in_blocks("__nb").alias("__bb")))

    def dealt(df, own, other):
        # of the same type as the copies, or the join would deal both sides anew
        mine = F.pmod("__h", F.coalesce(f"__b{own}", F.lit(1))).cast("int").alias(f"__{own}")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(f"__b{other}", F.lit(1)) - 1)).alias(f"__{other}")
        rows = df.withColumn("__h", _row_hash(df)).join(full, keys, "left").select("*", mine, copies)
        return rows.drop("__h", "__ba", "__bb").repartition(tasks, *keys, "__a", "__b")

    # a broadcast would leave all pairs to the few tasks that read the other side
    return dealt(a, "a", "b").join(dealt(b, "b", "a").hint("merge"), [*keys, "__a", "__b"]).drop("__a", "__b")


def range_join(points: DataFrame, x: str, intervals: DataFrame, lo: str, hi: str, unit: float = 1.0,
               how: str = "inner") -> DataFrame:
    """``points JOIN intervals ON x BETWEEN lo AND hi``; ``how`` is inner, left_semi, left_anti or count.

    ``unit`` is the finest cell width; any positive value is right, one near the usual
    interval length is fast. A point is compared on the levels that occur among
    the intervals; those with infinite ends share one cell.

    ``count`` gives what ``inner`` grouped by all columns of ``intervals`` and counted as ``n`` gives. Neither it
    nor the semi and anti joins make pairs: they are read off running counts along the order of the values.
    """
    proper = intervals.filter(F.col(lo) <= F.col(hi))
    if how == "inner":
        level = _level(F.col(hi).cast("double") - F.col(lo).cast("double"), unit)
        v = proper.withColumn("__lvl", level)
        a, b = (_cell(F.col(c).cast("double"), F.col("__lvl"), unit) for c in (lo, hi))
        v = v.withColumn("__cell", F.explode(F.when(a == b, F.array(a)).otherwise(F.array(a, b))))
        p = points.filter(F.col(x).isNotNull()).withColumn("__lvl", F.explode(proper.select(level.alias("l")).agg(F.collect_set("l")).scalar()))
        p = p.withColumn("__cell", _cell(F.col(x).cast("double"), F.col("__lvl"), unit))
        return _meet(p, v, ["__lvl", "__cell"]).filter(F.col(x).between(F.col(lo), F.col(hi))).drop("__lvl", "__cell")
    number = F.count(F.lit(1)).cast("bigint").alias("w")
    none = F.lit(0).cast("bigint")
    if how == "count":
        ends = proper.select(F.struct("*").alias("iv"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
        tie = F.xxhash64("lo", "hi") if any("map<" in f.dataType.simpleString() for f in intervals.schema.fields) else F.xxhash64("iv")
        at = points.filter(F.col(x).isNotNull()).groupBy(F.col(x).alias("v")).agg(number)
        end = lambda c, kind: ends.select("iv", F.col(c).alias("v"), F.lit(kind).alias("kind"), none.alias("w"), tie.alias("tie"))
        swept = _running(end("lo", 0).unionByName(end("hi", 2)).unionByName(
            at.select("v", F.lit(1).alias("kind"), "w", none.alias("tie")), allowMissingColumns=True))
        inside = F.sum(F.when(F.col("kind") == 2, F.col("total")).otherwise(-F.col("total"))).alias("n")
        return swept.filter("kind <> 1").groupBy("iv").agg(inside).filter("n > 0").select("iv.*", "n")
    # Semi and anti joins decide per distinct value, which is then looked up.
    sides = [proper.groupBy(F.col(lo).alias("v")).agg(number).withColumn("kind", F.lit(0)),
             proper.groupBy(F.col(hi).alias("v")).agg((-number).alias("w")).withColumn("kind", F.lit(2)),
             points.filter(F.col(x).isNotNull()).select(F.col(x).alias("v")).distinct().select("v", none.alias("w"), F.lit(1).alias("kind"))]
    swept = _running(sides[0].unionByName(sides[1]).unionByName(sides[2]).withColumn("tie", none))
    found = swept.filter("kind = 1 and total > 0").select(F.col("v").alias("__x"))
    return points.join(found, points[x] == found["__x"], how)


def _running(rows: DataFrame) -> DataFrame:
    """``total``: the sum of ``w`` up to each row, by value; at one value begins (kind 0) come before points (1) and ends (2)."""
    return running_total(rows.withColumn("one", F.lit(1)), F.col("w"), "total", keys=["one"], order=["v", "kind", "tie"], by=["one"])


_BOX = ("xmin", "ymin", "xmax", "ymax")


def intersects(a: str, b: str) -> Column:
    """Boxes ``a`` and ``b`` (prefixes of xmin, ymin, xmax, ymax) share a point."""
    f = lambda p, c: F.col(f"{p}{c}")
    return ((f(a, "xmin") <= f(b, "xmax")) & (f(b, "xmin") <= f(a, "xmax"))
            & (f(a, "ymin") <= f(b, "ymax")) & (f(b, "ymin") <= f(a, "ymax")))


def bbox_join(left: DataFrame, right: DataFrame, lp: str, rp: str, unit: float = 1.0) -> DataFrame:
    """Pairs of overlapping boxes. ``lp`` and ``rp`` prefix the box columns of each side.

    Width and height have levels of their own, so a long thin box lies in few cells of its shape. A pair meets on
    the coarser of its two levels along each axis: each box is laid out once for every pair of levels the other
    side uses (four cells each at most), and both sides' levels are part of the key.
    The pair is kept in the cell of the lower left corner of the overlap only, so
    no removal of duplicates is needed.
    """
    def own_level(p):
        across, up = (_level((F.col(f"{p}{c}max") - F.col(f"{p}{c}min")).cast("double"), unit) for c in "xy")
        return across * (2 * _OPEN) + up

    # along each axis the coarser of the two levels
    along = {"x": lambda c: F.floor(F.col(c) / (2 * _OPEN)), "y": lambda c: F.col(c) % (2 * _OPEN)}
    coarser = {c: F.greatest(f("__la"), f("__lb")) for c, f in along.items()}

    def laid_out(df, p, own, other_df, q, other):
        levels = other_df.agg(F.collect_set(own_level(q))).scalar()
        df = df.withColumn(f"__l{own}", own_level(p)).withColumn(f"__l{other}", F.explode(levels))
        for c in "xy":
            lo, hi = (_cell(F.col(f"{p}{c}{m}").cast("double"), coarser[c], unit) for m in ("min", "max"))
            df = df.withColumn(f"__c{c}", F.explode(F.sequence(lo, hi)))
        return df

    a, b = laid_out(left, lp, "a", right, rp, "b"), laid_out(right, rp, "b", left, lp, "a")
    corner = {c: _cell(F.greatest(f"{lp}{c}min", f"{rp}{c}min").cast("double"), coarser[c], unit) for c in "xy"}
    return (_meet(a, b, ["__la", "__lb", "__cx", "__cy"])
            .filter(intersects(lp, rp) & (F.col("__cx") == corner["x"]) & (F.col("__cy") == corner["y"]))
            .drop("__cx", "__cy", "__la", "__lb"))


def envelope_union(p: str = "") -> list[Column]:
    """Aggregates giving the smallest box around a column of boxes."""
    return [F.min(f"{p}xmin").alias("xmin"), F.min(f"{p}ymin").alias("ymin"),
            F.max(f"{p}xmax").alias("xmax"), F.max(f"{p}ymax").alias("ymax")]


def quantified(x: Column, op: str, quantifier: str, values: DataFrame, column: str) -> Column:
    """``x op ALL (values)`` or ``x op ANY (values)`` with SQL NULL rules.

    The values are reduced to one row (smallest, largest, counts), so their number
    does not matter. ALL over nothing is TRUE, ANY over nothing is FALSE.
    """
    c = F.col(column)
    s = values.agg(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(F.lit(1)).alias("n"),
                            F.count_if(c.isNull()).alias("nulls")).alias("s")).scalar()
    lo, hi, n, nulls = s["lo"], s["hi"], s["n"], s["nulls"]
    test = {">": lambda v: x > v, ">=": lambda v: x >= v, "<": lambda v: x < v, "<=": lambda v: x <= v}
    every = quantifier.upper() == "ALL"
    if op in test:
        hardest, easiest = (hi, lo) if op in (">", ">=") else (lo, hi)
        hit = test[op](hardest if every else easiest)
    elif every and op == "=":
        hit = (x == lo) & (x == hi)
    elif not every and op == "<>":
        hit = (x != lo) | (x != hi)
    else:
        raise ValueError("use IN for = ANY and NOT IN for <> ALL")
    unknown = F.lit(None).cast("boolean")
    if every:
        return F.when(n == 0, True).when(~hit, False).when((nulls > 0) | x.isNull(), unknown).otherwise(hit)
    return F.when(n == 0, False).when(hit, True).when((nulls > 0) | x.isNull(), unknown).otherwise(hit)


def _right_side(values: DataFrame) -> tuple[DataFrame, Column, Column]:
    """The values without NULL, and two one-row summaries of all of them: whether there is any, whether one is NULL."""
    v = values.select(F.col(f"`{values.columns[0]}`").alias("__v"))
    return (v.where(F.col("__v").isNotNull()), v.agg(F.count(F.lit(1)) > 0).scalar(), v.agg(F.count_if(F.col("__v").isNull()) > 0).scalar())


def not_in(df: DataFrame, value: Column, values: DataFrame) -> DataFrame:
    """Rows for which ``value NOT IN (values)`` is true; ``values`` has one column.

    NULL makes the answer unknown: a NULL among the values for every row, a NULL value unless there are no values.
    Both are read off a summary of the right side, so the rest is an ordinary anti join on the key.
    """
    known, some, some_null = _right_side(values)
    keyed = df.withColumn("__k", value)
    # rows without a value never match; they would all meet in one task of the join
    rest = keyed.where(F.col("__k").isNotNull() & ~some_null).join(known, F.col("__k") == F.col("__v"), "left_anti")
    return rest.unionByName(keyed.where(F.col("__k").isNull() & ~some)).drop("__k")


def with_not_in(df: DataFrame, value: Column, values: DataFrame, out: str) -> DataFrame:
    """Adds the answer of ``value NOT IN (values)`` as ``out``: true, false or NULL."""
    known, some, some_null = _right_side(values)
    keyed = df.withColumn("__k", value)
    hits = known.distinct().withColumn("__hit", F.lit(True))
    joined = keyed.where(F.col("__k").isNotNull()).join(hits, F.col("__k") == F.col("__v"), "left")
    answer = F.when(F.col("__hit"), False).when(some_null, F.lit(None).cast("boolean")).otherwise(True)
    return (joined.withColumn(out, answer).drop("__k", "__v", "__hit")
            .unionByName(keyed.where(F.col("__k").isNull()).withColumn(out, F.when(~some, True)).drop("__k")))
