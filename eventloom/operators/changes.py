"""Changes of a table, each as a new DataFrame.

Rows with a NULL in a key take no part in matching. They are set apart before the join
(and put back afterwards): in an outer join they would all meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.ids import assign_ids
from eventloom.session import cut_lineage


def _has_keys(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def _fail_on_duplicates(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """The same rows; running it fails when a key occurs twice. Shares the partitioning of a join on the keys."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return (df.withColumn("__n", n)
            .withColumn("__n", F.when(F.col("__n") > 1, F.raise_error(F.lit(f"duplicate key in {what}"))).otherwise(F.col("__n")))
            .filter(F.col("__n") == 1).drop("__n"))


SetExpr = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], set_exprs: Mapping[str, SetExpr] | None = None,
           defaults: Mapping[str, Column] | None = None, order: Sequence[Column | str] | None = None) -> DataFrame:
    """Update by key, insert where the key is new.

    Columns missing from ``source`` keep their value on update and take their default on
    insert. ``set_exprs`` maps a column to a function of (old, new) column getters for
    "on duplicate key update"; columns not named there stay as they are. The target must have unique keys: a
    duplicate fails the query. So must the source, unless ``order`` is given: its rows of one key are then applied
    one after the other in that order, as single statements would be.
    """
    missing = [k for k in keys if k not in source.columns]
    if missing:
        raise ValueError(f"key columns {missing} are not in the source")
    defaults = defaults or {}
    if order is not None:
        return _upsert_in_turn(target, source, list(keys), set_exprs, defaults, order)
    t = _fail_on_duplicates(target.filter(_has_keys(keys)), keys, "target").select(
        *[F.col(k).alias(f"__tk_{k}") for k in keys], F.struct(*target.columns).alias("__t"))
    s = _fail_on_duplicates(source.filter(_has_keys(keys)), keys, "source").select(
        *[F.col(k).alias(f"__sk_{k}") for k in keys], F.struct(*source.columns).alias("__s"))
    on = reduce(lambda a, b: a & b, [F.col(f"__tk_{k}") == F.col(f"__sk_{k}") for k in keys])
    old, new = (lambda c: F.col(f"__t.{c}")), (lambda c: F.col(f"__s.{c}"))
    has_t, has_s = F.col("__t").isNotNull(), F.col("__s").isNotNull()
    cols = []
    for f in target.schema.fields:
        c = f.name
        inserted = new(c) if c in source.columns else defaults.get(c, F.lit(None))
        if set_exprs is not None:
            updated = set_exprs[c](old, new) if c in set_exprs else old(c)
        else:
            updated = new(c) if c in source.columns else old(c)
        cols.append(F.when(has_t & has_s, updated).when(has_t, old(c)).otherwise(inserted).cast(f.dataType).alias(c))
    merged = t.join(s, on, "full").select(*cols)
    rest_t = target.filter(~_has_keys(keys))
    rest_s = source.filter(~_has_keys(keys)).select(*[
        (F.col(f.name) if f.name in source.columns else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
        for f in target.schema.fields])
    return merged.unionByName(rest_t).unionByName(rest_s)


#: Source rows of one key that are folded in one go.
FOLD_ROWS = 10_000


def _upsert_in_turn(target: DataFrame, source: DataFrame, keys: list[str], set_exprs, defaults, order) -> DataFrame:
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    keyed, rest = source.filter(_has_keys(keys)), source.filter(~_has_keys(keys))
    if set_exprs is None:
        # every listed column is overwritten each time, so only the last row of a key counts
        last = keyed.groupBy(*keys).agg(F.max_by(F.struct(*keyed.columns), F.struct(*by)).alias("__s"))
        return upsert(target, last.select("__s.*").unionByName(rest), keys, None, defaults)
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) - 1
    turns = cut_lineage(keyed.withColumn("__turn", turn).withColumn("__part", F.floor(F.col("__turn") / FOLD_ROWS)))
    parts = (turns.agg(F.max("__part")).first()[0] or 0) + 1
    out = _fail_on_duplicates(target.filter(_has_keys(keys)), keys, "target").unionByName(target.filter(~_has_keys(keys)))
    for part in range(parts):
        out = _fold(out, turns.filter(F.col("__part") == part), keys, set_exprs, defaults)
        out = cut_lineage(out) if part + 1 < parts else out
    return upsert(out, rest, keys, set_exprs, defaults)


def _fold(target: DataFrame, turns: DataFrame, keys: list[str], set_exprs, defaults) -> DataFrame:
    """``turns`` applied to the target: per key an ordered array of at most FOLD_ROWS rows, folded by the set expressions."""
    fields = target.schema.fields
    listed = [c for c in turns.columns if not c.startswith("__")]
    rows = turns.groupBy(*[F.col(k).alias(f"__sk_{k}") for k in keys]).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__turn", F.struct(*listed).alias("row")))), lambda r: r["row"]).alias("__rows"))
    t = target.filter(_has_keys(keys)).select(*[F.col(k).alias(f"__tk_{k}") for k in keys], F.struct(*[F.col(f.name) for f in fields]).alias("__t"))
    on = reduce(lambda a, b: a & b, [F.col(f"__tk_{k}") == F.col(f"__sk_{k}") for k in keys])
    known, first = F.col("__t").isNotNull(), F.col("__rows")[0]
    entered = F.struct(*[(first[f.name] if f.name in listed else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in fields])

    def apply(state: Column, row: Column) -> Column:
        return F.struct(*[(set_exprs[f.name](lambda c: state[c], lambda c: row[c]) if f.name in set_exprs else state[f.name])
                          .cast(f.dataType).alias(f.name) for f in fields])

    start = F.struct(*[F.when(known, F.col("__t")[f.name]).otherwise(entered[f.name]).alias(f.name) for f in fields])
    later = F.when(known, F.col("__rows")).otherwise(F.slice("__rows", F.lit(2), F.greatest(F.size("__rows"), F.lit(1))))
    state = F.when(F.col("__rows").isNull(), start).otherwise(F.aggregate(later, start, apply))
    return t.join(rows, on, "full").select(state.alias("__o")).select("__o.*").unionByName(target.filter(~_has_keys(keys)))


def replace_into(target: DataFrame, source: DataFrame, keys: Sequence[str] = (), order: Sequence[Column | str] | None = None) -> DataFrame:
    """Upsert by primary key; a plain insert for a table without one."""
    return upsert(target, source, keys, order=order) if keys else insert(target, source)


def insert(target: DataFrame, rows: DataFrame, defaults: Mapping[str, Column] | None = None,
           null_to_default: Sequence[str] = (), computed: Mapping[str, Column] | None = None) -> DataFrame:
    """Appends rows: types converted, omitted columns defaulted, computed columns derived."""
    defaults, computed = defaults or {}, computed or {}
    cols = []
    for f in target.schema.fields:
        if f.name in rows.columns:
            c = F.col(f.name)
            if f.name in null_to_default and f.name in defaults:
                c = F.coalesce(c, defaults[f.name])
        else:
            c = defaults.get(f.name, F.lit(None))
        cols.append(c.cast(f.dataType).alias(f.name))
    filled = rows.select(*cols)
    for name, c in computed.items():
        filled = filled.withColumn(name, c.cast(target.schema[name].dataType))
    return target.unionByName(filled)


#: Limits up to which the first rows are found by a top-n; beyond, all rows are numbered.
TOP_ROWS = 100_000


def _chosen(df: DataFrame, where: Column, limit: int | None, order: Sequence[str]) -> tuple[DataFrame, Column]:
    hit = F.coalesce(where, F.lit(False))
    if limit is None:
        return df, hit
    if not order:
        raise ValueError("a limit needs an order")
    if limit > TOP_ROWS:
        # matching rows are numbered first, so the number alone decides and equal or NULL order values are no matter
        numbered = assign_ids(df.withColumn("__hit", hit), [F.col("__hit").desc(), *order], "__number")
        return numbered, F.col("__hit") & (F.col("__number") <= limit)
    if limit <= 0:
        return df, F.lit(False)
    # the last of the first rows is a bound; only rows equal to it need a number, and only if not all of them are wanted
    at = F.struct(*order)
    first = df.filter(hit).select(*order).orderBy(*order).limit(limit).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last")).first()
    if first.n < limit:
        return df, hit
    kinds = dict(df.dtypes)
    last = F.struct(*[F.lit(first["last"][o]).cast(kinds[o]).alias(o) for o in order])
    before, same = df.agg(F.count_if(hit & (at < last)), F.count_if(hit & at.eqNullSafe(last))).first()
    if before + same <= limit:
        return df, hit & (at <= last)
    tied = hit & at.eqNullSafe(last)
    numbered = assign_ids(df.filter(tied), list(order), "__number").unionByName(df.filter(~tied).withColumn("__number", F.lit(0).cast("bigint")))
    return numbered, hit & ((at < last) | (at.eqNullSafe(last) & (F.col("__number") <= limit - before)))


def update(df: DataFrame, set_values: Mapping[str, Column], where: Column, limit: int | None = None,
           order: Sequence[str] = ()) -> DataFrame:
    """New values are computed from the old row; with a limit only the first matching rows change."""
    marked, hit = _chosen(df, where, limit, order)
    return marked.select(*[
        F.when(hit, set_values[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name)
        if f.name in set_values else F.col(f.name) for f in df.schema.fields])


def delete(df: DataFrame, where: Column, limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Removes the rows for which the condition is TRUE; NULL keeps the row."""
    marked, hit = _chosen(df, where, limit, order)
    return marked.filter(~hit).select(*df.columns)


def truncate(df: DataFrame) -> DataFrame:
    return df.filter(F.lit(False))


def alter(df: DataFrame, add: Mapping[str, Column] | None = None, drop: Sequence[str] = (),
          rename: Mapping[str, str] | None = None, retype: Mapping[str, str] | None = None) -> DataFrame:
    """Add, drop, rename and retype columns in one projection."""
    add, rename, retype = add or {}, rename or {}, retype or {}
    cols = [(F.col(c).cast(retype[c]) if c in retype else F.col(c)).alias(rename.get(c, c))
            for c in df.columns if c not in drop]
    return df.select(*cols, *[v.alias(k) for k, v in add.items()])


# --- constraints as checks --------------------------------------------------------------

def violations_unique(df: DataFrame, keys: Sequence[str], primary: bool = False) -> DataFrame:
    """Keys that occur more than once, with their count. Keys holding NULL are exempt,
    unless the key is primary: then each such key is a violation itself."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    full = _has_keys(keys)
    return counted.filter((full & (F.col("n") > 1)) | ~full) if primary else counted.filter(full & (F.col("n") > 1))


def violations_check(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is FALSE; NULL passes."""
    return df.filter(~condition)


def violations_fk(child: DataFrame, fk: Sequence[str], parent: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Child rows without parent; keys holding NULL are exempt."""
    keys = parent.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(pk)])
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__p{i}") for i, c in enumerate(fk)])
    return child.filter(_has_keys(fk)).join(keys, on, "left_anti")


def cascade_delete(child: DataFrame, fk: Sequence[str], deleted: DataFrame, pk: Sequence[str]) -> DataFrame:
    """The child rows that remain after their parents were deleted."""
    gone = deleted.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(pk)])
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__p{i}") for i, c in enumerate(fk)])
    return child.join(gone, on, "left_anti")


def cascade_set(child: DataFrame, fk: Sequence[str], deleted: DataFrame, pk: Sequence[str],
                values: Mapping[str, Column] | None = None) -> DataFrame:
    """SET NULL (or SET DEFAULT, with ``values``) of the keys whose parent was deleted."""
    gone = deleted.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(pk)]).distinct().withColumn("__gone", F.lit(True))
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__p{i}") for i, c in enumerate(fk)])
    hit = F.col("__gone").isNotNull()
    return child.join(gone, on, "left").select(*[
        F.when(hit, (values or {}).get(f.name, F.lit(None))).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name)
        if f.name in fk else F.col(f.name) for f in child.schema.fields])
