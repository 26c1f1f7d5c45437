"""User-defined functions, aggregates and table functions."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from eventloom.session import cut_lineage


@F.pandas_udf(T.BooleanType())
def is_prime(values: pd.Series) -> pd.Series:
    """A scalar function in Python, one Arrow batch at a time; NULL stays NULL."""
    v = values.to_numpy(dtype="float64", na_value=np.nan)
    out = np.where(np.isnan(v), np.nan, (v >= 2) * 1.0)
    top = int(np.sqrt(np.nanmax(v))) if np.isfinite(v).any() and np.nanmax(v) >= 4 else 1
    for d in range(2, top + 1):
        out = np.where((v % d == 0) & (v > d), 0.0, out)
    return pd.Series([None if np.isnan(x) else bool(x) for x in out], dtype=object)


def sql_function(spark: SparkSession, name: str, arguments: str, returns: str, expression: str) -> None:
    """A function from source text: an SQL expression, which the optimizer can see through."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {expression}")


@F.udtf(returnType=T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())]))
class Matrix:
    """A table function: the n x n index pairs of its argument."""

    def eval(self, n: int):
        for i in range(n or 0):
            for j in range(n):
                yield i, j


@F.udtf
class LabelCounts:
    """A table function whose columns depend on its argument: per key, how often each listed label occurs.

    ``label_counts(TABLE(...) PARTITION BY (key), 'a,b')``; the first column of the table is the key, the second the label.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, labels: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or len(rows.dataType.fields) < 2 or labels.value is None:
            raise ValueError("a table of keys and labels and a constant list of labels are needed")
        counts = [T.StructField(label, T.LongType()) for label in labels.value.split(",")]
        return AnalyzeResult(T.StructType([T.StructField("key", rows.dataType.fields[0].dataType), *counts]))

    def __init__(self):
        self.key, self.counts = None, {}

    def eval(self, row, labels: str):
        self.key, self.labels = row[0], labels.split(",")
        self.counts[row[1]] = self.counts.get(row[1], 0) + 1

    def terminate(self):
        if self.counts:
            yield (self.key, *[self.counts.get(label, 0) for label in self.labels])


@F.udtf
class LabelSteps:
    """A table function over an ordered table: per key, each label after the one before it.

    ``label_steps(TABLE(...) PARTITION BY (key) ORDER BY (...))``; rows of a key arrive one by one, and only the last is held.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        key, label = rows.dataType.fields[:2]
        return AnalyzeResult(T.StructType([T.StructField("key", key.dataType), T.StructField("before", label.dataType), T.StructField("after", label.dataType)]))

    def __init__(self):
        self.last = None

    def eval(self, row):
        if self.last is not None:
            yield row[0], self.last[0], row[1]
        self.last = (row[1],)


def register(spark: SparkSession) -> None:
    """Makes the functions of this module available in SQL."""
    spark.udf.register("is_prime", is_prime)
    for name, function in (("matrix", Matrix), ("label_counts", LabelCounts), ("label_steps", LabelSteps)):
        spark.udtf.register(name, function)


def register_function(spark: SparkSession, name: str, by_arity: Mapping[int, Callable], returns: str, null_on_null: bool = True,
                      deterministic: bool = True):
    """A function for SQL with one body for each number of arguments (``-1``: any other number), called on Arrow batches.

    With ``null_on_null`` a row with a NULL argument gives NULL and the body does not see it. A function that is not
    deterministic is never folded, moved or called less often than it is written.
    """
    bodies = dict(by_arity)

    @F.pandas_udf(returns)
    def call(*columns: pd.Series) -> pd.Series:
        body = bodies.get(len(columns), bodies.get(-1))
        if body is None:
            raise ValueError(f"{name} does not take {len(columns)} arguments")
        if not null_on_null or not columns:
            return body(*columns)
        there = np.logical_and.reduce([c.notna().to_numpy() for c in columns])
        out = pd.Series([None] * len(there), dtype=object)
        if there.any():
            out[there] = list(body(*[c[there] for c in columns]))
        return out

    return spark.udf.register(name, call if deterministic else call.asNondeterministic())


class Fold:
    """A user aggregate over one numeric column that merges.

    ``add`` turns a batch of values and a state into a state, ``merge`` joins two states
    and ``finish`` gives the result; a state is a list of floats. Merging is what lets a group
    be folded where its rows are, instead of being sent to one task.
    """

    def __init__(self, zero: Sequence[float], add: Callable, merge: Callable, finish: Callable):
        self.zero, self.add, self.merge, self.finish = list(zero), add, merge, finish


def aggregate_by(df: DataFrame, keys: Sequence[str], value: str, fold: Fold, out: str = "result",
                 salts: int = 64) -> DataFrame:
    """Per key the fold of all values (NULLs skipped): folded per Arrow batch, then merged
    per (key, salt), then per key."""
    keys = list(keys)
    key_fields = [df.schema[k] for k in keys]
    state = T.StructField("state", T.ArrayType(T.DoubleType()))
    zero, add, merge, finish = fold.zero, fold.add, fold.merge, fold.finish

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf = pdf.dropna(subset=[value])
            if len(pdf):
                g = pdf.groupby(keys, dropna=False, sort=False)[value]
                states = g.apply(lambda s: add(list(zero), s.to_numpy())).rename("state").reset_index()
                yield states.astype({k: object for k in keys})

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        acc = list(zero)
        for s in pdf["state"]:
            acc = merge(acc, list(s))
        return pdf[keys].head(1).astype(object).assign(state=[acc])

    schema = T.StructType([*key_fields, state])
    parts = df.select(*keys, value).mapInPandas(partial, schema)
    parts = parts.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    salted = parts.groupBy(*keys, "salt").applyInPandas(lambda pdf: merged(pdf.drop(columns="salt")), schema)

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        m = merged(pdf)
        return m.assign(**{out: [float(finish(m["state"].iloc[0]))]}).drop(columns="state")

    return salted.groupBy(*keys).applyInPandas(last, T.StructType([*key_fields, T.StructField(out, T.DoubleType())]))


class TypedFold:
    """A user aggregate over several columns of any type.

    ``add(state, frame)`` takes a frame of rows without NULL, ``merge`` joins two states and ``finish`` gives the
    result. A state is any value that can be pickled; ``None`` is the empty one, which ``add`` has to expect.
    """

    def __init__(self, add: Callable, merge: Callable, finish: Callable):
        self.add, self.merge, self.finish = add, merge, finish


#: States of a group that are merged together.
FAN_IN = 64


def fold_by(df: DataFrame, keys: Sequence[str], columns: Sequence[str], fold: TypedFold, out: str, returns: str, fan_in: int = FAN_IN) -> DataFrame:
    """Per key the fold of the rows in which no column is NULL.

    Rows are folded where they are, batch by batch. The states of a key are then merged by at most ``fan_in`` at a time, in as
    many rounds as the largest count of states asks for, so no task holds more than that many states of one key.
    """
    keys, add, merge, finish = list(keys), fold.add, fold.merge, fold.finish
    key_fields = [df.schema[k] for k in keys]
    schema = T.StructType([*key_fields, T.StructField("state", T.BinaryType())])

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf = pdf.dropna(subset=list(columns))
            rows = [(*(k if isinstance(k, tuple) else (k,)), pickle.dumps(add(None, g))) for k, g in pdf.groupby(keys, dropna=False, sort=False)] if len(pdf) else []
            yield pd.DataFrame(rows, columns=schema.names).astype({k: object for k in keys})

    def merged(pdf: pd.DataFrame):
        return reduce(merge, [pickle.loads(bytes(s)) for s in pdf["state"]])

    states = df.select(*dict.fromkeys([*keys, *columns])).mapInPandas(partial, schema)
    while True:
        stored_states = cut_lineage(states)
        most = stored_states.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= fan_in:
            break
        salted = stored_states.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(-(-most // fan_in))))
        states = salted.groupBy(*keys, "salt").applyInPandas(
            lambda pdf: pdf[keys].head(1).astype(object).assign(state=[pickle.dumps(merged(pdf))]), schema)
    return stored_states.groupBy(*keys).applyInPandas(
        lambda pdf: pdf[keys].head(1).astype(object).assign(**{out: [finish(merged(pdf))]}),
        T.StructType([*key_fields, T.StructField(out, T.DataType.fromDDL(returns))]))


def _dearest(state, rows: pd.DataFrame):
    """(price, name, rows): the highest price, of equal ones the smallest name."""
    top = rows.iloc[:, 1].max()
    here = (float(top), min(rows.iloc[:, 0][rows.iloc[:, 1] == top]), len(rows))
    return here if state is None else _dearer(state, here)


def _dearer(a, b):
    first = min(a, b, key=lambda s: (-s[0], s[1]))
    return first[0], first[1], a[2] + b[2]


#: Over (name, price): the dearest name and the number of rows.
DEAREST = TypedFold(lambda state, rows: _dearest(state, rows[["p_name", "p_retailprice"]]), _dearer, lambda s: f"{s[1]}/{s[2]}")

GEOMETRIC_MEAN = Fold([0.0, 0.0], lambda s, v: [s[0] + float(np.log(v).sum()), s[1] + len(v)],
                      lambda a, b: [a[0] + b[0], a[1] + b[1]], lambda s: float(np.exp(s[0] / s[1])) if s[1] else float("nan"))
