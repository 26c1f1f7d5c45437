"""The event log: what every mining operator takes as input.

Shape: ``case struct<id>``, ``label``, ``ms bigint``, ``tie struct<...>``.

* ``case`` is wrapped in a one-field struct. A NULL case id is one case like any
  other, and a struct holding NULL equals itself, so joins and groupings on
  ``case`` keep that case without null-safe operators (which would change the
  hash partitioning and cost an extra shuffle).
* ``label`` is text.
* ``ms`` is the timestamp cut to milliseconds; two events less than one
  millisecond apart are simultaneous.
* ``tie`` orders simultaneous events. Input order does not exist in Spark, so
  callers name the columns that define it; the label is the fallback.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

def epoch_ms(df: DataFrame, ts_col: str) -> Column:
    """Milliseconds since the epoch for any time-like (or integral) column.

    Timestamps without a zone are read as they stand, independent of the session
    time zone.
    """
    kind = df.schema[ts_col].dataType
    c = F.col(f"`{ts_col}`")
    if isinstance(kind, T.TimestampType):
        return F.unix_millis(c)
    if isinstance(kind, T.TimestampNTZType):
        micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts_col}`)")
        return F.call_function("div", micros - F.pmod(micros, F.lit(1000)), F.lit(1000))
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("bigint") * 86_400_000
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("bigint")
    raise TypeError(f"{ts_col}: {kind.simpleString()} has no order in time")


def as_log(df: DataFrame, case_col: str, activity_col: str, ts_col: str,
           tiebreak: str | Sequence[str] | None = None) -> DataFrame:
    """Project ``df`` to a log. Rows without a timestamp are left out
    (``log_quality`` counts them); rows without a label stay."""
    ties = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak or [activity_col])
    return (df.filter(F.col(f"`{ts_col}`").isNotNull())
              .select(F.struct(F.col(f"`{case_col}`").alias("id")).alias("case"),
                      F.col(f"`{activity_col}`").cast("string").alias("label"),
                      epoch_ms(df, ts_col).alias("ms"),
                      F.struct(*[F.col(f"`{c}`").alias(f"t{i}") for i, c in enumerate(ties)]).alias("tie")))


def log_quality(df: DataFrame, case_col: str, activity_col: str, ts_col: str) -> DataFrame:
    """One row counting the rows that mining operators leave out or treat specially."""
    return df.agg(F.count(F.lit(1)).alias("events"),
                  F.count_if(F.col(ts_col).isNull()).alias("no_timestamp"),
                  F.count_if(F.col(activity_col).isNull()).alias("no_label"),
                  F.count_if(F.col(case_col).isNull()).alias("no_case"))


def profile_log(df: DataFrame, case_col: str, activity_col: str) -> DataFrame:
    """Number of events, cases and event types.

    Counted on the (case, label) table, which is combined map-side first.
    """
    pairs = df.groupBy(F.col(case_col).alias("c"), F.col(activity_col).alias("l")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("events"),
                     F.count_distinct("c").alias("cases"),
                     F.count_distinct("l").alias("event_types"))


def rescale_time(df: DataFrame, ts_col: str, origin_ms: int = 0, out: str = "scaled_ms") -> DataFrame:
    """Event time for replay: one day of the log becomes one second."""
    ms = epoch_ms(df, ts_col)
    return df.withColumn(out, F.call_function("div", (ms - F.lit(origin_ms)) * 1000, F.lit(86_400_000)))
