"""Date and time functions whose results differ from Spark's own of the same name.

Timestamps are read by their wall-clock fields: pass TIMESTAMP_NTZ, or a TIMESTAMP that
is meant in the session time zone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of date parts.
_PARTS = {
    "YEAR": "YEAR YYYY YY SQL_TSI_YEAR", "QUARTER": "QUARTER SQL_TSI_QUARTER",
    "MONTH": "MONTH MM M SQL_TSI_MONTH", "DAY": "DAY DD D SQL_TSI_DAY",
    "DAYOFYEAR": "DAYOFYEAR DAY_OF_YEAR DOY DY", "WEEK": "WEEK WW WK SQL_TSI_WEEK",
    "HOUR": "HOUR HH SQL_TSI_HOUR", "MINUTE": "MINUTE MI N SQL_TSI_MINUTE",
    "SECOND": "SECOND SS S SQL_TSI_SECOND", "MILLISECOND": "MILLISECOND MS",
}
_PART_OF = {alias: part for part, names in _PARTS.items() for alias in names.split()}
_UNIT_MS = {"MILLISECOND": 1, "SECOND": 1000, "MINUTE": 60_000, "HOUR": 3_600_000,
            "DAY": 86_400_000, "DAYOFYEAR": 86_400_000, "WEEK": 604_800_000}


def date_part(name: str) -> str:
    try:
        return _PART_OF[name.upper()]
    except KeyError:
        raise ValueError(f"unknown date part {name!r}") from None


def wall_ms(ts: Column) -> Column:
    """Milliseconds from 1970-01-01 00:00 to the wall-clock time."""
    micros = F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), ts.cast("timestamp_ntz"))
    return F.call_function("div", micros - F.pmod(micros, F.lit(1000)), F.lit(1000))


def dateadd(part: str, n, ts: Column) -> Column:
    unit = date_part(part)
    return F.timestamp_add("DAY" if unit == "DAYOFYEAR" else unit, n if isinstance(n, Column) else F.lit(n), ts)


def datediff(part: str, a: Column, b: Column) -> Column:
    """Number of unit boundaries crossed from a to b (not of whole units elapsed).

    DAYOFYEAR and WEEK count full spans from the hour of the earlier time.
    """
    unit = date_part(part)
    if unit in ("YEAR", "QUARTER", "MONTH"):
        field = {"YEAR": F.year, "QUARTER": lambda c: F.year(c) * 4 + F.quarter(c),
                 "MONTH": lambda c: F.year(c) * 12 + F.month(c)}[unit]
        return (field(b) - field(a)).cast("bigint")
    ta, tb, step = wall_ms(a), wall_ms(b), F.lit(_UNIT_MS[unit])
    if unit in ("DAYOFYEAR", "WEEK"):
        base = F.least(ta, tb)
        base = base - F.pmod(base, F.lit(3_600_000))
        ta, tb = ta - base, tb - base
    index = lambda t: F.floor(t / step)
    return (index(tb) - index(ta)).cast("bigint")


def plus_days(ts: Column, days: Column | float) -> Column:
    """``ts + n``: whole numbers are days, fractions become seconds."""
    if isinstance(days, int):
        return F.timestamp_add("DAY", F.lit(days), ts)
    seconds = (days if isinstance(days, Column) else F.lit(days)).cast("double") * 86_400
    return F.timestamp_add("SECOND", seconds.cast("bigint").cast("int"), ts)


def plus_time(ts: Column, time_ms: Column | int) -> Column:
    """``ts + t`` (or ``- t`` when negative) for a time of day in milliseconds. Arithmetic on
    times themselves (``+ - * /``) is plain arithmetic on such numbers."""
    return F.timestamp_add("MILLISECOND", (time_ms if isinstance(time_ms, Column) else F.lit(time_ms)).cast("int"), ts)


def minus_timestamps(a: Column, b: Column) -> Column:
    """``a - b`` in days."""
    return datediff("DAY", b, a)


def truncate_day(ts: Column) -> Column:
    return F.date_trunc("DAY", ts).cast("timestamp_ntz")


def week_us(d: Column) -> Column:
    """Week of the year with weeks from Sunday to Saturday; the one holding January 1st is
    week 1, so the last days of December can be in week 1."""
    first = lambda year: F.make_date(year, F.lit(1), F.lit(1))
    sunday = lambda x: F.date_sub(x, F.dayofweek(x) - 1)
    day = F.to_date(d)
    this, following = sunday(first(F.year(day))), sunday(first(F.year(day) + 1))
    count = (F.datediff(sunday(day), this) / 7).cast("int") + 1
    return F.when(sunday(day) >= following, F.lit(1)).otherwise(count)


def iso_year(d: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), d).cast("int")


def iso_week(d: Column) -> Column:
    return F.extract(F.lit("WEEK"), d).cast("int")


def iso_day_of_week(d: Column) -> Column:
    return F.extract(F.lit("DAYOFWEEK_ISO"), d).cast("int")


def dayname(d: Column) -> Column:
    return F.date_format(d, "EEEE")


def monthname(d: Column) -> Column:
    return F.date_format(d, "MMMM")


def extract(part: str, ts: Column) -> Column:
    unit = date_part(part)
    fields = {"YEAR": F.year, "QUARTER": F.quarter, "MONTH": F.month, "DAY": F.dayofmonth, "DAYOFYEAR": F.dayofyear,
              "WEEK": week_us, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second,
              "MILLISECOND": lambda t: F.pmod(wall_ms(t), F.lit(1000)).cast("int")}
    return fields[unit](ts)


def current_timestamp(scale: int = 6) -> Column:
    """The wall-clock time of the query, cut to ``scale`` digits of a second (0 to 6)."""
    now = F.localtimestamp()
    extra = F.extract(F.lit("SECOND"), now).cast("decimal(8,6)") * 1000000
    return F.timestamp_add("MICROSECOND", -F.pmod(extra.cast("int"), F.lit(10 ** (6 - min(max(scale, 0), 6)))), now)


def _in_locale(pattern: str, locale: str) -> dict[str, str]:
    # a lone value of a one-column line: nothing to separate, nothing to quote
    return {"timestampFormat": pattern, "locale": locale, "sep": "\u0001", "quote": "\u0002", "escape": "\u0002", "mode": "FAILFAST"}


def format_datetime(ts: Column, pattern: str, locale: str | None = None, zone: str | None = None) -> Column:
    """The time as text; names in the language of ``locale``; for a ``zone``, the wall-clock time of the session is moved there."""
    if zone:
        ts = F.convert_timezone(F.current_timezone(), F.lit(zone), ts)
    if not locale:
        return F.date_format(ts, pattern)
    return F.when(ts.isNotNull(), F.to_csv(F.struct(ts.cast("timestamp").alias("t")), _in_locale(pattern, locale)))


def parse_datetime(s: Column, pattern: str, locale: str | None = None, zone: str | None = None) -> Column:
    """A text read as a time; with a ``zone`` as the wall-clock time there, which is moved to the session's."""
    ts = F.from_csv(s, "t timestamp", _in_locale(pattern, locale))["t"].cast("timestamp_ntz") if locale else F.to_timestamp_ntz(s, F.lit(pattern))
    return F.convert_timezone(F.lit(zone), F.current_timezone(), ts) if zone else ts


def add_months(ts: Column, n) -> Column:
    """Keeps the time of day; the day is held at the end of the month."""
    return F.timestamp_add("MONTH", n if isinstance(n, Column) else F.lit(n), ts)


# --- MySQL flavour ---------------------------------------------------------------------

# MySQL format letters and their Java pattern.
_MYSQL_FORMAT = {"%a": "EEE", "%b": "MMM", "%c": "MM", "%d": "dd", "%e": "d", "%H": "HH", "%h": "hh", "%I": "hh",
                 "%i": "mm", "%j": "DDD", "%k": "H", "%l": "h", "%M": "MMMM", "%m": "MM", "%p": "a", "%r": "hh:mm:ss a",
                 "%S": "ss", "%s": "ss", "%T": "HH:mm:ss", "%W": "EEEE", "%Y": "yyyy", "%y": "yy", "%%": "%"}


def unix_timestamp(ts: Column) -> Column:
    """Seconds since 1970 of the wall-clock time read as UTC."""
    return F.floor(wall_ms(ts) / 1000).cast("int")


def from_unixtime(seconds: Column, mysql_format: str = "%Y-%m-%d %H:%i:%S") -> Column:
    """UTC text of a number of seconds; independent of the session time zone."""
    pattern = re.sub("%.", lambda m: _MYSQL_FORMAT.get(m.group(), m.group()), mysql_format)
    at = F.timestamp_add("SECOND", seconds.cast("int"), F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")))
    return F.date_format(at, pattern)


def mysql_date(s: Column) -> Column:
    """The part of a date-time text before the first blank."""
    return F.substring_index(s, " ", 1)


# --- Oracle formats --------------------------------------------------------------------

# Oracle parse tokens and their Spark pattern, longest first.
_ORACLE_PARSE = [("YYYY", "yyyy"), ("RRRR", "yyyy"), ("MONTH", "MMMM"), ("HH24", "HH"), ("HH12", "hh"), ("DAY", "EEEE"),
                 ("DDD", "DDD"), ("MON", "MMM"), ("FF9", "SSSSSSSSS"), ("FF6", "SSSSSS"), ("FF3", "SSS"), ("FF", "SSSSSS"),
                 ("YY", "yy"), ("RR", "yy"), ("MM", "MM"), ("DD", "dd"), ("DY", "EEE"), ("HH", "hh"), ("MI", "mm"),
                 ("SS", "ss"), ("AM", "a"), ("PM", "a")]


def oracle_pattern(fmt: str) -> str:
    tokens = dict(_ORACLE_PARSE)
    rx = re.compile('"([^"]*)"|' + "|".join(t for t, _ in _ORACLE_PARSE) + "|(.)", re.IGNORECASE)

    def one(m):
        if m.group(1) is not None:
            return "'" + m.group(1).replace("'", "''") + "'"
        if m.group(2) is not None:
            if m.group(2).isalpha():
                raise ValueError(f"unknown format letter {m.group(2)!r} in {fmt!r}")
            return m.group(2)
        return tokens[m.group().upper()]

    return rx.sub(one, fmt)


def to_timestamp(s: Column, fmt: str) -> Column:
    """Parses with an Oracle format; month and day names in any case."""
    pattern = oracle_pattern(fmt)
    text = F.initcap(s) if re.search("MMM|EEE", pattern) else s
    return F.to_timestamp_ntz(text, F.lit(pattern))


def to_date(s: Column, fmt: str) -> Column:
    return to_timestamp(s, fmt)
