"""TO_CHAR for numbers and timestamps with Oracle formats.

A format is a constant; it is turned into one column expression, so formatting runs
inside generated code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions import datetimes as dt

# Roman numerals by place.
_ROMAN = [("", "M", "MM", "MMM"),
          ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"),
          ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"),
          ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")]


def roman(n: Column) -> Column:
    """Roman numeral of a whole number; empty below one."""
    whole = F.greatest(n.cast("int"), F.lit(0))
    thousands = F.repeat(F.lit("M"), F.floor(whole / 1000).cast("int"))
    digits = [F.element_at(F.array(*[F.lit(t) for t in place]), (F.floor(whole / p) % 10 + 1).cast("int"))
              for place, p in zip(_ROMAN[1:], (100, 10, 1))]
    return F.concat(thousands, *digits)


def _hex(x: Column, fmt: str) -> Column:
    digits = sum(c in "0Xx" for c in fmt)
    h = F.hex(F.round(x.cast("decimal(38,10)"), 0).cast("bigint"))
    if "x" in fmt:
        h = F.lower(h)
    padded = F.lpad(h, digits, "0") if fmt.startswith("0") else h
    if not fmt.upper().startswith("FM"):
        padded = F.lpad(padded, len(fmt) + 1, " ")
    return F.when(F.length(h) > digits, F.lit("#" * (digits + 1))).otherwise(padded)


def number_to_char(x: Column, fmt: str | None = None) -> Column:
    """Format elements: 9 0 . D , G $ S MI PR FM V, and TM, RN, X formats.

    Not built: locale currency (C L U) and scientific notation (EEEE, TME).
    """
    up = fmt.upper() if fmt is not None else "TM"
    if up in ("TM", "TM9"):
        return F.regexp_replace(x.cast("string"), r"^0\.", ".")
    if up in ("RN", "FMRN"):
        out = roman(x) if up == "FMRN" else F.lpad(roman(x), 15, " ")
        return F.lower(out) if fmt.lstrip("Ff").lstrip("Mm").startswith("r") else out
    if up.endswith("X"):
        return _hex(x, fmt)
    body, lead, trail, minus, angle = up, False, False, False, False
    if body.startswith("S"):
        body, lead = body[1:], True
    if body.endswith("S"):
        body, trail = body[:-1], True
    if body.endswith("MI"):
        body, minus = body[:-2], True
    if body.endswith("PR"):
        body, angle = body[:-2], True
    fill = not body.startswith("FM")
    if not fill:
        body = body[2:]
    body = body.replace("B", "")
    shift = 0
    if "V" in body:
        shift = len(re.findall("[09]", body.split("V", 1)[1]))
        body = body.replace("V", "")
    if re.search("[^09.,DG$]", body):
        raise ValueError(f"format element not supported: {fmt!r}")
    whole, sep, frac = re.match(r"([^.D]*)([.D]?)(.*)", body).groups()
    scale = len(frac)
    value = F.round(x.cast("decimal(38,10)") * F.lit(10 ** shift).cast("decimal(20,0)"), scale)
    digits = F.abs(value).cast("decimal(38,10)").cast("string")
    int_part = F.regexp_replace(F.substring_index(digits, ".", 1), "^0+", "")
    slots = len(re.findall("[09]", whole))
    # Blank-padded integer digits: place k of the format reads character k.
    padded = F.lpad(int_part, slots, " ") if slots else F.lit("")
    pieces, k, zeros, cost = [], 0, False, 1
    for ch in whole:
        cost += ch in "09,G"
        if ch in "09":
            k += 1
            zeros = zeros or ch == "0"
            at = F.substring(padded, k, 1)
            pieces.append(F.when(at == " ", F.lit("0")).otherwise(at) if zeros else F.replace(at, F.lit(" "), F.lit("")))
        elif ch in ",G":
            shown = F.trim(F.substring(padded, 1, k)) != ""
            pieces.append(F.when(F.lit(zeros) | shown, F.lit(",")).otherwise(F.lit("")))
        else:
            pieces.append(F.lit("$"))
    if sep:
        cost += 1 + scale
        frac_digits = F.substring(F.substring_index(digits, ".", -1), 1, scale)
        if not fill:
            # Without fill mode trailing zeros stay only where the format says 0.
            keep = max((i + 1 for i, ch in enumerate(frac) if ch == "0"), default=0)
            tail = F.regexp_replace(F.substring(frac_digits, keep + 1, scale), "0+$", "")
            frac_digits = F.concat(F.substring(frac_digits, 1, keep), tail)
        pieces += [F.lit("."), frac_digits]
    text = F.concat(*pieces) if pieces else F.lit("")
    neg, pos = value < 0, value > 0
    if angle:
        signed = F.when(neg, F.concat(F.lit("<"), text, F.lit(">"))).otherwise(
            F.concat(F.lit(" "), text, F.lit(" ")) if fill else text)
    else:
        plus = "+" if lead or trail else (" " if fill else "")
        mark = F.when(neg, F.lit("-")).when(pos, F.lit(plus)).otherwise(F.lit(""))
        signed = F.concat(text, mark) if minus or trail else F.concat(mark, text)
    if fill:
        signed = F.when(F.length(signed) < cost, F.lpad(signed, cost, " ")).otherwise(signed)
    return F.when(F.length(int_part) > slots, F.lit("#" * (len(body) + 1))).otherwise(signed)


def _cased(token: str, c: Column) -> Column:
    """Written case of a token: DY, Dy and dy give MON, Mon and mon."""
    letters = [ch for ch in token if ch.isalpha()]
    if letters[0].islower():
        return F.lower(c)
    return F.upper(c) if len(letters) < 2 or letters[1].isupper() else F.initcap(c)


_TIME_TOKENS = ("A.D.", "B.C.", "AD", "BC", "A.M.", "P.M.", "AM", "PM", "DL", "DS", "TS", "DDD", "DD", "DY", "DAY", "D", "J",
                "HH24", "HH12", "HH", "MI", "SSSSS", "SS", "FF1", "FF2", "FF3", "FF4", "FF5", "FF6", "FF7", "FF8", "FF9", "FF",
                "IW", "WW", "W", "Y,YYY", "SYYYY", "YYYY", "IYYY", "RRRR", "YYY", "IYY", "YY", "IY", "RR", "I", "Y",
                "MONTH", "MON", "MM", "RM", "Q", "X", "FM", "FX")


def timestamp_to_char(ts: Column, fmt: str = "DD-MON-YY HH.MI.SS.FF PM") -> Column:
    """Oracle format tokens over the wall-clock fields. Time-zone tokens are not built."""
    rx = re.compile('"([^"]*)"|' + "|".join(re.escape(t) for t in sorted(_TIME_TOKENS, key=len, reverse=True)) + "|[-/,.;: ]",
                    re.IGNORECASE)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    year, ms = F.year(ts), F.pmod(dt.wall_ms(ts), F.lit(1000))
    filled, at, parts = True, 0, []
    while at < len(fmt):
        m = rx.match(fmt, at)
        if not m:
            raise ValueError(f"unknown format at {fmt[at:]!r}")
        raw, at = m.group(), m.end()
        t = raw.upper()
        if m.group(1) is not None:
            parts.append(F.lit(m.group(1)))
        elif t in ("FM", "FX"):
            filled = filled if t == "FX" else not filled
        elif t in ("A.D.", "B.C.", "AD", "BC"):
            dots = "." in t
            parts.append(_cased(raw, F.when(year > 0, F.lit("A.D." if dots else "AD")).otherwise(F.lit("B.C." if dots else "BC"))))
        elif t in ("A.M.", "P.M.", "AM", "PM"):
            dots = "." in t
            parts.append(_cased(raw, F.when(F.hour(ts) < 12, F.lit("A.M." if dots else "AM")).otherwise(F.lit("P.M." if dots else "PM"))))
        elif t in ("DL", "DS", "TS"):
            parts.append(F.date_format(ts, {"DL": "EEEE, MMMM d, yyyy", "DS": "MM/dd/yyyy", "TS": "h:mm:ss a"}[t]))
        elif t in ("DAY", "MONTH"):
            name = F.date_format(ts, "EEEE" if t == "DAY" else "MMMM")
            parts.append(_cased(raw, F.rpad(name, 9, " ") if filled else name))
        elif t in ("DY", "MON"):
            parts.append(_cased(raw, F.date_format(ts, "EEE" if t == "DY" else "MMM")))
        elif t == "RM":
            parts.append(_cased(raw, roman(F.month(ts))))
        elif t.startswith("FF"):
            scale = int(t[2]) - 3 if len(t) > 2 else 3
            parts.append(F.floor(ms * F.lit(float(10 ** scale) if scale >= 0 else 1 / 10 ** -scale)).cast("bigint").cast("string"))
        else:
            number = {
                "DDD": lambda: F.dayofyear(ts), "DD": lambda: two(F.dayofmonth(ts)), "D": lambda: F.dayofweek(ts),
                "J": lambda: F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) + 2440588,
                "HH24": lambda: two(F.hour(ts)), "HH12": lambda: two(F.hour(ts) % 12), "HH": lambda: two(F.hour(ts) % 12),
                "MM": lambda: two(F.month(ts)), "MI": lambda: two(F.minute(ts)), "SS": lambda: two(F.second(ts)),
                "SSSSS": lambda: F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts),
                "IW": lambda: dt.week_us(ts), "WW": lambda: dt.week_us(ts), "W": lambda: F.floor(F.dayofmonth(ts) / 7) + 1,
                "Y,YYY": lambda: F.format_number(year, 0), "Q": lambda: F.quarter(ts), "X": lambda: F.lit("."),
                "SYYYY": lambda: F.lpad(year.cast("string"), 4, "0"), "I": lambda: year % 10, "Y": lambda: year % 10,
            }.get(t)
            if number is None and len(t) > 1 and set(t) <= set("YIR"):
                number = lambda: F.lpad((year % 10 ** len(t)).cast("string"), len(t), "0")
            parts.append(F.lit(raw) if number is None else number().cast("string"))
    return F.concat(*parts)
