"""Numeric functions whose results differ from Spark's own of the same name.

Everything else of the numeric surface (abs, acos, asin, atan, atan2, cos, cosh, cot,
degrees, exp, log10, pow, radians, sin, sinh, sqrt, tan, tanh, greatest, least, ...) is the
Spark function itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ceiling(x: Column) -> Column:
    """Smallest whole number >= x, as a double."""
    return F.ceil(x).cast("double")


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def ln(x: Column) -> Column:
    """Natural logarithm; NaN (not NULL) below zero and -Infinity at zero."""
    v = x.cast("double")
    return F.when(v < 0, F.lit(float("nan"))).when(v == 0, F.lit(float("-inf"))).otherwise(F.ln(v))


def log(x: Column, base10: bool = False) -> Column:
    """LOG is the natural logarithm, or base 10 in the PostgreSQL flavour."""
    return ln(x) / F.lit(2.302585092994046) if base10 else ln(x)


def mod(a: Column, b: Column) -> Column:
    """Remainder as BIGINT; dividing by zero raises."""
    return a.cast("bigint") % b.cast("bigint")


def round_half_away(x: Column, digits: Column | int = 0) -> Column:
    """Half away from zero, as a double."""
    d = F.lit(digits) if isinstance(digits, int) else digits
    f = F.pow(F.lit(10.0), d)
    return F.signum(x) * F.floor(F.abs(x) * f + 0.5) / f


def round_magic(x: Column) -> Column:
    """Removes the digit noise of binary fractions.

    Only a long decimal (16 characters or more, three or more after the point) changes, by its tail: its last two characters go; if the three
    before the then last one are 000 that one becomes 0, if they are 999 it becomes 9 and more nines follow. Values
    within 1e-13 are 0, those beyond 1e12 and those with an exponent stay as they are.
    """
    v = x.cast("double")
    text = v.cast("string")
    size = F.length(text)
    body = F.substring(text, F.lit(1), size - 3)
    tail = F.substring(text, size - 5, F.lit(3))
    cut = F.when(tail == "000", F.concat(body, F.lit("0"))).when(tail == "999", F.concat(body, F.lit("9999"))).otherwise(
        F.substring(text, F.lit(1), size - 2))
    short = (size < 16) | F.contains(text, F.lit("E")) | (size - F.instr(text, ".") < 3)
    return F.when(F.abs(v) < 1e-13, F.lit(0.0)).when((F.abs(v) > 1e12) | short, v).otherwise(cut.try_cast("double"))


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def truncate(x: Column, digits: int = 0) -> Column:
    """Toward zero, as a double."""
    f = float(10 ** digits) if digits >= 0 else 1.0 / 10 ** -digits
    g = x.cast("double") * F.lit(f)
    return F.when(g < 0, F.ceil(g)).otherwise(F.floor(g)).cast("double") / F.lit(f)


def bit_get(x: Column, i: Column | int) -> Column:
    return F.getbit(x.cast("bigint"), F.lit(i) if isinstance(i, int) else i) == 1


def bit_and(a: Column, b: Column) -> Column:
    return a.cast("bigint").bitwiseAND(b.cast("bigint"))


def bit_or(a: Column, b: Column) -> Column:
    return a.cast("bigint").bitwiseOR(b.cast("bigint"))


def bit_xor(a: Column, b: Column) -> Column:
    return a.cast("bigint").bitwiseXOR(b.cast("bigint"))


def sha256_hash(data: Column, rounds: int = 1) -> Column:
    """SHA-256 applied ``rounds`` times, as binary."""
    out = data
    for _ in range(rounds):
        out = F.unhex(F.sha2(out, 256))
    return out


def random_bytes(n: int) -> Column:
    """``n`` random bytes, cut from random UUIDs. Not meant as key material."""
    pieces = [F.replace(F.uuid(), F.lit("-"), F.lit("")) for _ in range(-(-n // 15))]
    # The version digit of a UUID is constant; 15 of its 16 bytes are taken.
    body = F.concat(*[F.concat(F.substring(p, 1, 12), F.substring(p, 15, 18)) for p in pieces])
    return F.unhex(F.substring(body, 1, 2 * n))


def text_hash(s: Column, buckets: int = 0, seed: int = 0) -> Column:
    """32-bit polynomial hash of the UTF-16 units of a text (``h = 31 h + unit``)."""
    hexed = F.hex(F.encode(s, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(1), F.length(hexed), F.lit(4)),
                        lambda i: F.conv(F.substring(hexed, i, F.lit(4)), 16, 10).cast("bigint"))
    wrap = lambda c: F.pmod(c, F.lit(1 << 32))
    h = F.aggregate(units, F.lit(0).cast("bigint"), lambda a, u: wrap(a * 31 + u))
    if seed:
        h = wrap(h * F.lit((seed * 17) % (1 << 32)))
    h = F.when(s == "", F.lit(0)).otherwise(F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h))
    return (h % buckets if buckets > 0 else h).cast("int")
