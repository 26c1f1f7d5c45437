"""Text functions whose results differ from Spark's own of the same name.

Lengths are counted in UTF-16 units. Positions and cuts are counted in characters, so
they differ for characters outside the basic plane only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def ascii_code(s: Column) -> Column:
    """Code of the first character; NULL for an empty text."""
    return F.when(s != "", F.ascii(s))


def char(n: Column) -> Column:
    """The character with UTF-16 code ``n``; of larger numbers the lowest 16 bits count."""
    return F.decode(F.unhex(F.lpad(F.hex(n.cast("bigint").bitwiseAND(F.lit(0xFFFF))), 4, "0")), "UTF-16BE")


def char_length(s: Column) -> Column:
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("bigint")


def bit_length(s: Column) -> Column:
    return char_length(s) * 16


def octet_length(s: Column) -> Column:
    return char_length(s) * 2


def concat(*cols: Column) -> Column:
    """Joins the non-NULL parts; NULL only when every part is."""
    return F.when(F.coalesce(*cols).isNotNull(), F.concat_ws("", *cols))


def concat_ws(sep, *cols: Column) -> Column:
    """Joins the parts that are neither NULL nor empty; '' when there is none."""
    parts = F.array(*cols)
    kept = F.filter(parts, lambda x: x.isNotNull() & (x != ""))
    return F.array_join(kept, sep) if isinstance(sep, str) else F.concat_ws("", F.transform(
        kept, lambda x, i: F.when(i > 0, F.concat(sep, x)).otherwise(x)))


def soundex(s: Column) -> Column:
    """Four-place code over the letters A-Z; the first letter keeps its case; '0000' without letters."""
    letters = F.regexp_replace(s, "[^A-Za-z]", "")
    code = F.soundex(letters)
    return F.when(letters == "", F.lit("0000")).otherwise(
        F.concat(F.left(letters, F.lit(1)), F.substring(code, 2, 3)))


def difference(a: Column, b: Column) -> Column:
    """How many of the four code places agree, 0..4."""
    x, y = soundex(a), soundex(b)
    same = [F.when(F.substring(x, i, 1) == F.substring(y, i, 1), 1).otherwise(0) for i in range(1, 5)]
    return F.when(a.isNotNull() & b.isNotNull(), same[0] + same[1] + same[2] + same[3])


def hex_to_raw(h: Column) -> Column:
    """Four hexadecimal digits per character; any other length is an error."""
    wrong = F.raise_error(F.concat(F.lit("not four hexadecimal digits per character: "), h)).cast("string")
    return F.when(F.length(h) % 4 == 0, F.decode(F.unhex(h), "UTF-16BE")).when(h.isNotNull(), wrong)


def raw_to_hex(s: Column) -> Column:
    return F.lower(F.hex(F.encode(s, "UTF-16BE")))


def insert(s: Column, start, length, new: Column) -> Column:
    """Replaces ``length`` characters from ``start``; an impossible request changes nothing."""
    start, length = _c(start), _c(length)
    idle = (start < 1) | (length <= 0) | (new == "") | (start - 1 > F.length(s))
    done = F.concat(F.substring(s, F.lit(1), start - 1), new, F.substring(s, start + length, F.length(s)))
    return F.when(s.isNull(), new).when(new.isNull() | idle, s).otherwise(done)


def left(s: Column, n) -> Column:
    return F.left(s, F.greatest(_c(n), F.lit(0)))


def right(s: Column, n) -> Column:
    return F.right(s, F.greatest(_c(n), F.lit(0)))


def locate(search, s: Column, start=1) -> Column:
    """1-based place of ``search`` from ``start`` on, 0 if absent. A negative start searches
    backwards, from that many characters before the end."""
    search, start = _c(search), _c(start)
    forward = F.call_function("locate", search, s, F.greatest(start, F.lit(1)))
    head = F.substring(s, F.lit(1), F.length(s) + start + F.length(search))
    place = F.call_function("locate", F.reverse(search), F.reverse(head))
    back = F.when((F.length(s) + start < 0) | (place == 0), F.lit(0)).otherwise(
        F.length(head) - place - F.length(search) + 2)
    return F.when(start < 0, back).otherwise(forward).cast("int")


def instr(s: Column, search, start=1) -> Column:
    return locate(search, s, start)


def position(search, s: Column) -> Column:
    return locate(search, s)


def truncate_value(s: Column, precision: int) -> Column:
    """A text cut to a column's precision."""
    return F.left(s, F.lit(precision))


def _first(c) -> Column:
    """The first character; an empty text means a blank."""
    return F.when(_c(c) == "", F.lit(" ")).otherwise(F.left(_c(c), F.lit(1)))


def trim(s: Column, char=" ") -> Column:
    """Strips the first character of ``char`` only, not a set of characters."""
    return F.btrim(s, _first(char))


def ltrim(s: Column, char=" ") -> Column:
    return F.ltrim(s, _first(char))


def rtrim(s: Column, char=" ") -> Column:
    return F.rtrim(s, _first(char))


def lpad(s: Column, n, pad=" ") -> Column:
    """Pads with the first character of ``pad``, or cuts to ``n``."""
    return F.call_function("lpad", s, _c(n), _first(pad))


def rpad(s: Column, n, pad=" ") -> Column:
    return F.call_function("rpad", s, _c(n), _first(pad))


def repeat(s: Column, n) -> Column:
    return F.repeat(s, F.greatest(_c(n), F.lit(0)))


def space(n) -> Column:
    return repeat(F.lit(" "), n)


def replace(s: Column, old, new="") -> Column:
    """Replaces every ``old``; an empty ``old`` changes nothing."""
    return F.when(_c(old) == "", s).otherwise(F.replace(s, _c(old), _c(new)))


def substring(s: Column, start, length=None) -> Column:
    """0 means 1; a negative start counts from the end and is held at the first character
    without shortening the length."""
    start = _c(start)
    size = F.length(s)
    at = F.greatest(F.when(start < 0, size + start + 1).otherwise(start), F.lit(1))
    return F.substring(s, at, size if length is None else F.greatest(_c(length), F.lit(0)))


def _with_flags(pattern: str, flags: str) -> str:
    names = {"i": "i", "n": "s", "m": "m"}
    on: set[str] = set()
    for f in flags:
        if f == "c":
            on.discard("i")
        elif f in names:
            on.add(names[f])
        else:
            raise ValueError(f"unknown regular expression flag {f!r}")
    return f"(?{''.join(sorted(on | {'u'}))}){pattern}"


def regexp_replace(s: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    return F.regexp_replace(s, _with_flags(pattern, flags), replacement)


def regexp_like(s: Column, pattern: str, flags: str = "") -> Column:
    """TRUE when the pattern is found anywhere."""
    return F.rlike(s, F.lit(_with_flags(pattern, flags)))


def translate(s: Column, find: str, to: str) -> Column:
    """Characters of ``find`` beyond the length of ``to`` are kept."""
    return F.translate(s, find, to + find[len(to):]) if find else s


def utf8_bytes(s: Column) -> Column:
    return F.encode(s, "UTF-8")


def utf8_text(b: Column) -> Column:
    return F.decode(b, "UTF-8")


# --- XML ------------------------------------------------------------------------------

# The escapes of XML text.
_XML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")]


def xml_text(s: Column, escape_newline: bool = False) -> Column:
    """Escapes markup, and every character outside printable ASCII as ``&#x...;``."""
    out = s
    for raw, esc in _XML_ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(esc))
    plain = r"^[\x20-\x7F\t]*$" if escape_newline else r"^[\x20-\x7F\t\r\n]*$"
    keep = r"[\x20-\x7F\t]" if escape_newline else r"[\x20-\x7F\t\r\n]"
    coded = F.array_join(F.transform(F.split(out, ""), lambda ch: F.when(
        (ch == "") | ch.rlike(keep), ch).otherwise(F.regexp_replace(
            F.lower(F.hex(F.encode(ch, "UTF-16BE"))), "0*([0-9a-f]{1,4})(?=([0-9a-f]{4})*$)", "&#x$1;"))), "")
    return F.when(out.rlike(plain), out).otherwise(coded)


def xml_attr(name, value: Column) -> Column:
    return F.concat(F.lit(" "), _c(name), F.lit('="'), xml_text(value), F.lit('"'))


def indent(s: Column, spaces: int = 4) -> Column:
    """Every line moved right; the text ends with a newline."""
    moved = F.regexp_replace(s, r"(?<=\A|\n)(?!\z)", " " * spaces)
    return F.when(F.endswith(moved, F.lit("\n")), moved).otherwise(F.concat(moved, F.lit("\n")))


def xml_node(name, attributes: Column | None = None, content: Column | None = None, indented: bool = True) -> Column:
    name = _c(name)
    start = F.concat(name, F.coalesce(attributes, F.lit(""))) if attributes is not None else name
    empty = F.concat(F.lit("<"), start, F.lit("/>\n"))
    if content is None:
        return empty
    body = content
    if indented:
        body = F.when(F.contains(content, F.lit("\n")), F.concat(F.lit("\n"), indent(content))).otherwise(content)
    return F.when(content.isNull(), empty).otherwise(
        F.concat(F.lit("<"), start, F.lit(">"), body, F.lit("</"), name, F.lit(">\n")))


def xml_comment(s: Column) -> Column:
    apart = F.regexp_replace(s, "-(?=-)", "- ")
    return F.when(F.contains(apart, F.lit("\n")), F.concat(F.lit("<!--\n"), indent(apart), F.lit("-->\n"))).otherwise(
        F.concat(F.lit("<!-- "), apart, F.lit(" -->\n")))


def xml_cdata(s: Column) -> Column:
    wrapped = F.concat(F.lit("<![CDATA["), s, F.lit("]]>"))
    return (F.when(F.contains(s, F.lit("]]>")), xml_text(s))
            .when(F.endswith(s, F.lit("\n")), F.concat(wrapped, F.lit("\n"))).otherwise(wrapped))


def xml_start_doc() -> Column:
    return F.lit('<?xml version="1.0"?>\n')
