"""CSV files in and out, with the option names of the CSVREAD / CSVWRITE functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Option names and their aliases.
_OPTIONS = {
    "escape": "escape esc escapeCharacter", "delimiter": "fieldDelimiter fieldDelim",
    "separator": "fieldSeparator fieldSep", "comment": "lineComment lineCommentCharacter",
    "lineSep": "lineSeparator lineSep", "null": "null nullString", "charset": "charset characterSet",
    "preserve": "preserveWhitespace", "header": "writeColumnHeader", "case": "caseSensitiveColumnNames",
}
_NAMES = {alias.lower(): key for key, aliases in _OPTIONS.items() for alias in aliases.split()}

# An unquoted empty field becomes the null string; it must not equal a quoted empty one.
_NO_TEXT = "\ue000"


def parse_options(text: str = "") -> dict[str, str]:
    """``'fieldSeparator=; charset=UTF-8'`` as a dictionary with canonical names."""
    out = {}
    for pair in text.split(" "):
        if pair:
            name, _, value = pair.partition("=")
            if name.strip().lower() not in _NAMES:
                raise ValueError(f"unknown CSV option {name!r}")
            out[_NAMES[name.strip().lower()]] = value
    return out


def unique_names(names: Sequence[str | None], keep_case: bool = False) -> list[str]:
    """Blank headers become C1, C2, ...; a repeated one gets a ``1`` appended until it is new."""
    out: list[str] = []
    for i, n in enumerate(names):
        name = n if n else f"C{i + 1}"
        name = name if keep_case or not n else name.upper()
        while name in out:
            name += "1"
        out.append(name)
    return out


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, options: str = "",
             multiline: bool = True, keep_case: bool = True) -> DataFrame:
    """All columns are text. Without ``columns`` the first line names them.

    An unquoted empty field is NULL, a quoted one ''; unquoted fields are trimmed; short
    lines are filled with NULL, further fields dropped. ``multiline=False`` lets large
    files be split; it is for files known to have no line break inside quotes.
    """
    o = parse_options(options)
    space = "false" if o.get("preserve", "").lower() == "true" else "true"
    reader = (spark.read.option("sep", o.get("separator", ",")[:1]).option("quote", o.get("delimiter", '"')[:1])
              .option("escape", (o.get("escape") or '"')[:1]).option("encoding", o.get("charset", "UTF-8"))
              .option("nullValue", o.get("null") or _NO_TEXT).option("emptyValue", "")
              .option("ignoreLeadingWhiteSpace", space).option("ignoreTrailingWhiteSpace", space)
              .option("mode", "PERMISSIVE").option("multiLine", str(multiline).lower()))
    if o.get("comment"):
        reader = reader.option("comment", o["comment"][:1])
    if o.get("lineSep"):
        reader = reader.option("lineSep", o["lineSep"])
    if columns is None:
        first = reader.option("header", "false").csv(path).first()
        names = unique_names(list(first) if first else [], keep_case or o.get("case", "").lower() == "true")
    else:
        names = list(columns)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return reader.option("header", str(columns is None).lower()).option("enforceSchema", "true").schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, options: str = "") -> int:
    """Writes every non-NULL value quoted and NULL as the null string; returns the row count.

    The count is observed while writing. One file per task; each has the header.
    """
    o = parse_options(options)
    seen = Observation()
    texts = df.observe(seen, F.count(F.lit(1)).alias("n"))
    quote, null = o.get("delimiter", '"')[:1], o.get("null", "")
    esc = (o.get("escape") or quote)[:1]
    sep = o.get("separator", ",")

    def field(name):
        c = F.col(f"`{name}`").cast("string")
        body = F.replace(c, F.lit(quote), F.lit(esc + quote))
        if esc != quote:
            body = F.replace(F.replace(c, F.lit(esc), F.lit(esc * 2)), F.lit(quote), F.lit(esc + quote))
        return F.when(c.isNull(), F.lit(null)).otherwise(F.concat(F.lit(quote), body, F.lit(quote)))

    head = sep.join(quote + c.replace(quote, esc + quote) + quote for c in df.columns)
    line = F.concat_ws(sep, *[field(c) for c in df.columns])
    ready = texts.select(line.alias("value"))
    if o.get("header", "true").lower() != "false":
        # The header goes in front of the first row of each task's file.
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
        ready = ready.select(F.when(first, F.concat(F.lit(head + o.get("lineSep", "\n")), F.col("value"))).otherwise(F.col("value")).alias("value"))
    writer = ready.write.mode("overwrite").option("encoding", o.get("charset", "UTF-8"))
    if o.get("lineSep"):
        writer = writer.option("lineSep", o["lineSep"])
    writer.text(path)
    if not seen.get["n"] and o.get("header", "true").lower() != "false":
        # no row, so no task has put the header down
        line = df.sparkSession.range(1).select(F.lit(head).alias("value")).coalesce(1).write.mode("overwrite").option("encoding", o.get("charset", "UTF-8"))
        (line.option("lineSep", o["lineSep"]) if o.get("lineSep") else line).text(path)
    return seen.get["n"]
