"""Word search over text columns: an inverted index as a table, AND search, BM25 ranking."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that separate words.
SEPARATORS = " \t\n\r\f+\"*%&/()=?'!,.;:-_#@|^~`{}[]<>\\"


def _separator_class(negated: bool = False) -> str:
    named = {"\t": "\\t", "\n": "\\n", "\r": "\\r", "\f": "\\f"}
    return ("[^" if negated else "[") + "".join(named.get(c, c if c == " " else "\\" + c) for c in SEPARATORS) + "]+"


def _pieces(columns: Sequence[str]) -> Column:
    """The texts of a row cut at separators, upper-cased. Pieces may be empty.

    The columns are put together with a separator, which no word can cross.
    """
    return F.split(F.upper(F.concat_ws(" ", *columns)), _separator_class())


def query_words(text: str, ignore: Iterable[str] = ()) -> list[str]:
    """The distinct words a search text asks for."""
    table = str.maketrans({c: " " for c in SEPARATORS})
    drop = {w.upper() for w in ignore}
    return list(dict.fromkeys(w for w in text.upper().translate(table).split(" ") if w and w not in drop))


def build_inverted_index(df: DataFrame, key: str, columns: Sequence[str], ignore: Iterable[str] = ()) -> DataFrame:
    """``token, key, tf``: one row per word and row of the table.

    The count per (token, key) combines map-side; a word found in a third of all rows is
    spread over their keys.
    """
    rows = df.select(F.col(key).alias("key"), F.explode(_pieces(columns)).alias("token")).filter(F.col("token") != "")
    drop = [w.upper() for w in ignore]
    if drop:
        rows = rows.filter(~F.col("token").isin(drop))
    return rows.groupBy("token", "key").agg(F.count(F.lit(1)).alias("tf"))


def text_lengths(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key, len``: the number of words of each row, ignored ones included. No shuffle."""
    words = F.regexp_count(F.concat_ws(" ", *columns), F.lit(_separator_class(negated=True)))
    return df.select(F.col(key).alias("key"), words.alias("len"))


def write_index(index: DataFrame, path: str, buckets: int = 256) -> None:
    """Stores the index clustered by word: a search reads few row groups, and the words of
    one file are spread by their hash so that no file holds the frequent ones together."""
    (index.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
     .repartitionByRange("bucket", "token", "key").sortWithinPartitions("bucket", "token", "key")
     .write.mode("overwrite").partitionBy("bucket").parquet(path))


def search(index: DataFrame, text: str, ignore: Iterable[str] = ()) -> DataFrame:
    """Keys of the rows containing all words of ``text``, score 1.0 each.

    Ignored words are dropped from the query; an unknown word gives no rows, and so does
    an empty query.
    """
    asked = query_words(text, ignore)
    if not asked:
        return index.filter(F.lit(False)).select("key", F.lit(1.0).alias("score"))
    return (index.filter(F.col("token").isin(asked)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") == len(asked)).select("key", F.lit(1.0).alias("score")))


def search_data(index: DataFrame, df: DataFrame, key: str, text: str, ignore: Iterable[str] = ()) -> DataFrame:
    """The rows themselves, with their score."""
    hits = search(index, text, ignore)
    return df.join(hits, df[key] == hits["key"]).drop("key")


def bm25(index: DataFrame, lengths: DataFrame, text: str, ignore: Iterable[str] = (), k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``key, score`` of rows containing any asked word, by BM25.

    ``lengths`` is ``text_lengths`` of the same table. Only postings of asked words are read
    from the index and meet the lengths. Rows without words do not count.
    """
    asked = query_words(text, ignore)
    lengths = lengths.filter(F.col("len") > 0)
    total = lengths.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg")).alias("s")).scalar()
    hits = index.filter(F.col("token").isin(asked) if asked else F.lit(False))
    # One row per asked word: as long as the query.
    df_of = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    scored = hits.join(F.broadcast(df_of), "token").join(lengths, "key")
    idf = F.log(1 + (total["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("len") / total["avg"])
    return scored.groupBy("key").agg(F.sum(idf * F.col("tf") * (k1 + 1) / norm).alias("score"))
