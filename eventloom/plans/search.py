"""Word search over the documents, and z-order box queries over the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import search as fts
from eventloom.operators import zorder as zo
from eventloom.plans.registry import query, table
from eventloom.session import scratch_path

# The word separators as a regular expression for the check, and the upper-casing of it.
_CLASS = r"""[ \t\n\r\f+"*%&/()=?''!,.;:\-_#@|^~`{}\[\]<>\\]+"""
_WORDS = f"SELECT doc_id AS key, unnest(regexp_split_to_array(upper(replace(text, 'ß', 'ss')), '{_CLASS}')) AS token FROM documents"
_INDEX = f"SELECT token, key, CAST(count(*) AS BIGINT) AS tf FROM ({_WORDS}) WHERE token <> '' GROUP BY 1, 2"


def _index(spark, sf, ignore=()):
    return fts.build_inverted_index(table(spark, sf, "documents"), "doc_id", ["text"], ignore)


query("text_index", _INDEX)(_index)
query("text_index_with_ignored_words", f"SELECT * FROM ({_INDEX}) WHERE token NOT IN ('THE', 'OF', 'LES')")(
    lambda s, d: _index(s, d, ["the", "of", "les"]))


def _search_sql(*words):
    w = ", ".join(f"'{x}'" for x in words)
    return f"""SELECT key, CAST(1.0 AS DOUBLE) AS score FROM ({_INDEX}) WHERE token IN ({w}) GROUP BY key HAVING count(*) = {len(words)}"""


query("text_search_all_words", _search_sql("THE", "OF", "AND"))(lambda s, d: fts.search(_index(s, d), "the of, and THE"))
query("text_search_unknown_word", "SELECT doc_id AS key, CAST(1.0 AS DOUBLE) AS score FROM documents WHERE false")(
    lambda s, d: fts.search(_index(s, d), "the zzzunknownzzz"))
query("text_search_ignored_word", _search_sql("AND"))(lambda s, d: fts.search(_index(s, d, ["the"]), "the and", ["the"]))


@query("text_search_rows", f"SELECT doc_id, lang, source, CAST(1.0 AS DOUBLE) AS score FROM documents WHERE doc_id IN (SELECT key FROM ({_search_sql('THE', 'IN')}))")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return fts.search_data(_index(spark, sf), docs, "doc_id", "the in").select("doc_id", "lang", "source", "score")


@query("text_search_stored_index", _search_sql("LE", "DES"))
def _(spark, sf):
    path = scratch_path(spark, "index")
    fts.write_index(_index(spark, sf), path, buckets=16)
    return fts.search(spark.read.parquet(path), "le des")


@query("text_search_ranked", f"""WITH i AS ({_INDEX}), len AS (SELECT key, sum(tf) AS len FROM i GROUP BY key),
t AS (SELECT count(*) AS n, avg(len) AS avg FROM len), h AS (SELECT * FROM i WHERE token IN ('THE', 'ONEN', 'LEAUX')),
d AS (SELECT token, count(*) AS df FROM h GROUP BY token)
SELECT h.key, round(sum(ln(1 + (t.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len.len / t.avg))), 6) AS score
FROM h JOIN d ON h.token = d.token JOIN len ON len.key = h.key CROSS JOIN t GROUP BY h.key""")
def _(spark, sf):
    lengths = fts.text_lengths(table(spark, sf, "documents"), "doc_id", ["text"])
    return fts.bm25(_index(spark, sf), lengths, "the onen leaux").withColumn("score", F.round("score", 6))


def _z_sql(a, b):
    return " | ".join(f"((({a} >> {i}) & 1) << {2 * i}) | ((({b} >> {i}) & 1) << {2 * i + 1})" for i in range(24))


_CENTS = "CAST(round(p_retailprice * 10) AS BIGINT)"


def _points(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("x"), F.round(F.col("p_retailprice") * 10).cast("bigint").alias("y"))


@query("zorder_encode_decode", f"SELECT p_partkey, {_z_sql('CAST(p_size AS BIGINT)', _CENTS)} AS z, CAST(p_size AS BIGINT) AS x, {_CENTS} AS y FROM part")
def _(spark, sf):
    z = _points(spark, sf).select("p_partkey", zo.interleave(F.col("x"), F.col("y")).alias("z"))
    return z.select("p_partkey", "z", zo.deinterleave(F.col("z"), 2, 0).alias("x"), zo.deinterleave(F.col("z"), 2, 1).alias("y"))


@query("zorder_box_query", f"SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 25 AND {_CENTS} BETWEEN 9100 AND 9600")
def _(spark, sf):
    path = scratch_path(spark, "zorder")
    zo.write_zordered(_points(spark, sf), ["x", "y"], path)
    return spark.read.parquet(path).filter(zo.box_filter("z", ["x", "y"], [10, 9100], [25, 9600])).select("p_partkey")
