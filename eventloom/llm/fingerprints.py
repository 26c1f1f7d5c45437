"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range, kept exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import text_key
from eventloom.llm.mixing import WORD
from eventloom.llm.registry import query
from eventloom.operators.ids import assign_ids
from eventloom.session import cut_lineage

WORDS = 5
FRACTION = 0.125


def sketch(text: Column, fraction: float = FRACTION, n: int = WORDS) -> Column:
    """Sorted distinct hashes of the text's ``n``-word shingles below ``fraction`` of the range.

    A text with fewer words is one shingle; where no hash is below the limit, the smallest one stands for the text,
    so only texts without words have an empty sketch.
    """
    limit = int(-(1 << 63) + fraction * (1 << 64))
    hashes = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})")), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        last = F.size(h) - n
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(
            last <= 0, F.array(F.xxhash64(h))).otherwise(F.transform(
                F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])))

    def kept(s: Column) -> Column:
        low = F.filter(s, lambda x: x < limit)
        return F.when(F.size(low) > 0, F.sort_array(F.array_distinct(low))).when(
            F.size(s) > 0, F.array(F.array_min(s))).otherwise(F.array().cast("array<bigint>"))

    # one-element transforms name an intermediate value, so it is computed once
    return F.transform(F.transform(F.array(hashes), shingles), kept)[0]


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of the smaller text's shingles that the other has; 1 for two texts without words."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(
        (F.size(a) == F.size(b)).cast("double"))


def as_text(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def next_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, key, n, next_id, next_key`` for each different document, in descending id, the first after the last.

    Nulls come last; equal ids are ordered by the text's digest; rows equal in both are one document.
    """
    light = docs.select("doc_id", text_key().alias("key"), F.coalesce(F.length("text"), F.lit(0)).alias("n")).distinct()
    placed = cut_lineage(assign_ids(light, [F.col("doc_id").desc_nulls_last(), F.col("key").desc_nulls_last()], "at", 0))
    total = placed.count()
    after = placed.select(F.pmod(F.col("at") - 1, F.lit(max(total, 1))).alias("at"), F.col("doc_id").alias("next_id"),
                          F.col("key").alias("next_key"))
    return placed.join(after, "at").drop("at")


def fingerprints(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """One row per row of ``docs``: the fingerprint, that of the edited text, and both likenesses.

    Null texts count as empty. The texts are shuffled once by document; the second join reads the same exchange.
    """
    # both joins read the same columns, so the second reuses the exchange of the first
    texts = docs.select(F.xxhash64("doc_id", text_key()).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    nexts = next_documents(docs).select("doc_id", F.xxhash64("doc_id", "key").alias("for_k"), F.xxhash64("next_id", "next_key").alias("k"),
                                        F.floor(F.col("n") / 3).cast("int").alias("take"))
    heads = (texts.join(nexts, "k").withColumn("head", F.substring(F.col("text"), F.lit(1), F.col("take")))
             .withColumn("next_print", sketch(F.col("text"), fraction))
             .groupBy(F.col("for_k").alias("k")).agg(F.first("doc_id").alias("doc_id"), F.first("head").alias("head"), F.first("next_print").alias("next_print")))
    both = texts.join(heads, "k")
    n = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 3).cast("int")), F.col("head"))
    return (both.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
            .withColumn("print", sketch(F.col("text"), fraction)).withColumn("edited_print", sketch(F.col("edited"), fraction)))


@query("op10_fingerprints")
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return f.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                    as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"),
                    likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
                    likeness(F.col("print"), F.col("next_print")).alias("near_next"))
