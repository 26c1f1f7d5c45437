"""The corpus pipeline: language, near copies, personal data, mixing, packing; each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import langid, minhash, mixing, packing, pii
from eventloom.llm.common import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A language guess below this is a rejection, as is ``und``.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those whose language stays unclear; without labels nothing is unclear."""
    net = langid.train(docs.where(~langid.held_out(3, 1)).select("doc_id", "text", "lang"))
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    return langid.identify(docs, net).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``row`` number of its own for every row, written down, so it stays the same in all later reads."""
    return stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "numbered")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class, null last; ids name no row, so they may be null or repeated."""
    rows = numbered(docs)
    classes = minhash.near_copies(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "class_id")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", F.md5(F.col("text").cast("binary")).alias("t"), "source", "lang", "row")
    kept = (classes.join(rows.select("row", order.alias("place")), "row").groupBy("class_id").agg(F.min("place").alias("first"))
            .select(F.col("first.row").alias("row")))
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every span found by its kind in brackets."""
    return pii.redact(pii.find(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as the mix takes it; the one on a source's boundary is cut after the words taken."""
    rows = numbered(docs)
    joined = rows.join(mixing.mix(rows, row="row").where("taken > 0").select("row", "size", "taken"), "row")
    whole = F.array_repeat(F.col("size"), F.floor(F.col("taken") / F.col("size")).cast("int"))
    rest = F.col("taken") % F.col("size")
    parts = F.concat(whole, F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    short = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"([\\x20\\x09-\\x0D]*{mixing.WORD})")), F.lit(1),
                                 F.col("words").cast("int")), "")
    cut = joined.withColumn("words", F.explode(parts)).withColumn(
        "text", F.when(F.col("words") < F.col("size"), short).otherwise(F.col("text")))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids; repeats of a document are documents of their own."""
    return packing.digest(packing.pack_documents(docs))


STAGES = [("language", language), ("near_dedup", near_dedup), ("personal_data", personal_data),
          ("mixture", mixture), ("packing", packed)]

#: A trained network and a tokenizer are no SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
