"""Mixing sources to target weights by exponential keys.

Every source gets a share of the words to take. A source whose share holds all its words
once or twice is taken in whole epochs first; the rest of the share is filled in the order
of exponential keys ``-ln(u) / w`` (``u`` from the document id, ``w`` the document's
quality), which samples without replacement in proportion to quality.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import small_side
from eventloom.llm.registry import query
from eventloom.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Keys are cut into so many ranges, twice: a source's boundary is looked for in one of them only.
RANGES = 4096
JUNK = "#$%&*|<>{}=~"


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: str = "text") -> Column:
    """From 0.25 to 1: how little of the text is junk punctuation; 1 for an empty text."""
    n = F.length(text)
    kept = F.length(F.translate(F.col(text), JUNK, ""))
    return F.when(n > 0, F.lit(0.25) + F.lit(0.75) * (kept / n)).otherwise(F.lit(1.0))


def unit(key: Column) -> Column:
    """A fixed number between 0 and 1, both excluded, for each key (null is a key too)."""
    bits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from one row per source.

    Sources in code-point order, null last, weigh ``weights`` in turn. Together they get ``share`` of
    all words; none gets more than ``most`` times its own, and what is over goes to the others by weight.
    That is one water level: with sources in the order of cap over weight, those below the level are
    capped. Windows run over one row per source, never over documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    s = (sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(most))
         .withColumn("ratio", F.col("cap") / F.col("w")))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = (s.withColumn("budget", F.sum("source_size").over(whole) * F.lit(share))
         .withColumn("capped", F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
         .withColumn("left_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
         .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("left_w"))
         .withColumn("is_capped", F.col("ratio") <= F.col("level")))
    first = F.min(F.when(~F.col("is_capped"), F.struct("ratio", F.col("source").isNull().alias("n"),
                                                       F.coalesce("source", F.lit("")).alias("s"), "level"))).over(whole)
    return s.select("source", "source_size",
                    F.when(F.col("is_capped"), F.col("cap")).otherwise(F.col("w") * first["level"]).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST,
        quality: Column | None = None, id_col: str = "doc_id", row: str | None = None) -> DataFrame:
    """``doc_id, source, size, source_size, target, epochs, taken`` for every row of ``docs``.

    ``taken`` counts words, repeats included: ``epochs`` times the whole document and, for the
    fractional rest of the source's target, whole documents in key order; the document on the
    boundary is taken in part, so each source meets its target to the word.

    Null text: size 0, nothing to take. Null source: a source of its own, last. Null or repeated ids
    share a key and are ordered by the text. A column named by ``row`` is handed on beside each row. Only ids, sources, sizes and keys are kept for the
    passes after the first; the boundary is found from two histograms of fixed length per source,
    and only the documents of one key range per source are sorted.
    """
    key = -F.log(unit(F.col(id_col))) / (quality if quality is not None else text_quality())
    light = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), F.col("source"), words().alias("size"),
                                    key.alias("key"), F.xxhash64("text").alias("tie"), *([row] if row else [])))
    # ranges of 1 - exp(-key): even for equal weights, monotonic always
    at = (F.lit(1.0) - F.exp(-F.col("key"))) * F.lit(float(RANGES))
    light = (light.withColumn("r1", F.least(F.floor(at), F.lit(RANGES - 1)).cast("int"))
             .withColumn("r2", F.least(F.floor((at - F.floor(at)) * F.lit(float(RANGES))), F.lit(RANGES - 1)).cast("int"))
             .withColumn("no_source", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit(""))))
    by = ["source", "no_source"]
    first = cut_lineage(light.groupBy(*by, "r1").agg(F.sum("size").alias("n")))
    sizes = first.groupBy(*by).agg(F.sum("n").alias("source_size"))
    named = F.when(~F.col("no_source"), F.col("source"))
    targets = source_targets(sizes.select(named.alias("source"), "source_size"), weights, share, most)
    targets = cut_lineage(targets.select(
        F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("no_source"),
        "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(F.lit(0))
        .cast("long").alias("epochs")))
    targets = targets.withColumn("rest", F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))

    def boundary(counts: DataFrame, r: str, need: str) -> DataFrame:
        """The range of each source in which the running sum passes ``need``, and what is left to take in it."""
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(r)
                                            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return (counts.withColumn("before", before)
                .where((F.col("before") <= F.col(need)) & (F.col(need) < F.col("before") + F.col("n")))
                .select(*by, F.col(r).alias(f"cut_{r}"), (F.col(need) - F.col("before")).alias(f"need_{r}")))

    one = cut_lineage(boundary(first.join(small_side(targets), by), "r1", "rest"))
    inside = light.join(small_side(one), by).where("r1 = cut_r1")
    second = inside.groupBy(*by, "r2").agg(F.sum("size").alias("n"), F.first("need_r1").alias("need_r1"))
    two = cut_lineage(boundary(second, "r2", "need_r1"))
    plan = cut_lineage(targets.join(one, by, "left").join(two, by, "left"))
    placed = light.join(small_side(plan), by)
    edge = (F.col("r1") == F.col("cut_r1")) & (F.col("r2") == F.col("cut_r2"))
    below = F.col("cut_r1").isNull() | (F.col("r1") < F.col("cut_r1")) | \
        ((F.col("r1") == F.col("cut_r1")) & (F.col("r2") < F.col("cut_r2")))
    out = ["doc_id", named.alias("source"), "size", "source_size", "target", "epochs", *([row] if row else [])]
    # no boundary: the rest is 0, or the source has no words; nothing is taken beyond whole epochs then
    plain = (placed.where(~F.coalesce(edge, F.lit(False)))
             .withColumn("part", F.when(F.col("cut_r1").isNotNull() & below, F.col("size")).otherwise(F.lit(0))))
    order = Window.partitionBy(*by).orderBy("key", F.col("doc_id").asc_nulls_first(), "tie", "size")
    used = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sorted_ = placed.where(F.coalesce(edge, F.lit(False))).withColumn(
        "part", F.least(F.greatest(F.col("need_r2") - used, F.lit(0)), F.col("size")))
    taken = (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken")
    return plain.select(*out, taken).unionByName(sorted_.select(*out, taken))


_ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN length(text) > 0
              THEN 0.25::DOUBLE + 0.75::DOUBLE * (length(translate(text, '#$%&*|<>{}=~', ''))::DOUBLE / length(text)::DOUBLE)
              ELSE 1.0::DOUBLE END AS q,
         ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / q AS key FROM d),
z AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS wt,
             source_size * 2.0::DOUBLE AS cap FROM z),
v AS (SELECT *, cap / wt AS ratio,
             (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
              - coalesce(sum(cap) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / (sum(wt) OVER () - coalesce(sum(wt) OVER (ORDER BY cap / wt, source NULLS LAST
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
l AS (SELECT level FROM v WHERE ratio > level ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN ratio <= level THEN cap ELSE wt * (SELECT level FROM l) END AS target FROM v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(round(target) / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT *, round(target)::BIGINT - epochs * source_size AS rest FROM e)
SELECT k.doc_id, k.size, r.source_size, r.target,
       (r.epochs * k.size + least(greatest(r.rest - coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), k.size))::BIGINT AS taken
FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source
"""


@query("op7_mixing", _ORACLE)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "source_size", "target", "taken")
