"""Toxicity by a weighted finite-state grammar over clauses.

Insult and threat arcs carry weights, partly given and partly learned from labels (words and word
beginnings that almost only toxic texts have). The target, negation and reported-speech transducers
rewrite the weight of what they meet in the same clause. A logistic curve fitted on labelled texts
turns the sum of clause weights into a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import small_side
from eventloom.llm.langid import held_out
from eventloom.llm.registry import query
from eventloom.session import cut_lineage

#: At most about so many labelled texts are fitted on, chosen by a hash.
SAMPLE_ROWS = 20_000
INSULTS = frozenset("idiot moron loser scum trash worthless stupid pathetic disgusting clown".split())
THREATS = frozenset("kill hurt destroy murder beat stab shoot".split())
TARGETS = frozenset("you your yourself they them he she his her".split())
NEGATIONS = frozenset("not never isn aren wasn don doesn didn".split())
REPORTS = frozenset("said says reported quoted wrote claims claimed".split())
PREFIXES = (4, 5, 6)
REACH = 3  # tokens that a negation governs
_CLAUSE = re.compile(r"[.!?;\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def clause_weight(tokens: list[str], arcs: dict[str, float]) -> float:
    """The composed weight of one clause: negated arcs count a quarter and reported clauses half, aimed ones 1.25 times."""
    total, negated, aimed, reported = 0.0, 0, False, False
    for t in tokens:
        w = arcs.get(t, 0.0)
        if not w:
            w = max((arcs.get(t[:n] + "*", 0.0) for n in PREFIXES if len(t) >= n), default=0.0)
        if w:
            total += w * (0.25 if negated else 1.0)
        aimed |= t in TARGETS
        reported |= t in REPORTS
        negated = REACH if t in NEGATIONS else max(0, negated - 1)
    return total * (1.25 if aimed else 1.0) * (0.5 if reported else 1.0)


def text_weight(text: str | None, arcs: dict[str, float]) -> float:
    """Sum of the clause weights; clauses are walked only in texts that have an arc's word at all."""
    if not text:
        return 0.0
    low = text.lower()
    words = set(_WORD.findall(low))
    if not any(w in arcs or any(w[:n] + "*" in arcs for n in PREFIXES) for w in words):
        return 0.0
    return sum(clause_weight(_WORD.findall(c), arcs) for c in _CLAUSE.split(low))


def weigh(docs: DataFrame, arcs: dict[str, float]) -> DataFrame:
    """``docs`` with ``weight``."""
    from pyspark.sql import types as T
    names = docs.columns
    at = names.index("text")

    def run(batches) -> Iterator:
        import pyarrow as pa
        for b in batches:
            w = [text_weight(t, arcs) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(w, pa.float64())], [*names, "weight"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("weight", T.DoubleType())]))


def sample(labels: DataFrame, key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``sample_rows`` of the labels, chosen by a hash of the key; all of them if they are fewer."""
    known = labels.where(F.col("toxic").isNotNull())
    share = min(1.0, sample_rows / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64(key, F.lit(9)), F.lit(1 << 20)) / (1 << 20) < share)


def train(rows: DataFrame) -> tuple[dict[str, float], float, float]:
    """``(arcs, intercept, slope)`` from ``text, toxic``, a bounded number of rows; without labels the given arcs alone.

    Arcs are words and word beginnings found in at least five texts of which nine tenths are toxic.
    """
    import math

    import numpy as np
    arcs = {**dict.fromkeys(INSULTS, 1.0), **dict.fromkeys(THREATS, 0.5)}
    rows = cut_lineage(rows.where("text is not null and toxic is not null").select("text", "toxic"))
    if rows.isEmpty():
        return arcs, -3.0, 3.0
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    terms = F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(
        F.array(w), *[F.when(F.length(w) > k, F.array(F.concat(F.substring(w, 1, k), F.lit("*")))).otherwise(
            F.array().cast("array<string>")) for k in PREFIXES]))))
    found = (rows.select("toxic", F.explode(terms).alias("term")).groupBy("term")
             .agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
             .where("bad >= 5 and bad >= 0.9 * n and length(term) > 3")
             .collect())
    for r in found:
        arcs[r.term] = max(arcs.get(r.term, 0.0), min(1.0, math.log((r.bad + 0.5) / (r.n - r.bad + 0.5)) / 4))
    pairs = weigh(rows, arcs).select(F.log1p("weight").alias("x"), "toxic").toPandas()
    x, y = pairs["x"].to_numpy(float), pairs["toxic"].to_numpy(float)
    a, b = -3.0, 3.0
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([(y - p).sum() - 1e-2 * a, ((y - p) * x).sum() - 1e-2 * b])
        h = np.array([[w.sum() + 1e-2, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-2]])
        d = np.linalg.solve(h, g)
        a, b = a + float(np.clip(d[0], -2, 2)), b + float(np.clip(d[1], -2, 2))
    return arcs, a, b


def score(docs: DataFrame, model: tuple[dict[str, float], float, float]) -> DataFrame:
    """``docs`` with ``weight``, ``score`` (0 to 1) and ``predicted`` (score of 0.3 or more); null texts count as empty."""
    arcs, a, b = model
    s = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.log1p("weight"))))
    return weigh(docs, arcs).withColumn("score", s).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(4, 2)).select("doc_id", "toxic")
    # the sample is drawn among the labels, so no text is shuffled to find the labelled ones
    few = cut_lineage(sample(labels))
    return score(docs, train(docs.join(small_side(few), "doc_id"))).select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")
