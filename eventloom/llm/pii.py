"""Personal data by bootstrapped context.

The base rules give seed entities. The word before a seed induces a pattern; pattern and instance scores
are passed back and forth over their graph; patterns that stay reliable discover spans of looser form.
Everything is column expressions and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import small_side, text_key
from eventloom.llm.registry import query
from eventloom.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
# the base rules; possessive and anchored at the start of a run, so long runs take linear time and match the same
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
# looser forms that only a reliable pattern makes an entity
LOOSE = {
    "email": r"(?<![A-Za-z0-9._])[A-Za-z0-9._]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9-])[0-9]{4}(?:[./][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+()-])\(?0[0-9]{1,4}\)?[ /.-][0-9]{3,4}[ .-][0-9]{3,5}(?![0-9])",
}
ROUNDS = 3
SUPPORT = 3
RELIABLE = 0.5
_CHUNK = 256


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _running(lengths: Column) -> Column:
    """Sums before each element; in chunks, so that long arrays do not cost the square of their length."""
    def before(a: Column) -> Column:
        zero = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("l"))
        return F.aggregate(a, zero, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["l"], F.array(acc["s"])).alias("l")))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _CHUNK).cast("int")),
                         lambda c: before(F.slice(lengths, c * _CHUNK + 1, _CHUNK)))
    def joined(cs: Column) -> Column:
        return F.flatten(F.zip_with(cs, before(F.transform(cs, lambda c: c["s"]))["l"],
                                    lambda c, o: F.transform(c["l"], lambda x: x + o)))
    return F.transform(F.array(chunks), joined)[0]


def _matches(text: Column, kind: str, pattern: str, check: bool, need: str) -> Column:
    """Structs kind, start, end, value, cue of a rule's matches; ``cue`` is the word before, in lower case."""
    marked = F.regexp_replace(F.translate(text, "\x01\x02", "\x03\x03"), f"({pattern})", "\x01$1\x02")
    def spans(p: Column) -> Column:
        at = _running(F.transform(p, lambda x: F.length(F.translate(x, "\x02", ""))))
        value = lambda x: F.substring_index(x, "\x02", 1)
        made = F.zip_with(F.sequence(F.lit(0), F.size(p) - 1), F.transform(F.array(at), lambda a: a)[0], lambda i, o: F.struct(
            F.lit(kind).alias("kind"), o.alias("start"), (o + F.length(value(F.get(p, i)))).alias("end"), value(F.get(p, i)).alias("value"),
            F.lower(F.regexp_extract(F.right(F.substring_index(F.get(p, i - 1), "\x02", -1), F.lit(80)), r"([^\s]+)\s*$", 1)).alias("cue")))
        return F.slice(made, 2, F.size(made))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,cue:string>>")
    found = F.filter(F.transform(F.array(F.split(marked, "\x01")), spans)[0], lambda m: _valid(kind, m["value"]) if check else F.lit(True))
    has = text.rlike("[0-9]") if kind != "email" else F.lit(True)
    return F.when(has & (F.contains(text, F.lit(need)) if need else F.lit(True)) & text.rlike(pattern), found).otherwise(none)


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` (null: empty), ``base`` and ``extra``: arrays of kind, start, end, value, cue.

    Rows equal in id and text get equal spans. Only texts with a loose match take part in the discovery; its graph
    holds identifiers and the words before them, and each pattern is weighed against all its occurrences in the corpus.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(*[_matches(text, k, BASE[k], True, NEEDS[k]) for k in KINDS])
    loose = F.concat(*[_matches(text, k, LOOSE[k], False, {"email": "at", "ip": ":"}.get(k, "")) for k in KINDS])
    keyed = (docs.drop("base", "extra", "__loose", "__k").withColumn("__k", F.xxhash64("doc_id", text_key()))
             .withColumn("text", text).withColumn("base", base).withColumn("__loose", loose))
    clear = F.filter("__loose", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    seen = cut_lineage(keyed.select("__k", "base", clear.alias("loose")).where("size(base) > 0 or size(loose) > 0"))
    entry = F.explode(F.concat(F.transform("base", lambda m: F.struct(F.lit(True).alias("seed"), m.alias("m"))),
                               F.transform("loose", lambda m: F.struct(F.lit(False).alias("seed"), m.alias("m")))))
    rows = seen.select(entry.alias("e")).select(F.col("e.seed").alias("seed"), F.col("e.m.kind").alias("kind"),
                                                F.col("e.m.cue").alias("cue"), F.xxhash64("e.m.value").alias("item")).where("cue <> ''")
    edges = cut_lineage(rows.groupBy("kind", "cue", "item").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")))
    # only cues of loose matches can discover anything, so only their patterns are weighed
    asked = edges.where("not seed").select("kind", "cue").distinct()
    support = edges.where("seed").groupBy("kind", "cue").agg(F.count(F.lit(1)).alias("items")).where(F.col("items") >= SUPPORT)
    patterns = cut_lineage(asked.join(support, ["kind", "cue"]))
    wanted = cut_lineage(patterns.select("cue").distinct())
    if wanted.limit(1).count():
        words = docs.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("cue")).join(small_side(wanted), "cue")
        total = cut_lineage(words.groupBy("cue").agg(F.count(F.lit(1)).alias("total")))
    else:
        total = wanted.withColumn("total", F.lit(0).cast("long"))
    graph = edges.join(small_side(patterns.select("kind", "cue")), ["kind", "cue"]).join(small_side(total), "cue", "left")
    graph = cut_lineage(graph.withColumn("score", F.col("seed").cast("double")))
    for _ in range(ROUNDS if wanted.limit(1).count() else 0):
        worth = graph.groupBy("kind", "cue").agg((F.sum(F.col("n") * F.col("score")) / F.greatest(
            F.max(F.coalesce("total", F.lit(0))), F.sum("n"))).alias("conf"))
        scored = graph.drop("score").join(worth, ["kind", "cue"])
        item = scored.groupBy("kind", "item").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-9)))))).alias("best"))
        graph = cut_lineage(scored.join(item, ["kind", "item"]).withColumn(
            "score", F.when(F.col("seed"), 1.0).otherwise(F.col("best"))).drop("best", "conf"))
    good = cut_lineage(graph.where(~F.col("seed") & (F.col("score") >= RELIABLE)).select(
        F.col("kind").alias("g_kind"), F.col("cue").alias("g_cue"), F.col("item").alias("g_item")).distinct())
    named = seen.where("size(loose) > 0").select("__k", F.explode("loose").alias("m")).withColumn("item", F.xxhash64("m.value"))
    extra = (named.join(small_side(good), (F.col("m.kind") == F.col("g_kind")) & (F.col("m.cue") == F.col("g_cue"))
                        & (F.col("item") == F.col("g_item")), "left_semi")
             .groupBy("__k").agg(F.collect_set("m").alias("extra")))
    extra = cut_lineage(extra)
    out = keyed.join(small_side(extra), "__k", "left")
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,cue:string>>")
    return out.withColumn("extra", F.coalesce("extra", empty)).drop("__k", "__loose")


def span_text(spans: Column) -> Column:
    order = F.array_sort(F.transform(spans, lambda m: F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), m["kind"]).alias("o"),
                                                             m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def redact(found: DataFrame) -> DataFrame:
    """``found`` with every span of ``text`` replaced by its kind in brackets; overlapping spans become one."""
    spans = F.array_sort(F.transform(F.concat("base", "extra"), lambda m: F.struct(
        m["start"].alias("s"), m["end"].alias("e"), m["kind"].alias("k"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("t"))
    def step(acc: Column, m: Column) -> Column:
        return F.struct(F.greatest(acc["at"], m["e"]).alias("at"), F.when(m["s"] < acc["at"], acc["t"]).otherwise(F.concat(
            acc["t"], F.substring(F.col("text"), acc["at"] + 1, m["s"] - acc["at"]), F.lit("["), F.upper(m["k"]), F.lit("]"))).alias("t"))
    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["t"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return found.withColumn("text", F.when(F.size(spans) > 0, done).otherwise(F.col("text")))


@query("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return f.select("doc_id", *[count(k) for k in KINDS], F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                    span_text(F.concat("base", "extra")).alias("spans"))
