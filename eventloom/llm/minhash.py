"""Near copies by improved consistent weighted sampling over TF-IDF shingles, banded and verified.

Equal texts are collapsed first. A shingle's weight is ``(1 + ln tf) * (1 + 0.25 * idf share)``. Document
frequencies are counted in a fixed number of hashed features, so the table of weights never grows; the load that
a feature has from unrelated shingles, the median of all, is taken off, and the idf depends on the share of the
documents alone, so weights do not flatten as the corpus grows. Each sample is the least ``ln a`` of the scheme, which two texts share with the probability of
their weighted Jaccard similarity. Candidates are verified on their whole texts: every member of a bucket
against the bucket's first and a few others, which settles nearly all classes. What is left of
the buckets with several classes is joined by an exact prefix filter, whatever bucket it is in, so that no link
is lost and texts that only share a bucket cost no comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import components, scratch, small_side, stored, text_key
from eventloom.llm.registry import query

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 10, 3
FEATURES = 1 << 18
IDF_SHARE = 0.25
#: Share of the documents up to which a shingle counts as rare and has the full idf.
RARE = 2 ** -10
#: Mean number of pairs that share one copy of a text which many pairs have.
PART = 64
#: Mean number of members of a bucket that are compared with each other after the hubs; a bucket of no more is compared whole.
SLOT = 8
#: Shingles that are sampled together, so that short texts share the cost of a call.
TOGETHER = 1 << 14


def _mix(x):
    import numpy as np
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    y ^= y >> np.uint64(27)
    y *= np.uint64(0x94D049BB133111EB)
    y ^= y >> np.uint64(31)
    return y


def shingles(text: str):
    """Distinct hashes of the text's five-word shingles and how often each occurs; all its words if fewer."""
    import numpy as np
    from xxhash import xxh3_64_intdigest
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    s = np.zeros(n, np.uint64)
    for i in range(min(WORDS, len(h))):
        s = _mix(s + h[i:i + n] + np.uint64(i + 1))
    values, counts = np.unique(s, return_counts=True)
    return values, counts


def shingled(texts) -> Iterator:
    """``places, values, counts, starts`` of about TOGETHER words of ``texts`` at a time: what :func:`shingles` gives
    for each text with words, end to end, and where each begins. Texts are never split, so a long one is a group of its own.
    """
    waiting, size = [], 0
    for place, text in enumerate(texts):
        words = text.lower().split()
        if words:
            waiting.append((place, words))
            size += len(words)
        if size >= TOGETHER:
            yield _shingled(waiting)
            waiting, size = [], 0
    if waiting:
        yield _shingled(waiting)


def _shingled(waiting):
    from itertools import chain

    import numpy as np
    from xxhash import xxh3_64_intdigest
    lens = np.array([len(w) for _, w in waiting])
    h = np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(w for _, w in waiting)), np.uint64, lens.sum())
    first, n = np.cumsum(lens) - lens, np.maximum(1, lens - WORDS + 1)
    padded, s = np.concatenate([h, np.zeros(WORDS, np.uint64)]), np.zeros(len(h), np.uint64)
    for i in range(WORDS):
        s = _mix(s + padded[i:i + len(h)] + np.uint64(i + 1))
    short = lens < WORDS
    if short.any():
        at, has, v = first[short], lens[short], np.zeros(short.sum(), np.uint64)
        for i in range(WORDS):
            v = np.where(has > i, _mix(v + padded[at + i] + np.uint64(i + 1)), v)
        s[at] = v
    s = s[np.arange(len(h)) - np.repeat(first, lens) < np.repeat(n, lens)]
    begin = np.cumsum(n) - n
    for a, b in zip(begin.tolist(), (begin + n).tolist()):
        s[a:b].sort()
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    new[begin] = True
    at = np.flatnonzero(new)
    return [p for p, _ in waiting], s[at], np.diff(at, append=len(s)), np.searchsorted(at, begin)


def weights(values, counts, idf):
    import numpy as np
    return (1 + np.log(counts)) * (1 + IDF_SHARE * idf[(values % np.uint64(FEATURES)).astype(np.int64)])


def idf_table(texts: DataFrame):
    """The idf of each hashed feature, from 0 (in all documents) to 1 (in a share of RARE at most); collected, of fixed length."""
    import numpy as np

    def run(batches) -> Iterator:
        import pyarrow as pa
        total, docs = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            docs += b.num_rows
            for _, v, _, _ in shingled(b.column(0).to_pylist()):
                np.add.at(total, (v % np.uint64(FEATURES)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int32()), pa.array([*total[at], docs], pa.int64())], ["f", "n"])

    rows = texts.select("text").mapInArrow(run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(FEATURES), 1
    for r in rows:
        if r.f < 0:
            n = max(1, r.n)
        else:
            df[r.f] = r.n
    share = (df - max(np.median(df), 1)) / n
    return np.clip(np.log(np.maximum(share, RARE)) / np.log(RARE), 0, 1)


def band_keys(values, w, starts):
    """One 64-bit key for each band of samples (rows) and text (columns); a text's shingles begin at its start."""
    import numpy as np
    logw, keys, at = np.log(w).astype(np.float32), [], 0

    def unit(bits):  # 23 of 32 bits, never 0 or 1
        return (bits >> np.uint32(9)).astype(np.float32) * np.float32(2 ** -23) + np.float32(2 ** -24)

    for _ in range(BANDS):
        key = np.zeros(len(starts), np.uint64)
        for _ in range(ROWS):
            at += 1
            h = _mix(values + np.uint64(at * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            (x, y), (u, v) = (k.view(np.uint32).reshape(-1, 2).T for k in (h, _mix(h)))
            beta = ((x ^ u) & np.uint32(0xFFFF)).astype(np.float32) * np.float32(2 ** -16)
            r, c = -np.log(unit(x) * unit(y)), -np.log(unit(u) * unit(v))
            t = np.floor(logw / r + beta)
            least = np.minimum.reduceat(np.log(c) - r * (t - beta + 1), starts)
            key = _mix(key + least.view(np.uint32).astype(np.uint64))
        keys.append(key.view(np.int64))
    return np.stack(keys)


def weighed(texts: DataFrame, idf) -> DataFrame:
    """``id, root, stray, s, w`` for each distinct shingle of ``texts``; ``idf`` is the broadcast table."""
    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for b in batches:
            for i in range(b.num_rows):
                v, c = shingles(b.column(3)[i].as_py())
                same = [pa.array(np.repeat(b.column(k)[i].as_py(), len(v))) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(v.view(np.int64)), pa.array(weights(v, c, idf.value))],
                                                 ["id", "root", "stray", "s", "w"])

    return texts.select("id", "root", "stray", "text").mapInArrow(run, "id long, root long, stray boolean, s long, w double")


def prefix_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: every pair of texts of different roots, one of them stray, that can be as similar as ``threshold``.

    Shingles are ordered from rare to frequent. Two texts of the weights ``x <= y`` that are similar share at least
    ``2t / (1 + t)`` of ``x`` and ``t`` of ``y``, so they share a shingle that stands before that much of the
    order is left, in either of them; at the first shingle they share, either has as much left as both must share.
    Shingles of one root, or of no stray text, are shared by no pair asked for, so they come first and need no row. What a pair
    shares in these prefixes and has left behind them bounds what it shares at all.
    """
    rows = stored(rows, "weighed")
    total = rows.groupBy("id").agg(F.sum("w").alias("total"))
    often = rows.groupBy("s").agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("stray").alias("some"))
    often = often.where("lo < hi and some").select("s", "df")
    behind = Window.partitionBy("id").orderBy(F.col("df").desc(), F.col("s").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least, slack = 2 * threshold / (1 + threshold), 1e-9
    left = rows.join(often, "s").join(total, "id").withColumn("left", F.sum("w").over(behind))
    prefix = stored(left.where(F.col("left") >= (threshold - slack) * F.col("total")), "prefix")
    small = prefix.where(F.col("left") >= (least - slack) * F.col("total"))
    x, y = (d.select("s", *[F.col(c).alias(f"{c}_{k}") for c in ("id", "root", "stray", "w", "left", "total")]) for d, k in ((small, "x"), (prefix, "y")))
    met = x.join(y, "s").where((F.col("root_x") != F.col("root_y")) & (F.col("stray_x") | F.col("stray_y"))
                               & ((F.col("total_x") < F.col("total_y")) | ((F.col("total_x") == F.col("total_y")) & (F.col("id_x") < F.col("id_y"))))
                               & (F.col("total_x") >= (threshold - slack) * F.col("total_y"))
                               & (F.least("left_x", "left_y") >= (least / 2 - slack) * (F.col("total_x") + F.col("total_y"))))
    shared = F.least("w_x", "w_y")
    pairs = met.groupBy("id_x", "id_y").agg(
        F.sum(shared).alias("both"), F.min(F.least(F.col("left_x") - F.col("w_x"), F.col("left_y") - F.col("w_y"))).alias("after"),
        F.first("total_x").alias("total_x"), F.first("total_y").alias("total_y"))
    enough = F.col("both") + F.col("after") >= (least / 2 - slack) * (F.col("total_x") + F.col("total_y"))
    return pairs.where(enough).select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"))


def _classes(some: DataFrame, threshold: float) -> DataFrame:
    """``key, class_id`` for each text of ``doc_id, key, text``."""
    texts = stored(some.groupBy("key").agg(F.min("doc_id").alias("id"), F.first("text").alias("text")), "texts")
    idf = texts.sparkSession.sparkContext.broadcast(idf_table(texts))

    def sign(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for b in batches:
            out = [[]] * b.num_rows
            for places, v, c, starts in shingled(b.column(1).to_pylist()):
                for place, keys in zip(places, band_keys(v, weights(v, c, idf.value), starts).T):
                    out[place] = keys
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["id", "bands"])

    signed = stored(texts.select("id", "text").mapInArrow(sign, "id long, bands array<long>"), "bands")
    members = signed.select("id", F.posexplode("bands").alias("band", "bucket"))
    sizes = members.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("hub")).where("n > 1")
    placed = stored(members.join(sizes, ["band", "bucket"]).select("band", "bucket", "n", "id", "hub"), "buckets")

    def verify(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            s, t = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            alike, last, one = [], None, None
            for x, y in zip(s, t):
                if x != last:
                    v, c = shingles(x)
                    last, one = x, (v, weights(v, c, idf.value))
                u, d = shingles(y)
                (v, wv), wu = one, weights(u, d, idf.value)
                _, i, j = np.intersect1d(v, u, assume_unique=True, return_indices=True)
                both = np.minimum(wv[i], wu[j]).sum()
                alike.append(float(both / (wv.sum() + wu.sum() - both)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike, pa.float64())], ["a", "b", "alike"])

    def compared(pairs: DataFrame, label: str) -> DataFrame:
        """Similarity of ``a, b, n`` pairs; an ``a`` that many pairs have is dealt over parts of about PART pairs each."""
        part = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / PART)).alias("part")
        dealt = stored(pairs.groupBy("a", "b").agg(F.max("n").alias("n")).select("a", "b", part), f"{label}_pairs")
        # texts stay where they are if the pairs are few enough to be sent to them
        first = small_side(dealt.select("a", "part").distinct()).join(texts.select(F.col("id").alias("a"), F.col("text").alias("s")), "a")
        second = small_side(dealt).join(texts.select(F.col("id").alias("b"), F.col("text").alias("t")), "b")
        joined = second.join(first, ["a", "part"]).select("a", "b", "s", "t")
        return stored(joined.mapInArrow(verify, "a long, b long, alike double"), label)

    hubs = compared(placed.where("hub < id").select(F.col("hub").alias("a"), F.col("id").alias("b"), "n"), "hubs")
    links = hubs.where(F.col("alike") >= threshold).select("a", "b")
    roots = stored(components(links).select(F.col("node").alias("id"), "root"), "roots")

    near = hubs.select(F.col("a").alias("hub"), F.col("b").alias("id"), "alike")
    held = stored(placed.join(near, ["hub", "id"], "left").select("band", "bucket", "n", "id", F.coalesce("alike", F.lit(1.0)).alias("alike")), "held")

    def unsettled(label: str) -> DataFrame:
        """Members of the buckets that hold several classes so far, with the class and the bucket's largest."""
        known = held.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        each = known.groupBy("band", "bucket", "root").agg(F.count(F.lit(1)).alias("c"))
        largest = (each.groupBy("band", "bucket").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("classes"))
                   .where("classes > 1").drop("classes"))
        return stored(known.join(largest, ["band", "bucket"]), label)

    def merged(found: DataFrame) -> DataFrame:
        late = found.where(F.col("alike") >= threshold).select("a", "b")
        if not late.limit(1).count():
            return roots
        joined = roots.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).union(late)
        return stored(components(joined).select(F.col("node").alias("id"), "root"), "roots")

    # a few others of the bucket each, which joins nearly all that the hub alone leaves apart
    slot = F.pmod(F.xxhash64("id", "band"), F.ceil(F.col("n") / SLOT)).alias("slot")
    dealt = unsettled("unsettled").select("band", "bucket", slot, "n", "id", "root", "alike")
    mate = dealt.select("band", "bucket", "slot", F.col("id").alias("b"), F.col("root").alias("q"), F.col("alike").alias("v"))
    some = dealt.join(mate, ["band", "bucket", "slot"]).where(
        (F.col("id") < F.col("b")) & (F.col("root") != F.col("q")) & (F.abs(F.col("alike") - F.col("v")) <= 1 - threshold + 1e-9))
    roots = merged(compared(some.select(F.col("id").alias("a"), "b", "n"), "some"))
    # then, exactly, all that can still be linked: texts of different classes whose prefixes share a shingle, in buckets
    # of several slots; of the others all pairs have been compared
    several = unsettled("open").where(F.col("n") > SLOT)
    open_ = stored(several.groupBy("id").agg(F.first("root").alias("root"), F.max(F.col("root") != F.col("main")).alias("stray")), "open_ids")
    rest = prefix_pairs(weighed(texts.join(small_side(open_), "id"), idf), threshold)
    roots = merged(compared(rest.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("a"))), "rest"))
    return texts.select("key", "id").join(roots, "id", "left").select("key", F.coalesce("root", "id").alias("class_id"))


def near_copies(docs: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """``doc_id, class_id, kept`` for every row: the class is named by its smallest id, whose row is kept.

    Null ids stay rows of their own class (null) and are kept. Null texts and texts without words resemble
    nothing; equal texts with words always share a class.
    """
    light = docs.select("doc_id", text_key().alias("key"), "text")
    some = light.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S"))
    with scratch(docs.sparkSession):
        classes = stored(_classes(some, threshold), "classes", keep=True)
    return (light.select("doc_id", "key").join(classes, "key", "left")
            .select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True))))


@query("op1_minhash")
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
