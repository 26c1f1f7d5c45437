"""Packing token sequences by minimum bin slack.

Documents become ids plus a closing 0. Whole windows are cut off first; what remains of each document is
shorter than a window. The number of remainders of each length is all the planner sees: a bitset
subset-sum over that multiset picks the lengths that fill a window closest to capacity, and the pick
is repeated as often as the counts allow, so the plan is as long as there are lengths, whatever the
data. Picks that leave slack are laid end to end and cut at the window instead.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import small_side, stored
from eventloom.llm.registry import query

WINDOW = 1024
#: Texts with other characters go to the tokenizer library itself; for these the faster one gives the same ids.
_PLAIN_BELOW = "ƀ"


@functools.cache
def _encoder(path: str):
    """texts -> lists of ids, the ids of ``path``; built once a Python worker."""
    import base64
    import os
    import re

    import tiktoken
    from tokenizers import Tokenizer
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    exact = Tokenizer.from_file(path)
    exact.encode_special_tokens = True
    ranks_file = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_file):
        return lambda texts: [e.ids for e in exact.encode_batch(texts, add_special_tokens=False)]
    import public_tokenizers
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = re.compile("[^\t\n\r -~¡-" + _PLAIN_BELOW + "]|[^ \n]{2000}")

    def encode(texts):
        return [exact.encode(t, add_special_tokens=False).ids if odd.search(t) else fast.encode_ordinary(t)
                for t in texts]
    return encode


def tokenize(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """``doc_id, ids`` (little-endian 32 bit), and places within the input partition, for :func:`pack`."""
    keys = dict(docs.dtypes)["doc_id"]

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        encode, part, whole, seen = _encoder(path), TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            ids, fulls, ranks = [], [], []
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 256):
                for one in encode([t or "" for t in texts[at:at + 256]]):
                    a = np.empty(len(one) + 1, "<u4")
                    a[:-1], a[-1] = one, 0
                    ids.append(a.tobytes())
                    rest = len(a) % window
                    fulls.append(whole)
                    ranks.append(seen.get(rest, 0))
                    whole, seen[rest] = whole + len(a) // window, seen.get(rest, 0) + 1
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([part] * n, pa.int32()),
                 pa.array(fulls, pa.int64()), pa.array(ranks, pa.int64())],
                ["doc_id", "ids", "part", "full_before", "rank"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {keys}, ids binary, part int, full_before long, rank long")


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[list[int], int]]:
    """Minimum bin slack: ``(lengths of one window, times)`` until no remainder is left.

    The longest remaining length is always part of the pick, so every round uses up a length or a
    copy pattern; the bitset holds the sums reachable with the lengths so far.
    """
    left = {k: v for k, v in sorted(counts.items(), reverse=True) if v > 0 and k > 0}
    out = []
    while left:
        top = next(iter(left))
        steps, reach, room = [], 1, window - top
        for length, n in left.items():
            n = min(n - (length == top), room // length)
            size = 1
            while n > 0:
                k = min(size, n)
                steps.append((length, k, reach))
                reach |= (reach << (length * k)) & ((1 << (room + 1)) - 1)
                n, size = n - k, size * 2
            if reach >> room & 1:
                break
        total, pick = reach.bit_length() - 1, {top: 1}
        for length, k, before in reversed(steps):
            if not before >> total & 1:
                total -= length * k
                pick[length] = pick.get(length, 0) + k
        times = min(left[length] // m for length, m in pick.items())
        out.append(([length for length, m in pick.items() for _ in range(m)], times))
        for length, m in pick.items():
            left[length] -= m * times
            if not left[length]:
                del left[length]
    return out


def pack(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces ``doc_id, start, length, ids, doc_tokens, sequence_id, offset`` from :func:`tokenize`'s rows.

    Full windows come first, then the planned windows, then the remainders that no full window takes: laid
    end to end, cut at the window, the last stretch cut into powers of two, so nothing is padded.
    An empty table gives no pieces. Repeated and null ids are documents of their own.
    """
    spark = tokens.sparkSession
    t = stored(tokens, "tokens")
    t = (t.withColumn("n", (F.octet_length("ids") / 4).cast("long")).withColumn("rest", (F.col("n") % window).cast("int"))
         .withColumn("full", F.floor(F.col("n") / window)))
    per = stored(t.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("c"), F.sum("full").alias("f")), "places")
    counts = {r.rest: r.c for r in per.where("rest > 0").groupBy("rest").agg(F.sum("c").alias("c")).collect()}
    n_full = per.agg(F.sum("f")).first()[0] or 0
    upto = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = stored(per.withColumn("base", F.coalesce(F.sum("c").over(upto), F.lit(0))).select("part", "rest", "base"), "bases")
    parts = per.groupBy("part").agg(F.sum("f").alias("f"))
    fulls = stored(parts.select("part", F.coalesce(F.sum("f").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full_base")), "fulls")

    slots, used, sequence, stream = [], {}, n_full, 0
    for lengths, times in plan(counts, window):
        exact, fill = sum(lengths) == window, sum(lengths)
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            m, low = lengths.count(length), used.get(length, 0)
            slots.append((length, low, low + m * times, m, exact, sequence if exact else stream, fill, offset))
            used[length] = low + m * times
            offset += m * length
        if exact:
            sequence += times
        else:
            stream += fill * times
    slot_table = spark.createDataFrame(slots, "rest int, low long, high long, m long, exact boolean, first long, fill long, at long")
    tail0, tail = sequence + stream // window, stream % window
    cuts, at = [], 0
    for bit in reversed(range(window.bit_length())):
        if tail >> bit & 1:
            cuts.append((at, 1 << bit, tail0 + len(cuts)))
            at += 1 << bit

    t = t.join(small_side(places), ["part", "rest"]).join(small_side(fulls), "part")
    whole = F.transform(F.sequence(F.lit(0).cast("long"), F.col("full") - 1), lambda i: F.struct(
        (i * window).alias("start"), F.lit(window).cast("long").alias("length"),
        (F.col("full_base") + F.col("full_before") + i).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    none = F.array().cast("array<struct<start:bigint,length:bigint,sequence_id:bigint,offset:bigint>>")
    k = F.col("base") + F.col("rank")
    s = slot_table.withColumnRenamed("rest", "s_rest")
    t = t.withColumn("k", k).join(F.broadcast(s), (F.col("rest") == F.col("s_rest")) & (F.col("k") >= F.col("low"))
                                  & (F.col("k") < F.col("high")), "left")
    turn = F.floor((F.col("k") - F.col("low")) / F.col("m"))
    inner = F.col("at") + ((F.col("k") - F.col("low")) % F.col("m")) * F.col("rest")
    begin = F.col("full") * window
    kept = F.array(F.struct(begin.alias("start"), F.col("rest").cast("long").alias("length"),
                            (F.col("first") + turn).alias("sequence_id"), inner.alias("offset")))
    pos, end = F.col("pos"), F.col("pos") + F.col("rest")
    t = t.withColumn("pos", F.col("first") + turn * F.col("fill") + inner)
    base = stream - tail
    bounds: list[Column] = [F.struct((F.floor(F.col("pos") / window) * window + d).alias("lo"), F.least(
        F.floor(F.col("pos") / window) * window + d + window, F.lit(base)).alias("hi"),
        (F.lit(sequence) + F.floor(F.col("pos") / window) + d // window).alias("q")) for d in (0, window)]
    bounds += [F.struct(F.lit(base + a).cast("long").alias("lo"), F.lit(base + a + n).cast("long").alias("hi"),
                        F.lit(q).cast("long").alias("q")) for a, n, q in cuts]
    cut = F.filter(F.transform(F.array(*bounds), lambda b: F.struct(
        (begin + F.greatest(pos, b["lo"]) - pos).alias("start"),
        (F.least(end, b["hi"]) - F.greatest(pos, b["lo"])).cast("long").alias("length"),
        b["q"].cast("long").alias("sequence_id"), (F.greatest(pos, b["lo"]) - b["lo"]).alias("offset"))),
        lambda p: p["length"] > 0)
    rest = F.when(F.col("rest") == 0, none).when(F.col("exact"), kept).otherwise(cut)
    pieces = F.concat(F.when(F.col("full") > 0, whole).otherwise(none), rest)
    with_ids = F.transform(pieces, lambda p: F.struct(
        p["start"].alias("start"), p["length"].alias("length"),
        p["sequence_id"].alias("sequence_id"), p["offset"].alias("offset"),
        F.substring(F.col("ids"), (p["start"] * 4 + 1).cast("int"), (p["length"] * 4).cast("int")).alias("ids")))
    return (t.select("doc_id", F.col("n").alias("doc_tokens"), F.explode(with_ids).alias("p"))
            .select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset"))


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    import public_tokenizers
    return pack(tokenize(docs, path or public_tokenizers.path("byte_bpe_50k.json"), window), window)


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
