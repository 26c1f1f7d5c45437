"""Best-fit packing by bin completion.

Documents become ids plus a closing 0; only those longer than a window are cut, into whole windows behind a shorter
first piece. What is left to pack is one piece a document, shorter than a window, and all the planner sees is how many
there are of each length. It fills one sequence after the other around the largest length left. The fillings tried are
the undominated ones, least waste first: none in which a document outside could take the place of some inside and waste
no more. Branches whose waste is more than a better solution may have are cut off. Best-fit decreasing gives the first
solution to beat, and again one at some nodes for what is left there. The search ends when a bound on the number
of sequences is met, or after a given number of nodes; all documents are packed either way.

A pattern is laid as often as the counts allow at once, so the plan is about as long as there are lengths, whatever the
number of documents. Nulls and empty texts are the closing 0 alone; texts of any length are read whole, one at a time.
Null and repeated ids are documents of their own, equal texts too; equal lengths take places by the order of their
input partitions. Other columns are not looked at; an empty table gives no pieces.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm import packing
from eventloom.llm.common import small_side, stored
from eventloom.llm.registry import query

WINDOW = 2048
#: Nodes of the search at most; what is found until then is kept.
NODES = 3000
#: Fillings looked at in one node at most, dominated ones included.
TRIES = 100
#: Best-fit is tried again after this many nodes, and always when at most as many lengths are left.
LOOK = 64
#: Texts turned into ids together.
TEXTS = 64

Counts = dict[int, int]
#: (lengths of one sequence, times)
Plan = list[tuple[tuple[int, ...], int]]


# -- planning ---------------------------------------------------------------------------

def lower_bound(counts: Counts, capacity: int) -> int:
    """Sequences that no packing can do without: by sum, and by what cannot share one (over all ways to tell large from small)."""
    import numpy as np
    n = np.zeros(capacity + 1, np.int64)
    for length, c in counts.items():
        n[length] += c
    size = n * np.arange(capacity + 1)
    upto, filled = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(size)])
    half = capacity // 2
    small = np.arange(0, half + 1)
    alone = upto[-1] - upto[capacity - small + 1]
    middle, middle_size = upto[capacity - small + 1] - upto[half + 1], filled[capacity - small + 1] - filled[half + 1]
    rest = (filled[half + 1] - filled[small]) - (middle * capacity - middle_size)
    return int(max((alone + middle + np.maximum(0, -(-rest // capacity))).max(), -(-int(size.sum()) // capacity)))


def best_fit(counts: Counts, capacity: int) -> Plan:
    """Best-fit decreasing on counts: each length goes where it leaves the least room, equal sequences together."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, lengths: tuple[int, ...], times: int) -> None:
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append((lengths, times))

    for length in sorted(counts, reverse=True):
        left, at = counts[length], bisect.bisect_left(rooms, length)
        while left and at < len(rooms):
            room = rooms[at]
            lengths, times = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            each = room // length
            whole = min(times, left // each)
            part = left - whole * each if whole < times else 0
            if whole:
                put(room - each * length, lengths + (length,) * each, whole)
            if part:
                put(room - part * length, lengths + (length,) * part, 1)
            if times - whole - (part > 0):
                put(room, lengths, times - whole - (part > 0))
            left -= whole * each + part
            at = bisect.bisect_left(rooms, length)
        each = capacity // length
        if left // each:
            put(capacity - each * length, (length,) * each, left // each)
        if left % each:
            put(capacity - left % each * length, (length,) * (left % each), 1)
    return [g for room in rooms for g in groups[room]]


def _sums(lengths: list[int], counts: Counts, most: int) -> list[int]:
    """Bitsets of the sums up to ``most`` of the first 0, 1, 2, ... lengths; the list ends where every sum is in."""
    full, out = (1 << (most + 1)) - 1, [1]
    for length in lengths:
        reach, step = out[-1], 1
        n = min(counts[length], most // length)
        while n > 0:
            k = min(step, n)
            reach |= reach << (length * k) & full
            n, step = n - k, step * 2
        out.append(reach)
        if reach == full:
            break
    return out


def _totalling(total: int, lengths: list[int], upto: int, counts: Counts, sums: list[int]) -> Iterator[tuple[int, ...]]:
    """Every choice among the first ``upto`` (rising) lengths with this sum, large ones first; ``sums`` shows dead ends."""
    if total == 0:
        yield ()
        return
    for i in range(bisect.bisect_right(lengths, total, 0, upto) - 1, -1, -1):
        if i + 1 < len(sums) and not sums[i + 1] >> total & 1:
            return
        length = lengths[i]
        for k in range(min(counts[length], total // length), 0, -1):
            rest = total - k * length
            if i >= len(sums) or sums[i] >> rest & 1:
                for more in _totalling(rest, lengths, i, counts, sums):
                    yield (length,) * k + more


def dominated(filling: tuple[int, ...], outside: int, slack: int) -> bool:
    """Whether a document outside (bitset of lengths) could replace some of the filling and waste no more."""
    one, several = 0, 0
    for length in filling:
        several |= several << length | one << length
        one |= 1 << length
    if several & outside:
        return True
    reach = slack and (1 | one | several) << 1
    width = 1
    while width < slack:
        step = min(width, slack - width)
        reach |= reach << step
        width += step
    return bool(reach & outside)


def fillings(counts: Counts, lengths: list[int], room: int, waste: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Undominated choices for ``room`` among ``lengths`` (rising) with their slack, least slack first, up to ``waste``.

    ``counts`` may change between two steps as long as it is as before at each of them.
    """
    sums, tries = _sums(lengths, counts, room), TRIES
    held = sum(1 << k for k in lengths)
    for slack in range(0, min(waste, room) + 1):
        if not sums[-1] >> (room - slack) & 1:
            continue
        for one in _totalling(room - slack, lengths, len(lengths), counts, sums):
            if not tries:
                return
            tries -= 1
            used_up = sum(1 << k for k in set(one) if counts[k] == one.count(k))
            if not dominated(one, held ^ used_up, slack):
                yield one, slack


def complete(counts: Counts, capacity: int = WINDOW, nodes: int = NODES) -> Plan:
    """Sequences for all lengths: ``(lengths, times)``."""
    left = {k: n for k, n in counts.items() if n > 0}
    if not left:
        return []
    keys, total, bound = sorted(left), sum(k * n for k, n in left.items()), lower_bound(left, capacity)
    best = best_fit(left, capacity)
    used = sum(t for _, t in best)
    #: (lengths, times, waste) of what is laid, and its sums
    laid: list[tuple[tuple[int, ...], int, int]] = []
    here, spent = 0, 0

    def change(lengths: tuple[int, ...], times: int) -> None:
        for k in lengths:
            n = left.get(k, 0)
            if not n:
                bisect.insort(keys, k)
            if n + times:
                left[k] = n + times
            else:
                del left[k]
                keys.pop(bisect.bisect_left(keys, k))

    def branches() -> Iterator[tuple[tuple[int, ...], int, int]]:
        """(sequence around the largest length, times, waste of all), read between changes that are undone."""
        top = keys[-1]
        room = capacity - top
        lengths = keys[:bisect.bisect_right(keys, room)]
        if top <= room and left[top] == 1:
            lengths.pop()
        less = {**left, top: left[top] - 1} if top <= room else left
        for filling, slack in fillings(less, lengths, room, (used - 1) * capacity - total - spent):
            allowed = (used - 1) * capacity - total - spent
            if slack > allowed:
                return
            whole = (top, *filling)
            times = min(left[k] // whole.count(k) for k in set(whole))
            if slack:
                times = min(times, allowed // slack)
            yield whole, times, slack * times
            if times > 1:
                yield whole, 1, slack

    stack, seen = [branches()], 0
    while stack and used > bound and seen < nodes:
        step = next(stack[-1], None)
        if step is not None and spent + step[2] <= (used - 1) * capacity - total:
            lengths, times, waste = step
            change(lengths, -times)
            laid.append(step)
            here, spent, seen = here + times, spent + waste, seen + 1
            if not left or seen % LOOK == 0 or len(keys) <= LOOK:
                rest = best_fit(left, capacity)
                if here + sum(t for _, t in rest) < used:
                    best, used = [*[(lengths, n) for lengths, n, _ in laid], *rest], here + sum(t for _, t in rest)
            if left and here + lower_bound(left, capacity) < used:
                stack.append(branches())
                continue
        elif step is None:
            stack.pop()
            if not laid:
                break
        else:
            continue
        lengths, times, waste = laid.pop()
        change(lengths, times)
        here, spent = here - times, spent - waste
    return best


# -- packing ----------------------------------------------------------------------------

@lru_cache(maxsize=1)
def _encoder(path: str):
    return packing._encoder(path)


def tokenize(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """``doc_id, ids`` (little-endian 32 bit), and what lies before each within the input partition: whole windows, equal rests."""
    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        encode, part, whole, seen = _encoder(path), TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some, ids, fulls, ranks = batch.slice(at, TEXTS), [], [], []
                for one in encode([t or "" for t in some.column("text").to_pylist()]):
                    a = np.empty(len(one) + 1, "<u4")
                    a[:-1], a[-1] = one, 0
                    rest = len(a) % window
                    ids.append(a.tobytes())
                    fulls.append(whole)
                    ranks.append(seen.get(rest, 0))
                    whole, seen[rest] = whole + len(a) // window, seen.get(rest, 0) + 1
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array(ids, pa.binary()), pa.array([part] * len(ids), pa.int32()), pa.array(fulls, pa.int64()),
                     pa.array(ranks, pa.int64())], ["doc_id", "ids", "part", "full_before", "rank"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary, part int, full_before long, rank long")


def pack(tokens: DataFrame, window: int = WINDOW, nodes: int = NODES) -> DataFrame:
    """Pieces ``doc_id, piece, start, length, ids, sequence_id, offset`` of :func:`tokenize`'s rows."""
    spark = tokens.sparkSession
    n = (F.octet_length("ids") / 4).cast("long")
    t = stored(tokens.withColumn("rest", (n % window).cast("int")).withColumn("full", F.floor(n / window)), "tokens")
    per = stored(t.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("c"), F.sum("full").alias("f")), "places")
    counts = {r.rest: r.c for r in per.where("rest > 0").groupBy("rest").agg(F.sum("c").alias("c")).collect()}
    n_full = per.agg(F.sum("f")).first()[0] or 0
    before = lambda key: Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = stored(per.select("part", "rest", F.coalesce(F.sum("c").over(before(["rest"])), F.lit(0)).alias("base")), "bases")
    fulls = stored(per.groupBy("part").agg(F.sum("f").alias("f")).select(
        "part", F.coalesce(F.sum("f").over(before([])), F.lit(0)).alias("full_base")), "fulls")

    slots, taken, sequence = [], {}, n_full
    for lengths, times in complete(counts, window, nodes):
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            m, low = lengths.count(length), taken.get(length, 0)
            slots.append((length, low, low + m * times, m, sequence, offset))
            taken[length] = low + m * times
            offset += m * length
        sequence += times
    # a row for each length of each pattern: as long as the plan, which the window bounds
    slot = spark.createDataFrame(slots, "rest int, low long, high long, m long, first long, at long").withColumnRenamed("rest", "s_rest")
    t = t.join(small_side(places), ["part", "rest"]).join(small_side(fulls), "part").withColumn("k", F.col("base") + F.col("rank"))
    t = t.join(F.broadcast(slot), (F.col("rest") == F.col("s_rest")) & (F.col("k") >= F.col("low")) & (F.col("k") < F.col("high")), "left")
    turn = F.floor((F.col("k") - F.col("low")) / F.col("m"))
    opening = F.struct(F.lit(0).cast("long").alias("start"), F.col("rest").cast("long").alias("length"), (F.col("first") + turn).alias("sequence_id"),
                       (F.col("at") + (F.col("k") - F.col("low")) % F.col("m") * F.col("rest")).alias("offset"))
    whole = F.transform(F.sequence(F.lit(0).cast("long"), F.col("full") - 1), lambda i: F.struct(
        (F.col("rest") + i * window).alias("start"), F.lit(window).cast("long").alias("length"),
        (F.col("full_base") + F.col("full_before") + i).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    none = F.array().cast("array<struct<start:bigint,length:bigint,sequence_id:bigint,offset:bigint>>")
    pieces = F.concat(F.when(F.col("rest") > 0, F.array(opening)).otherwise(none), F.when(F.col("full") > 0, whole).otherwise(none))
    return (t.select("doc_id", "ids", F.posexplode(pieces).alias("piece", "p"))
            .select("doc_id", "piece", "p.start", "p.length",
                    F.substring("ids", (F.col("p.start") * 4 + 1).cast("int"), (F.col("p.length") * 4).cast("int")).alias("ids"),
                    "p.sequence_id", "p.offset"))


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW, nodes: int = NODES) -> DataFrame:
    import public_tokenizers
    return pack(tokenize(docs, path or public_tokenizers.path("byte_bpe_50k.json"), window), window, nodes)


@query("op12_completion")
def op12_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
