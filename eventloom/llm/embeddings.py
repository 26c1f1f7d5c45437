"""Near copies of vectors by NN-descent, audited on a sample of every label.

Equal vectors are collapsed. Every label, whatever its size, starts with neighbours that share the signs of random
projections, as many tables of them as make a pair at the threshold meet almost surely, refined by comparing the
neighbours of each node with each other; a list full of links grows. A sample of each label is then compared with
all its vectors; labels whose links were missed are compared exactly after all, block against block. A label whose
sample has no link is unmeasured and rests on the tables. Links give components, inside which all pairs are compared
in blocks, so link counts are exact there.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import components, small_side, stored
from eventloom.llm.registry import query
from eventloom.session import cut_lineage

THRESHOLD = 0.93
LIST = 8
#: Vectors that meet in one group of a table, about; and the chance that a pair at the threshold meets in no table.
GROUP = 256
MISSED = 0.001
#: Vectors of each label compared with all the others, and the share of their links that has to be found.
SAMPLE = 64
RECALL = 0.99
#: Rows of a block; labels and components are compared block against block.
BLOCK = 1024
ROUNDS = 4


def _unit(x):
    import numpy as np
    x = np.asarray(x, float)
    return x / np.sqrt((x * x).sum(-1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where("label is not null and vec_id is not null and embedding is not null").where(
        ~bad & F.exists("embedding", lambda x: x != 0))


def _local(groups: DataFrame, size: int) -> DataFrame:
    """Compares the members of each ``members`` array (id, vec) and keeps each one's best ``size``."""
    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for b in batches:
            a, c, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            members = b.column(0)
            ids, vec = (members.values.field(k) for k in ("id", "vec"))
            ids, ends, data = ids.to_numpy(), vec.offsets.to_numpy(), vec.values.to_numpy(zero_copy_only=False)
            starts = members.offsets.to_numpy()
            for lo, hi in zip(starts[:-1], starts[1:]):
                at = lo + np.unique(ids[lo:hi], return_index=True)[1]
                lengths = ends[at + 1] - ends[at]
                for length in np.unique(lengths):
                    rows = at[lengths == length]
                    if len(rows) < 2:
                        continue
                    x = _unit(data[ends[rows][:, None] + np.arange(length)])
                    sims = x @ x.T
                    np.fill_diagonal(sims, -2)
                    most = min(size, len(rows) - 1)
                    top = np.argpartition(-sims, most - 1, axis=1)[:, :most]
                    a.append(np.repeat(ids[rows], most))
                    c.append(ids[rows][top].ravel())
                    s.append(np.take_along_axis(sims, top, 1).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(k)) for k in (a, c, s)], ["u", "v", "s"])

    return groups.select("members").mapInArrow(run, "u long, v long, s double")


def start_groups(nodes: DataFrame) -> DataFrame:
    """``members``: groups of about GROUP vectors with equal signs along random projections, in several tables.

    The label's size sets the signs per table and the number of tables. A cell with more vectors than a group
    holds is dealt over as many slots as its counted size asks for.
    """
    import math
    near = math.log(1 - math.acos(THRESHOLD) / math.pi)
    sizes = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    bits = F.greatest(F.lit(1), F.least(F.lit(60), F.ceil(F.log2(F.col("n") / (GROUP / 2)))))
    tables = F.ceil(F.lit(math.log(MISSED)) / F.log(F.lit(1.0) - F.least(F.lit(0.999), F.exp(F.col("bits") * F.lit(near)))))
    plan = cut_lineage(sizes.withColumn("bits", bits.cast("int")).withColumn("tables", tables.cast("int")).select("label", "bits", "tables"))

    def sign(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        planes: dict[tuple[int, int], object] = {}
        for b in batches:
            ids, at, codes = [], [], []
            for i, v, bits, tables in zip(*(b.column(k).to_pylist() for k in range(4))):
                if (len(v), tables) not in planes:
                    planes[len(v), tables] = np.stack([np.random.default_rng([len(v), t]).normal(size=(60, len(v))) for t in range(tables)])
                side = planes[len(v), tables][:, :bits] @ np.asarray(v, float) > 0
                ids += [i] * tables
                at += range(tables)
                codes += (side @ (1 << np.arange(bits, dtype=np.int64))).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(codes, pa.int64())], ["id", "t", "code"])

    signed = nodes.join(small_side(plan), "label").select("id", "vec", "bits", "tables").mapInArrow(sign, "id long, t int, code long")
    cell = ["label", "dim", "t", "code"]
    cells = stored(signed.join(nodes.select("id", "label", F.size("vec").alias("dim")), "id"), "cells")
    dense = cut_lineage(cells.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP))
    slot = F.pmod(F.xxhash64("id", "t"), F.coalesce(F.ceil(F.col("n") / GROUP), F.lit(1)))
    dealt = cells.join(small_side(dense), cell, "left").withColumn("slot", slot).select(*cell, "slot", "id")
    return dealt.join(nodes.select("id", "vec"), "id").groupBy(*cell, "slot").agg(F.collect_list(F.struct("id", "vec")).alias("members")).select("members")


def neighbour_graph(nodes: DataFrame, size: int = LIST, rounds: int = ROUNDS) -> DataFrame:
    """``u, v, s``: refined lists of about ``size`` neighbours with their cosines; ``nodes`` has id, label, vec."""
    def best(edges: DataFrame) -> DataFrame:
        w = Window.partitionBy("u").orderBy(F.col("s").desc(), "v")
        # a link always stays: a list full of links is a list that has to grow
        return edges.groupBy("u", "v").agg(F.max("s").alias("s")).withColumn("r", F.row_number().over(w)).where(
            (F.col("r") <= size) | (F.col("s") >= THRESHOLD)).drop("r")

    first = start_groups(nodes)
    graph = stored(best(_local(first, size)), "graph")
    before = None
    for turn in range(rounds):
        both = graph.select("u", "v").union(graph.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        lists = (both.withColumn("h", F.xxhash64("u", "v", F.lit(turn)))
                 .withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy("h"))).where(F.col("r") <= 2 * size))
        groups = lists.join(nodes.select(F.col("id").alias("v"), F.struct("id", "vec").alias("m")), "v").groupBy("u").agg(
            F.collect_list("m").alias("members"))
        graph = stored(best(graph.unionByName(_local(groups, size))), "graph")
        lists = graph.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if lists == before:
            break
        before = lists
    return graph


def compared(placed: DataFrame, label: str) -> DataFrame:
    """All pairs of each group ``g`` of ``g, id, vec, copies``: ``u, null, links`` to be added up, and ``u, v`` that join what is linked."""
    sizes = placed.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    held = placed.join(small_side(cut_lineage(sizes)), "g").withColumn("block", F.pmod(F.xxhash64("id", F.lit(17)), F.col("blocks")))
    rows = stored(held.groupBy("g", "blocks", "block").agg(F.collect_list(F.struct("id", "vec", "copies")).alias("mine")), "blocks")
    left = rows.withColumn("other", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)))
    right = rows.select("g", F.col("block").alias("other"), F.col("mine").alias("theirs"))

    def count(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for b in batches:
            for mine, theirs in zip(b.column(0), b.column(1)):
                mine, theirs = mine.as_py(), theirs.as_py()
                p, q = (np.array([m["id"] for m in x]) for x in (mine, theirs))
                linked = (_unit([m["vec"] for m in mine]) @ _unit([m["vec"] for m in theirs]).T) >= THRESHOLD
                linked &= p[:, None] != q[None, :]
                links = linked @ np.array([m["copies"] for m in theirs])
                u, n = [p[links > 0]], [links[links > 0]]
                if p[0] not in q:
                    back = np.array([m["copies"] for m in mine]) @ linked
                    u.append(q[back > 0])
                    n.append(back[back > 0])
                # one star for each set of vectors that links connect here
                fresh, open_, a, c = linked.any(1), linked.any(0), [], []
                while fresh.any():
                    root = front = np.flatnonzero(fresh)[:1]
                    fresh[root] = False
                    while len(front):
                        new = np.flatnonzero(linked[front].any(0) & open_)
                        open_[new] = False
                        front = np.flatnonzero(linked[:, new].any(1) & fresh)
                        fresh[front] = False
                        for x in (q[new], p[front]):
                            a += [int(p[root[0]])] * len(x)
                            c += x.tolist()
                u, n = np.concatenate(u).tolist(), np.concatenate(n).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(u + a, pa.int64()), pa.array([None] * len(u) + c, pa.int64()),
                                                  pa.array(n + [0] * len(a), pa.int64())], ["u", "v", "n"])

    return stored(left.join(right, ["g", "other"]).select("mine", "theirs").mapInArrow(count, "u long, v long, n long"), label)


def audit(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """``label, u, v``: all links of about SAMPLE vectors of each label, by comparison with every vector of the label."""
    some = nodes.join(small_side(sizes), "label").where(F.pmod(F.xxhash64("id", F.lit(5)), F.col("n")) < SAMPLE).select("label", "id", "vec")
    table: dict = {}
    for r in some.collect():
        table.setdefault((r.label, len(r.vec)), []).append((r.id, r.vec))
    sent = nodes.sparkSession.sparkContext.broadcast({k: ([i for i, _ in v], _unit([x for _, x in v])) for k, v in table.items()})

    def look(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for b in batches:
            u, v, groups = [], [], {}
            for label, i, x in zip(*(b.column(k).to_pylist() for k in range(3))):
                groups.setdefault((label, len(x)), []).append((i, x))
            for key, rows in groups.items():
                if key in sent.value:
                    ids, x = sent.value[key]
                    for r, c in zip(*np.nonzero(_unit([x for _, x in rows]) @ x.T >= THRESHOLD)):
                        u.append(ids[c])
                        v.append(rows[r][0])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    found = nodes.select("label", "id", "vec").mapInArrow(look, "u long, v long").where("u <> v")
    return stored(found.join(nodes.select(F.col("id").alias("u"), "label"), "u"), "audit")


def near_vectors(vectors: DataFrame, exact: int = 0) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row; unusable vectors and null labels link with nothing.

    ``exact`` is the number of vectors up to which a label is compared whole instead, for checks of the descent.
    """
    good = usable(vectors).select("vec_id", "label", "embedding", F.xxhash64("label", "embedding").alias("k"))
    nodes = stored(good.groupBy("label", "k").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("vec"))
                   .select("id", "label", "k", "copies", "vec"), "nodes")
    sizes = cut_lineage(nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")))
    large = cut_lineage(sizes.where(F.col("n") > exact))
    whole = sizes.where(F.col("n") <= exact).select("label")
    edges = None
    if large.limit(1).count():
        wide = stored(nodes.join(small_side(large.select("label")), "label"), "large")
        near = neighbour_graph(wide).where(F.col("s") >= THRESHOLD).select("u", "v")
        true = audit(wide, large)
        found = components(near, "u", "v")
        ends = (true.join(found.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u", "left")
                .join(found.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v", "left"))
        recall = ends.groupBy("label").agg(F.avg(F.coalesce(F.col("ru") == F.col("rv"), F.lit(False)).cast("double")).alias("recall"))
        # where the sample shows missed links the label is compared whole
        poor = cut_lineage(large.join(recall, "label", "left").where(F.coalesce("recall", F.lit(1.0)) < RECALL).select("label"))
        whole = whole.union(poor)
        edges = near.union(true.select("u", "v"))
    g = F.struct("label", F.size("vec").alias("dim")).alias("g")
    every = compared(nodes.join(small_side(cut_lineage(whole)), "label").select(g, "id", "vec", "copies"), "every")
    joined = every.where("v is not null").select("u", "v")
    roots = stored(components(joined if edges is None else joined.union(edges), "u", "v"), "roots")
    links = every.where("v is null")
    if edges is not None:
        rest = nodes.join(small_side(cut_lineage(whole)), "label", "left_anti")
        links = links.union(compared(rest.join(roots, F.col("node") == F.col("id")).select(F.col("root").alias("g"), "id", "vec", "copies"), "inside")
                            .where("v is null"))
    links = links.groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("links"))
    known = (nodes.select("id", "label", "k", "copies").join(roots.withColumnRenamed("node", "id"), "id", "left").join(links, "id", "left")
             .select("label", "k", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id")))
    mine = good.select("vec_id", "label", "k").join(known, ["label", "k"]).select("vec_id", "n_links", "component_id").dropDuplicates(["vec_id"])
    return (vectors.select("vec_id").join(mine, "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


@query("op2_embeddings")
def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
