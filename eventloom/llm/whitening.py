"""Whitening of vectors by spectral divide and conquer.

Spark sums the fit list: counts and sums first, then products of entries centred at the rounded mean. Both are whole
numbers, so any order of summing gives the same, and what the rounding of the mean leaves over is taken off exactly.
The covariance is as wide as a vector is long, whatever the number of rows; it is split on the driver: the polar factor
of the shifted matrix (QDWH: dynamically weighted Halley steps) is its sign, which gives the projector on the directions
above the shift; bases of its range and null space cut the matrix into two smaller ones, down to single components.
The components go to all tasks, and rows are projected there.

Nulls: a null vector, or one with a null or non-finite entry, is dropped. Vectors of another length form a fit list of
their own; empty ones have no component. Repeated rows and null or repeated ids stay rows of their own, ties of
eigenvalues get an arbitrary but fixed basis, other columns are not looked at, an empty table gives no rows. A component
without variance (one vector, equal vectors, dependent entries) cannot be scaled and is left out. ``deviation`` is null
beyond a long; an entry is saturated at 2**60.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.registry import query

COMPONENTS = 32
#: Entries become whole numbers: ``floor(SCALE * entry) + OFFSET``.
SCALE, OFFSET = 64, 1_000_000
#: A component counts as without variance below this share of the whole variance.
FLAT = 1e-13
_SATURATED = 1 << 60


class Whitening(NamedTuple):
    """The fit for one vector length: ``basis`` has a column per component, ``values`` falls."""
    n: int
    sums: list[int]
    covariance: object
    values: object
    basis: object

    @property
    def mean(self) -> list[int]:
        return [round(s / self.n) for s in self.sums]

    @property
    def rest(self) -> list[float]:
        """The mean less its rounded value."""
        return [(s - self.n * m) / self.n for s, m in zip(self.sums, self.mean)]


def usable(vectors: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.size("embedding") > 0))


def _grid(column, scale: int, offset: int):
    """(length, rows of that length, whole numbers) of an Arrow list column, length by length."""
    import numpy as np
    sizes = np.diff(column.offsets.to_numpy())
    flat, begin = column.values.to_numpy(zero_copy_only=False).astype(float), column.offsets.to_numpy()[:-1]
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        x = np.floor(scale * flat[begin[at][:, None] + np.arange(d)])
        yield int(d), at, np.clip(x, -_SATURATED, _SATURATED).astype(np.int64) + offset


def moments(rows: DataFrame, scale: int, offset: int) -> dict[int, tuple[int, list[int]]]:
    """length -> (rows, sum of each entry), exact. The driver gets one row per vector entry."""
    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        total: dict[int, list] = {}
        for b in batches:
            for d, at, x in _grid(b.column(0), scale, offset):
                one = total.setdefault(d, [0, np.zeros(d, np.int64), np.zeros(d, np.int64)])
                one[0] += len(at)
                one[1] += (x >> 32).sum(0)
                one[2] += (x & 0xFFFFFFFF).sum(0)
        for d, (n, high, low) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()),
                                              pa.array(high), pa.array(low)], ["d", "j", "n", "high", "low"])

    sums = rows.select("embedding").mapInArrow(run, "d int, j int, n long, high long, low long").groupBy("d", "j").agg(
        F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sums.collect():
        out.setdefault(r.d, (r.n, [0] * r.d))[1][r.j] = (int(r.high) << 32) + int(r.low)
    return out


def _products(rows: DataFrame, centred, out: str) -> DataFrame:
    """``d, i, j, p``: sums of products of what ``centred`` makes of the batches, upper half, one row a task and place."""
    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        total: dict[int, object] = {}
        for b in batches:
            for d, y in centred(b):
                total[d] = total.get(d, 0) + y.T @ y
        for d, p in total.items():
            i, j = np.triu_indices(len(p))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d), pa.int32()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                              pa.array(p[i, j].astype(float))], ["d", "i", "j", out])

    return rows.select("embedding").mapInArrow(run, f"d int, i int, j int, {out} double").groupBy("d", "i", "j").agg(F.sum(out).alias(out))


def covariances(rows: DataFrame, sums: dict[int, tuple[int, list[int]]], scale: int, offset: int) -> dict[int, object]:
    """length -> covariance (divisor n). Products of entries less the rounded mean, exact up to 2**53, so in any order."""
    import numpy as np
    middle = {d: [round(s / n) for s in total] for d, (n, total) in sums.items()}

    def centred(b):
        for d, _, x in _grid(b.column(0), scale, offset):
            yield d, (x - np.array(middle[d])).astype(float)

    out = {d: np.zeros((d, d)) for d in sums}
    for r in _products(rows, centred, "p").collect():
        n, total = sums[r.d]
        rest = [total[k] - n * middle[r.d][k] for k in (r.i, r.j)]
        # both sides are whole numbers: only the division rounds
        out[r.d][r.i, r.j] = out[r.d][r.j, r.i] = (int(r.p) * n - rest[0] * rest[1]) / (n * n)
    return out


def polar_factor(a):
    """The orthogonal factor of the symmetric ``a`` by QDWH steps: its sign, as a matrix."""
    import numpy as np
    n, eye = len(a), np.eye(len(a))
    size = np.sqrt((a * a).sum())
    x, low = a / size, 1e-17
    for _ in range(30):
        l2 = low * low
        d = np.cbrt(4 * (1 - l2) / (l2 * l2)) if l2 < 1 else 0.0
        r = np.sqrt(1 + d)
        wa = r + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - l2) / (l2 * r))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(eye + wc * (x @ x), x)
        new = (new + new.T) / 2
        moved, x, low = np.abs(new - x).max(), new, min(1.0, low * (wa + wb * l2) / (1 + wc * l2))
        if 1 - low < 1e-14 and moved < 1e-6:
            break
    return x


def _halves(a, scale: float):
    """Bases of the two invariant subspaces of ``a`` that a shift parts, or None where no shift does."""
    import numpy as np
    n, mean = len(a), np.trace(a) / len(a)
    spread = np.sqrt(((a - mean * np.eye(n)) ** 2).sum())
    if spread <= 1e-15 * scale:
        return None
    # the median splits evenly; the mean always lies between the extremes; the others avoid an eigenvalue hit exactly
    for shift in (np.median(np.diag(a)), mean, mean + 0.1 * spread / n, mean - 0.07 * spread / n, mean + 0.013 * spread / n):
        above = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = round(np.trace(above))
        if not 0 < k < n or np.abs(above @ above - above).max() > 1e-9:
            continue
        # two steps of subspace iteration: the first start may be badly conditioned, the second is not
        q, _ = np.linalg.qr(above @ np.random.default_rng(n).normal(size=(n, k)))
        q, _ = np.linalg.qr(above @ q, mode="complete")
        if np.abs(q[:, k:].T @ a @ q[:, :k]).max() <= 1e-11 * scale:
            return q[:, :k], q[:, k:]
    return None


def divide(v):
    """Eigenvalues, falling, and unit eigenvectors (columns) of the symmetric ``v``; the largest entry of each is positive."""
    import numpy as np
    v = np.asarray(v, float)
    scale, done, open_ = max(np.abs(v).max(initial=0), 1e-300), [], [np.eye(len(v))]
    while open_:
        q = open_.pop()
        a = q.T @ v @ q
        parts = _halves((a + a.T) / 2, scale) if q.shape[1] > 1 else None
        if parts is None:
            done.append(q)
        else:
            open_ += [q @ p for p in parts]
    # blocks are orthogonal up to rounding, which one QR step takes off
    basis, _ = np.linalg.qr(np.hstack(done)) if done else (np.zeros((0, 0)), None)
    values = np.einsum("ij,ij->j", basis, v @ basis)
    order = np.argsort(-values, kind="stable")
    basis, values = basis[:, order], values[order]
    top = basis[np.abs(basis).argmax(0), np.arange(len(order))] if len(order) else np.ones(0)
    return values, basis * np.where(top < 0, -1.0, 1.0)


def fit(rows: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> dict[int, Whitening]:
    """The whitening of every vector length of the usable ``rows``."""
    sums = moments(rows, scale, offset)
    spread = covariances(rows, sums, scale, offset) if sums else {}
    return {d: Whitening(*sums[d], v, *divide(v)) for d, v in spread.items()}


def _factors(model: dict[int, Whitening], components: int):
    """length -> (rounded mean, its rest, directions over the root of their eigenvalue)."""
    import numpy as np
    out = {}
    for d, m in model.items():
        k = int((m.values[:components] > FLAT * max(m.values.sum(), 1e-300)).sum())
        out[d] = np.array(m.mean, np.int64), np.array(m.rest), m.basis[:, :k] / np.sqrt(m.values[:k])
    return out


def identity_error(rows: DataFrame, model: dict[int, Whitening], components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> dict[int, float]:
    """length -> largest absolute entry of (covariance of the whitened rows - identity), measured on all rows."""
    import numpy as np
    factors = _factors(model, components)

    def centred(b):
        for d, _, x in _grid(b.column(0), scale, offset):
            middle, rest, w = factors[d]
            # the added one carries the sums, so that the covariance is taken about the mean of the whitened rows
            yield d, np.hstack([((x - middle) - rest) @ w, np.ones((len(x), 1))])

    sums: dict[int, object] = {d: np.zeros((f[2].shape[1] + 1,) * 2) for d, f in factors.items()}
    for r in _products(rows, centred, "p").collect():
        sums[r.d][r.i, r.j] = sums[r.d][r.j, r.i] = r.p
    out = {}
    for d, s in sums.items():
        n, mean = model[d].n, s[:-1, -1] / model[d].n
        out[d] = float(np.abs(s[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0))
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``vec_id, n, deviation, white`` (one entry per component), ``explained``, ``identity_error`` of every usable row."""
    rows = usable(vectors.select("vec_id", "embedding"))
    model = fit(rows, scale, offset)
    factors, errors = _factors(model, components), identity_error(rows, model, components, scale, offset)
    sent = {d: (m.n, m.sums, *factors[d], (m.values / max(m.values.sum(), 1e-300))[:factors[d][2].shape[1]], errors[d]) for d, m in model.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(sent)

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for b in batches:
            for d, at, x in _grid(b.column("embedding"), scale, offset):
                n, sums, middle, rest, w, share, error = shared.value[d]
                white = ((x - middle) - rest) @ w
                far = float(np.abs(x - middle).max(initial=0) + 1) * n
                if far * far * d < 2.0**62:
                    y = (x - middle) * n - (np.array([s - n * m for s, m in zip(sums, middle.tolist())]))
                    off = (y * y).sum(1).tolist()
                else:  # whole numbers of any length
                    off = [sum((n * e - s) ** 2 for e, s in zip(r, sums)) for r in x.tolist()]
                    off = [o if o < 1 << 63 else None for o in off]
                count = len(at)
                lists = lambda a, k: pa.ListArray.from_arrays(np.arange(0, count * k + 1, k, dtype=np.int32) if k else np.zeros(count + 1, np.int32), pa.array(a.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id").take(pa.array(at)), pa.array([n] * count, pa.int64()), pa.array(off, pa.int64()), lists(white, len(share)),
                     lists(np.tile(share, count), len(share)), pa.array([error] * count, pa.float64())],
                    ["vec_id", "n", "deviation", "white", "explained", "identity_error"])

    return rows.mapInArrow(run, f"vec_id {dict(vectors.dtypes)['vec_id']}, n long, deviation long, white array<double>, explained array<double>, identity_error double")


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return (rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("white", "explained")).alias("place", "c"))
            .select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", F.col("c.white").alias("whitened"),
                    F.col("c.explained").alias("explained"), "identity_error"))
