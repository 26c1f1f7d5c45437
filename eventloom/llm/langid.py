"""Language of a text by a small byte convolutional network trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import small_side
from eventloom.llm.registry import query
from eventloom.session import cut_lineage

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: At most about so many labelled rows are fitted on, chosen by a hash and evenly by language.
SAMPLE_ROWS = 3000
#: Windows taken from each fitted row, spread over its whole text.
ROW_WINDOWS = 4


class ByteNet:
    """Per offset of each filter width, a table from byte to filter values; max pooling; softmax."""

    def __init__(self, labels: list[str], seed: int = 7):
        import numpy as np
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.tables = [rng.normal(0, 0.3, (w, 257, FILTERS)).astype("f4") for w in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype("f4")
        self.bias = np.zeros(len(labels), "f4")

    def features(self, x):
        """Pooled values and where the maxima are, for rows of bytes padded with 256."""
        import numpy as np
        values, places = [], []
        for t in self.tables:
            span = x.shape[1] - len(t) + 1
            conv = t[0][x[:, :span]]
            for j in range(1, len(t)):
                conv += t[j][x[:, j:j + span]]
            at = conv.argmax(1)
            places.append(at)
            values.append(np.take_along_axis(conv, at[:, None, :], 1)[:, 0])
        return np.tanh(np.concatenate(values, 1)), places

    def probabilities(self, x):
        import numpy as np
        z = self.features(x)[0] @ self.out + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, x, y, epochs: int = 6, rate: float = 0.02, seed: int = 11) -> None:
        """Adam on cross-entropy, classes weighed evenly; only the winning positions carry gradients."""
        import numpy as np
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.out, self.bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        weight = (len(y) / (len(self.labels) * np.maximum(np.bincount(y, minlength=len(self.labels)), 1))).astype("f4")
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(order), 128):
                pick = order[at:at + 128]
                bx, by = x[pick], y[pick]
                h, places = self.features(bx)
                z = h @ self.out + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(by)), by] -= 1
                p *= (weight[by] / len(by))[:, None]
                dh = (p @ self.out.T) * (1 - h * h)
                grads = [np.zeros_like(t) for t in self.tables]
                cols = np.broadcast_to(np.arange(FILTERS), (len(by), FILTERS))
                for i, t in enumerate(self.tables):
                    d = dh[:, i * FILTERS:(i + 1) * FILTERS]
                    for j in range(len(t)):
                        np.add.at(grads[i][j], (np.take_along_axis(bx, places[i] + j, 1), cols), d)
                grads += [h.T @ p, p.sum(0)]
                step += 1
                for q, g, a, b in zip(params, grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)


def _windows(data: bytes):
    """The whole of ``data`` as rows of WINDOW bytes; the end is padded with 256."""
    import numpy as np
    n = max(1, -(-len(data) // WINDOW))
    x = np.full(n * WINDOW, 256, np.int64)
    x[:len(data)] = np.frombuffer(data, np.uint8)
    return x.reshape(n, WINDOW)


def train(labelled: DataFrame, key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> ByteNet | None:
    """Fits on a bounded sample of ``text, lang`` rows; None if there is no label.

    Rows are chosen by a hash of ``key``, about as many of each language, however many languages there are; windows
    come from all over a text. The sample's languages are the classes.
    """
    import numpy as np
    rows = labelled.where("lang is not null and text is not null and length(text) > 0")
    sizes = cut_lineage(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    languages = sizes.count()
    if not languages:
        return None
    each = max(1, sample_rows // languages)
    shares = sizes.select("lang", F.least(F.lit(1.0), F.lit(float(each)) / F.col("n")).alias("share"))
    u = F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 20)) / (1 << 20)
    step = F.greatest(F.floor(F.length("text") / ROW_WINDOWS), F.lit(WINDOW))
    cuts = F.transform(F.sequence(F.lit(0), F.lit(ROW_WINDOWS - 1)),
                       lambda i: F.substring(F.col("text"), (i * step + 1).cast("int"), F.lit(WINDOW)))
    sample = (rows.join(small_side(shares), "lang").where(u < F.col("share")).select("lang", cuts.alias("cuts"), F.xxhash64(key).alias("k"))
              .orderBy("k", "lang").limit(2 * sample_rows).collect())
    labels, rng = sorted({r.lang for r in sample}), np.random.default_rng(3)
    x, y = [], []
    for r in sample:
        for c in r.cuts:
            data = c.encode()[:WINDOW]
            if not data:
                continue
            for n in {len(data), int(rng.integers(min(12, len(data)), len(data) + 1))}:
                x.append(_windows(data[:n])[0])
                y.append(labels.index(r.lang))
    if not y:
        return None
    net = ByteNet(labels)
    net.fit(np.stack(x), np.array(y))
    return net


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from the text alone, over all its windows.

    ``und`` with score 0 for null texts and texts without letters, and for all if there is no network.
    A text's probabilities are the mean over its windows, by their bytes.
    """
    from pyspark.sql import types as T
    schema = T.StructType([f for f in docs.schema if f.name not in ("lang_pred", "score")]
                          + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = [f.name for f in schema][:-2]
    at = names.index("text")

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import re
        letter = re.compile(r"[^\W\d_]")

        def one(data: bytes):
            total = np.zeros(len(net.labels))
            x = _windows(data)
            for i in range(0, len(x), 64):
                p = net.probabilities(x[i:i + 64])
                total += ((x[i:i + 64] < 256).sum(1)[:, None] * p).sum(0)
            return total / len(data)

        for batch in batches:
            langs, scores = [], []
            texts = [t if t and net is not None and letter.search(t) else None for t in batch.column(at).to_pylist()]
            for first in range(0, len(texts), 32):
                group = [t.encode() if t else b"" for t in texts[first:first + 32]]
                short = [g for g in group if 0 < len(g) <= 64 * WINDOW]
                if short:
                    xs = [_windows(g) for g in short]
                    x = np.concatenate(xs)
                    p = np.concatenate([net.probabilities(x[i:i + 64]) for i in range(0, len(x), 64)])
                    p *= (x < 256).sum(1)[:, None]
                    sums = iter(np.add.reduceat(p, np.cumsum([0] + [len(a) for a in xs[:-1]]), 0))
                for g in group:
                    if not g:
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    q = next(sums) / len(g) if len(g) <= 64 * WINDOW else one(g)
                    k = int(q.argmax())
                    langs.append(net.labels[k])
                    scores.append(float(min(1.0, q[k])))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return docs.select(*names).mapInArrow(run, schema)


def held_out(mod: int, rest: int, key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % mod == rest, F.lit(False))


@query("op3_language")
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = train(docs.where(~held_out(3, 1)).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), net).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")
