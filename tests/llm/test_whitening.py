import numpy as np
import pytest

from eventloom.llm.whitening import divide, polar_factor, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def spectrum(values, seed=3):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values),) * 2))
    a = (q * np.asarray(values, float)) @ q.T
    return (a + a.T) / 2, q


def test_polar_factor_is_the_sign():
    values = np.r_[3.0, -2.0, 1e-9, -1e-9, 0.5, -40.0]
    a, q = spectrum(values)
    assert np.abs(polar_factor(a) - (q * np.sign(values)) @ q.T).max() < 1e-6


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], np.linspace(1, 2, 64), [1, 1, 1, 1], [2, 2, 1, 1, 0, 0], [1e12, 1, 1e-3, 0], [7],
                                    np.r_[np.ones(20) + 1e-9 * np.arange(20), 3]])
def test_components(values):
    a, _ = spectrum(values)
    e, v = divide(a)
    assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-13
    assert np.abs(a @ v - v * e).max() <= 1e-13 * np.abs(a).max() * len(e)
    assert np.abs(np.sort(e) - np.sort(values)).max() <= 1e-13 * max(np.abs(values)) * len(e)


def test_of_nothing():
    assert len(divide(np.zeros((0, 0)))[0]) == 0


def check(rows, vectors, components=32):
    """Against the covariance and eigenvectors of a plain library."""
    ids = [i for i, v in vectors if v is not None and len(v) and all(e is not None and np.isfinite(e) for e in v)]
    x = np.floor(64 * np.array([np.float32(v) for i, v in vectors if i in set(ids)], float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    y = x - s / n
    cov = y.T @ y / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    got = {r.vec_id: r for r in rows}
    assert sorted(got) == sorted(ids)
    for i, row, whole in zip(ids, y, x):
        r = got[i]
        assert r.n == n and r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(whole, s))
        assert len(r.white) == min(components, len(e)) and r.identity_error <= 1e-9
        assert np.allclose(r.explained, (e / np.trace(cov))[:components], rtol=1e-9)
        assert np.allclose(np.abs(r.white), np.abs(row @ v[:, :components] / np.sqrt(e[:components])), atol=1e-7)


def test_against_a_library(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40)) * 0.1
    vectors = [(i, [float(f) for f in v]) for i, v in enumerate(x)]
    odd = [(900, None), (901, [None] + [1.0] * 39), (902, [float("nan")] * 40), (903, [float("inf")] * 40)]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors + odd], SCHEMA).repartition(7)
    check(whiten(df).collect(), vectors + odd)


def test_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check(whiten(df).collect(), [(r.vec_id, r.embedding) for r in df.collect()])


def test_edges(spark):
    # one vector, equal vectors: no variance, so no component; other lengths are lists of their own; ids may repeat or be null
    rows = [(1, [0.5, 0.25, 2.0], 1), (1, [0.5, 0.5, -2.0], 1), (None, [1.5, 0.25, 0.0], None), (7, [3.0, 4.0], 2), (8, [], 2), (9, [1e30, 1.0, 1.0, 1.0], 1), (10, [1.0] * 4, 1)]
    got = whiten(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "2 AS white", "3 AS deviation")).collect()
    assert sorted((r.vec_id or 0, r.n, len(r.white)) for r in got) == [(0, 3, 2), (1, 3, 2), (1, 3, 2), (7, 1, 0), (9, 2, 1), (10, 2, 1)]
    assert {r.deviation is None for r in got if r.n == 2} == {True}
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
