import numpy as np

from eventloom.llm.embeddings import GROUP, near_vectors, start_groups


def test_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    x[100:140] = x[7] + rng.normal(size=(40, 16)) * 0.1
    x[200:210] = x[201]
    x[250] = x[3] + 0.02
    rows = [(i, [float(f) for f in v], i % 2 if i < 100 else 1) for i, v in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, rows[7][1], None)]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")).collect()}
    f = np.array([np.float32(r[1]) for r in rows], float)
    u = f / np.linalg.norm(f, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    link = (u @ u.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    for i in range(300):
        assert got[i].n_links == link[i].sum(), i
        assert got[i].component_id <= i
    smallest = np.arange(300)
    for _ in range(300):
        smallest = np.where(link, smallest[None, :], smallest[:, None]).min(1)
    assert [got[i].component_id for i in range(300)] == smallest.tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903))


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def isolated(pairs: int):
    """Random vectors with pairs at a cosine of 0.935, far from all others."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(pairs):
        y = x[i + 2000] - (x[i + 2000] @ x[i]) * x[i]
        x[i + 2000] = 0.935 * x[i] + np.sqrt(1 - 0.935 ** 2) * y / np.linalg.norm(y)
    return [(i, [float(f) for f in v], 1) for i, v in enumerate(x)]


def test_isolated_links(spark):
    docs = spark.createDataFrame(isolated(200), "vec_id long, embedding array<float>, label int")
    for exact in (8192, 1000):
        got = {r.vec_id: r.component_id for r in near_vectors(docs, exact=exact).collect()}
        assert sum(got[i + 2000] == i for i in range(200)) >= (200 if exact > 4000 else 198)


def test_groups_of_a_dense_cell_are_bounded(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=16) + rng.normal(size=(3000, 16)) * 0.01
    nodes = spark.createDataFrame([(i, 1, [float(f) for f in v]) for i, v in enumerate(x)], "id long, label int, vec array<float>")
    sizes = [r[0] for r in start_groups(nodes).selectExpr("size(members)").collect()]
    assert max(sizes) <= 1.5 * GROUP and sum(sizes) % 3000 == 0


def test_descent_finds_what_all_pairs_give(spark):
    docs = spark.createDataFrame(isolated(150), "vec_id long, embedding array<float>, label int").selectExpr("vec_id", "embedding", "vec_id % 4 div 2 label")
    descent, whole = ({(r.vec_id, r.n_links, r.component_id) for r in near_vectors(docs, exact).collect()} for exact in (0, 1 << 40))
    assert sum(n for _, n, _ in whole) == 300 and len(descent & whole) >= 0.99 * len(whole)
