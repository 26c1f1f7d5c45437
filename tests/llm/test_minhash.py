import os

import numpy as np

from eventloom.llm.common import scratch, stored
from eventloom.llm.minhash import idf_table, near_copies, op1_minhash, prefix_pairs, shingled, shingles
from eventloom.session import shared_dir

SF = "/root/testdata/sf0.01"


def plain(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_against_all_pairs(spark):
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.class_id for r in op1_minhash(spark, SF).collect()}
    assert set(got) == set(docs)
    ids, near, caught = sorted(docs), 0, 0
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = docs[a], docs[b]
            if x and y and min(len(x), len(y)) >= 0.82 * max(len(x), len(y)) and len(x & y) >= 0.82 * len(x | y):
                near += 1
                caught += got[a] == got[b]
    assert near > 50 and caught >= 0.99 * near


def test_cases(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(1, base, 1), (2, base, 1), (3, base + " tail", 1), (4, None, 1), (5, "", 1), (None, base, 1), (6, "other words", 1), (6, "other words", 1),
            (7, "\u00a0", 1)]
    got = {(r.doc_id, r.class_id) for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string, kept int")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (None, None), (6, 6), (7, 7)}
    assert near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefix_pairs_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base, texts = list(range(60)), {}
    for i in range(120):
        own = rng.choice(60, rng.integers(0, 20), replace=False)
        texts[i] = {(1000 + 100 * i + s if k in own else s): 1 + s % 7 / 7 for k, s in enumerate(base)}
    rows = [(i, i // 2, i % 3 > 0, s, w) for i, t in texts.items() for s, w in t.items()]
    got = {(r.a, r.b) for r in prefix_pairs(spark.createDataFrame(rows, "id long, root long, stray boolean, s long, w double"), 0.8).collect()}
    wanted = set()
    for a in texts:
        for b in range(a + 1, 120):
            x, y = texts[a], texts[b]
            both = sum(x[s] for s in x.keys() & y.keys())
            if a // 2 != b // 2 and (a % 3 or b % 3) and both >= 0.8 * (sum(x.values()) + sum(y.values()) - both):
                wanted.add((a, b))
    assert len(wanted) > 100 and wanted <= got and len(got) < 120 * 119 / 2


def test_shingles_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(5)
    texts = ["", " \t", "one", "one two", "a b c d", "a b c d e", "x " * 9, "\u00a0", "A b C d e f"]
    texts += [" ".join(f"w{k}" for k in rng.integers(0, 40, n)) for n in (3, 700, 30_000, 5, 4, 90)]
    got = {}
    for places, values, counts, starts in shingled(texts):
        ends = [*starts[1:], len(values)]
        got |= {p: (values[a:b].tolist(), counts[a:b].tolist()) for p, a, b in zip(places, starts, ends)}
    want = {p: (v.tolist(), c.tolist()) for p, (v, c) in enumerate(map(shingles, texts)) if len(v)}
    assert got == want and len(got) == len(texts) - 3


def test_idf_depends_on_the_share_of_documents_alone(spark):
    def table(n):
        rows = [(" ".join([f"own{i}x{k}" for k in range(200)] + (["these words stand here often"] if i % 4 == 0 else [])),) for i in range(n)]
        return idf_table(spark.createDataFrame(rows, "text string"))
    value = shingles("these words stand here often")[0][0]
    small, large = table(200), table(4000)
    at = int(value % np.uint64(len(small)))
    assert abs(small[at] - 0.2) < 0.02 and abs(large[at] - 0.2) < 0.02
    assert small.mean() > 0.9 and large.mean() > 0.9


def test_scratch_tables_go_and_kept_ones_stay(spark):
    base = shared_dir(spark).removeprefix("file://") + "/eventloom"
    with scratch(spark):
        with scratch(spark):
            gone = stored(spark.range(3), "inner")
            kept = stored(gone, "outer", keep=True)
        assert kept.count() == 3
        names = os.listdir(base)
        assert any(n.startswith("outer-") for n in names) and not any(n.startswith("inner-") for n in names)
    assert not any(n.startswith("outer-") for n in os.listdir(base))
