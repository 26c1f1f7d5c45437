import re

from pyspark.sql import functions as F

import corpus_pipeline as p
from eventloom.llm import mixing
from eventloom.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in p.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == list(p.COLUMNS)
        seen.append(docs)
    first, lang, near, private, mixed = ([(r.doc_id, r.text) for r in d.collect()] for d in seen)
    assert len(lang) >= 0.97 * len(first)
    assert len(near) == len({t for _, t in near}) < len(lang)
    assert len(private) == len(near) and not any(re.search(r"[a-z0-9]@[a-z0-9]+\.com", t) for _, t in private)
    total = sum(len(t.split()) for _, t in private)
    assert abs(sum(len(t.split()) for _, t in mixed) - 1.5 * total) < 0.02 * total
    rows = p.packed(spark, docs, SF).collect()
    assert len({r.sequence_id for r in rows}) >= sum(r.length for r in rows) / 1024


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], SCHEMA)


def test_mixture_of_null_and_repeated_ids(spark):
    # of each text all words are the same, so an output row tells which text it was cut from
    rows = [(None if i % 3 else i % 5, " ".join([f"w{i}"] * (5 + 7 * i % 90)), f"s{i % 3}") for i in range(60)]
    rows += [rows[4]] * 3
    docs = stored(frame(spark, rows), "docs")
    want = sorted((r.source, r.size, r.taken) for r in mixing.mix(docs).collect())
    got = {}
    for r in p.mixture(spark, docs, SF).collect():
        words = r.text.split()
        got.setdefault((r.source, words[0]), []).append(len(words))
    total, have = {}, {}
    for source, _, taken in want:
        total[source] = total.get(source, 0) + taken
    for (source, word), sizes in got.items():
        text = next(t for _, t, s in rows if t.split()[0] == word)
        assert max(sizes) <= len(text.split())
        have[source] = have.get(source, 0) + sum(sizes)
    assert have == {k: v for k, v in total.items() if v}


def test_near_copies_of_null_and_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    docs = frame(spark, [(1, a, "s"), (1, b, "s"), (2, a, "s"), (None, a, "s"), (None, c, "s"), (None, c, "t"), (None, d, "s"), (3, d, "s"), (3, d, "s")])
    got = p.near_dedup(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r.text[0]) for r in got) == [(0, "c"), (1, "a"), (1, "b"), (3, "d")]


def test_language_without_labels(spark):
    docs = frame(spark, [(1, "some words", "s"), (2, "\u00e9t\u00e9", "s"), (3, "123 --", "s")]).withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in p.language(spark, docs, SF).collect()} == {1, 2}
