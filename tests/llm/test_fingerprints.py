import hashlib

from eventloom.llm.fingerprints import fingerprints, op10_fingerprints

SF = "/root/testdata/sf0.001"


def test_edited_texts(spark):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in op10_fingerprints(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, (d, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        cut = len(t) // 3
        edited = t[:len(t) - cut] + after[:cut]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d].n_chars == len(t)
        assert 0 <= got[d].near_next <= 1
    long = [r for r in got.values() if r.n_chars > 400]
    assert sum(r.near_edited > r.near_next for r in long) > 0.9 * len(long)


def test_cases(spark):
    rows = [(1, "a b c d e f g", 1), (1, "a b c d e f g", 1), (2, None, 1), (None, "", 1), (3, "a b c d e f g", 1)]
    got = fingerprints(spark.createDataFrame(rows, "doc_id long, text string, edited int")).collect()
    assert len(got) == 5
    assert len({tuple(r["print"]) for r in got if r.text}) == 1
    assert fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
