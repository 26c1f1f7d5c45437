from eventloom.llm.langid import identify, op3_language, train

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in op3_language(spark, SF).collect()]
    assert len(got) == len(true)
    out = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(true[r.doc_id] == r.lang_pred for r in out) / len(out) > 0.95


def test_cases(spark):
    rows = [(1, "the cat and the dog", "en", 1.0), (2, None, "en", 1.0), (3, "", None, 1.0), (4, "12 34 !!", "en", 1.0),
            (5, "der Hund und die Katze " * 3000, "de", 1.0), (None, "les chats", None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {r.text: r for r in identify(docs, train(docs)).collect()}
    assert len(got) == 6
    assert all(got[t].lang_pred == "und" for t in (None, "", "12 34 !!"))
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = docs.limit(0)
    assert train(empty) is None and identify(empty, None).count() == 0


def test_every_language_is_a_class(spark):
    rows = [(i, f"word{i % 700} text{i % 700}", f"l{i % 700:03}") for i in range(2800)]
    net = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=2800)
    assert len(net.labels) == 700
