from eventloom.llm.toxicity import clause_weight, op5_toxicity, score, train

SF = "/root/testdata/sf0.1"


def test_held_out_rows(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in op5_toxicity(spark, SF).collect() if r.held_out and r.doc_id in toxic]
    right = sum(r.predicted and toxic[r.doc_id] for r in rows)
    assert right / sum(toxic[r.doc_id] for r in rows) > 0.85
    assert right / sum(r.predicted for r in rows) > 0.85


def test_grammar():
    arcs = {"idiot": 1.0}
    plain = clause_weight("an idiot".split(), arcs)
    assert clause_weight("you are an idiot".split(), arcs) > plain
    assert clause_weight("not an idiot".split(), arcs) < plain
    assert clause_weight("someone said idiot".split(), arcs) < plain


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 0), (3, "you idiot", 1), (3, "you idiot", 1), (None, "fine " * 9000, 0)],
                                 "doc_id long, text string, toxic int")
    got = score(docs.select("doc_id", "text"), train(docs.limit(0))).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert all((r.predicted == 1) == (r.text == "you idiot") for r in got)
