from compare import compare, connect

from eventloom.llm.mixing import mix, op7_mixing
from eventloom.llm.registry import ORACLES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, size int"


def test_against_sql(spark):
    assert compare(op7_mixing(spark, SF), connect(SF), ORACLES["op7_mixing"]) is None


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(1, "a b c", "x", 9), (1, "a b c", "x", 9), (2, None, "x", 9), (None, "a", None, 9), (3, "", "y", 9)]
    got = mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5
    assert all(r.taken <= 2 * r.size for r in got)
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert sum(r.taken for r in mine) == round(mine[0].target)


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
