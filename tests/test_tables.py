"""Changes, checks, joins, sets, sources and search on small tables."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from eventloom.operators import aggregates as agg
from eventloom.operators import changes as ch
from eventloom.operators import joins, search, sets, sql_relations, zorder
from eventloom.operators.ids import Sequencer, assign_ids
from eventloom.sources import csv as csv_files
from eventloom.sources import files, jdbc
from eventloom.sources.tables import range_over, system_range, table_of, unnest, values


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upsert(spark):
    t = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (None, "n", 0)], "k int, s string, v int")
    s = spark.createDataFrame([(2, 5), (3, 7), (None, 9)], "k int, v int")
    assert rows(ch.upsert(t, s, ["k"])) == sorted([(1, "a", 10), (2, "b", 5), (3, None, 7), (None, "n", 0), (None, None, 9)], key=repr)
    added = ch.upsert(t, s, ["k"], {"v": lambda old, new: old("v") + new("v")}, {"s": F.lit("new")})
    assert (2, "b", 25) in rows(added) and (3, "new", 7) in rows(added)
    with pytest.raises(ValueError):
        ch.upsert(t, s.drop("k"), ["k"])


def test_duplicate_keys_fail(spark):
    t = spark.createDataFrame([(1, 1), (1, 2)], "k int, v int")
    s = spark.createDataFrame([(1, 3)], "k int, v int")
    for a, b in ((t, s), (s, t)):
        with pytest.raises(Exception, match="duplicate key"):
            ch.upsert(a, b, ["k"]).collect()


def test_update_delete_null_condition_keeps_the_row(spark):
    t = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "k int, v int")
    assert rows(ch.delete(t, F.col("v") > 5)) == [(1, 5), (2, None)]
    assert rows(ch.update(t, {"v": F.col("k")}, F.col("v") > 5)) == [(1, 5), (2, None), (3, 3)]
    assert rows(ch.delete(t, F.lit(True), 1, ["k"])) == [(2, None), (3, 7)]
    with pytest.raises(ValueError):
        ch.delete(t, F.lit(True), 1)


def test_checks(spark):
    t = spark.createDataFrame([(1, 5), (1, None), (None, 1), (None, 2)], "k int, v int")
    assert rows(ch.violations_unique(t, ["k"])) == [(1, 2)] and len(rows(ch.violations_unique(t, ["k"], primary=True))) == 2
    assert rows(ch.violations_check(t, F.col("v") > 4)) == sorted([(None, 1), (None, 2)], key=repr)
    parents = spark.createDataFrame([(2,)], "p int")
    assert rows(ch.violations_fk(t, ["k"], parents, ["p"])) == sorted([(1, 5), (1, None)], key=repr)


def test_ids_are_gap_free_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = assign_ids(df, ["v"], start=10, step=2).collect()
    assert sorted((r.v, r.id) for r in got) == [(v, 10 + 2 * v) for v in range(1000)]


def test_sequence(spark):
    s, df = Sequencer(start=5, increment=-2, minimum=0, maximum=6, cycle=True), spark.range(5)
    assert [r[1] for r in sorted(map(tuple, s.next_values(df, ["id"], "n").collect()))] == [5, 3, 1, 6, 4] and s.current == 4
    assert sorted(map(tuple, s.next_values(spark.range(2), ["id"], "n").collect())) == [(0, 2), (1, 0)]
    with pytest.raises(OverflowError):
        Sequencer(maximum=3).next_values(df, ["id"], "n")


@pytest.mark.parametrize("unit", [0.3, 1.0, 50.0])
def test_range_join_by_definition(spark, unit):
    rnd = random.Random(3)
    pts = [(i, rnd.uniform(-50, 50)) for i in range(120)] + [(500, None)]
    ivs = [(i, a, a + rnd.choice([-1, 0, 0.5, 1, 3, 80])) for i, a in enumerate(rnd.uniform(-60, 50) for _ in range(60))]
    p, v = spark.createDataFrame(pts, "i int, x double"), spark.createDataFrame(ivs, "j int, lo double, hi double")
    want = {(i, j) for i, x in pts for j, lo, hi in ivs if x is not None and lo <= x <= hi}
    got = joins.range_join(p, "x", v, "lo", "hi", unit).select("i", "j")
    assert got.count() == len(want) and {tuple(r) for r in got.collect()} == want
    hit = {i for i, _ in want}
    assert {r.i for r in joins.range_join(p, "x", v, "lo", "hi", unit, "left_semi").collect()} == hit
    assert {r.i for r in joins.range_join(p, "x", v, "lo", "hi", unit, "left_anti").collect()} == {i for i, _ in pts} - hit


@pytest.mark.parametrize("unit", [0.5, 4.0, 100.0])
def test_bbox_join_by_definition(spark, unit):
    rnd = random.Random(4)
    box = lambda: (x := rnd.randint(-20, 20), y := rnd.randint(-20, 20), x + rnd.choice([0, 1, 5, 30]), y + rnd.choice([0, 2, 9]))
    a, b = [(i, *map(float, box())) for i in range(50)], [(i, *map(float, box())) for i in range(50)]
    fields = lambda p: f"{p}id int, {p}xmin double, {p}ymin double, {p}xmax double, {p}ymax double"
    got = joins.bbox_join(spark.createDataFrame(a, fields("a")), spark.createDataFrame(b, fields("b")), "a", "b", unit).select("aid", "bid")
    want = {(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    assert got.count() == len(want) and {tuple(r) for r in got.collect()} == want


def test_quantified_null_rules(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    v = spark.createDataFrame([(2,), (None,)], "v int")
    ask = lambda op, q, values: [r.v for r in df.select(joins.quantified(F.col("x"), op, q, values, "v").alias("v")).collect()]
    assert ask(">", "ALL", v) == [False, None, None] and ask(">", "ANY", v) == [None, True, None]
    assert ask(">", "ALL", v.limit(0)) == [True] * 3 and ask("<", "ANY", v.limit(0)) == [False] * 3
    assert ask("=", "ALL", v.filter("v = 2")) == [False, False, None] and ask("<>", "ANY", v) == [True, True, None]


def test_set_operations_have_equal_precedence(spark):
    one, two, three = (spark.createDataFrame([(i,)], "v int") for i in (1, 2, 3))
    assert rows(sets.chain(one, ("union", two), ("intersect", three))) == []
    assert rows(sets.chain(one, ("union all", one), ("minus", two))) == [(1,)]


def test_recursion_keeps_duplicates_across_rounds(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4)], "a int, b int")
    start = spark.createDataFrame([(1,)], "n int")
    step = lambda d: edges.join(d, edges.a == d.n).select(F.col("b").alias("n"))
    assert rows(sets.recursive(start, step)) == [(1,), (2,), (3,), (4,), (4,)]
    assert rows(sets.recursive(start, step, distinct=True)) == [(1,), (2,), (3,), (4,)]
    with pytest.raises(RuntimeError):
        sets.recursive(start, lambda d: d, max_rounds=3)


def test_aggregates(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (-6, "a"), (None, "b")], "x int, s string")
    r = df.agg(agg.avg_same_type(F.col("x")).alias("a"), agg.group_concat(F.col("s"), distinct=True).alias("g"), agg.sum_true(F.col("x") > 0).alias("t"),
               agg.selectivity("x", True).alias("sel"), agg.group_concat(F.col("s"), "+", [F.col("x")]).alias("o")).first()
    assert (r.a, r.g, r.t, r.sel, r.o) == (-1, "a,b", 2, 100, "b+a+b")
    assert df.limit(0).agg(agg.selectivity("x").alias("s"), agg.group_concat(F.col("s")).alias("g"), agg.avg_same_type(F.col("x")).alias("a")).first() == (0, None, None)
    assert [tuple(e) for e in agg.histogram(df, "s").first().histogram] == [(None, 1), ("a", 1), ("b", 2)]
    p = {r.column_name: r for r in agg.profile(df).collect()}
    assert p["s"].nulls == 1 and p["x"].low == "-6" and p["x"].high == "2"


def test_ranges_and_values(spark):
    assert [r.X for r in system_range(spark, 1, 5, 2).collect()] == [1, 3, 5] and [r.X for r in system_range(spark, 3, 1, -1).collect()] == [3, 2, 1]
    v = values(spark, [(1, "a"), (2, "b")])
    assert v.columns == ["C1", "C2"]
    assert range_over(v, F.min("C1"), F.max("C1") + 250_000).count() == 250_002
    assert rows(table_of(spark, x=[1, 2], y=[3])) == sorted([(1, 3), (2, None)], key=repr)
    assert unnest(spark.createDataFrame([([1, 1],), ([1],)], "a array<int>"), "a", distinct=True).count() == 1
    with pytest.raises(ValueError):
        values(spark, [(1,), (1, 2)])


def test_csv_semantics(spark, tmp_path):
    (tmp_path / "in.csv").write_text('a,,a\n 1 ,"",x\n"q ""r""",,\n2\n\n3,4,5,6\n"line\nbreak",y,z\n')
    df = csv_files.read_csv(spark, str(tmp_path / "in.csv"))
    assert df.columns == ["a", "C2", "a1"]
    assert [tuple(r) for r in df.collect()] == [("1", "", "x"), ('q "r"', None, None), ("2", None, None), ("3", "4", "5"), ("line\nbreak", "y", "z")]
    (tmp_path / "opt.csv").write_text("#no\n1;NIL\n")
    o = csv_files.read_csv(spark, str(tmp_path / "opt.csv"), ["x", "y"], "fieldSeparator=; lineComment=# null=NIL")
    assert rows(o) == [("1", None)]
    with pytest.raises(ValueError):
        csv_files.parse_options("bogus=1")


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a;b", 'say "hi"'), (None, ""), ("x\ny", "z\\")], "p string, q string")
    assert csv_files.write_csv(df, str(tmp_path / "out"), "fieldSeparator=;") == 3
    assert rows(csv_files.read_csv(spark, str(tmp_path / "out"), options="fieldSeparator=;")) == rows(df)


def test_files_and_stored_query(spark, tmp_path):
    (tmp_path / "t.txt").write_text("grüße")
    assert files.file_read(spark, str(tmp_path / "t.txt"), "UTF-8").first().content == "grüße"
    assert files.create_table_as(spark.range(50), str(tmp_path / "c"), ["id"]).count() == 50


def test_jdbc_options():
    assert jdbc.options("jdbc:x", "u", None) == {"url": "jdbc:x", "user": "u", "fetchsize": "10000"}


def test_relation_of_wrong_width_is_empty(spark):
    assert sql_relations.directlyfollows(spark, "SELECT 1, 2").count() == 0
    log = "SELECT * FROM VALUES (1, 'A', timestamp_ntz'2020-01-01'), (1, 'B', timestamp_ntz'2020-01-02'), (1, 'C', timestamp_ntz'2020-02-02') t(c, l, t)"
    assert rows(sql_relations.follows(spark, log)) == [("A", "B"), ("B", "C")]
    state = sql_relations.autofollows(spark, "c, l, t", f"({log})", "l <> 'Z'", "2020-01-01", "2020-01-31", 5)
    assert rows(state.dfr) == [("A", "B", 1)]


def test_search(spark):
    docs = spark.createDataFrame([(1, "The quick, brown fox"), (2, "the lazy-dog"), (3, None), (4, "quick quick the")], "id int, t string")
    index = search.build_inverted_index(docs, "id", ["t"], ["of"])
    keys = lambda q, **k: sorted(r.key for r in search.search(index, q, **k).collect())
    assert keys("the QUICK") == [1, 4] and keys("dog") == [2] and keys("the cat") == [] and keys("") == [] and keys("of dog", ignore=["of"]) == [2]
    ranked = {r.key: r.score for r in search.bm25(index, search.text_lengths(docs, "id", ["t"]), "quick").collect()}
    assert set(ranked) == {1, 4} and ranked[4] > ranked[1]


@pytest.mark.parametrize("dims", [2, 3, 5])
def test_zorder(spark, dims):
    bits = zorder.bits_per_dimension(dims)
    rnd = random.Random(dims)
    pts = [tuple(rnd.randrange(1 << bits) for _ in range(dims)) for _ in range(20)] + [((1 << bits) - 1,) * dims]
    names = [f"d{j}" for j in range(dims)]
    df = spark.createDataFrame(pts, ", ".join(f"{n} bigint" for n in names)).withColumn("z", zorder.interleave(*[F.col(n) for n in names]))
    back = df.select(*[zorder.deinterleave(F.col("z"), dims, j) for j in range(dims)]).collect()
    assert [tuple(r) for r in back] == pts


def test_box_ranges_cover_exactly_the_needed_cells():
    for lo, hi in (((1, 2), (6, 5)), ((0, 0), (7, 7)), ((3, 3), (3, 3))):
        ranges = zorder.box_ranges(lo, hi)
        for x, y in itertools.product(range(9), range(9)):
            z = zorder._interleave_int((x, y))
            assert any(a <= z <= b for a, b in ranges) == (lo[0] <= x <= hi[0] and lo[1] <= y <= hi[1])


def test_limits_with_repeated_and_null_order_values(spark):
    from pyspark.sql import functions as F

    from eventloom.operators.changes import delete, update
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, None)], "a int, o int")
    changed = update(df, {"a": F.lit(0)}, F.lit(True), 2, ["o"]).collect()
    assert len(changed) == 4 and sum(r.a == 0 for r in changed) == 2
    assert delete(df, F.lit(True), 2, ["o"]).count() == 2


def test_empty_pad_wide_codes_and_bad_hex(spark):
    import pytest
    from pyspark.sql import functions as F

    from eventloom.functions import strings
    one = spark.range(1)
    got = one.select(strings.lpad(F.lit("ab"), 5, "").alias("p"), strings.trim(F.lit(" ab "), "").alias("t"),
                     strings.char(F.lit(65601)).alias("c")).first()
    assert (got.p, got.t, got.c) == ("   ab", "ab", "A")
    with pytest.raises(Exception, match="four hexadecimal"):
        one.select(strings.hex_to_raw(F.concat(F.lit("004"), F.col("id").substr(1, 0)))).collect()


def test_range_join_of_very_long_and_open_intervals(spark):
    from eventloom.operators.joins import range_join
    points = spark.createDataFrame([(0.0,), (5.0,), (5e12,), (1e13,), (-1e299,)], "x double")
    spans = [(0.0, 1e13), (-1e300, 1e300), (float("-inf"), 4.0), (5.0, 5.0), (-1.7e308, 1.7e308)]
    intervals = spark.createDataFrame(spans, "lo double, hi double")
    want = sum(lo <= r.x <= hi for r in points.collect() for lo, hi in spans)
    for unit in (1e-6, 1.0, 1e6):
        assert range_join(points, "x", intervals, "lo", "hi", unit).count() == want


def test_distinct_concatenation_keeps_the_order_asked_for(spark):
    from pyspark.sql import functions as F

    from eventloom.operators import aggregates
    df = spark.createDataFrame([("a", 2), ("b", 1), ("a", 3), (None, 0)], "x string, o int")
    got = df.agg(aggregates.group_concat(F.col("x"), ",", order=[F.col("o")], distinct=True).alias("t")).first()
    assert got.t == "b,a"


# --- NOT IN, recursion, source keys in turn, z-order ranges ---------------------------------

@pytest.mark.parametrize("values", [[], [1, 3], [1, None], [None]])
def test_not_in_by_definition(spark, values):
    rows = [1, 2, 3, None, None]
    df, v = spark.createDataFrame([(x,) for x in rows], "k int"), spark.createDataFrame([(x,) for x in values], "v int")

    def answer(x):
        if not values:
            return True
        if x is not None and x in values:
            return False
        return None if x is None or None in values else True

    got = joins.with_not_in(df, F.col("k"), v, "out").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(x, answer(x)) for x in rows], key=repr)
    kept = [r.k for r in joins.not_in(df, F.col("k"), v).collect()]
    assert sorted(kept, key=repr) == sorted([x for x in rows if answer(x)], key=repr)


def test_not_in_has_no_nested_loop(spark):
    df = spark.range(100)
    for out in (joins.not_in(df, F.col("id"), df), joins.with_not_in(df, F.col("id"), df, "out")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_recursion_beyond_a_hundred_levels_and_a_million_rows(spark):
    base = "SELECT id AS k, 0 AS depth FROM range(10000)"
    out = sets.recursive_sql(spark, "walk", base, "SELECT k, depth + 1 FROM walk WHERE depth < 104")
    assert out.agg(F.count("k"), F.max("depth")).first() == (1_050_000, 104)
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan") <= 2
    with pytest.raises(RuntimeError):
        sets.recursive_sql(spark, "walk", base, "SELECT * FROM walk", max_rounds=2)


def test_source_rows_of_a_key_apply_in_turn(spark, monkeypatch):
    monkeypatch.setattr(ch, "FOLD_ROWS", 3)
    target = [(1, 10, "a"), (2, 20, "b"), (None, 5, "n")]
    source = [(1, i, i) for i in range(8)] + [(3, 7, 1), (3, 4, 0), (None, 9, 0), (None, 9, 1)]
    t, s = spark.createDataFrame(target, "k int, v bigint, w string"), spark.createDataFrame(source, "k int, v bigint, o int").repartition(3)
    got = ch.upsert(t, s, ["k"], {"v": lambda old, new: old("v") * 2 + new("v")}, {"w": F.lit("new")}, order=["o"])
    v = 10
    for i in range(8):
        v = v * 2 + i
    want = [(1, v, "a"), (2, 20, "b"), (3, 4 * 2 + 7, "new"), (None, 5, "n"), (None, 9, "new"), (None, 9, "new")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    last = ch.replace_into(t, s, ["k"], order=["o"])
    assert sorted((r.k or 0, r.v) for r in last.collect()) == [(0, 5), (0, 9), (0, 9), (1, 7), (2, 20), (3, 7)]
    assert ch.upsert(t, s.limit(0), ["k"], {"v": lambda old, new: new("v")}, order=["o"]).count() == 3


def test_ranges_of_a_box_are_few_and_cover_it():
    for dims, low, high, n in ((2, [3, 5], [12, 9], 16), (3, [1, 0, 2], [6, 7, 3], 8), (32, [1] * 32, [2] * 32, 100), (16, [3] * 16, [9] * 16, 50)):
        begin = time.perf_counter()
        ranges = zorder.box_ranges(low, high, n)
        assert time.perf_counter() - begin < 1 and 0 < len(ranges) <= n
        rnd = random.Random(dims)
        for _ in range(300):
            z = zorder._interleave_int([rnd.randint(a, b) for a, b in zip(low, high)])
            assert any(a <= z <= b for a, b in ranges)
    exact = zorder.box_ranges([3, 5], [12, 9], 1000)
    inside = {zorder._interleave_int([x, y]) for x in range(3, 13) for y in range(5, 10)}
    assert {z for a, b in exact for z in range(a, b + 1)} == inside
    assert zorder.box_ranges([2, 2], [1, 5]) == []


def test_box_filter_beyond_the_sign(spark):
    df = spark.createDataFrame([tuple((i >> (j % 7)) & 3 for j in range(32)) for i in range(128)], ", ".join(f"c{j} int" for j in range(32)))
    cols = [f"c{j}" for j in range(32)]
    placed = df.withColumn("z", zorder.interleave(*[F.col(c) for c in cols]))
    low, high = [0] * 31 + [1], [3] * 32
    assert placed.where(zorder.box_filter("z", cols, low, high)).count() == df.where("c31 >= 1").count() > 0


def test_descending_concatenation(spark):
    df = spark.createDataFrame([("b", 1), ("a", None), ("c", 2), ("b", 3), (None, 9)], "x string, o int")
    one = lambda *o, **kw: df.agg(agg.group_concat(F.col("x"), order=list(o), **kw).alias("v")).first().v
    assert one(agg.descending("x")) == "c,b,b,a" and one(agg.descending("x"), distinct=True) == "c,b,a"
    assert one(agg.descending("o")) == "b,c,b,a" and one(F.col("o")) == "a,b,c,b"
    assert one(F.col("x"), agg.descending("o")) == "a,b,b,c"


def test_empty_table_keeps_its_columns(spark, tmp_path):
    empty = spark.createDataFrame([], "a int, `b,c` string")
    assert csv_files.write_csv(empty, str(tmp_path / "x")) == 0
    back = csv_files.read_csv(spark, str(tmp_path / "x"))
    assert back.columns == ["a", "b,c"] and back.count() == 0


def most_in_a_task(df):
    """Share of the rows that the fullest task made."""
    made = [r["count"] for r in df.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()]
    return max(made) / sum(made)


def test_box_join_deals_a_crowded_place_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 16, raising=False)
    monkeypatch.setattr(joins, "TASK_PAIRS", 3000, raising=False)
    rnd, inf = random.Random(5), float("inf")
    # long thin boxes, all in one place, some of them twice, open, or without a corner
    box = lambda i: (i, x := rnd.uniform(0, 50), y := rnd.uniform(0, 100), x + rnd.choice([0, 2]), y + rnd.choice([0, 3, 90]))
    odd = [(900, -inf, 5.0, inf, 6.0), (901, 3.0, -inf, 4.0, inf), (902, None, 1.0, 2.0, 3.0), (903, 7.0, 7.0, 6.0, 8.0)]
    a, b = ([box(i) for i in range(300)] + odd for _ in "ab")
    a += a[:5]
    fields = lambda p: f"{p}id int, {p}xmin double, {p}ymin double, {p}xmax double, {p}ymax double"
    got = joins.bbox_join(spark.createDataFrame(a, fields("a")).coalesce(1), spark.createDataFrame(b, fields("b")).coalesce(1), "a", "b", 4.0).select("aid", "bid")
    want = [(p[0], q[0]) for p in a for q in b if None not in p + q and p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]]
    assert rows(got) == sorted(want, key=repr) and most_in_a_task(got) < 0.5


def test_range_join_deals_a_crowded_cell_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 16, raising=False)
    monkeypatch.setattr(joins, "TASK_PAIRS", 3000, raising=False)
    rnd = random.Random(6)
    pts = [(i, rnd.choice([1.0, rnd.uniform(0, 3)])) for i in range(300)] + [(900, None), (0, 1.0), (0, 1.0)]
    ivs = [(i, a, a + rnd.choice([0.0, 1.0, 2.0])) for i, a in enumerate(rnd.uniform(0, 2) for _ in range(300))] + [(900, None, 2.0), (0, 1.0, 1.0), (0, 1.0, 1.0)]
    p, v = spark.createDataFrame(pts, "i int, x double").coalesce(1), spark.createDataFrame(ivs, "j int, lo double, hi double").coalesce(1)
    got = joins.range_join(p, "x", v, "lo", "hi", 4.0).select("i", "j")
    want = [(i, j) for i, x in pts for j, lo, hi in ivs if None not in (x, lo) and lo <= x <= hi]
    assert rows(got) == sorted(want, key=repr) and most_in_a_task(got) < 0.5


@pytest.mark.parametrize("route", ["ordinary", "hot"])
def test_range_join_counts_without_pairs(spark, request, route):
    if route == "hot":
        request.getfixturevalue("all_hot")
    nan, inf = float("nan"), float("inf")
    at = [0.0, -0.0, 1.0, 1.0, 2.5, nan, nan, inf, -inf, None]
    ivs = [(1, 0.0, 1.0), (2, -0.0, 0.0), (3, 1.0, 1.0), (3, 1.0, 1.0), (4, 2.0, 1.0), (5, -inf, inf), (6, 2.0, nan), (7, 1.5, 2.0), (8, None, 9.0), (None, 1.0, 3.0)]
    rnd = random.Random(7)
    at += [float(rnd.randint(0, 60)) for _ in range(400)]
    ivs += [(100 + i, a, a + 2.0 ** (i % 7)) for i, a in enumerate(float(rnd.randint(0, 60)) for _ in range(90))]
    p, v = spark.createDataFrame([(x,) for x in at], "x double"), spark.createDataFrame(ivs, "j int, lo double, hi double")
    plain = p.crossJoin(v).where(F.col("x").between(F.col("lo"), F.col("hi")))
    got = joins.range_join(p, "x", v, "lo", "hi", how="count").groupBy("j").agg(F.sum("n").alias("n"))
    assert rows(got) == rows(plain.groupBy("j").count())
    # points of one value, and NaN among them, are looked up whole
    hit = plain.select("x").distinct()
    assert joins.range_join(p, "x", v, "lo", "hi", how="left_semi").count() == p.join(hit, "x", "left_semi").count()
    assert joins.range_join(p, "x", v, "lo", "hi", how="left_anti").count() == p.join(hit, "x", "left_anti").count()
