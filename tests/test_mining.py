"""The mining operators against worked-out logs, against plain-Python definitions on random
logs, and against each other. Every test runs on the ordinary and on the hot route."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventloom.operators import recurrent as rec
from eventloom.operators.controller import controller
from eventloom.operators.dfg import dfg
from eventloom.operators.follows import directly_follows, follows_by_sequence, weakly_follows
from eventloom.operators.log import as_log, log_quality, profile_log, rescale_time
from eventloom.operators.rules import Rule, check_rules, occurrence_matrix, rules_from_text


@pytest.fixture(params=["ordinary", "hot"])
def route(request):
    if request.param == "hot":
        request.getfixturevalue("all_hot")
    return request.param


def hours(spark, *cases):
    """Each case is a text of label@hour."""
    rows, k = [], 0
    for i, text in enumerate(cases, 1):
        for e in text.split():
            label, hour = e.split("@")
            rows.append((i, label, datetime(2020, 1, 1) + timedelta(hours=int(hour)), k))
            k += 1
    df = spark.createDataFrame(rows, "case_id int, event string, end_time timestamp_ntz, k int")
    return as_log(df, "case_id", "event", "end_time", "k")


# Logs and the relation each must give.
FIXTURES = {
    "A": (["A@1 B@2 C@3"], "AB BC"),
    "B": (["A@1 B@2 C@3", "A@1 B@2 D@3"], "AB BC BD"),
    "C": (["A@1 B@2 C@2 D@3 E@3 F@4"], "AB AC BD BE CD CE DF EF"),
    "D": (["A@1 B@1 C@2 D@3 E@3"], "AC BC CD CE"),
    "E": (["A@1 B@2 B@2 C@3"], "AB BC"),
    "F": (["A@1 B@2 E@3", "A@1 D@2 E@3", "A@1 D@2 E@3", "A@1 B@2 E@3", "A@1 B@2 E@3", "A@1 C@2 E@3"], "AB AC AD BE CE DE"),
    "G": ([], ""),
    "H": (["A@1"], ""),
}


@pytest.mark.parametrize("name", FIXTURES)
def test_weakly_follows(spark, route, name):
    cases, want = FIXTURES[name]
    got = weakly_follows(hours(spark, *cases)).collect()
    assert sorted(r.event_label_p + r.event_label_s for r in got) == want.split()


def bag(df):
    return {(r.event_label_p, r.event_label_s): r.frequency for r in df.collect()}


def test_directly_follows_counts_combinations(spark, route):
    assert bag(directly_follows(hours(spark, *FIXTURES["E"][0]))) == {("A", "B"): 2, ("B", "C"): 2}
    assert set(bag(directly_follows(hours(spark, *FIXTURES["C"][0]))).values()) == {1}
    assert bag(directly_follows(hours(spark, *FIXTURES["F"][0]))) == {
        ("A", "B"): 3, ("A", "D"): 2, ("A", "C"): 1, ("B", "E"): 3, ("D", "E"): 2, ("C", "E"): 1}


def test_graph_endpoints(spark, route):
    assert bag(dfg(hours(spark, "A@1 B@2 C@3"))) == {("START", "A"): 1, ("A", "B"): 1, ("B", "C"): 1, ("C", "END"): 1}
    assert bag(dfg(hours(spark, "A@1"))) == {("START", "A"): 1, ("A", "END"): 1}
    assert bag(dfg(hours(spark, "A@1"), start_for_singletons=False)) == {("A", "END"): 1}
    assert bag(dfg(hours(spark, "A@1 B@1"))) == {("START", "A"): 1, ("A", "B"): 1, ("B", "END"): 1}


def test_controller_worked_example(spark, route):
    log = hours(spark, "A@1 B@2 A@3 A@4 C@5", "A@1 C@2")
    got = defaultdict(set)
    for r in controller(log).collect():
        got[r.type].add(f"{r.event_label_p},{r.event_label_s},{r.frequency}")
    assert got == {
        "OCCURRENCE": {"A,A,4", "B,B,1", "C,C,2"}, "NO FOLLOWING": {"A,B,3", "C,A,2", "C,B,2"},
        "NO PRECEDING": {"A,B,2", "A,C,4", "B,C,1", "C,B,1"}, "NO COOCCURRING": {"A,B,1", "C,B,1"},
        "DIRECTLY FOLLOWS": {"A,B,1", "B,A,1", "A,A,1", "A,C,2"}, "REPETITION": {"A,C,2"}, "REPETITION BACK": {"A,B,1"}}


def test_controller_of_one_event(spark, route):
    assert [tuple(r) for r in controller(hours(spark, "A@1")).collect()] == [("OCCURRENCE", "A", "A", 1)]


def random_log(seed, cases=12, length=14, labels="ABCDE", spread=9):
    rnd = random.Random(seed)
    rows, k = [], 0
    for case in range(cases):
        for _ in range(rnd.randint(1, length)):
            rows.append((case if case else None, rnd.choice(labels), rnd.randint(0, spread), k))
            k += 1
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return as_log(spark.createDataFrame(rows, "c int, l string, t bigint, k int"), "c", "l", "t", "k")


def traces(rows):
    by = defaultdict(list)
    for c, l, t, k in rows:
        by[c].append((t, k, l))
    return {c: sorted(v) for c, v in by.items()}


@pytest.mark.parametrize("seed", range(3))
def test_relations_by_definition(spark, route, seed):
    rows = random_log(seed)
    batches, steps = Counter(), Counter()
    for trace in traces(rows).values():
        times = sorted({t for t, _, _ in trace})
        for a, b in zip(times, times[1:]):
            for p in (l for t, _, l in trace if t == a):
                for s in (l for t, _, l in trace if t == b):
                    batches[p, s] += 1
        seq = ["START", *[l for _, _, l in trace], "END"]
        steps.update(zip(seq, seq[1:]))
    log = frame(spark, rows)
    assert bag(directly_follows(log)) == batches
    assert {tuple(r) for r in weakly_follows(log).collect()} == set(batches)
    graph = bag(dfg(log))
    assert graph == steps
    cases = len(traces(rows))
    assert sum(n for (p, _), n in graph.items() if p == "START") == cases == sum(n for (_, s), n in graph.items() if s == "END")


@pytest.mark.parametrize("columns", [64, 2], ids=["label-columns", "label-join"])
@pytest.mark.parametrize("seed", range(2))
def test_controller_by_definition(spark, route, seed, columns, monkeypatch):
    from eventloom.operators import controller as module
    monkeypatch.setattr(module, "MAX_LABEL_COLUMNS", columns)
    rows = random_log(seed + 50)
    labels = sorted({r[1] for r in rows})
    want = Counter()
    for trace in traces(rows).values():
        seq = [l for _, _, l in trace]
        for i, x in enumerate(seq):
            want["OCCURRENCE", x, x] += 1
            if i + 1 < len(seq):
                want["DIRECTLY FOLLOWS", x, seq[i + 1]] += 1
            for y in labels:
                if y == x:
                    continue
                want["NO FOLLOWING", x, y] += y not in seq[i + 1:]
                want["NO PRECEDING", x, y] += y not in seq[:i]
                want["NO COOCCURRING", x, y] += y not in seq
                later, earlier = [l for l in seq[i + 1:] if l in (x, y)], [l for l in seq[:i] if l in (x, y)]
                want["REPETITION", x, y] += bool(later) and later[0] == x and y in later
                want["REPETITION BACK", x, y] += bool(earlier) and earlier[-1] == x and y in earlier
    got = {(r.type, r.event_label_p, r.event_label_s): r.frequency for r in controller(frame(spark, rows)).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_null_labels_stay_and_null_times_go(spark, route):
    rows = [(1, "A", 1, 0), (1, None, 2, 1), (1, "C", 3, 2), (1, "X", None, 3)]
    log = frame(spark, rows)
    assert {tuple(r) for r in weakly_follows(log).collect()} == {("A", None), (None, "C")}
    assert bag(dfg(log)) == {("START", "A"): 1, ("A", None): 1, (None, "C"): 1, ("C", "END"): 1}
    quality = log_quality(spark.createDataFrame(rows, "c int, l string, t bigint, k int"), "c", "l", "t").first()
    assert (quality.events, quality.no_timestamp, quality.no_label, quality.no_case) == (4, 1, 1, 0)


def test_less_than_a_millisecond_apart_is_simultaneous(spark, route):
    at = datetime(2024, 5, 1, 10, 0, 0, 1100)
    rows = [(1, "A", at), (1, "B", at + timedelta(microseconds=400)), (1, "C", at + timedelta(milliseconds=1))]
    log = as_log(spark.createDataFrame(rows, "c int, l string, t timestamp_ntz"), "c", "l", "t")
    assert {tuple(r) for r in weakly_follows(log).collect()} == {("A", "C"), ("B", "C")}


def test_many_ties_collapse(spark, route):
    ties = spark.range(20000).selectExpr("1 c", "if(id % 2 = 0, 'A', 'B') l", "5L t", "id k").union(
        spark.range(3).selectExpr("1 c", "'Z' l", "9L t", "id k"))
    assert bag(directly_follows(as_log(ties, "c", "l", "t", "k"))) == {("A", "Z"): 30000, ("B", "Z"): 30000}


def day_grain(spark):
    """A case that holds two thirds of a log whose times are days: most events are simultaneous."""
    return as_log(spark.range(60000).selectExpr(
        "if(id % 3 = 0, id % 3000, -1) c", "substr('ABCDEFG', cast(pmod(id * id, 7) as int) + 1, 1) l", "(id * 977 % 90) * 86400000L t", "id k"), "c", "l", "t", "k")


def test_one_case_holds_most_events(spark, monkeypatch):
    from eventloom.operators import sequence
    monkeypatch.setattr(sequence, "LARGE_ROWS", 5000)
    monkeypatch.setattr(sequence, "PART_ROWS", 3000)
    log = day_grain(spark)
    hot = sequence.hot_cases(log)
    assert [r[0].case.id for r in hot.keys.collect()] == [-1]
    rules = [Rule(1, ["A"], ["B"], {"B": 0}), Rule(2, ["A", "C"], ["D", "E"], {"E": 0, "D": 1}, 3)]
    for op in (directly_follows, dfg, controller, lambda log, hot: check_rules(log, rules, hot)):
        assert sorted(map(tuple, op(log, hot=hot).collect())) == sorted(map(tuple, op(log, hot=[]).collect()))


def test_parts_of_a_large_case_are_even(spark, monkeypatch):
    """40,000 events of one case on 90 days: a part holds a small share, so no task sees the case."""
    from eventloom.operators import sequence
    monkeypatch.setattr(sequence, "LARGE_ROWS", 5000)
    monkeypatch.setattr(sequence, "PART_ROWS", 3000)
    parts = sequence.with_parts(sequence.split_hot(day_grain(spark))[1], ["case", "ms", "tie"])
    rows = parts.groupBy("slice").agg(F.count(F.lit(1)), F.min(F.struct("ms", "tie")), F.max(F.struct("ms", "tie"))).orderBy("slice").collect()
    assert sum(r[1] for r in rows) == 40000 and max(r[1] for r in rows) <= 2 * 3000
    assert all(a[3] < b[2] for a, b in zip(rows, rows[1:]))


def test_filter_inside_and_outside_the_log_differ(spark):
    log = hours(spark, "A@1 B@2 C@3")
    assert bag(directly_follows(log).filter("event_label_p = 'A'")) == {("A", "B"): 1}
    assert bag(directly_follows(log.filter("label <> 'B'"))) == {("A", "C"): 1}


def test_pairs_by_position_column(spark):
    df = spark.createDataFrame([(1, "A", 1), (1, "B", 2), (1, "C", 4), (2, "A", 7), (2, "B", 8)], "c int, l string, s int")
    assert bag(follows_by_sequence(df, "c", "l", "s")) == {("A", "B"): 2}


def test_profile_and_rescaling(spark):
    df = spark.createDataFrame([(1, "A", 0), (1, "B", 86_400_000), (2, "A", 43_200_000)], "c int, l string, t bigint")
    assert tuple(profile_log(df, "c", "l").first()) == (3, 2, 2)
    assert sorted(r.scaled_ms for r in rescale_time(df, "t").collect()) == [0, 500, 1000]


# --- counting rules -----------------------------------------------------------------------

def test_first_violation_only(spark, route):
    rule = Rule(1, ["A"], ["B"], {"B": 0})
    got = check_rules(hours(spark, "A@1 B@2 B@3 B@4"), [rule]).collect()
    assert [tuple(r) for r in got] == [(1, 2, 1)]


def test_rules_from_text():
    rules = rules_from_text("1>>0=1;2>>0,0=1,2", "3>>2=0=1", "A=0;B=1;C=2", "1=2,1", "1=3")
    assert rules[0] == Rule(1, ["A"], ["B"], {"B": 1})
    assert rules[1] == Rule(2, ["A", "A"], ["B", "C"], {"B": 0})
    assert rules[2] == Rule(3, ["A"], ["B"], {"B": 0}, 2)
    assert rules[1].deltas() == {"A": 2, "B": -1, "C": -1}


@pytest.mark.parametrize("seed", range(3))
def test_rules_by_definition(spark, route, seed):
    rules = rules_from_text("1>>0=1;2>>0,1=2,3;5>>3,3=2", "4>>1=2=0;6>>2==4", "A=0;B=1;C=2;D=3;E=4", "1=1,2;2=2,5;3=2;0=5", "0=4;4=6,4")
    rows = random_log(seed + 90, cases=15, length=20)
    want = {}
    for case, trace in traces(rows).items():
        seen = Counter()
        for i, (_, _, label) in enumerate(trace):
            seen[label] += 1
            for kind in (0, 1):
                tried = sorted((r for r in rules if r.kind == kind and label in r.attached), key=lambda r: r.attached[label])
                bad = next((r for r in tried if sum(seen[x] for x in r.left) + (r.token or 0) < sum(seen[x] for x in r.right)), None)
                if bad:
                    want.setdefault((case, bad.rule_id), i)
                    break
    assert {(r.case_id, r.rule_id): r.idx for r in check_rules(frame(spark, rows), rules).collect()} == want


def test_occurrence_matrix(spark):
    got = occurrence_matrix(hours(spark, "A@1 B@2 A@3"), ["A", "B", "C"]).first()
    assert got.asDict() == {"case_id": 1, "A": 2, "B": 1, "C": 0, "lastindex": 2}


# --- sliding window -----------------------------------------------------------------------

def test_expiry_boundaries(spark, route):
    log = frame(spark, [(1, "A", 1000, 0), (1, "B", 2000, 1), (1, "C", 9000, 2)])
    state = rec.bootstrap(log, 7000)
    assert bag(state.dfr) == {("A", "B"): 1, ("B", "C"): 1}
    assert bag(rec.expire(state, 7999).dfr) == {("A", "B"): 1, ("B", "C"): 1}
    assert bag(rec.expire(state, 8000).dfr) == {("B", "C"): 1}
    assert bag(rec.expire(state, 9000).dfr) == {}
    assert [tuple(r) for r in state.start_event.collect()] == [(1, "A", 8000)]
    assert [tuple(r) for r in state.last_event.collect()] == [(1, "C", 16000)]
    # The oldest live event becomes the start event (divergence: not the newest).
    assert [tuple(r) for r in rec.expire(state, 8500).start_event.collect()] == [(1, "B", 9000)]


def test_period_includes_both_ends(spark):
    log = frame(spark, [(1, "A", 10, 0), (1, "B", 20, 1), (1, "C", 30, 2), (1, "D", 31, 3)])
    assert bag(rec.bootstrap(log, 5, 10, 30).dfr) == {("A", "B"): 1, ("B", "C"): 1}


def test_tasks_of_ordinary_cases_follow_the_rows(spark, monkeypatch):
    from eventloom.operators import sequence
    monkeypatch.setattr(sequence, "TASK_ROWS", 100, raising=False)
    events = spark.range(3000).select((F.col("id") % 500).alias("c"), (F.col("id") % 3).cast("string").alias("l"), F.col("id").alias("t"))
    log = as_log(events, "c", "l", "t")
    steps = sequence.neighbours(log, F.col("label")).withColumn("task", F.spark_partition_id())
    made = [r["count"] for r in steps.groupBy("task").count().collect()]
    assert sum(made) == 2500 and max(made) < 400
    # known to have no large case, the rows are counted all the same
    assert sequence.split_hot(log, [])[0].rdd.getNumPartitions() == 31
    assert sequence.split_hot(log.limit(0))[0].count() == 0
