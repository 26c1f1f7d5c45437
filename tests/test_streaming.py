"""Replays against the batch operators, and the edges of expiry."""

from eventloom.operators import recurrent as rec
from eventloom.operators.dfg import dfg
from eventloom.operators.log import as_log
from eventloom.operators.rules import Rule, check_rules
from eventloom.session import scratch_path
from eventloom.streaming import maintained
from eventloom.streaming.conformance import ConformanceStream
from eventloom.streaming.maintained import Counts
from eventloom.streaming.recurrent import FollowsStream, sliding_counts
from eventloom.streaming.replay import replay, replay_stream

ROWS = [(1, "A", 1000, 0), (2, "A", 1500, 1), (1, "B", 2000, 2), (None, "A", 2500, 3), (1, "C", 9000, 4), (2, "A", 9100, 5), (2, "D", 9200, 6), (None, "B", 9300, 7)]
SCHEMA = "c int, l string, t bigint, k int"


def follow(spark, rows=ROWS, slices=3, **kw):
    df, path = spark.createDataFrame(rows, SCHEMA), scratch_path(spark, "replay")
    run = FollowsStream(spark, replay_stream(spark, path, df.schema), "c", "l", "t", "k", 7000, **kw)
    replay(df, "t", path, run.run_available, slices)
    return run


def bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_replay_equals_batch(spark):
    run, log = follow(spark), as_log(spark.createDataFrame(ROWS, SCHEMA), "c", "l", "t", "k")
    batch = rec.bootstrap(log, 7000)
    assert bag(run.snapshot().dfr) == bag(batch.dfr) and bag(run.pairs()) == bag(batch.to_delete_event)
    assert bag(run.last_events()) == bag(batch.last_event) and bag(run.starts()) == bag(batch.start_event)
    assert bag(run.graph()) == bag(dfg(log))
    assert bag(run.snapshot(8000).dfr) == bag(rec.expire(batch, 8000).dfr)


def test_nothing_new_changes_nothing(spark):
    run = follow(spark)
    before = bag(run.pairs())
    assert bag(run.run_available().pairs()) == before


def test_expired_last_event_opens_a_new_sequence(spark):
    run = follow(spark, [(1, "A", 1000, 0), (1, "B", 2000, 1), (1, "C", 9000, 2), (1, "D", 9500, 3)], expire=True)
    assert bag(run.snapshot().dfr) == [("A", "B", 1), ("C", "D", 1)]
    assert bag(run.starts()) == [(1, "A", 8000), (1, "C", 16000)]


def test_late_event_counts_as_newest(spark):
    df, path = spark.createDataFrame(ROWS[:1], SCHEMA), scratch_path(spark, "late")
    run = FollowsStream(spark, replay_stream(spark, path, df.schema), "c", "l", "t", "k", 7000)
    for i, row in enumerate([(1, "A", 5000, 0), (1, "B", 3000, 1)]):
        spark.createDataFrame([row], SCHEMA).write.parquet(f"{path}/slice={i}")
        run.run_available()
    assert bag(run.snapshot().dfr) == [("A", "B", 1)]


def out_of_order(rows, shift):
    """The rows with the time they arrive, up to ``shift`` ms late."""
    return [(c, l, t, k, t + (k * 7919) % (shift + 1)) for c, l, t, k in rows]


def test_out_of_order_with_expiry_and_a_restart(spark):
    """Each micro-batch meets a stream object of its own, as after a restart; the result is that of events in order."""
    rows = [((i * 31) % 5 or None, "ABCD"[i * i % 4], i * 700, i) for i in range(60)]
    late, path, root = out_of_order(rows, 3000), scratch_path(spark, "late"), scratch_path(spark, "root")
    df = spark.createDataFrame(late, SCHEMA + ", arrival bigint")
    make = lambda: FollowsStream(spark, replay_stream(spark, path, df.schema), "c", "l", "t", "k", 4000, expire=True, root=root, lateness_ms=3000)
    replay(df, "arrival", path, lambda: make().run_available(), 4)
    run = make().close()
    batch = rec.bootstrap(as_log(df, "c", "l", "t", "k"), 4000)
    live = [r for r in bag(batch.to_delete_event) if r[4] < r[3] + 4000]
    assert bag(run.pairs()) == live and run.too_late().count() == 0
    assert sum(r[2] for r in bag(run.relation())) == len(live)
    assert bag(run.last_events()) == bag(batch.last_event)
    # every sequence is closed once and opened once
    graph = bag(run.graph())
    assert sum(n for p, _, n in graph if p == "START") == sum(n for _, s, n in graph if s == "END") == run.starts().count() == 60 - len(live)
    # what is dead goes, what lives stays, and the counts do not change
    before, now = bag(run.relation()), 40_000
    alive = bag(run.snapshot(now).to_delete_event)
    assert run.vacuum(now) > 0 and bag(run.snapshot(now).to_delete_event) == alive and bag(run.relation()) == before


def test_events_behind_the_clock_are_set_apart(spark):
    path = scratch_path(spark, "late")
    df = spark.createDataFrame(ROWS[:1], SCHEMA)
    run = FollowsStream(spark, replay_stream(spark, path, df.schema), "c", "l", "t", "k", 7000, lateness_ms=1000)
    for i, rows in enumerate([[(1, "A", 5000, 0), (1, "B", 5500, 1)], [(1, "C", 9000, 2), (1, "X", 4400, 3), (1, "D", 4600, 4)], []]):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/slice={i}")
        run.run_available()
    run.close()
    assert bag(run.relation()) == [("A", "B", 1), ("B", "C", 1), ("D", "A", 1)]
    assert [(r.label, r.ms) for r in run.too_late().collect()] == [("X", 4400)]


def test_late_event_with_expiry_in_arrival_order(spark):
    path = scratch_path(spark, "late")
    df = spark.createDataFrame(ROWS[:1], SCHEMA)
    run = FollowsStream(spark, replay_stream(spark, path, df.schema), "c", "l", "t", "k", 7000, expire=True)
    for i, row in enumerate([(1, "A", 50_000, 0), (1, "B", 3000, 1), (1, "C", 4000, 2), (1, "D", 90_000, 3)]):
        spark.createDataFrame([row], SCHEMA).write.parquet(f"{path}/slice={i}")
        run.run_available()
    # once B is taken as the newest it is already out of the window
    assert bag(run.relation()) == [("A", "B", 1)] and sorted(r.event_label for r in run.starts().collect()) == ["A", "C", "D"]


def test_counts_read_a_bounded_number_of_folders(spark, monkeypatch):
    monkeypatch.setattr(maintained, "FAN", 2)
    counts = Counts(spark, scratch_path(spark, "counts"), spark.createDataFrame([], "k string").schema)
    most = 0
    for batch in range(8):
        for _ in range(1 + batch % 2):  # every other micro-batch is replayed
            counts.add(batch, spark.createDataFrame([("a", 1), (None, 2), ("b", 1), ("b", -1)], "k string, n bigint").coalesce(1))
        most = max(most, counts.folders())
    assert most <= 3 and bag(counts.read()) == [("a", 8), (None, 16)]


def test_rules_across_micro_batches(spark):
    df, path = spark.createDataFrame([(1, "A", 1, 0), (1, "B", 2, 1), (1, "X", 3, 2), (1, "B", 4, 3), (1, "B", 9, 4), (None, "B", 9, 5)], SCHEMA), scratch_path(spark, "r")
    rules = [Rule(7, ["A"], ["B"], {"B": 0}), Rule(8, ["A"], ["B"], {"B": 0}, 1)]
    run = ConformanceStream(spark, replay_stream(spark, path, df.schema), "c", "l", "t", "k", rules)
    replay(df, "t", path, run.run_available, 3)
    assert bag(run.violations()) == [(1, 3, 7), (None, 0, 7)]
    assert bag(run.violations()) == bag(check_rules(as_log(df, "c", "l", "t", "k"), rules))


def test_sliding_window_on_a_stream(spark):
    df, path = spark.createDataFrame([("A", "B", 0), ("A", "B", 2500), ("A", "B", 5000)], "event_label_p string, event_label_s string, t bigint"), scratch_path(spark, "w")
    df.write.parquet(path)
    q = (sliding_counts(spark.readStream.schema(df.schema).parquet(path), "t", "4 seconds", "2 seconds", "1 second")
         .writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start())
    q.awaitTermination()
    assert bag(spark.table("windows").select("window_start", "frequency")) == [(-2000, 1), (0, 2), (2000, 2), (4000, 1)]


def test_groups_are_worked_without_frames(monkeypatch):
    """A group has a row or two: joining and sorting frames would cost more than all else."""
    import pandas as pd
    from eventloom.streaming import conformance, recurrent

    class State:
        hasTimedOut = exists = False

        def update(self, value):
            self.get, self.exists = value, True

    monkeypatch.setattr(pd, "concat", None)
    ends = pd.DataFrame([(7, "C", 2**53 + 1, None, 2**53 + 2, 1), (7, "A", 1, "B", 2, 0)], columns=["case_id", "head", "head_ms", "tail", "tail_ms", "batch"])
    state, stitch = State(), recurrent._stitcher(100, False)
    (out,) = stitch((7,), iter([ends]), state)
    assert list(out.itertuples(index=False, name=None)) == [(7, "start", None, None, "A", 1), (7, "pair", "B", 2, "C", 2**53 + 1)]
    assert state.get == (None, 2**53 + 2, 1) and list(stitch((7,), iter([ends]), state)) == []
    state = State()
    sums = pd.DataFrame({"case_id": [7, 7], "totals": [[1, -1], [2, 0]], "events": [3, 4], "batch": [1, 0]})
    (out,) = conformance._carry_totals((7,), iter([sums]), state)
    assert out.values.tolist() == [[7, [0, 0], 0, 0], [7, [2, 0], 4, 1]] and state.get == ([3, -1], 7, 1)
    state = State()
    found = [pd.DataFrame({"idx": [5, 2, 9], "rule_id": [1, 1, 3]}), pd.DataFrame({"idx": [1], "rule_id": [3]})]
    (out,) = conformance._only_new((7,), iter(found), state)
    assert out.values.tolist() == [[7, 1, 3], [7, 2, 1]] and state.get == ([1, 3],) and list(conformance._only_new((7,), iter(found), state)) == []
