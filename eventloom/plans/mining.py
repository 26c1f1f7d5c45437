"""Mining queries: ``events`` by user, ``orders`` by customer (day granularity, so many
ties), ``lineitem`` by order and ``conversations`` by turn, each as an event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import controller as ctl
from eventloom.operators import recurrent as rec
from eventloom.operators.dfg import dfg
from eventloom.operators.follows import directly_follows, follows_by_sequence, weakly_follows
from eventloom.operators.log import as_log, log_quality, profile_log, rescale_time
from eventloom.operators.rules import Rule, check_rules, occurrence_matrix, rules_from_text
from eventloom.plans.registry import query, table

DAY_MS = 86_400_000


def events_log(spark, sf):
    return as_log(table(spark, sf, "events"), "user_id", "event_type", "ts", "event_id")


def orders_log(spark, sf):
    return as_log(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey")


def lineitem_log(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("flags", F.concat("l_returnflag", "l_linestatus"))
    return as_log(li, "l_orderkey", "flags", "l_shipdate", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


def conversations_log(spark, sf):
    return as_log(table(spark, sf, "conversations"), "conv_id", "role", "turn")


def daily_events_log(spark, sf):
    """Events with their time cut to the day: large batches of simultaneous events."""
    ev = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return as_log(ev, "user_id", "event_type", "day", "event_id")


# SQL for the same logs: case c, label l, time t (ms), tiebreak k.
EVENTS = "SELECT user_id c, event_type l, epoch_us(ts) // 1000 t, event_id k FROM events"
DAILY = "SELECT user_id c, event_type l, epoch_us(date_trunc('day', ts)::TIMESTAMP) // 1000 t, event_id k FROM events"
ORDERS = "SELECT o_custkey c, o_orderpriority l, epoch_us(o_orderdate) // 1000 t, o_orderkey k FROM orders"
LINEITEM = ("SELECT l_orderkey c, l_returnflag || l_linestatus l, epoch_us(l_shipdate) // 1000 t, "
            "(l_linenumber, l_partkey, l_suppkey, l_extendedprice) k FROM lineitem")
TALKS = "SELECT conv_id c, role l, turn t, role k FROM conversations"


def batch_sql(source: str, distinct: bool) -> str:
    head = (f"WITH log AS ({source}), b AS (SELECT c, l, dense_rank() OVER (PARTITION BY c ORDER BY t) b FROM log) ")
    if distinct:
        return head + ("SELECT DISTINCT x.l AS event_label_p, y.l AS event_label_s FROM b x JOIN b y "
                       "ON x.c IS NOT DISTINCT FROM y.c AND y.b = x.b + 1")
    return head + ("SELECT x.l AS event_label_p, y.l AS event_label_s, CAST(count(*) AS BIGINT) AS frequency FROM b x JOIN b y "
                   "ON x.c IS NOT DISTINCT FROM y.c AND y.b = x.b + 1 GROUP BY 1, 2")


def not_exists_sql(source: str, distinct: bool) -> str:
    """The relation as a nested query: a later event with no event in between."""
    out = "SELECT DISTINCT a.l AS event_label_p, b.l AS event_label_s" if distinct else \
        "SELECT a.l AS event_label_p, b.l AS event_label_s, CAST(count(*) AS BIGINT) AS frequency"
    return (f"WITH log AS ({source}) {out} FROM log a JOIN log b ON a.c = b.c AND a.t < b.t WHERE NOT EXISTS "
            "(SELECT 1 FROM log m WHERE m.c = a.c AND m.t > a.t AND m.t < b.t)" + ("" if distinct else " GROUP BY 1, 2"))


def graph_sql(source: str, endpoints: bool = True, singles: bool = True, start="START", end="END") -> str:
    parts = ["SELECT l p, nx s FROM w WHERE nx_t IS NOT NULL"]
    if endpoints:
        parts += [f"SELECT '{start}' p, l s FROM w WHERE pv_t IS NULL" + ("" if singles else " AND nx_t IS NOT NULL"),
                  f"SELECT l p, '{end}' s FROM w WHERE nx_t IS NULL"]
    return (f"WITH log AS ({source}), w AS (SELECT l, lead(l) OVER q nx, lead(t) OVER q nx_t, lag(t) OVER q pv_t FROM log "
            "WINDOW q AS (PARTITION BY c ORDER BY t, k)), pairs AS (" + " UNION ALL ".join(parts) + ") "
            "SELECT p AS event_label_p, s AS event_label_s, CAST(count(*) AS BIGINT) AS frequency FROM pairs GROUP BY 1, 2")


def controller_sql(source: str) -> str:
    """From the definitions, event by event."""
    return f"""
WITH log AS ({source}),
e AS (SELECT c, l x, row_number() OVER (PARTITION BY c ORDER BY t, k) pos FROM log WHERE l IS NOT NULL),
labels AS (SELECT DISTINCT x y FROM e),
g AS (SELECT e.c, e.x, e.pos, y FROM e JOIN labels ON y <> x),
yp AS (SELECT c, x y, min(pos) f, max(pos) l FROM e GROUP BY 1, 2),
r AS (SELECT g.x, g.y, g.pos, yp.f, yp.l FROM g LEFT JOIN yp ON yp.c = g.c AND yp.y = g.y),
two AS (SELECT e.c, e.pos, e.x, y FROM e JOIN yp ON yp.c = e.c AND yp.y <> e.x),
n AS (SELECT x, y, lead(x) OVER w nx, lag(x) OVER w pv, count_if(x = hi) OVER later hi_after, count_if(x = lo) OVER later lo_after,
             count_if(x = hi) OVER earlier hi_before, count_if(x = lo) OVER earlier lo_before, x = lo is_lo
      FROM (SELECT *, least(x, y) lo, greatest(x, y) hi FROM two)
      WINDOW w AS (PARTITION BY c, lo, hi ORDER BY pos),
             later AS (PARTITION BY c, lo, hi ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
             earlier AS (PARTITION BY c, lo, hi ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
steps AS (SELECT x, lead(x) OVER (PARTITION BY c ORDER BY pos) s, lead(pos) OVER (PARTITION BY c ORDER BY pos) sp FROM e),
u AS (
SELECT 'OCCURRENCE' AS type, x p, x s, count(*) f FROM e GROUP BY x
UNION ALL SELECT 'NO FOLLOWING', x, y, count_if(l IS NULL OR l < pos) FROM r GROUP BY x, y
UNION ALL SELECT 'NO PRECEDING', x, y, count_if(f IS NULL OR f > pos) FROM r GROUP BY x, y
UNION ALL SELECT 'NO COOCCURRING', x, y, count_if(l IS NULL) FROM r GROUP BY x, y
UNION ALL SELECT 'DIRECTLY FOLLOWS', x, s, count(*) FROM steps WHERE sp IS NOT NULL GROUP BY x, s
UNION ALL SELECT 'REPETITION', x, y, count_if(nx = x AND CASE WHEN is_lo THEN hi_after ELSE lo_after END > 0) FROM n GROUP BY x, y
UNION ALL SELECT 'REPETITION BACK', x, y, count_if(pv = x AND CASE WHEN is_lo THEN hi_before ELSE lo_before END > 0) FROM n GROUP BY x, y)
SELECT type, p AS event_label_p, s AS event_label_s, CAST(f AS BIGINT) AS frequency FROM u WHERE f <> 0"""


LOGS = {"events": (events_log, EVENTS), "orders": (orders_log, ORDERS), "lineitem": (lineitem_log, LINEITEM),
        "conversations": (conversations_log, TALKS), "daily_events": (daily_events_log, DAILY)}


def parts_log(spark, sf):
    """Line items of an order as a log with hundreds of labels: the parts, in groups."""
    li = table(spark, sf, "lineitem").withColumn("part", F.concat(F.lit("P"), F.col("l_partkey") % 400))
    return as_log(li, "l_orderkey", "part", "l_shipdate", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


PARTS = ("SELECT l_orderkey c, 'P' || (l_partkey % 400) l, epoch_us(l_shipdate) // 1000 t, "
         "(l_linenumber, l_partkey, l_suppkey, l_extendedprice) k FROM lineitem")


def _register():
    for name, (log, src) in LOGS.items():
        query(f"weakly_follows_{name}", batch_sql(src, True))(lambda s, d, log=log: weakly_follows(log(s, d)))
        query(f"directly_follows_{name}", batch_sql(src, False))(lambda s, d, log=log: directly_follows(log(s, d)))
        query(f"follows_graph_{name}", graph_sql(src))(lambda s, d, log=log: dfg(log(s, d)))
        query(f"controller_{name}", controller_sql(src))(lambda s, d, log=log: ctl.controller(log(s, d)))
    for kind in (ctl.OCCURRENCE, ctl.NO_FOLLOWING, ctl.NO_PRECEDING, ctl.NO_COOCCURRING, ctl.DIRECTLY_FOLLOWS,
                 ctl.REPETITION, ctl.REPETITION_BACK):
        query("controller_" + kind.lower().replace(" ", "_"),
              f"SELECT * FROM ({controller_sql(EVENTS)}) WHERE type = '{kind}'")(
            lambda s, d, kind=kind: ctl.controller(events_log(s, d)).filter(F.col("type") == kind))


_register()
query("controller_many_labels", controller_sql(PARTS))(lambda s, d: ctl.controller(parts_log(s, d)))


@query("follows_graph_no_start_for_singletons", graph_sql(DAILY.replace("user_id c", "event_id % 7919 c"), singles=False))
def _(spark, sf):
    ev = table(spark, sf, "events").withColumn("day", F.to_date("ts")).withColumn("c", F.col("event_id") % 7919)
    return dfg(as_log(ev, "c", "event_type", "day", "event_id"), start_for_singletons=False)


@query("follows_graph_without_endpoints", graph_sql(EVENTS, endpoints=False))
def _(spark, sf):
    return dfg(events_log(spark, sf), with_endpoints=False)


@query("sorted_log_pairs", graph_sql(LINEITEM, start="start", end="end"))
def _(spark, sf):
    return dfg(lineitem_log(spark, sf), start="start", end="end")


@query("weakly_follows_nested_query", not_exists_sql(DAILY, True))
def _(spark, sf):
    return weakly_follows(daily_events_log(spark, sf))


@query("directly_follows_nested_query", not_exists_sql(ORDERS, False))
def _(spark, sf):
    return directly_follows(orders_log(spark, sf))


@query("follows_by_sequence_column", """
SELECT a.role AS event_label_p, b.role AS event_label_s, CAST(count(*) AS BIGINT) AS frequency
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn - 1 GROUP BY 1, 2""")
def _(spark, sf):
    return follows_by_sequence(table(spark, sf, "conversations"), "conv_id", "role", "turn")


@query("relation_filter_above_log", f"SELECT * FROM ({batch_sql(EVENTS, False)}) WHERE event_label_p = 'view'")
def _(spark, sf):
    return directly_follows(events_log(spark, sf)).filter(F.col("event_label_p") == "view")


@query("relation_filter_inside_log", batch_sql(EVENTS + " WHERE event_type <> 'error'", False))
def _(spark, sf):
    return directly_follows(events_log(spark, sf).filter(F.col("label") != "error"))


@query("log_profile", """SELECT CAST(count(*) AS BIGINT) AS events, CAST(count(DISTINCT user_id) AS BIGINT) AS cases,
CAST(count(DISTINCT event_type) AS BIGINT) AS event_types FROM events""")
def _(spark, sf):
    return profile_log(table(spark, sf, "events"), "user_id", "event_type")


@query("log_quality", """SELECT CAST(count(*) AS BIGINT) AS events, CAST(count_if(ts IS NULL) AS BIGINT) AS no_timestamp,
CAST(count_if(event_type IS NULL) AS BIGINT) AS no_label, CAST(count_if(user_id IS NULL) AS BIGINT) AS no_case FROM events""")
def _(spark, sf):
    return log_quality(table(spark, sf, "events"), "user_id", "event_type", "ts")


ORIGIN_MS = 1_704_067_200_000  # 2024-01-01


@query("rescaled_time", f"""SELECT event_id, (epoch_us(ts) // 1000 - {ORIGIN_MS}) * 1000 // 86400000 AS scaled_ms FROM events""")
def _(spark, sf):
    return rescale_time(table(spark, sf, "events"), "ts", ORIGIN_MS).select("event_id", "scaled_ms")


# --- sliding window, batch side -------------------------------------------------------

INTERVAL = 3 * DAY_MS
FROM_MS, TO_MS, NOW_MS = ORIGIN_MS + 2 * DAY_MS, ORIGIN_MS + 20 * DAY_MS, ORIGIN_MS + 19 * DAY_MS

PERIOD = f"SELECT * FROM ({EVENTS}) WHERE t >= {FROM_MS} AND t <= {TO_MS}"
PAIRS = f"""SELECT c AS caseid, l AS event_label_p, nx AS event_label_s, t + {INTERVAL} AS delete_time_p, nt + {INTERVAL} AS delete_time_s
FROM (SELECT c, l, t, lead(l) OVER w nx, lead(t) OVER w nt FROM ({PERIOD}) WINDOW w AS (PARTITION BY c ORDER BY t, k)) WHERE nt IS NOT NULL"""


def edge_sql(pick):
    return f"""SELECT c AS caseid, l AS event_label, t + {INTERVAL} AS delete_time FROM (SELECT c, l, t, row_number() OVER
(PARTITION BY c ORDER BY t {pick}, k {pick}) r FROM ({PERIOD})) WHERE r = 1"""


def _bootstrap(spark, sf):
    return rec.bootstrap(events_log(spark, sf), INTERVAL, FROM_MS, TO_MS)


COUNT_PAIRS = "SELECT event_label_p, event_label_s, CAST(count(*) AS BIGINT) AS frequency FROM ({}) GROUP BY 1, 2"

query("recurrent_relation", COUNT_PAIRS.format(PAIRS))(lambda s, d: _bootstrap(s, d).dfr)
query("recurrent_start_events", edge_sql(""))(lambda s, d: _bootstrap(s, d).start_event)
query("recurrent_last_events", edge_sql("DESC"))(lambda s, d: _bootstrap(s, d).last_event)
query("recurrent_pairs", PAIRS)(lambda s, d: _bootstrap(s, d).to_delete_event)
query("recurrent_live_relation", COUNT_PAIRS.format(f"SELECT * FROM ({PAIRS}) WHERE delete_time_p > {NOW_MS}"))(
    lambda s, d: rec.expire(_bootstrap(s, d), NOW_MS).dfr)
query("recurrent_live_last_events", f"SELECT * FROM ({edge_sql('DESC')}) WHERE delete_time > {NOW_MS}")(
    lambda s, d: rec.expire(_bootstrap(s, d), NOW_MS).last_event)
query("recurrent_live_start_events", f"""SELECT c AS caseid, l AS event_label, t + {INTERVAL} AS delete_time FROM
(SELECT c, l, t, row_number() OVER (PARTITION BY c ORDER BY t, l) r FROM ({PERIOD}) WHERE t + {INTERVAL} > {NOW_MS}) WHERE r = 1""")(
    lambda s, d: rec.expire(_bootstrap(s, d), NOW_MS).start_event)


# --- counting rules -------------------------------------------------------------------

RULES = rules_from_text(
    "1>>0=1;2>>0,1=2,3;3>>4=2", "4>>3=0=4;5>>10=1,2=0,3", "view=0;click=1;purchase=2;signup=3;error=4",
    "1=1;2=2,3;3=2", "4=4;0=5;3=5,4")


def rules_sql(source: str, rules: list[Rule]) -> str:
    """Running sums per rule, then the first failing rule of each event."""
    checks = []
    for r in rules:
        signed = " + ".join([f"(l = '{x}')::INT" for x in r.left] + [f"-((l = '{x}')::INT)" for x in r.right]) or "0"
        for label, place in r.attached.items():
            checks.append(f"SELECT c, pos, {r.kind} kind, {place} place, {r.rule_id} rule_id FROM "
                          f"(SELECT *, sum({signed}) OVER w bal FROM e WINDOW w AS (PARTITION BY c ORDER BY pos)) "
                          f"WHERE l = '{label}' AND bal + {r.token or 0} < 0")
    return (f"WITH log AS ({source}), e AS (SELECT c, l, row_number() OVER (PARTITION BY c ORDER BY t, k) - 1 pos FROM log), "
            "f AS (" + " UNION ALL ".join(checks) + "), "
            "first AS (SELECT *, row_number() OVER (PARTITION BY c, pos ORDER BY kind, place) r FROM f) "
            "SELECT c AS case_id, CAST(min(pos) AS BIGINT) AS idx, CAST(rule_id AS INTEGER) AS rule_id FROM first WHERE r = 1 GROUP BY c, rule_id")


@query("rule_violations", rules_sql(EVENTS, RULES))
def _(spark, sf):
    return check_rules(events_log(spark, sf), RULES)


LABELS = ["view", "click", "purchase", "signup", "error"]


@query("occurrence_matrix", "SELECT user_id AS case_id, " + ", ".join(
    f"CAST(count_if(event_type = '{l}') AS BIGINT) AS {l}" for l in LABELS)
    + ", CAST(count(*) - 1 AS BIGINT) AS lastindex FROM events GROUP BY 1")
def _(spark, sf):
    return occurrence_matrix(events_log(spark, sf), LABELS)
