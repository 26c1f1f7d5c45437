"""Streaming queries: the event table replayed in time order through the streaming
operators. Without expiry a replay has to give what the batch operator gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import recurrent as rec
from eventloom.operators.log import epoch_ms
from eventloom.plans.mining import (COUNT_PAIRS, DAY_MS, EVENTS, RULES, events_log, graph_sql, rules_sql)
from eventloom.plans.registry import query, table
from eventloom.session import scratch_path
from eventloom.streaming.conformance import ConformanceStream
from eventloom.streaming.recurrent import FollowsStream, sliding_counts
from eventloom.streaming.replay import replay, replay_stream

INTERVAL = 2 * DAY_MS
NOW_MS = 1_704_067_200_000 + 25 * DAY_MS


def _follows(spark, sf, expire=False, **kw):
    """A replay of the event table in time order."""
    events, path = table(spark, sf, "events"), scratch_path(spark, "replay")
    run = FollowsStream(spark, replay_stream(spark, path, events.schema), "user_id", "event_type", "ts", "event_id", INTERVAL, expire=expire, **kw)
    replay(events, "ts", path, run.run_available, 2)
    return run


def _out_of_order(spark, sf):
    """A replay in which every event arrives up to a day late; the stream allows for a day."""
    events, path = table(spark, sf, "events"), scratch_path(spark, "replay")
    delay = F.pmod(F.xxhash64("event_id"), F.lit(DAY_MS))
    late = events.withColumn("arrival", epoch_ms(events, "ts") + delay)
    run = FollowsStream(spark, replay_stream(spark, path, late.schema), "user_id", "event_type", "ts", "event_id", INTERVAL, expire=True, lateness_ms=DAY_MS)
    replay(late, "arrival", path, run.run_available, 2)
    return run.close()


LAG = f"SELECT *, lag(t) OVER (PARTITION BY c ORDER BY t, k) pt, lag(l) OVER (PARTITION BY c ORDER BY t, k) pl FROM ({EVENTS})"
PAIRS = f"""SELECT c AS caseid, pl AS event_label_p, l AS event_label_s, pt + {INTERVAL} AS delete_time_p, t + {INTERVAL} AS delete_time_s
FROM ({LAG}) WHERE pt IS NOT NULL"""

query("stream_relation", COUNT_PAIRS.format(PAIRS))(lambda s, d: _follows(s, d).snapshot().dfr)
query("stream_pairs", PAIRS)(lambda s, d: _follows(s, d).pairs())
query("stream_live_relation", COUNT_PAIRS.format(f"SELECT * FROM ({PAIRS}) WHERE delete_time_p > {NOW_MS}"))(
    lambda s, d: _follows(s, d).snapshot(NOW_MS).dfr)
query("stream_last_events", f"""SELECT c AS caseid, l AS event_label, t + {INTERVAL} AS delete_time FROM
(SELECT *, row_number() OVER (PARTITION BY c ORDER BY t DESC, k DESC) r FROM ({EVENTS})) WHERE r = 1""")(
    lambda s, d: _follows(s, d).last_events())
query("stream_graph_with_endpoints", graph_sql(EVENTS))(lambda s, d: _follows(s, d).graph())
query("stream_relation_with_expiry", COUNT_PAIRS.format(f"SELECT * FROM ({PAIRS}) WHERE delete_time_s < delete_time_p + {INTERVAL}"))(
    lambda s, d: _follows(s, d, expire=True).snapshot().dfr)
query("stream_starts_with_expiry", f"""SELECT c AS caseid, l AS event_label, t + {INTERVAL} AS delete_time FROM ({LAG})
WHERE pt IS NULL OR t >= pt + {INTERVAL}""")(lambda s, d: _follows(s, d, expire=True).starts())


query("stream_out_of_order_relation", COUNT_PAIRS.format(f"SELECT * FROM ({PAIRS}) WHERE delete_time_s < delete_time_p + {INTERVAL}"))(
    lambda s, d: _out_of_order(s, d).relation())
query("stream_out_of_order_starts", f"""SELECT c AS caseid, l AS event_label, t + {INTERVAL} AS delete_time FROM ({LAG})
WHERE pt IS NULL OR t >= pt + {INTERVAL}""")(lambda s, d: _out_of_order(s, d).starts())
query("stream_out_of_order_graph", f"""
WITH w AS (SELECT l, t, pl, pt, lead(t) OVER (PARTITION BY c ORDER BY t, k) nt FROM ({LAG})),
e AS (SELECT pl p, l s FROM w WHERE t < pt + {INTERVAL} UNION ALL SELECT 'START', l FROM w WHERE pt IS NULL OR t >= pt + {INTERVAL}
UNION ALL SELECT l, 'END' FROM w WHERE nt IS NULL OR nt >= t + {INTERVAL})
SELECT p AS event_label_p, s AS event_label_s, CAST(count(*) AS BIGINT) AS frequency FROM e GROUP BY 1, 2""")(
    lambda s, d: _out_of_order(s, d).graph())


@query("stream_rule_violations", rules_sql(EVENTS, RULES))
def _(spark, sf):
    events, path = table(spark, sf, "events"), scratch_path(spark, "replay")
    run = ConformanceStream(spark, replay_stream(spark, path, events.schema), "user_id", "event_type", "ts", "event_id", RULES)
    replay(events, "ts", path, run.run_available)
    return run.violations()


@query("sliding_window_relation", f"""
WITH p AS (SELECT pl, l, t FROM ({LAG}) WHERE pt IS NOT NULL),
w AS (SELECT pl, l, unnest(range(t // {DAY_MS} * {DAY_MS} - {DAY_MS}, t + 1, {DAY_MS})) ws, t FROM p)
SELECT ws AS window_start, pl AS event_label_p, l AS event_label_s, CAST(count(*) AS BIGINT) AS frequency
FROM w WHERE ws <= t AND t < ws + 2 * {DAY_MS} GROUP BY 1, 2, 3""")
def _(spark, sf):
    pairs = rec.bootstrap(events_log(spark, sf), 0).to_delete_event
    return sliding_counts(pairs, "delete_time_s", "2 days", "1 day")
