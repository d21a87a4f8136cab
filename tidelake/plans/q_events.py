"""The event log, extension points and replays."""

from pyspark.sql import functions as F

from ..operators import dq, events as ev, registry
from .base import OBS, events, obs, q, r6
from .catalog import table
from .q_rules import payloads
from .q_windows import ALIGNED, CROSS, OBJ_SCHEMA, OBJECTIVES, ORDER, TRANS, aligned, long_metrics, packed, states




def detected(s, d, start=None, end=None, log=None):
    """The log without what a log of the days divisible by 5 has already, with the context of each hour."""
    goals = F.broadcast(s.createDataFrame(OBJECTIVES, OBJ_SCHEMA))  # the literal list
    found = ev.detect(states(s, d), long_metrics(s, d), goals, "user_id", "ts", "event_type", "event_id", start, end, aligned(s, d), ["value_mean", "k_mean"], log)
    return found.select("event_key", "user_id", "ts", F.col("event_type").alias("kind"), "detail", "metric_value", *packed(found))


def logged(s, d):
    goals = F.broadcast(s.createDataFrame(OBJECTIVES, OBJ_SCHEMA))
    return ev.detect(states(s, d), long_metrics(s, d), goals, "user_id", "ts", "event_type", "event_id").where("day(ts) % 5 = 0")


LOG = f"""SELECT sha256(concat_ws('|', epoch_us(ts)::VARCHAR, e.user_id::VARCHAR, kind, detail)) AS event_key, e.user_id, ts, kind, detail, metric_value, a.value_mean, a.k_mean,
CASE WHEN a.bucket IS NULL THEN 0 ELSE 2 END AS n_keys FROM (SELECT user_id, ts, 'state_transition' AS kind, from_state || '>' || coalesce(to_state, 'null') AS detail, NULL::DOUBLE AS metric_value
FROM ({TRANS}) WHERE is_actual_transition AND from_state IS NOT NULL UNION ALL SELECT user_id, ts, 'threshold_crossing', objective_id || ':' || crossing, value FROM ({CROSS})) e
LEFT JOIN {ALIGNED} a ON date_trunc('hour', e.ts) = a.bucket AND e.user_id = a.user_id"""
q("detect_events", lambda s, d: detected(s, d, log=logged(s, d)), f"SELECT * FROM ({LOG}) WHERE day(ts) % 5 > 0")
q("detect_events_range", lambda s, d: detected(s, d, "2024-01-10 00:00:00", "2024-01-12 00:00:00"), f"SELECT * FROM ({LOG}) WHERE ts BETWEEN '2024-01-10' AND '2024-01-12'")
q(
    "table_functions",
    lambda s, d: ev.crossings_since(long_metrics(s, d), F.broadcast(s.createDataFrame(OBJECTIVES, OBJ_SCHEMA)), "user_id", "ts", "event_id", "2024-01-25 00:00:00", ["k"]).select("event_id", "objective_id", "crossing"),
    f"SELECT event_id, objective_id, crossing FROM ({CROSS}) WHERE ts >= '2024-01-25' AND metric = 'k'",
)
q("feature_registry", lambda s, d: registry.add_features(events(s, d), [{"name": "lag", "field": "value", "lags": [2], "entity": "user_id", "order": ORDER}, {"name": "trend", "field": "value", "rows": 4, "entity": "user_id", "order": ORDER}])
  .select("event_id", "value_lag_2h", r6("value_trend").alias("value_trend")),
  "SELECT event_id, lag(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_lag_2h, round((last_value(value) OVER w - first_value(value) OVER w) / 4, 8) + 0 AS value_trend FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")


def parsed(s, d):
    """Two parsers by name over the same payloads: numbers at the top, and a column-oriented one."""
    rows = payloads(s, d)
    flat = registry.parse(rows, "flat_json", "payload", ["event_id"], {"location_field": "serialno", "skip": ["bootCount"]})
    fields = [{"path": "windSpeed", "metric": "wind", "scale": 2.0}]
    columns = registry.parse(rows, "column_oriented", "payload", ["event_id"], {"base": "properties", "fields": fields})
    return flat.select("event_id", "metric", r6("value").alias("value")).unionByName(columns.select("event_id", "metric", r6("value").alias("value")))


q("custom_parser", parsed, """SELECT event_id, 'pm02' AS metric, round(value, 8) + 0 AS value FROM events WHERE event_id % 9 > 0 AND event_id % 8 > 0
UNION ALL SELECT event_id, 'wind', 2 * CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events""")  # fmt: skip
q("recent_signals", lambda s, d: events(s, d).join(F.broadcast(events(s, d).agg(F.max("ts").alias("as_of"))), F.expr("ts >= as_of - INTERVAL 24 HOURS")).join(table(s, d, "customer"), F.col("user_id") == F.col("c_custkey"), "left").select("event_id", "c_name", "c_mktsegment"),
  "SELECT event_id, c_name, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS")
q("rate_of_change_dq", lambda s, d: obs(s, d).withColumn("flag", dq.rate_of_change("value", "ts", 0.5, "user_id", "event_id")).groupBy("user_id").agg(F.count("flag").alias("n")),
  f"SELECT user_id, count(*) FILTER (WHERE rate > 0.5) AS n FROM (SELECT user_id, abs(value - lag(value) OVER w) / nullif((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60e6, 0) AS rate FROM {OBS} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1")
