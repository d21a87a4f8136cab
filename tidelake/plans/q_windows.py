"""Window functions, sorting, set operations and joins."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import align, events as ev, features as ft
from .base import GAPPY, HOURLY, OBS, events, gappy, hourly, obs, q, r6
from .catalog import table

ORDER = ["ts", "event_id"]
EW = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


def pick(df, *columns, keys=("event_id",)):
    return df.select(*keys, *[r6(c).alias(c) for c in columns])


q("lag_features", lambda s, d: pick(ft.lag_features(obs(s, d), "value", [1, 6, 24], "user_id", ORDER), "value_lag_1h", "value_lag_6h", "value_lag_24h"),
  f"SELECT event_id, round(lag(value, 1) OVER w, 8) + 0 AS value_lag_1h, round(lag(value, 6) OVER w, 8) + 0 AS value_lag_6h, round(lag(value, 24) OVER w, 8) + 0 AS value_lag_24h FROM {OBS} {EW}")
q("lag_diff", lambda s, d: pick(ft.lag_features(obs(s, d), "value", [1, 6, 24], "user_id", ORDER, diff=True), "value_diff_1h", "value_diff_6h", "value_diff_24h"),
  f"SELECT event_id, round(value - lag(value, 1) OVER w, 8) + 0 AS value_diff_1h, round(value - lag(value, 6) OVER w, 8) + 0 AS value_diff_6h, round(value - lag(value, 24) OVER w, 8) + 0 AS value_diff_24h FROM {OBS} {EW}")
q("rolling_features", lambda s, d: pick(ft.rolling_features(obs(s, d), "value", 6, "user_id", ORDER), *[f"value_rolling_{m}_6" for m in ("mean", "std", "min", "max")]),
  f"SELECT event_id, round(avg(value) OVER w, 8) + 0 AS value_rolling_mean_6, round(stddev_samp(value) OVER w, 8) + 0 AS value_rolling_std_6, round(min(value) OVER w, 8) + 0 AS value_rolling_min_6, round(max(value) OVER w, 8) + 0 AS value_rolling_max_6 "
  f"FROM {OBS} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)")
q("trend_simple", lambda s, d: events(s, d).select("event_id", r6(ft.trend_simple("value", 6, "user_id", ORDER)).alias("trend")),
  "SELECT event_id, round((last_value(value) OVER w - first_value(value) OVER w) / 6, 8) + 0 AS trend FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)")


def full_window(s, d):
    m, sd = ft.rolling_full_window("value", 6, "user_id", ORDER)
    return events(s, d).select("event_id", F.round(m, 8).alias("m"), F.round(sd, 6).alias("sd"))


q("rolling_full_window", full_window, "SELECT event_id, CASE WHEN count(*) OVER w = 6 THEN round(avg(value) OVER w, 8) ELSE 'nan'::DOUBLE END AS m, CASE WHEN count(*) OVER w = 6 THEN round(stddev_pop(value) OVER w, 6) ELSE 'nan'::DOUBLE END AS sd "
  "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)")
q("lag_zero_fill", lambda s, d: events(s, d).select("event_id", F.lag("value", 3, 0.0).over(W.partitionBy("user_id").orderBy(*ORDER)).alias("lagged")), f"SELECT event_id, lag(value, 3, 0.0::DOUBLE) OVER w AS lagged FROM events {EW}")
q("null_preserve", lambda s, d: obs(s, d).select("event_id", "value"), f"SELECT event_id, value FROM {OBS}")
q("null_carry_forward", lambda s, d: gappy(s, d).select("event_type", "bucket", ft.carry_forward("v", "bucket", "event_type").alias("v")),
  f"SELECT event_type, bucket, coalesce(v, lag(v, 1) OVER w, lag(v, 2) OVER w, lag(v, 3) OVER w, lag(v, 4) OVER w, lag(v, 5) OVER w, lag(v, 6) OVER w) AS v FROM {GAPPY} WINDOW w AS (PARTITION BY event_type ORDER BY bucket)")
q("null_interpolate", lambda s, d: gappy(s, d).select("event_type", "bucket", r6(ft.interpolate("v", "bucket", "event_type")).alias("v")),
  f"SELECT event_type, bucket, round(coalesce(v, (lag(v) OVER w + lead(v) OVER w) / 2, lag(v) OVER w, lead(v) OVER w), 8) + 0 AS v FROM {GAPPY} WINDOW w AS (PARTITION BY event_type ORDER BY bucket)")

LABELS = {"view_to_click": "engaging", "click_to_purchase": "converting"}




STATE = "nullif(event_type, 'signup')"
TRANS = f"""SELECT event_id, user_id, ts, lag({STATE}) OVER w AS from_state, {STATE} AS to_state,
CAST(floor((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000) AS BIGINT) AS duration_ms,
lag({STATE}) OVER w IS NULL OR lag({STATE}) OVER w IS DISTINCT FROM {STATE} AS is_actual_transition,
CASE WHEN lag({STATE}) OVER w IS NULL THEN 'initial' WHEN lag({STATE}) OVER w = 'view' AND event_type = 'click' THEN 'engaging'
WHEN lag({STATE}) OVER w = 'click' AND event_type = 'purchase' THEN 'converting' ELSE 'unknown' END AS direction FROM events {EW}"""


def states(s, d):
    """Events whose type is a state; sign-ups are missing states."""
    return events(s, d).withColumn("event_type", F.expr("nullif(event_type, 'signup')"))


def transitions(s, d, labels=LABELS, two=None):
    found = ev.state_transitions(states(s, d), "user_id", "ts", "event_type", "event_id", labels, two)
    return found.select("event_id", "user_id", "ts", "from_state", "to_state", "duration_ms", "is_actual_transition", "direction")


q("state_transitions", transitions, TRANS)
q(
    "transition_direction_map",
    lambda s, d: transitions(s, d, None, ("click", "view")).select("event_id", F.col("direction").alias("two")).join(transitions(s, d, None).select("event_id", F.col("direction").alias("plain")), "event_id"),
    f"""SELECT event_id, CASE WHEN lag({STATE}) OVER w IS NULL THEN 'initial' WHEN lag({STATE}) OVER w = 'view' AND event_type = 'click' THEN 'activating'
    WHEN lag({STATE}) OVER w = 'click' AND event_type = 'view' THEN 'deactivating' ELSE 'unknown' END AS two,
    CASE WHEN lag({STATE}) OVER w IS NULL THEN 'initial' WHEN lag({STATE}) OVER w IS DISTINCT FROM {STATE} THEN 'changed' ELSE 'unchanged' END AS plain FROM events {EW}""",
)
q("actual_transitions", lambda s, d: transitions(s, d).where("is_actual_transition"), f"SELECT * FROM ({TRANS}) WHERE is_actual_transition")
q(
    "device_type",
    lambda s, d: table(s, d, "part").select("p_partkey", ev.device_type(F.col("p_type"), [("%BRASS%", "brass"), ("%STEEL%", "steel"), ("STANDARD%", "standard")]).alias("kind")),
    "SELECT p_partkey, CASE WHEN p_type LIKE '%BRASS%' THEN 'brass' WHEN p_type LIKE '%STEEL%' THEN 'steel' WHEN p_type LIKE 'STANDARD%' THEN 'standard' ELSE 'other' END AS kind FROM part",
)
q("validity_intervals", lambda s, d: ev.validity_intervals(events(s, d), "user_id", "ts", "event_id").select("event_id", "valid_from", "valid_to"), f"SELECT event_id, ts AS valid_from, lead(ts) OVER w AS valid_to FROM events {EW}")

OBJECTIVES = [
    ("value", "o1", ">=", 50.0, None),
    ("value", "o2", "<=", 20.0, None),
    ("value", "o3", "between", 30.0, 60.0),
    ("k", "o4", ">", 70.0, None),
    ("k", "o5", "<", 40.0, None),
]
OBJ_SCHEMA = "metric string, objective_id string, condition string, threshold double, threshold_upper double"
OBJ_SQL = """(VALUES ('value', 'o1', '>=', 50.0, NULL), ('value', 'o2', '<=', 20.0, NULL), ('value', 'o3', 'between', 30.0, 60.0),
('k', 'o4', '>', 70.0, NULL), ('k', 'o5', '<', 40.0, NULL)) o(metric, objective_id, condition, threshold, upper)"""


def long_metrics(s, d):
    e = events(s, d).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return e.unpivot(["event_id", "user_id", "ts"], ["value", "k"], "metric", "value")


LONG = "(SELECT event_id, user_id, ts, unnest(['value', 'k']) AS metric, unnest([value, CAST(json_extract_string(props, '$.k') AS DOUBLE)]) AS value FROM events)"




def crossings(s, d, simple=False):
    goals = F.broadcast(s.createDataFrame(OBJECTIVES, OBJ_SCHEMA))  # the literal list
    found = ev.threshold_crossings(long_metrics(s, d), goals, "user_id", "ts", "event_id", simple=simple)
    return found.select("event_id", "user_id", "ts", "objective_id", "metric", "threshold", "crossing", "value", "previous")


LAGGED = f"(SELECT *, lag(value) OVER (PARTITION BY user_id, metric ORDER BY ts, event_id) AS previous FROM {LONG})"
CROSS = f"""SELECT event_id, user_id, ts, objective_id, metric, threshold::DOUBLE AS threshold, crossing, value, previous FROM (SELECT *, CASE
WHEN condition = '<' THEN CASE WHEN previous < threshold AND value >= threshold THEN 'rising' WHEN previous >= threshold AND value < threshold THEN 'falling' END
WHEN condition = '<=' THEN CASE WHEN previous <= threshold AND value > threshold THEN 'rising' WHEN previous > threshold AND value <= threshold THEN 'falling' END
WHEN condition = '>' THEN CASE WHEN previous > threshold AND value <= threshold THEN 'rising' WHEN previous <= threshold AND value > threshold THEN 'falling' END
WHEN condition = '>=' THEN CASE WHEN previous >= threshold AND value < threshold THEN 'rising' WHEN previous < threshold AND value >= threshold THEN 'falling' END
WHEN condition = 'between' THEN CASE WHEN (previous < threshold OR previous > upper) AND value >= threshold AND value <= upper THEN 'entering_range'
WHEN previous BETWEEN threshold AND upper AND value < threshold THEN 'exiting_range_low' WHEN previous BETWEEN threshold AND upper AND value > upper THEN 'exiting_range_high' END
END AS crossing FROM {LAGGED} l JOIN {OBJ_SQL} USING (metric)) WHERE crossing IS NOT NULL"""
SIMPLE = f"""SELECT event_id, user_id, ts, objective_id, metric, threshold::DOUBLE AS threshold, CASE WHEN previous < threshold AND value >= threshold THEN 'rising' ELSE 'falling' END AS crossing, value, previous
FROM {LAGGED} l JOIN {OBJ_SQL} USING (metric) WHERE previous < threshold AND value >= threshold OR previous >= threshold AND value < threshold"""
q("threshold_crossings_conditions", crossings, CROSS)
q("threshold_crossings_simple", lambda s, d: crossings(s, d, True), SIMPLE)


def union_crossings(s, d):
    """Objective by objective, united: the same rows as one pass over all objectives."""
    found = None
    for goal in OBJECTIVES:
        own = ev.threshold_crossings(long_metrics(s, d), F.broadcast(s.createDataFrame([goal], OBJ_SCHEMA)), "user_id", "ts", "event_id")
        own = own.select("event_id", "objective_id", "crossing")
        found = own if found is None else found.unionByName(own)
    return found


q("union_crossings", union_crossings, f"SELECT event_id, objective_id, crossing FROM ({CROSS})")
q(
    "crossing_frequency",
    lambda s, d: ev.crossing_frequency(crossings(s, d), "user_id", "ts").withColumn("mean", r6("mean")),
    f"""SELECT date_trunc('day', ts) AS day, objective_id, metric, crossing, count(*) AS n, count(DISTINCT user_id) AS entities, round(avg(value), 8) + 0 AS mean,
    min(value) AS low, max(value) AS high FROM ({CROSS}) GROUP BY 1, 2, 3, 4""",
)
q(
    "crossing_oscillations",
    lambda s, d: ev.crossing_oscillations(crossings(s, d), "user_id", "ts", "event_id"),
    f"""SELECT date_trunc('day', ts) AS day, user_id, objective_id, metric, threshold, count(*) FILTER (WHERE gap < 3600e6) AS rapid_1h, count(*) FILTER (WHERE gap < 7200e6) AS rapid_2h,
    count(*) AS n, count(*) FILTER (WHERE gap < 3600e6 AND crossing <> before) AS oscillations FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER v) AS gap, lag(crossing) OVER v AS before
    FROM ({CROSS}) WINDOW v AS (PARTITION BY user_id, objective_id ORDER BY ts, event_id)) WHERE gap IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (WHERE gap < 7200e6) > 0""",
)


def aligned(s, d):
    """Hourly means of the values and of k side by side; hours with one row only have no k."""
    e = events(s, d).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    rows = e.groupBy(F.window("ts", "1 hour").start.alias("bucket"), "user_id").agg(F.round(F.avg("value"), 4).alias("value_mean"), F.round(F.avg("k"), 4).alias("k_mean"), F.count("*").alias("n"))
    return rows.where("n <> 2").select("bucket", "user_id", "value_mean", F.when(F.col("n") > 1, F.col("k_mean")).alias("k_mean"))


ALIGNED = """(SELECT * FROM (SELECT date_trunc('hour', ts) AS bucket, user_id, round(avg(value), 4) AS value_mean, CASE WHEN count(*) > 1 THEN round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 4) END AS k_mean,
count(*) AS n FROM events GROUP BY 1, 2) WHERE n <> 2)"""


def packed(found):
    return [F.get_json_object("context", f"$.{c}").cast("double").alias(c) for c in ("value_mean", "k_mean")] + [F.size(F.json_object_keys("context")).cast("long").alias("n_keys")]


q(
    "event_context",
    lambda s, d: ev.with_context(events(s, d), aligned(s, d), "ts", ["value_mean", "k_mean"], ["user_id"]).transform(lambda f: f.select("event_id", *packed(f))),
    f"""SELECT event_id, a.value_mean, a.k_mean, CASE WHEN a.bucket IS NULL THEN 0 ELSE 2 END AS n_keys FROM events e LEFT JOIN {ALIGNED} a
    ON date_trunc('hour', e.ts) = a.bucket AND e.user_id = a.user_id""",
)
q(
    "crossing_context",
    lambda s, d: ev.crossing_context(ev.with_context(crossings(s, d), aligned(s, d), "ts", ["value_mean", "k_mean"], ["user_id"]), ["value_mean", "k_mean"]).select(
        "objective_id", "metric", "crossing", "n", r6("avg_value_mean").alias("avg_value_mean"), r6("avg_k_mean").alias("avg_k_mean")
    ),
    f"""SELECT objective_id, metric, crossing, count(*) AS n, round(avg(value_mean), 8) + 0 AS avg_value_mean, round(avg(k_mean), 8) + 0 AS avg_k_mean FROM ({CROSS}) c LEFT JOIN {ALIGNED} a
    ON date_trunc('hour', c.ts) = a.bucket AND c.user_id = a.user_id GROUP BY 1, 2, 3""",
)
q(
    "trend_direction",
    lambda s, d: ft.with_trend(events(s, d), "value", "user_id", ORDER).select("event_id", "trend", r6("change").alias("change"), r6("rate_per_hour").alias("rate_per_hour")),
    f"""SELECT event_id, CASE WHEN value > 1.1::DOUBLE * lag(value, 4) OVER w THEN 'rising' WHEN value < 0.9::DOUBLE * lag(value, 4) OVER w THEN 'falling' ELSE 'stable' END AS trend,
    round(value - lag(value, 4) OVER w, 8) + 0 AS change, round((value - lag(value, 4) OVER w) / 4, 8) + 0 AS rate_per_hour FROM events {EW}""",
)
q("latest_per_key", lambda s, d: ft.latest_per_key(events(s, d), ["user_id"], ORDER).select("user_id", "event_id", "ts", "value"), "SELECT user_id, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
q("latest_text", lambda s, d: ft.latest_per_key(events(s, d).withColumn("kind", F.col("event_type")).unpivot(["event_id", "user_id", "ts"], ["kind", "props"], "field", "text"), ["user_id", "field"], ORDER).select("user_id", "field", "text"),
  "SELECT user_id, field, text FROM (SELECT user_id, ts, event_id, unnest(['kind', 'props']) AS field, unnest([event_type, props]) AS text FROM events) QUALIFY row_number() OVER (PARTITION BY user_id, field ORDER BY ts DESC, event_id DESC) = 1")
q("topk_recent", lambda s, d: events(s, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "ts"), "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
q("etl_history", lambda s, d: events(s, d).where("user_id % 5 = 1").orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "event_type", "ts"), "SELECT event_id, event_type, ts FROM events WHERE user_id % 5 = 1 ORDER BY ts DESC, event_id LIMIT 20")
def severity_ranked(s, d):
    counted = events(s, d).groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n"))
    severity = F.when(F.col("n") > 15, "critical").when(F.col("n") > 10, "warning").otherwise("info")
    return ft.severity_sort(counted.withColumn("severity", severity), "severity", ["user_id"])


q(
    "severity_sort",
    severity_ranked,
    """SELECT user_id, n, severity, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, user_id) AS rank FROM
    (SELECT *, CASE WHEN n > 15 THEN 'critical' WHEN n > 10 THEN 'warning' ELSE 'info' END AS severity FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS n FROM events GROUP BY 1))""",
)
q("page_incremental", lambda s, d: hourly(s, d).where("bucket > '2024-01-20'").orderBy("bucket", "user_id").limit(100).select("bucket", "user_id", "sample_count"), f"SELECT bucket, user_id, sample_count FROM {HOURLY} WHERE bucket > '2024-01-20' ORDER BY 1, 2 LIMIT 100")


# joins
def streams(s, d):
    day = lambda t, c, v, n: table(s, d, t).groupBy(F.date_trunc("day", c).alias("bucket")).agg(r6(F.avg(v)).alias(n))
    e = events(s, d).groupBy(F.date_trunc("day", "ts").alias("bucket")).agg(r6(F.avg("value")).alias("e"))
    return e, day("orders", "o_orderdate", "o_totalprice", "o"), day("lineitem", "l_shipdate", "l_quantity", "l")


STREAMS = """WITH e AS (SELECT date_trunc('day', ts) AS bucket, round(avg(value), 8) + 0 AS e FROM events GROUP BY 1), o AS (SELECT date_trunc('day', o_orderdate) AS bucket, round(avg(o_totalprice), 8) + 0 AS o FROM orders GROUP BY 1),
l AS (SELECT date_trunc('day', l_shipdate) AS bucket, round(avg(l_quantity), 8) + 0 AS l FROM lineitem GROUP BY 1) """
q("align_full_outer", lambda s, d: align.align(list(streams(s, d)[:3])), STREAMS + "SELECT * FROM e FULL JOIN o USING (bucket) FULL JOIN l USING (bucket)")
q("align_left", lambda s, d: align.align(list(streams(s, d)[1:3]), "left"), STREAMS + "SELECT * FROM o LEFT JOIN l USING (bucket)")
q("align_inner", lambda s, d: align.align(list(streams(s, d)[1:3]), "inner"), STREAMS + "SELECT * FROM o JOIN l USING (bucket)")


def forecast_asof(s, d, join=align.asof):
    e = events(s, d)
    left = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("issued_at"), F.col("event_id").alias("click_id"), "value")
    return join(left, right, "ts", "issued_at", ["user_id"], ["issued_at", "click_id", "value"], "click_id")


ASOF = """SELECT v.event_id, v.user_id, v.ts, c.ts AS issued_at, c.event_id AS click_id, c.value FROM (SELECT * FROM events WHERE event_type = 'view') v
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON v.user_id = c.user_id AND v.ts >= c.ts"""
q("forecast_asof", forecast_asof, ASOF)
q("forecast_asof_spread", lambda s, d: forecast_asof(s, d, align.asof_spread), ASOF)


def near_pairs(s, d):
    """Views with the clicks within five minutes; views without a value stay, each once."""
    views = obs(s, d).where("event_type = 'view'").select("event_id", "ts", "value")
    clicks = events(s, d).where("event_type = 'click'").select(F.col("event_id").alias("other"), F.col("ts").alias("other_ts"))
    return align.range_join(views, clicks, "ts", "other_ts", 300, [])


q(
    "range_join_5min",
    near_pairs,
    f"""SELECT v.event_id, v.ts, v.value, c.event_id AS other, c.ts AS other_ts FROM (SELECT * FROM {OBS} WHERE event_type = 'view') v
    LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON c.ts BETWEEN v.ts - INTERVAL 5 MINUTES AND v.ts + INTERVAL 5 MINUTES""",
)
q("exact_ts_join", lambda s, d: table(s, d, "orders").join(table(s, d, "lineitem"), [F.col("o_orderkey") == F.col("l_orderkey"), F.col("o_orderdate") == F.col("l_shipdate")]).select("o_orderkey", "l_linenumber"),
  "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND o_orderdate = l_shipdate")
q("exact_ts_left", lambda s, d: streams(s, d)[1].join(streams(s, d)[2], "bucket", "left").select("bucket", "o", F.coalesce("l", F.lit(-1.0)).alias("l")), STREAMS + "SELECT bucket, o, coalesce(l, -1) AS l FROM o LEFT JOIN l USING (bucket)")
q("dim_enrich", lambda s, d: events(s, d).join(table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id", "left").select("event_id", F.coalesce("c_name", F.lit("unknown")).alias("name")),
  "SELECT event_id, coalesce(c_name, 'unknown') AS name FROM events LEFT JOIN customer ON user_id = c_custkey")
q("anti_existing", lambda s, d: ev.append_new(events(s, d).where("event_id % 2 = 1").withColumn("event_key", ev.event_key(F.to_date("ts").cast("string"), F.col("user_id").cast("string"), "event_type")), events(s, d).where("event_id % 2 = 0").withColumn("event_key", ev.event_key(F.to_date("ts").cast("string"), F.col("user_id").cast("string"), "event_type"))).select("event_id"),
  "SELECT event_id FROM events n WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_id % 2 = 0 AND o.user_id = n.user_id AND o.event_type = n.event_type AND o.ts::DATE = n.ts::DATE)")
q("hybrid_anti_union", lambda s, d: events(s, d).where("event_id % 3 = 0").unionByName(events(s, d).where("event_id % 2 = 0").join(events(s, d).where("event_id % 3 = 0").select("user_id", "ts"), ["user_id", "ts"], "left_anti").select(*events(s, d).columns)).select("event_id", "user_id"),
  "SELECT event_id, user_id FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, user_id FROM events c WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM events h WHERE h.event_id % 3 = 0 AND h.user_id = c.user_id AND h.ts = c.ts)")
q("merge_sources", lambda s, d: align.drop_secondary(events(s, d).where("event_type = 'view'"), events(s, d).where("event_type = 'click'"), ["user_id"], "ts", 3600, F.col("value") > 90).select("event_id"),
  "SELECT event_id FROM events s WHERE event_type = 'view' AND (value > 90 OR NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'click' AND p.user_id = s.user_id AND abs(epoch(p.ts) - epoch(s.ts)) < 3600))")
q("objective_join", lambda s, d: long_metrics(s, d).join(F.broadcast(s.createDataFrame(OBJECTIVES, OBJ_SCHEMA)), "metric").groupBy("objective_id").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean")),
  f"SELECT objective_id, count(*) AS n, round(avg(value), 8) + 0 AS mean FROM {LONG} JOIN {OBJ_SQL} USING (metric) GROUP BY 1")
q("latest_run_full_outer", lambda s, d: ft.latest_per_key(events(s, d).where("user_id % 3 > 0"), ["user_id"], ORDER).select("user_id", "event_id").join(events(s, d).where("ts >= '2024-01-30'").groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "full_outer"),
  "SELECT user_id, event_id, n FROM (SELECT user_id, event_id FROM events WHERE user_id % 3 > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE ts >= '2024-01-30' GROUP BY 1) USING (user_id)")
q("lateral_latest_success", lambda s, d: events(s, d).groupBy("user_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(events(s, d).where("event_type = 'purchase'").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest")))),
  "SELECT user_id, n, latest FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1), (SELECT event_id AS latest FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 1)")


def three_hourly(s, d):
    """Indoor means of clicks, outdoor means of views, and weather of purchases, by hour."""
    def hourly_of(kind, **columns):
        rows = obs(s, d).where(F.col("event_type") == kind).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
        return rows.groupBy(F.window("ts", "1 hour").start.alias("bucket")).agg(*[F.avg(c).alias(n) for n, c in columns.items()])

    return hourly_of("click", indoor_pm25="value", indoor_temp="k"), hourly_of("view", outdoor_pm25="value"), hourly_of("purchase", outdoor_temp="k", outdoor_humidity="value")


q(
    "indoor_outdoor_full3",
    lambda s, d: align.indoor_outdoor(*three_hourly(s, d)).select(
        "bucket", *[r6(c).alias(c) for c in ("indoor_pm25", "outdoor_pm25", "outdoor_temp", "outdoor_humidity", "pm25_differential", "temp_differential")], "recommendation"
    ),
    f"""WITH o AS (SELECT date_trunc('hour', ts) AS bucket, event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM {OBS}),
    i AS (SELECT bucket, avg(value) AS pm, avg(k) AS temp FROM o WHERE event_type = 'click' GROUP BY 1), a AS (SELECT bucket, avg(value) AS pm FROM o WHERE event_type = 'view' GROUP BY 1),
    w AS (SELECT bucket, avg(k) AS temp, avg(value) AS hum FROM o WHERE event_type = 'purchase' GROUP BY 1)
    SELECT coalesce(i.bucket, a.bucket, w.bucket) AS bucket, round(i.pm, 8) + 0 AS indoor_pm25, round(a.pm, 8) + 0 AS outdoor_pm25, round(w.temp, 8) + 0 AS outdoor_temp,
    round(w.hum, 8) + 0 AS outdoor_humidity, round(i.pm - a.pm, 8) + 0 AS pm25_differential, round(i.temp - w.temp, 8) + 0 AS temp_differential,
    CASE WHEN a.pm < i.pm * 0.8::DOUBLE AND w.temp BETWEEN 18 AND 26 AND w.hum < 80 THEN 'OPEN_WINDOWS' WHEN a.pm > i.pm * 1.2::DOUBLE THEN 'KEEP_CLOSED' ELSE 'NEUTRAL' END AS recommendation
    FROM i FULL JOIN a ON i.bucket = a.bucket FULL JOIN w ON coalesce(i.bucket, a.bucket) = w.bucket""",
)


def forecasts_and_observations(s, d):
    """Forecasts of two metrics for the whole hours, and hourly observations of them; a ninth of the forecasts is flagged."""
    e = events(s, d).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    flags = F.when(F.col("event_id") % 9 == 0, F.array(F.lit("bad"))).when(F.col("event_id") % 9 == 1, F.array().cast("array<string>"))
    made = e.select(F.date_trunc("hour", "ts").alias("t"), "user_id", F.col("event_id").alias("issue"), F.col("value").alias("value"), "k", flags.alias("dq_flags"))
    seen = e.groupBy(F.date_trunc("hour", "ts").alias("t"), "user_id").agg(F.avg("value").alias("value"), F.avg("k").alias("k"), F.count("*").alias("n"))
    seen = seen.withColumn("dq_flags", F.when(F.col("n") > 2, F.array(F.lit("many"))))
    return made, seen.drop("n")


q(
    "forecast_accuracy",
    lambda s, d: align.forecast_accuracy(*forecasts_and_observations(s, d), ["t", "user_id"], ["value", "k"], ["issue"]).select(
        "issue", *[r6(f"{m}_{x}").alias(f"{m}_{x}") for m in ("value", "k") for x in ("forecast", "observed", "error", "bias")]
    ),
    """SELECT event_id AS issue, round(f.value, 8) + 0 AS value_forecast, round(o.value, 8) + 0 AS value_observed, round(abs(f.value - o.value), 8) + 0 AS value_error, round(f.value - o.value, 8) + 0 AS value_bias,
    round(f.k, 8) + 0 AS k_forecast, round(o.k, 8) + 0 AS k_observed, round(abs(f.k - o.k), 8) + 0 AS k_error, round(f.k - o.k, 8) + 0 AS k_bias
    FROM (SELECT event_id, user_id, date_trunc('hour', ts) AS t, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events WHERE event_id % 9 > 0) f
    JOIN (SELECT user_id, date_trunc('hour', ts) AS t, avg(value) AS value, avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS k FROM events GROUP BY 1, 2 HAVING count(*) <= 2) o USING (user_id, t)""",
)


def graph(s, d):
    o, line = table(s, d, "orders"), table(s, d, "lineitem")
    return o.join(line, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("source"), F.col("l_partkey").alias("target"), "l_returnflag")


q(
    "graph_neighbors",
    lambda s, d: align.neighbors(graph(s, d), table(s, d, "part").select(F.col("p_partkey").alias("id"), "p_brand"), "l_returnflag", ["R", "N"]),
    """SELECT DISTINCT o_custkey AS source, l_returnflag AS edge_type, p_partkey AS id, p_brand FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
    WHERE l_returnflag IN ('R', 'N')""",
)
q("graph_dangling", lambda s, d: graph(s, d).join(table(s, d, "customer").where("c_custkey % 10 > 0"), F.col("source") == F.col("c_custkey"), "left_anti").groupBy("source").agg(F.count("*").alias("n")),
  "SELECT o_custkey AS source, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 > 0) GROUP BY 1")
q("latest_readings_union", lambda s, d: ft.latest_per_key(events(s, d), ["user_id"], ORDER).select(F.lit("event").alias("kind"), F.col("user_id").alias("id"), F.to_json(F.struct("event_type")).alias("metrics")).unionByName(
    ft.latest_per_key(table(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(F.lit("order").alias("kind"), F.col("o_custkey").alias("id"), F.lit(None).cast("string").alias("metrics"))),
  "SELECT 'event' AS kind, user_id AS id, '{\"event_type\":\"' || event_type || '\"}' AS metrics FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 UNION ALL SELECT 'order', o_custkey, NULL FROM (SELECT DISTINCT o_custkey FROM orders)")
q("payload_profile", lambda s, d: events(s, d).select(F.explode(F.json_object_keys("props")).alias("key"), "props").groupBy("key").agg(F.count("*").alias("n")), "SELECT unnest(json_keys(props)) AS key, count(*) AS n FROM events GROUP BY 1")
q("gap_report", lambda s, d: events(s, d).select("event_id", F.array_except(F.json_object_keys("props"), F.array(F.lit("k"), F.lit("z"))).alias("extra"), F.array_except(F.array(F.lit("k"), F.lit("z")), F.json_object_keys("props")).alias("missing")).select("event_id", F.size("extra").cast("long").alias("n_extra"), F.array_join("missing", ",").alias("missing")),
  "SELECT event_id, len(list_filter(json_keys(props), lambda x: x NOT IN ('k', 'z'))) AS n_extra, array_to_string(list_filter(['k', 'z'], lambda x: NOT list_contains(json_keys(props), x)), ',') AS missing FROM events")
