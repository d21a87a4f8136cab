"""Aggregations."""

from pyspark.sql import functions as F

from ..operators.rollup import aggregate, bucket_collapse, corrected_stats, metric, rollup
from .base import HOURLY, OBS, events, hourly, obs, q, r6
from .catalog import table

STATS = {"value": ["mean", "std", "min", "max", "p95", "first", "last", "count"]}


def rounded():
    return [r6(f"value_{m}").alias(f"value_{m}") for m in ("mean", "std", "min", "max", "p95", "first", "last")]



q("rollup_bucket", lambda s, d: rollup(obs(s, d), "1 hour", ["user_id"], STATS).select("bucket", "user_id", *rounded(), "value_count", "sample_count"),
  f"""SELECT date_trunc('hour', ts) AS bucket, user_id, round(avg(value), 8) + 0 AS value_mean, round(stddev_samp(value), 8) + 0 AS value_std, round(min(value), 8) + 0 AS value_min,
  round(max(value), 8) + 0 AS value_max, round(quantile_cont(value, 0.95), 8) + 0 AS value_p95, round(arg_min_null(value, (ts, event_id)), 8) + 0 AS value_first,
  round(arg_max_null(value, (ts, event_id)), 8) + 0 AS value_last, count(value) AS value_count, count(*) AS sample_count FROM {OBS} GROUP BY 1, 2""")

for name, sql in {"mean": "avg(value)", "min": "min(value)", "max": "max(value)", "count": "count(value)", "std": "stddev_samp(value)", "p95": "quantile_cont(value, 0.95)",
                  "p99": "quantile_cont(value, 0.99)", "first": "arg_min_null(value, (ts, event_id))", "last": "arg_max_null(value, (ts, event_id))"}.items():
    q(f"agg_{name}", lambda s, d, name=name: obs(s, d).groupBy("user_id").agg(r6(metric(name, "value", "ts", "event_id")).alias("v")),
      f"SELECT user_id, round({sql}, 8) + 0.0::DOUBLE AS v FROM {OBS} GROUP BY 1")

q("agg_count_filter", lambda s, d: obs(s, d).groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("n_high"), F.count_if(F.col("value").isNull()).alias("n_missing")),
  f"SELECT event_type, count(*) FILTER (WHERE value > 50) AS n_high, count(*) FILTER (WHERE value IS NULL) AS n_missing FROM {OBS} GROUP BY 1")
q("agg_distinct", lambda s, d: events(s, d).groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users")),
  "SELECT event_type, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1")
q("events_hourly", lambda s, d: events(s, d).groupBy(F.window("ts", "1 hour").start.alias("bucket")).agg(
    *[F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in ("click", "view")], F.count("*").alias("n"), F.count_distinct("user_id").alias("entities"), F.count_distinct("event_type").alias("streams")),
  "SELECT date_trunc('hour', ts) AS bucket, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'view') AS n_view, count(*) AS n, "
  "count(DISTINCT user_id) AS entities, count(DISTINCT event_type) AS streams FROM events GROUP BY 1")
q("events_hourly_by_entity", lambda s, d: events(s, d).groupBy(F.window("ts", "1 hour").start.alias("bucket"), "user_id", "event_type").agg(F.count("*").alias("n")),
  "SELECT date_trunc('hour', ts) AS bucket, user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def with_raw(s, d):
    """Observations with the value as it was measured beside the corrected one."""
    return obs(s, d).withColumn("raw", F.when(F.col("event_id") % 11 == 0, F.col("value") / 10).otherwise(F.col("value")))


RAW = "(SELECT *, CASE WHEN event_id % 11 = 0 THEN value / 10 ELSE value END AS raw, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS fixed FROM " + OBS + ")"
for name, unit in (("silver_hourly", "hour"), ("silver_daily", "day")):
    q(
        name,
        lambda s, d, unit=unit: corrected_stats(with_raw(s, d).withColumn("fixed", F.when(F.col("event_id") % 5 > 0, F.col("value"))), "ts", f"1 {unit}", ["event_type"], "fixed", "raw").select(
            "bucket", "event_type", *[r6(c).alias(c) for c in ("mean", "high", "low")]
        ),
        f"""SELECT date_trunc('{unit}', ts) AS bucket, event_type, round(avg(coalesce(fixed, raw)), 8) + 0 AS mean, round(max(coalesce(fixed, raw)), 8) + 0 AS high,
        round(min(coalesce(fixed, raw)), 8) + 0 AS low FROM {RAW} GROUP BY 1, 2""",
    )
for name, source, time, key, fixed, raw in (
    ("silver_hourly_orders", "orders", "o_orderdate", "o_orderstatus", "CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END", "o_totalprice / 2"),
    ("silver_hourly_lineitem", "lineitem", "l_shipdate", "l_returnflag", "CASE WHEN l_orderkey % 3 > 0 THEN l_extendedprice END", "l_extendedprice / 2"),
):
    q(
        name,
        lambda s, d, source=source, time=time, key=key, fixed=fixed, raw=raw: corrected_stats(
            table(s, d, source).select(F.col(time).cast("timestamp").alias("ts"), key, F.expr(fixed).cast("double").alias("fixed"), F.expr(raw).cast("double").alias("raw")), "ts", "1 hour", [key], "fixed", "raw"
        ).select(F.unix_seconds("bucket").alias("bucket"), key, *[F.round(c, 6).alias(c) for c in ("mean", "high", "low")]),
        f"""SELECT epoch(date_trunc('hour', {time}::TIMESTAMP))::BIGINT AS bucket, {key}, round(avg(coalesce({fixed}, {raw}))::DOUBLE, 6) AS mean, round(max(coalesce({fixed}, {raw}))::DOUBLE, 6) AS high,
        round(min(coalesce({fixed}, {raw}))::DOUBLE, 6) AS low FROM {source} GROUP BY 1, 2""",
    )


def bars(df, unit, time="o_orderdate", price="o_totalprice", symbol="o_orderpriority", tie="o_orderkey"):
    order = F.struct(time, tie)
    return df.groupBy(F.date_trunc(unit, time).alias("bucket"), F.col(symbol).alias("symbol")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        F.round(F.sum(price), 3).alias("volume"), r6(F.avg(price)).alias("vwap"), r6(F.stddev_samp(price)).alias("volatility"), F.min(order).alias("o"), F.max(order).alias("c"))


BARS = """SELECT date_trunc('{unit}', o_orderdate) AS bucket, o_orderpriority AS symbol, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, round(sum(o_totalprice), 3) AS volume, round(avg(o_totalprice), 8) + 0 AS vwap, round(stddev_samp(o_totalprice), 8) + 0 AS volatility FROM orders GROUP BY 1, 2"""
q("ohlcv", lambda s, d: bars(table(s, d, "orders"), "day").drop("o", "c", "volatility"), f"SELECT * EXCLUDE volatility FROM ({BARS.format(unit='day')})")
q("ohlcv_volatility", lambda s, d: bars(table(s, d, "orders"), "month").drop("o", "c"), BARS.format(unit="month"))


def cascade(s, d):
    """Monthly bars from daily bars."""
    day = bars(table(s, d, "orders"), "day")
    return day.groupBy(F.date_trunc("month", "bucket").alias("bucket"), "symbol").agg(
        F.min_by("open", "o").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "c").alias("close"), F.round(F.sum("volume"), 3).alias("volume"))


q("ohlcv_cascade", cascade, f"SELECT bucket, symbol, open, high, low, close, round(volume, 3) AS volume FROM ({BARS.format(unit='month')})")
q("api_aggregate", lambda s, d: aggregate(events(s, d), "user_id", None, "2024-01-05", "2024-01-12", "5 minutes", {m: ("value", m) for m in ("mean", "min", "max", "p50", "p95")}).select("bucket", "user_id", *[r6(m).alias(m) for m in ("mean", "min", "max", "p50", "p95")]),
  "SELECT time_bucket(INTERVAL 5 minutes, ts) AS bucket, user_id, round(avg(value), 8) + 0 AS mean, round(min(value), 8) + 0 AS min, round(max(value), 8) + 0 AS max, round(quantile_cont(value, 0.5), 8) + 0 AS p50, "
  "round(quantile_cont(value, 0.95), 8) + 0 AS p95 FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-12' GROUP BY 1, 2")
q("api_aggregate_entities", lambda s, d: aggregate(obs(s, d), "event_type", ["view", "click"], None, None, "1 day", {"n": ("value", "count"), "newest": ("value", "last")}).select("bucket", "event_type", "n", r6("newest").alias("newest")),
  f"SELECT date_trunc('day', ts) AS bucket, event_type, count(value) AS n, round(arg_max_null(value, (ts, event_id)), 8) + 0 AS newest FROM {OBS} WHERE event_type IN ('view', 'click') GROUP BY 1, 2")
q("position_summary", lambda s, d: table(s, d, "lineitem").groupBy("l_partkey").agg(r6(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")))).alias("returned"), r6(F.avg("l_extendedprice")).alias("mean_price")),
  "SELECT l_partkey, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END)::DOUBLE, 8) + 0 AS returned, round(avg(l_extendedprice), 8) + 0 AS mean_price FROM lineitem GROUP BY 1")
AS_OF = "(SELECT max(ts) FROM events)"


def as_of(s, d):
    return events(s, d).agg(F.max("ts").alias("as_of"))  # one row


q("event_metrics", lambda s, d: events(s, d).crossJoin(F.broadcast(as_of(s, d))).groupBy("event_type").agg(
    *[F.count_if(F.col("ts") >= F.col("as_of") - F.expr(f"INTERVAL {h} HOURS")).alias(f"n_{h}h") for h in (1, 24, 168)], F.max("ts").alias("newest")),
  f"SELECT event_type, count(*) FILTER (WHERE ts >= {AS_OF} - INTERVAL 1 HOUR) AS n_1h, count(*) FILTER (WHERE ts >= {AS_OF} - INTERVAL 24 HOUR) AS n_24h, count(*) FILTER (WHERE ts >= {AS_OF} - INTERVAL 168 HOUR) AS n_168h, max(ts) AS newest FROM events GROUP BY 1")


def freshness(s, d):
    age = (F.unix_timestamp(F.col("as_of").cast("timestamp")) - F.unix_timestamp(F.col("newest").cast("timestamp"))) / 3600
    found = events(s, d).groupBy("user_id").agg(F.max("ts").alias("newest")).crossJoin(F.broadcast(as_of(s, d)))
    return found.withColumn("health", F.when(age < 18, "FRESH").when(age < 36, "STALE").otherwise("CRITICAL")).drop("as_of")


FRESH = f"""SELECT user_id, newest, CASE WHEN (epoch({AS_OF}) // 1 - epoch(newest) // 1) / 3600 < 18 THEN 'FRESH' WHEN (epoch({AS_OF}) // 1 - epoch(newest) // 1) / 3600 < 36 THEN 'STALE' ELSE 'CRITICAL' END AS health
FROM (SELECT user_id, max(ts) AS newest FROM events GROUP BY 1)"""
q("entity_freshness", freshness, FRESH)
q("freshness_rollup", lambda s, d: freshness(s, d).groupBy().agg(F.max(F.when(F.col("health") == "CRITICAL", 3).when(F.col("health") == "STALE", 2).otherwise(1)).alias("worst"), *[F.count_if(F.col("health") == h).alias(h.lower()) for h in ("FRESH", "STALE", "CRITICAL")]),
  f"SELECT max(CASE health WHEN 'CRITICAL' THEN 3 WHEN 'STALE' THEN 2 ELSE 1 END) AS worst, count(*) FILTER (WHERE health = 'FRESH') AS fresh, count(*) FILTER (WHERE health = 'STALE') AS stale, count(*) FILTER (WHERE health = 'CRITICAL') AS critical FROM ({FRESH})")

LIMITS = [("click", 1), ("view", 2), ("purchase", 24)]


def pipeline_health(s, d):
    limits = s.createDataFrame(LIMITS, "event_type string, hours int")
    age = (F.unix_timestamp(F.col("as_of").cast("timestamp")) - F.unix_timestamp(F.col("newest").cast("timestamp"))) / 3600
    found = events(s, d).groupBy("event_type").agg(F.max("ts").alias("newest"), F.count("*").alias("n")).join(F.broadcast(limits), "event_type", "left").crossJoin(F.broadcast(as_of(s, d)))
    hours = F.coalesce("hours", F.lit(12))
    return found.select("event_type", "n", F.when(age < hours, "healthy").when(age < hours * 2, "degraded").otherwise("down").alias("status"), (F.col("n") < 1000).alias("sparse"))


HEALTH = f"""SELECT event_type, n, CASE WHEN age < h THEN 'healthy' WHEN age < 2 * h THEN 'degraded' ELSE 'down' END AS status, n < 1000 AS sparse FROM (SELECT e.event_type, n, coalesce(hours, 12) AS h,
(epoch({AS_OF}) // 1 - epoch(newest) // 1) / 3600 AS age FROM (SELECT event_type, max(ts) AS newest, count(*) AS n FROM events GROUP BY 1) e LEFT JOIN (VALUES ('click', 1), ('view', 2), ('purchase', 24)) l(event_type, hours) USING (event_type))"""
q("pipeline_health", pipeline_health, HEALTH)
q("pipeline_health_summary", lambda s, d: pipeline_health(s, d).groupBy("status").agg(F.count("*").alias("streams"), F.sum("n").alias("n")), f"SELECT status, count(*) AS streams, sum(n)::BIGINT AS n FROM ({HEALTH}) GROUP BY 1")


def data_freshness(s, d):
    mark = events(s, d).agg(F.max("ts").alias("as_of"))
    one = events(s, d).groupBy(F.lit("events").alias("tbl")).agg(F.max("ts").cast("timestamp_ntz").alias("newest"), F.count("*").alias("n"))
    two = table(s, d, "orders").groupBy(F.lit("orders").alias("tbl")).agg(F.max("o_orderdate").cast("timestamp_ntz").alias("newest"), F.count("*").alias("n"))
    age = F.unix_timestamp(F.col("as_of").cast("timestamp")) - F.unix_timestamp(F.col("newest").cast("timestamp"))
    return one.unionByName(two).crossJoin(F.broadcast(mark)).select("tbl", "n", F.when(F.col("newest").isNull(), "unknown").when(age < 300, "fresh").when(age < 1800, "stale").otherwise("critical").alias("status"))


q("data_freshness", data_freshness, f"""SELECT tbl, n, CASE WHEN newest IS NULL THEN 'unknown' WHEN epoch({AS_OF}) - epoch(newest) < 300 THEN 'fresh' WHEN epoch({AS_OF}) - epoch(newest) < 1800 THEN 'stale' ELSE 'critical' END AS status
FROM (SELECT 'events' AS tbl, max(ts) AS newest, count(*) AS n FROM events UNION ALL SELECT 'orders', max(o_orderdate)::TIMESTAMP, count(*) FROM orders)""")
q("etl_history_summary", lambda s, d: events(s, d).where("event_type = 'click'").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"), F.max("ts").alias("newest")),
  "SELECT count(*) AS n, min(ts) AS oldest, max(ts) AS newest FROM events WHERE event_type = 'click'")
q("silver_stats", lambda s, d: obs(s, d).agg(F.count("*").alias("n"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"), r6(F.count("value") / F.count("*")).alias("coverage")),
  f"SELECT count(*) AS n, min(ts) AS oldest, max(ts) AS newest, round(count(value) / count(*), 8) + 0 AS coverage FROM {OBS}")
q("sensor_health", lambda s, d: freshness(s, d).crossJoin(F.broadcast(as_of(s, d))).select("user_id", F.when(F.timestamp_seconds(F.lit(0)).isNull(), "").when(
    F.unix_timestamp(F.col("as_of").cast("timestamp")) - F.unix_timestamp(F.col("newest").cast("timestamp")) < 300, "online").when(
    F.unix_timestamp(F.col("as_of").cast("timestamp")) - F.unix_timestamp(F.col("newest").cast("timestamp")) < 900, "degraded").otherwise("offline").alias("status")),
  f"SELECT user_id, CASE WHEN epoch({AS_OF}) // 1 - epoch(max(ts)) // 1 < 300 THEN 'online' WHEN epoch({AS_OF}) // 1 - epoch(max(ts)) // 1 < 900 THEN 'degraded' ELSE 'offline' END AS status FROM events GROUP BY 1")
q("scaler_fit", lambda s, d: events(s, d).crossJoin(F.broadcast(events(s, d).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd")))).select("event_id", r6(F.when(F.col("sd") == 0, 0.0).otherwise((F.col("value") - F.col("m")) / F.col("sd"))).alias("z")),
  "SELECT event_id, round((value - m) / sd, 8) + 0 AS z FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM events)")


def scale(s, d, how):
    a = events(s, d).groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    e = events(s, d).join(F.broadcast(a), "event_type")  # a row per type
    z = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) if how == "minmax" else (F.col("value") - F.col("m")) / F.col("sd")
    return e.select("event_id", r6(z).alias("z"))


q("minmax_scale", lambda s, d: scale(s, d, "minmax"), "SELECT event_id, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 8) + 0 AS z FROM events WINDOW w AS (PARTITION BY event_type)")
q("zscore_scale", lambda s, d: scale(s, d, "z"), "SELECT event_id, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 8) + 0 AS z FROM events WINDOW w AS (PARTITION BY event_type)")
q("bucket_collapse", lambda s, d: bucket_collapse(hourly(s, d).drop("user_id")).select("bucket", r6("v_mean").alias("v_mean"), "sample_count"),
  f"SELECT bucket, round(avg(v_mean), 8) + 0 AS v_mean, sum(sample_count)::BIGINT AS sample_count FROM {HOURLY} GROUP BY 1")
q("node_count", lambda s, d: table(s, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")), "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
q("edge_count", lambda s, d: table(s, d, "orders").join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("l_linestatus").agg(F.count("*").alias("n")),
  "SELECT l_linestatus, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
