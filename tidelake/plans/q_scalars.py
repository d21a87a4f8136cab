"""Scalar functions, reshaping, data quality and merging."""

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import dq, features as ft, merge
from .base import OBS, events, obs, q, r6
from .catalog import table


def each(name, column, sql, source=events, table_sql="events", key="event_id"):
    q(name, lambda s, d: source(s, d).select(key, column().alias("x")), f"SELECT {key}, {sql} AS x FROM {table_sql}")


V = lambda: F.col("value")
each("ts_micros", lambda: F.timestamp_micros(F.lit(1704067200000000) + F.col("event_id") * 1000), "make_timestamp(1704067200000000 + event_id * 1000)")
each("ts_unix_seconds", lambda: F.timestamp_seconds(F.lit(1704067200) + F.col("event_id")), "make_timestamp((1704067200 + event_id) * 1000000)")
each("ts_iso8601", lambda: F.to_timestamp(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")), "date_trunc('second', ts)")
each("ts_plus_duration", lambda: sc.ts_plus_duration(F.date_trunc("second", "ts"), F.concat(F.lit("PT"), F.col("event_id") % 48, F.lit("H30M"))), "date_trunc('second', ts) + to_hours((event_id % 48)::INT) + INTERVAL 30 MINUTES")
each("iso_interval_start", lambda: F.split(F.concat(F.lit("2024-01-0"), F.col("event_id") % 9 + 1, F.lit("T00:00:00Z/PT1H")), "/")[0], "split_part('2024-01-0' || (event_id % 9 + 1) || 'T00:00:00Z/PT1H', '/', 1)")
each("time_bucket", lambda: sc.time_bucket("ts", "15 minutes"), "time_bucket(INTERVAL 15 MINUTES, ts)")
each("lead_time_hours", lambda: F.bround((F.col("event_id") * 600) / 3600).cast("int"), "round_even(event_id * 600 / 3600, 0)::INT")
each("unit_linear", lambda: r6(sc.unit_linear(V(), 1.8, 32.0)), "round(value * 1.8::DOUBLE + 32::DOUBLE, 8) + 0")
each("unit_factor", lambda: r6(V() * 3.6), "round(value * 3.6::DOUBLE, 8) + 0")
each("expr_transform", lambda: F.expr("CASE WHEN value > 80 THEN 'high' WHEN value > 40 THEN 'mid' ELSE 'low' END"), "CASE WHEN value > 80 THEN 'high' WHEN value > 40 THEN 'mid' ELSE 'low' END")
each("lookup_transform", lambda: F.coalesce(F.create_map(F.lit("click"), F.lit(1), F.lit("view"), F.lit(2))[F.col("event_type")], F.lit(0)), "CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END")
each("json_extract", lambda: F.get_json_object("props", "$.k").cast("long"), "CAST(json_extract_string(props, '$.k') AS BIGINT)")
each("linear_interpolate", lambda: sc.linear_interpolate(V(), 0.0, 100.0, 10.0, 60.0, share_first=True), "round_even(value / 100 * 50 + 10, 0)")
each("hour_dow_weekend", lambda: F.concat_ws("-", *[c.cast("string") for c in ft.hour_dow_weekend("ts")]), "hour(ts) || '-' || (isodow(ts) - 1) || '-' || (isodow(ts) > 5)::VARCHAR")
each("cyclic_hour", lambda: r6(F.sin(F.hour("ts") * (2 * 3.141592653589793 / 24))), "round(sin(hour(ts) * (2 * 3.141592653589793::DOUBLE / 24)), 8) + 0")

# projections and filters
q("latest_range_filter", lambda s, d: events(s, d).where("user_id = 8 AND ts >= '2024-01-03' AND ts <= '2024-01-09'").select("event_id", "value"), "SELECT event_id, value FROM events WHERE user_id = 8 AND ts >= '2024-01-03' AND ts <= '2024-01-09'")
q("relative_range", lambda s, d: events(s, d).join(F.broadcast(events(s, d).agg(F.max("ts").alias("as_of"))), F.expr("ts >= as_of - INTERVAL 24 HOURS")).select("event_id"), "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS")
q("stream_filter", lambda s, d: events(s, d).where(F.col("event_type").isin("click", "view")).select("event_id"), "SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
q("domain_events", lambda s, d: events(s, d).join(F.broadcast(s.createDataFrame([("click",), ("error",)], "event_type string")), "event_type", "left_semi").groupBy("event_type").agg(F.count("*").alias("n")), "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'error') GROUP BY 1")
q("sample_silver", lambda s, d: events(s, d).where("ts >= '2024-01-10'").orderBy("ts", "event_id").limit(100).select("event_id", "ts"), "SELECT event_id, ts FROM events WHERE ts >= '2024-01-10' ORDER BY ts, event_id LIMIT 100")
q("alerts_query", lambda s, d: events(s, d).where("event_type = 'error' AND (value > 90 OR ts >= '2024-01-29')").select("event_id", "user_id"), "SELECT event_id, user_id FROM events WHERE event_type = 'error' AND (value > 90 OR ts >= '2024-01-29')")

# reshaping










q("unpivot_reading", lambda s, d: obs(s, d).withColumn("k", F.get_json_object("props", "$.k").cast("double")).unpivot(["event_id"], ["value", "k"], "metric", "v").where("v IS NOT NULL"),
  f"SELECT * FROM (SELECT event_id, unnest(['value', 'k']) AS metric, unnest([value, CAST(json_extract_string(props, '$.k') AS DOUBLE)]) AS v FROM {OBS}) WHERE v IS NOT NULL")


# data quality
def flagged(s, d):
    return obs(s, d).withColumn("flags", dq.flags(dq.range_check("value", 1, 99), dq.null_check("value"), dq.enum_check("event_type", ["CLICK", "VIEW", "PURCHASE", "SIGNUP"], True), dq.cross_field("value < 150", "plausible")))


FLAGS = f"""SELECT event_id, list_filter([CASE WHEN value < 1 OR value > 99 THEN 'range_check:value:out_of_bounds' END, CASE WHEN value IS NULL THEN 'null_check:value:missing' END,
CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN 'enum_check:event_type:invalid_value' END, CASE WHEN NOT value < 150 THEN 'cross_field_check:plausible' END], lambda x: x IS NOT NULL) AS flags FROM {OBS}"""
q("dq_flags_array", lambda s, d: flagged(s, d).select("event_id", F.array_join("flags", ",").alias("flags")), f"SELECT event_id, array_to_string(flags, ',') AS flags FROM ({FLAGS})")
q("clean_rows_only", lambda s, d: flagged(s, d).where(F.col("flags").isNull() | (F.size("flags") == 0)).select("event_id"), f"SELECT event_id FROM ({FLAGS}) WHERE len(flags) = 0")
q("dq_rule_summary", lambda s, d: dq.rule_summary(flagged(s, d), "observations"),
  f"""SELECT 'observations' AS table_name, CASE WHEN flag NOT LIKE 'cross%' THEN split_part(flag, ':', 2) END AS column_name,
  CASE WHEN flag LIKE 'cross%' THEN 'cross-field' ELSE 'column' END AS rule_scope, split_part(flag, ':', 1) AS rule_name, count(*) AS n
  FROM (SELECT unnest(flags) AS flag FROM ({FLAGS})) GROUP BY ALL""")
q("dq_result_score", lambda s, d: flagged(s, d).select("event_id", *[c.alias(n) for c, n in zip(dq.result("flags", 4, ("null_check",)), ("dropped", "score"), strict=True)]),
  f"SELECT event_id, list_contains(flags, 'null_check:value:missing') AS dropped, greatest(0.0::DOUBLE, 1 - len(flags) / 4) AS score FROM ({FLAGS})")
for name, column, sql in (
    ("dq_range_clamp", lambda: dq.clamp("value", 1.0, 99.0), "CASE WHEN value IS NOT NULL THEN least(greatest(value, 1), 99) END"),
    ("dq_range_reject", lambda: dq.reject("value", 1.0, 99.0), "CASE WHEN value BETWEEN 1 AND 99 THEN value END"),
    ("dq_null", lambda: dq.null_check("value"), "CASE WHEN value IS NULL THEN 'null_check:value:missing' END"),
    ("dq_enum", lambda: dq.enum_check("event_type", ["click", "view"]), "CASE WHEN event_type NOT IN ('click', 'view') THEN 'enum_check:event_type:invalid_value' END"),
    ("dq_pattern", lambda: dq.pattern_check("event_type", "^[a-p]"), "CASE WHEN NOT regexp_matches(event_type, '^[a-p]') THEN 'pattern_check:event_type:pattern_mismatch' END"),
    ("dq_freshness", lambda: dq.freshness_check("ts", F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00")), "10 DAYS", "2 DAYS"),
     "CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 'freshness_check:ts:stale' WHEN ts > TIMESTAMP '2024-01-22' THEN 'freshness_check:ts:future' END"),
    ("dq_range", lambda: dq.range_check("value", 1, 99), "CASE WHEN value < 1 OR value > 99 THEN 'range_check:value:out_of_bounds' END"),
    ("dq_range_flag_of_clamping", lambda: dq.range_check("value", 1, 99, clamp=True), "CASE WHEN value < 1 OR value > 99 THEN 'range_check:value:clamped' END"),
    ("dq_rate_of_change", lambda: dq.rate_of_change("value", "ts", 1.0, "user_id", "event_id"), "CASE WHEN abs(value - lag(value) OVER w) / nullif((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60e6, 0) > 1 THEN 'rate_of_change:value:exceeded' END"),
    ("dq_cross_field", lambda: dq.cross_field("value > user_id", "above"), "CASE WHEN NOT value > user_id THEN 'cross_field_check:above' END"),
    ("dq_cross_field_strict", lambda: dq.cross_field("value > user_id", "above", True), "CASE WHEN NOT coalesce(value > user_id, false) THEN 'cross_field_check:above' END"),
    ("dq_monotonic", lambda: dq.monotonic("value", "user_id", ["ts", "event_id"], 5.0), "CASE WHEN value < lag(value) OVER w AND value > 5 THEN 'monotonic:value:decreased' END"),
    ("dq_conditional", lambda: dq.conditional("event_type = 'click'", dq.null_check("value")), "CASE WHEN event_type = 'click' AND value IS NULL THEN 'null_check:value:missing' END"),
):
    each(name, column, sql, obs, f"{OBS} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)" if " w" in sql else OBS)
q("dq_completeness", lambda s, d: dq.completeness(obs(s, d), ["user_id"], ["value"]).select("user_id", r6("value_share").alias("share")), f"SELECT user_id, round(count(value) / count(*), 8) + 0 AS share FROM {OBS} GROUP BY 1")
q("dq_cardinality", lambda s, d: events(s, d).groupBy("user_id").agg(F.count_distinct("event_type").alias("n")).withColumn("ok", F.col("n").between(2, 4)), "SELECT user_id, count(DISTINCT event_type) AS n, count(DISTINCT event_type) BETWEEN 2 AND 4 AS ok FROM events GROUP BY 1")

# merging: key (user_id, day); old rows have even ids, new ones odd
ROW = lambda s, d: events(s, d).select("user_id", F.date_trunc("day", "ts").alias("day"), "event_id", "value")


def old(s, d):
    return ft.latest_per_key(ROW(s, d).where("event_id % 2 = 0"), ["user_id", "day"], ["event_id"])


def new(s, d):
    return ft.latest_per_key(ROW(s, d).where("event_id % 2 = 1"), ["user_id", "day"], ["event_id"])


SIDES = "WITH r AS (SELECT user_id, date_trunc('day', ts) AS day, event_id, value FROM events), o AS (SELECT * FROM r WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY event_id DESC) = 1), n AS (SELECT * FROM r WHERE event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY event_id DESC) = 1) "
q("dedup_upsert", lambda s, d: merge.upsert(old(s, d), ROW(s, d).where("event_id % 2 = 1"), ["user_id", "day"], ["event_id"], keep=("event_id",)), SIDES + "SELECT user_id, day, coalesce(o.event_id, n.event_id) AS event_id, coalesce(n.value, o.value) AS value FROM o FULL JOIN n USING (user_id, day)")
q("sink_upsert", lambda s, d: merge.upsert(old(s, d), new(s, d), ["user_id", "day"], ["event_id"]), SIDES + "SELECT user_id, day, coalesce(n.event_id, o.event_id) AS event_id, coalesce(n.value, o.value) AS value FROM o FULL JOIN n USING (user_id, day)")
q("dedup_skip", lambda s, d: merge.skip_existing(old(s, d), new(s, d), ["user_id", "day"]), SIDES + "SELECT * FROM o UNION ALL SELECT * FROM n ANTI JOIN o USING (user_id, day)")
q("dedup_replace", lambda s, d: merge.replace_rows(old(s, d), new(s, d), ["user_id", "day"]), SIDES + "SELECT * FROM n UNION ALL SELECT * FROM o ANTI JOIN n USING (user_id, day)")
q("dim_upsert", lambda s, d: merge.upsert(table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), table(s, d, "customer").where("c_custkey % 4 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal")), ["c_custkey"], ["c_acctbal"]), "SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
q("incremental_watermark", lambda s, d: merge.since_watermark(events(s, d), events(s, d).where("ts < '2024-01-20'"), "ts", "1 HOUR").select("event_id"), "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events WHERE ts < '2024-01-20') - INTERVAL 1 HOUR")


def bronze_to_silver(s, d):
    """Scan, watermark, map, rules, newest per key, merge: one plan."""
    fresh = merge.since_watermark(flagged(s, d), events(s, d).where("ts < '2024-01-15'"), "ts", "1 DAY")
    rows = fresh.select("user_id", F.date_trunc("day", "ts").alias("day"), "event_id", dq.reject("value", 0.0, 500.0).alias("value")).where("value IS NOT NULL")
    return merge.upsert(old(s, d), rows, ["user_id", "day"], ["event_id"])


q("bronze_to_silver", bronze_to_silver, SIDES + f""", f AS (SELECT user_id, date_trunc('day', ts) AS day, event_id, value FROM {OBS} WHERE ts > (SELECT max(ts) FROM events WHERE ts < '2024-01-15') - INTERVAL 1 DAY AND value BETWEEN 0 AND 500
QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_id DESC) = 1) SELECT user_id, day, coalesce(f.event_id, o.event_id) AS event_id, coalesce(f.value, o.value) AS value FROM o FULL JOIN f USING (user_id, day)""")
