"""Freshness and health reports, run histories, and what readers of a store ask for."""

from pyspark.sql import functions as F

from ..operators import access as ac, bars, events as ev, health as he
from ..session import new_path
from ..sources import tables as tb
from .base import OBS, events, obs, q, r6
from .catalog import table
from .q_lake import ticks
from .q_windows import CROSS, OBJ_SCHEMA, OBJECTIVES, TRANS, long_metrics, states

AS_OF = "(SELECT max(ts) FROM events)"
AGE = f"((epoch_us({AS_OF}) - epoch_us({{0}})) / 1e6::DOUBLE)"


def now(s, d):
    return he.newest(events(s, d), "ts")


# ---- entities: every tenth one has no times
def entities(s, d):
    return obs(s, d).withColumn("ts", F.when(F.col("user_id") % 10 > 0, F.col("ts")))


ENTITIES = "(SELECT event_id, user_id, CASE WHEN user_id % 10 > 0 THEN ts END AS ts FROM events)"
ENTITY = f"""SELECT user_id, last_event, {AGE.format('last_event')} / 3600 AS hours_since_event, CASE WHEN last_event IS NULL THEN 'CRITICAL' WHEN {AS_OF} - last_event < INTERVAL 18 HOURS THEN 'FRESH'
WHEN {AS_OF} - last_event < INTERVAL 36 HOURS THEN 'STALE' ELSE 'CRITICAL' END AS status FROM (SELECT user_id, max(ts) AS last_event FROM {ENTITIES} GROUP BY 1)"""


def freshness(s, d):
    return he.entity_freshness(entities(s, d), "user_id", "ts", now(s, d))


q("entity_freshness_report", lambda s, d: freshness(s, d).withColumn("hours_since_event", F.round("hours_since_event", 6)), f"SELECT * REPLACE (round(hours_since_event, 6) AS hours_since_event) FROM ({ENTITY})")
q(
    "freshness_overall",
    lambda s, d: he.freshness_overall(freshness(s, d), "user_id"),
    f"""SELECT CASE max(CASE status WHEN 'FRESH' THEN 1 WHEN 'STALE' THEN 2 ELSE 3 END) WHEN 1 THEN 'FRESH' WHEN 2 THEN 'STALE' ELSE 'CRITICAL' END AS overall_status, count(DISTINCT user_id) AS entity_count,
    count(DISTINCT user_id) FILTER (WHERE status = 'CRITICAL') AS critical_count, count(DISTINCT user_id) FILTER (WHERE status = 'STALE') AS stale_count,
    count(DISTINCT user_id) FILTER (WHERE status = 'FRESH') AS fresh_count, round(max(hours_since_event), 1) AS max_hours_since_event FROM ({ENTITY})""",
)
q(
    "sensor_status",
    lambda s, d: he.sensor_status(entities(s, d), "user_id", "ts", now(s, d)),
    f"""SELECT user_id, floor(age)::BIGINT AS age_seconds, CASE WHEN floor(age) < 300 THEN 'online' WHEN floor(age) < 900 THEN 'degraded' ELSE 'offline' END AS status
    FROM (SELECT user_id, {AGE.format('max(ts)')} AS age FROM {ENTITIES} GROUP BY 1)""",
)

# ---- streams: one that never had a row, one that had none for a day, and a sparse one
STREAMS = [
    he.Stream("click", "Clicks", "observation", 90, 1800),
    he.Stream("view", "Views", "observation", 1200, 2400),
    he.Stream("purchase", "Purchases", "forecast", 600, 1200),
    he.Stream("error", "Errors", "event", 64800, 129600, True),
    he.Stream("signup", "Signups", "observation", 1200, 2400),
    he.Stream("refund", "Refunds", "observation", 1200, 2400),
]
STREAM_SQL = "(VALUES " + ", ".join(f"('{x.stream}', '{x.display_name}', '{x.stream_type}', {x.warn}, {x.critical}, {x.sparse})" for x in STREAMS) + ") w(stream, display_name, stream_type, warn, critical, sparse)"
QUIET = "event_type <> 'signup' OR ts < TIMESTAMP '2024-01-20'"
GRID = f"""SELECT stream, display_name, stream_type, sparse, last_record, coalesce(records, 0) AS records, warn, critical, age, CASE WHEN age IS NULL OR age > critical THEN 'CRITICAL' WHEN age > warn THEN 'WARNING' ELSE 'HEALTHY' END AS status
FROM (SELECT w.*, last_record, records, {AGE.format('last_record')} AS age FROM {STREAM_SQL} LEFT JOIN (SELECT event_type AS stream, max(ts) AS last_record, count(*) AS records FROM events
WHERE ({QUIET}) AND (event_type = 'error' OR ts >= {AS_OF} - INTERVAL 24 HOURS) GROUP BY 1) r USING (stream))"""


def grid(s, d):
    return he.stream_health(events(s, d).where(QUIET), "event_type", "ts", STREAMS, now(s, d))


q(
    "stream_health_grid",
    grid,
    f"""SELECT stream, display_name, stream_type, CASE WHEN sparse THEN 'Sparse' ELSE 'Regular' END AS data_pattern, last_record, records, status,
    CASE WHEN age IS NULL THEN 'No Data' WHEN sparse THEN format('{{:.1f}} hours ago', age / 3600) ELSE round(age)::INT // 60 || 'm ' || round(age)::INT % 60 || 's ago' END AS time_since_last,
    CASE WHEN sparse THEN warn // 3600 || 'h/' || critical // 3600 || 'h' ELSE warn // 60 || 'm/' || critical // 60 || 'm' END AS thresholds FROM ({GRID})""",
)
q(
    "stream_health_overall",
    lambda s, d: he.health_overall(grid(s, d)),
    f"""SELECT count(*) AS total_streams, count(*) FILTER (WHERE status = 'HEALTHY') AS healthy_count, count(*) FILTER (WHERE status = 'WARNING') AS warning_count,
    count(*) FILTER (WHERE status = 'CRITICAL') AS critical_count, CASE WHEN bool_or(status = 'CRITICAL') THEN 'CRITICAL' WHEN bool_or(status = 'WARNING') THEN 'WARNING' ELSE 'HEALTHY' END AS overall_status FROM ({GRID})""",
)
q(
    "event_metrics_report",
    lambda s, d: he.event_metrics(events(s, d), "ts", "event_type", ["click", "error"], now(s, d)),
    f"""SELECT count(*) FILTER (WHERE ts > {AS_OF} - INTERVAL 1 HOUR) AS events_last_hour, count(*) FILTER (WHERE ts > {AS_OF} - INTERVAL 24 HOURS) AS events_last_24_hours,
    count(*) FILTER (WHERE ts > {AS_OF} - INTERVAL 7 DAYS) AS events_last_7_days, count(*) FILTER (WHERE event_type = 'click' AND ts > {AS_OF} - INTERVAL 24 HOURS) AS click_24h,
    count(*) FILTER (WHERE event_type = 'error' AND ts > {AS_OF} - INTERVAL 24 HOURS) AS error_24h, max(ts) AS most_recent_event, 0.0::DOUBLE AS seconds_since_last_event FROM events""",
)


# ---- runs: each event is a run of its type's stream; a fifth fails, a fifth has not ended
def runs(s, d):
    n = F.col("event_id") % 5
    status = F.when(n == 0, "failed").when(n == 1, "running").otherwise("success")
    mark = F.when(n > 1, F.col("ts") - F.make_dt_interval(mins=(F.col("event_id") % 7).cast("int")))
    return events(s, d).select(F.col("event_id").alias("id"), F.col("event_type").alias("stream_id"), F.col("ts").alias("started_at"), status.alias("status"), (F.col("event_id") * 3).alias("rows_processed"), mark.alias("watermark_after"))


RUNS = """(SELECT event_id AS id, event_type AS stream_id, ts AS started_at, CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'success' END AS status, event_id * 3 AS rows_processed,
CASE WHEN event_id % 5 > 1 THEN ts - to_minutes((event_id % 7)::BIGINT) END AS watermark_after FROM events)"""
GRADE = "CASE WHEN age IS NULL THEN 'unknown' WHEN age < 300 THEN 'fresh' WHEN age < 1800 THEN 'stale' ELSE 'critical' END AS status"
SINCE = lambda: F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))
q(
    "run_status",
    lambda s, d: he.run_status(runs(s, d), now(s, d), "id"),
    f"""WITH r AS (SELECT * FROM {RUNS}), l AS (SELECT DISTINCT ON (stream_id) * FROM r ORDER BY stream_id, started_at DESC, id DESC),
    n AS (SELECT stream_id, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed FROM r WHERE started_at > {AS_OF} - INTERVAL 24 HOURS GROUP BY 1)
    SELECT stream_id, id, started_at, status, rows_processed, watermark_after, coalesce(total, 0) AS runs_total, coalesce(succeeded, 0) AS runs_succeeded, coalesce(failed, 0) AS runs_failed FROM l FULL JOIN n USING (stream_id)""",
)
q(
    "run_history",
    lambda s, d: he.run_history(runs(s, d), "click", 25, "id", SINCE(), "failed"),
    f"SELECT * FROM {RUNS} WHERE stream_id = 'click' AND started_at > '2024-01-20' AND status = 'failed' ORDER BY started_at DESC, id DESC LIMIT 25",
)
q(
    "run_history_summary",
    lambda s, d: he.run_history_summary(runs(s, d), "click", SINCE(), "failed"),
    f"SELECT count(*) AS total_available, min(started_at) AS oldest, max(started_at) AS newest FROM {RUNS} WHERE stream_id = 'click' AND started_at > '2024-01-20' AND status = 'failed'",
)


def tables_and_streams(s, d):
    """Tables with what is known of the newest run, streams by their watermarks."""
    o = table(s, d, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("t"))
    r = runs(s, d)
    silver = he.table_freshness({"events": (events(s, d), "ts"), "orders": (o, "t"), "none": (o.where("t IS NULL"), "t")}, now(s, d))
    bronze = he.bronze_freshness(r, now(s, d))
    return silver.unionByName(bronze).withColumn("last_etl_run", F.when(F.col("layer") == "silver", he.latest_success(r, "id", "id")))


q(
    "table_freshness",
    tables_and_streams,
    f"""WITH t AS (SELECT 'silver' AS layer, 'events' AS name, max(ts) AS latest, count(*) AS row_count FROM events UNION ALL SELECT 'silver', 'orders', max(o_orderdate)::TIMESTAMP, count(*) FROM orders
    UNION ALL SELECT 'bronze', stream_id, arg_max(watermark_after, (started_at, watermark_after)), NULL FROM {RUNS} WHERE watermark_after IS NOT NULL GROUP BY stream_id)
    SELECT layer, name, latest, row_count, age AS age_seconds, {GRADE}, CASE WHEN layer = 'silver' THEN (SELECT id FROM {RUNS} WHERE status = 'success' ORDER BY started_at DESC, id DESC LIMIT 1) END AS last_etl_run
    FROM (SELECT *, floor({AGE.format('latest')})::BIGINT AS age FROM t)""",
)


def statistics(s, d):
    """Statistics of the events, where each brand of parts stands for a rule on a column named by its first letters."""
    rules = table(s, d, "part").select(F.when(F.col("p_partkey") % 4 > 0, F.col("p_brand")).alias("column_name"))
    return he.table_stats(events(s, d), "ts", rules)


q(
    "table_stats",
    statistics,
    "SELECT count(*) AS row_count, min(ts) AS oldest, max(ts) AS newest, (SELECT count(*) FROM part) AS total_rules, (SELECT count(DISTINCT CASE WHEN p_partkey % 4 > 0 THEN p_brand END) FROM part) AS columns_with_rules FROM events",
)

# ---- readers
q(
    "read_since_prefix",
    lambda s, d: ac.read_since(events(s, d), "2024-01-25", source="event_type", prefix="s").select("event_id"),
    "SELECT event_id FROM events WHERE ts >= '2024-01-25' AND starts_with(event_type, 's')",
)


def ranges(s, d):
    """The named ranges of one entity together."""
    told = [ac.relative_range(events(s, d), name, now(s, d), "user_id", 8).select("event_id", F.lit(name).alias("name")) for name in ("current", *ac.RANGES)]
    return told[0].unionByName(told[1]).unionByName(told[2]).unionByName(told[3])


q(
    "relative_ranges",
    ranges,
    f"""SELECT * FROM (SELECT event_id, 'current' AS name FROM events WHERE user_id = 8 ORDER BY ts DESC, event_id DESC LIMIT 1) UNION ALL
    SELECT event_id, name FROM events, (VALUES ('last_hour', 1), ('last_24h', 24), ('last_7d', 168)) r(name, hours) WHERE user_id = 8 AND ts >= {AS_OF} - to_hours(hours)""",
)


def alert_ranges(s, d):
    alerts = events(s, d).where("event_type = 'error'").select("event_id", (F.col("user_id") % 4).alias("location_id"), F.when(F.col("value") > 20, "active").otherwise("resolved").alias("status"), F.col("ts").alias("triggered_at"))
    told = [ac.alerts_of(alerts, 2, name, now(s, d)).select("event_id", F.lit(name).alias("name")) for name in ("active", "last_24h", "last_7d", "ever")]
    return told[0].unionByName(told[1]).unionByName(told[2]).unionByName(told[3])


q(
    "alerts_by_range",
    alert_ranges,
    f"""SELECT event_id, name FROM events, (VALUES ('active', 0), ('last_24h', 24), ('last_7d', 168)) r(name, hours) WHERE event_type = 'error' AND user_id % 4 = 2
    AND CASE name WHEN 'active' THEN value > 20 ELSE ts >= {AS_OF} - to_hours(hours) END""",
)
q(
    "sample_between",
    lambda s, d: ac.sample(events(s, d), [F.desc("ts"), "event_id"], 500, "2024-01-05", "2024-01-15").select("event_id", "ts"),
    "SELECT event_id, ts FROM events WHERE ts > '2024-01-05' AND ts < '2024-01-15' ORDER BY ts DESC, event_id LIMIT 100",
)


def stores(s, d):
    """A hot and a cold store that share rows; some keys are null in both."""
    e = events(s, d).select("event_id", F.when(F.col("user_id") % 9 > 0, F.col("user_id")).alias("source_id"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("timestamp"))
    return ac.hybrid(e.where("event_id % 3 = 0"), e.where("event_id % 2 = 0"), ["source_id", "timestamp"])


STORE = "(SELECT event_id, CASE WHEN user_id % 9 > 0 THEN user_id END AS source_id, date_trunc('minute', ts) AS timestamp FROM events)"
q(
    "hybrid_stores",
    stores,
    f"""WITH e AS (SELECT * FROM {STORE}) SELECT * FROM e WHERE event_id % 3 = 0 UNION ALL SELECT * FROM e c WHERE event_id % 2 = 0
    AND NOT EXISTS (SELECT 1 FROM e h WHERE h.event_id % 3 = 0 AND h.source_id IS NOT DISTINCT FROM c.source_id AND h.timestamp = c.timestamp)""",
)


def last_page(s, d):
    """The page after the newest bucket that was processed, told by a table of those."""
    hours = events(s, d).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket"), "user_id").agg(F.count("*").alias("n"))
    done = events(s, d).where("event_id % 2 = 0 AND ts < '2024-01-12'").agg(F.max(F.date_trunc("hour", "ts"))).scalar()
    return ac.next_page(hours, done, ["bucket", "user_id"])


q(
    "next_page",
    last_page,
    """SELECT date_trunc('hour', ts) AS bucket, user_id, count(*) AS n FROM events WHERE date_trunc('hour', ts) > (SELECT max(date_trunc('hour', ts)) FROM events WHERE event_id % 2 = 0 AND ts < '2024-01-12')
    GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 100""",
)


def readings(s, d):
    o = table(s, d, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp_ntz"))
    return ac.latest_readings([
        ("event", events(s, d), "user_id", "ts", "event_type", {"kind": "event_type", "event": "event_id"}),
        ("order", o, "o_custkey", "t", None, {"order": "o_orderkey", "status": "o_orderstatus"}),
    ])


q(
    "latest_readings_json",
    readings,
    """SELECT 'event' AS data_type, user_id::VARCHAR AS id, ts AS observation_time, event_type AS location, '{"kind":"' || event_type || '","event":' || event_id || '}' AS metrics FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, metrics DESC) = 1 UNION ALL
    SELECT 'order', o_custkey::VARCHAR, o_orderdate::TIMESTAMP, NULL, '{"order":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' AS metrics FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, metrics DESC) = 1""",
)
q(
    "recent_signals_models",
    lambda s, d: ac.recent_signals(
        events(s, d).select("event_id", F.col("ts").alias("signal_time"), (F.col("user_id") % 40).alias("model_id")),
        table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("model_id"), F.col("n_name").alias("model_name"), F.col("n_regionkey").cast("long").alias("model_version")), now(s, d),
    ),
    f"""SELECT event_id, ts AS signal_time, user_id % 40 AS model_id, n_name AS model_name, n_regionkey::BIGINT AS model_version FROM events LEFT JOIN nation ON n_nationkey = user_id % 40
    WHERE ts > {AS_OF} - INTERVAL 24 HOURS""",
)


def positions(s, d):
    held = table(s, d, "lineitem").select(
        F.col("l_partkey").alias("symbol"), F.when(F.col("l_linestatus") == "O", "OPEN").otherwise("CLOSED").alias("status"), F.col("l_quantity").cast("double").alias("quantity"),
        F.col("l_extendedprice").cast("double").alias("entry_price"), F.col("l_tax").cast("double").alias("realized_pnl"), F.col("l_discount").cast("double").alias("unrealized_pnl"),
    )
    told = ac.position_summary(held)
    return told.select("symbol", *[r6(c).alias(c) for c in told.columns[1:]])


q(
    "open_positions",
    positions,
    """SELECT l_partkey AS symbol, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END)::DOUBLE, 8) + 0 AS open_quantity,
    round(avg(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END)::DOUBLE, 8) + 0 AS avg_entry_price, round(sum(l_tax)::DOUBLE, 8) + 0 AS total_realized_pnl,
    round(sum(CASE WHEN l_linestatus = 'O' THEN l_discount ELSE 0 END)::DOUBLE, 8) + 0 AS total_unrealized_pnl FROM lineitem GROUP BY 1""",
)
KIND = {"state_transition_count": "event_type = 'click'", "threshold_crossing_count": "event_type = 'error'", "rising_threshold_count": "event_type = 'error' AND value > 20"}
q(
    "events_hourly_kinds",
    lambda s, d: ac.events_hourly(ac.of_domain(events(s, d), ["click", "error", "view"], "event_type"), "ts", "event_type", {n: F.expr(c) for n, c in KIND.items()}, "user_id", "event_type"),
    f"""SELECT date_trunc('hour', ts) AS bucket, count(*) AS total_events, {", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in KIND.items())}, count(DISTINCT user_id) AS distinct_entities_with_events,
    count(DISTINCT event_type) AS distinct_streams_with_events FROM events WHERE event_type IN ('click', 'error', 'view') GROUP BY 1""",
)


# ---- a graph of customers and parts in which some nodes are missing
def edges(s, d):
    line = table(s, d, "orders").join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return line.select(F.col("o_custkey").alias("source"), (F.lit(10000000) + F.col("l_partkey")).alias("target"), F.col("l_returnflag").alias("edge_type"))


def nodes(s, d):
    some = table(s, d, "customer").where("c_custkey % 10 > 0").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("node_type"))
    return some.unionByName(table(s, d, "part").where("p_partkey % 8 > 0").select((F.lit(10000000) + F.col("p_partkey")).alias("id"), F.lit("part").alias("node_type")))


EDGES = "(SELECT o_custkey AS source, 10000000 + l_partkey AS target, l_returnflag AS edge_type FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
NODES = "(SELECT c_custkey AS id, 'customer' AS node_type FROM customer WHERE c_custkey % 10 > 0 UNION ALL SELECT 10000000 + p_partkey, 'part' FROM part WHERE p_partkey % 8 > 0)"
q(
    "graph_edge_check",
    lambda s, d: ac.checked_edges(edges(s, d), nodes(s, d)).groupBy("missing").agg(F.count("*").alias("n"), F.min("source").alias("low")),
    f"""SELECT missing, count(*) AS n, min(source) AS low FROM (SELECT source, CASE WHEN source NOT IN (SELECT id FROM {NODES}) THEN source::VARCHAR WHEN target NOT IN (SELECT id FROM {NODES}) THEN target::VARCHAR END AS missing
    FROM {EDGES}) GROUP BY 1""",
)
q(
    "graph_counts",
    lambda s, d: ac.count_by_type(nodes(s, d), "node_type").unionByName(ac.count_by_type(nodes(s, d), "node_type", "part")).unionByName(ac.count_by_type(edges(s, d), "edge_type", "R")),
    f"SELECT count(*) AS n FROM {NODES} UNION ALL SELECT count(*) FROM {NODES} WHERE node_type = 'part' UNION ALL SELECT count(*) FROM {EDGES} WHERE edge_type = 'R'",
)
q(
    "silver_stats_observed",
    lambda s, d: he.table_stats(obs(s, d).where("value IS NOT NULL"), "ts"),
    f"SELECT count(*) AS row_count, min(ts) AS oldest, max(ts) AS newest FROM {OBS} WHERE value IS NOT NULL",
)


# ---- CSV rows as points: a file without header, cut by semicolons, with values of all types and bad rows
def csv_file(s, d):
    path, n = new_path(s, "points"), F.col("event_id")
    odd = F.when(n % 11 == 0, F.concat(n, F.lit("f"))).when(n % 11 == 1, F.lit("TRUE")).when(n % 11 == 2, F.lit("")).when(n % 11 == 3, F.lit("inf")).when(n % 11 == 4, F.lit('"a;b"')).otherwise(F.concat(n, F.lit(".5")))
    time = F.when(n % 13 == 0, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")).otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    line = F.concat_ws(";", time, n.cast("string"), odd, *[F.when(n % 17 == 0, F.lit("more"))])
    events(s, d).select(line).write.text(path)
    return path


def points(s, d):
    told = tb.csv_points(s, csv_file(s, d), "col_0", sep=";", header=False, on_error="log", fields=3)
    good = told.where("error IS NULL").select(F.col("timestamp").cast("timestamp_ntz").alias("ts"), F.get_json_object("payload", "$.col_1").cast("long").alias("event_id"), F.get_json_object("payload", "$.col_2").alias("x"), F.schema_of_variant(F.variant_get(F.parse_json("payload"), "$.col_2", "variant")).alias("kind"), F.lit(True).alias("good"))
    bad = told.where("error IS NOT NULL").select(F.lit(None).cast("timestamp_ntz").alias("ts"), F.regexp_extract("error", "^([a-z ]+):", 1).alias("x"))
    return good.withColumn("kind", F.regexp_extract("kind", "^[A-Z]+", 0)).unionByName(bad, allowMissingColumns=True).withColumn("good", F.coalesce("good", F.lit(False)))


q(
    "csv_points",
    points,
    """SELECT date_trunc('second', ts) AS ts, event_id, CASE event_id % 11 WHEN 0 THEN event_id || 'f' WHEN 1 THEN 'true' WHEN 2 THEN NULL WHEN 3 THEN '0' WHEN 4 THEN 'a;b' ELSE event_id || '.5' END AS x,
    CASE event_id % 11 WHEN 0 THEN 'STRING' WHEN 1 THEN 'BOOLEAN' WHEN 2 THEN 'VOID' WHEN 3 THEN 'BIGINT' WHEN 4 THEN 'STRING' ELSE 'DECIMAL' END AS kind, true AS good FROM events WHERE event_id % 13 > 0 AND event_id % 17 > 0
    UNION ALL SELECT NULL, NULL, CASE WHEN event_id % 17 = 0 THEN 'another number of fields' ELSE 'no time' END, NULL, false FROM events WHERE event_id % 13 = 0 OR event_id % 17 = 0""",
)


def cascaded(s, d):
    """Bars of six hours from bars of an hour from bars of a minute."""
    keys = ["symbol", "exchange"]
    six = bars.coarser(bars.coarser(bars.ohlcv(ticks(s, d), "1 minute", keys, "time", "event_id"), "1 hour", keys), "6 hours", keys)
    return six.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), *keys, "open", "high", "low", "close", "volume", "trades_count")


q(
    "ohlcv_coarser",
    cascaded,
    """SELECT time_bucket(INTERVAL 6 HOURS, ts) AS bucket, event_type AS symbol, user_id % 3 AS exchange, arg_min(value, (ts, event_id)) AS open, max(value + k) AS high, min(value - 1) AS low,
    arg_max(k, (ts, event_id)) AS close, sum(event_id)::BIGINT AS volume, sum(event_id % 7)::BIGINT AS trades_count FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY 1, 2, 3""",
)


def looked_back(s, d):
    """State changes of two days, from states at most a day older."""
    goals = F.broadcast(s.createDataFrame(OBJECTIVES, OBJ_SCHEMA))
    found = ev.detect(states(s, d), long_metrics(s, d), goals, "user_id", "ts", "event_type", "event_id", "2024-01-10 00:00:00", "2024-01-12 00:00:00", lookback="1 DAY")
    return found.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high"))


RECENT = "FROM (SELECT * FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-09' AND TIMESTAMP '2024-01-12')"
q(
    "detect_events_lookback",
    looked_back,
    f"""SELECT event_type, user_id, count(*) AS n, min(ts) AS low, max(ts) AS high FROM (SELECT 'state_transition' AS event_type, user_id, ts FROM ({TRANS.replace("FROM events", RECENT)})
    WHERE is_actual_transition AND from_state IS NOT NULL UNION ALL SELECT 'threshold_crossing', user_id, ts FROM ({CROSS.replace("FROM events", RECENT)})) WHERE ts >= '2024-01-10' GROUP BY 1, 2""",
)


def texts(s, d):
    return ac.latest_text([("events", events(s, d), "ts", ["event_type", "props"]), ("orders", table(s, d, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp_ntz")), "t", ["o_orderstatus", "o_orderpriority"])])


q(
    "latest_text_fields",
    texts,
    """SELECT DISTINCT ON (source_stream, field_name) time, source_stream, field_name, value FROM (
    SELECT ts AS time, 'events' AS source_stream, unnest(['event_type', 'props']) AS field_name, unnest([event_type, props]) AS value FROM events UNION ALL
    SELECT o_orderdate::TIMESTAMP, 'orders', unnest(['o_orderstatus', 'o_orderpriority']), unnest([o_orderstatus, o_orderpriority]) FROM orders) WHERE value IS NOT NULL ORDER BY source_stream, field_name, time DESC, value DESC""",
)
q(
    "unpivot_metrics",
    lambda s, d: ac.unpivot_reading(obs(s, d).withColumn("k", F.get_json_object("props", "$.k")), ["event_id", "ts"], {"pm25": "value", "co2": "k"}),
    f"""SELECT event_id, ts, 'pm25' AS metric, value FROM {OBS} WHERE value IS NOT NULL UNION ALL SELECT event_id, ts, 'co2', CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM {OBS} WHERE json_extract_string(props, '$.k') IS NOT NULL""",
)
