"""Stores, sinks, run logs, repairs, embeddings and predictions."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import dq, features as ft, routing, runs, vectors as vx
from ..session import new_path
from ..sources import tables as tb
from ..streaming import rollups as st
from .base import OBS, events, obs, q, r6
from .catalog import table
from .q_scalars import FLAGS, flagged
from .q_sources import EWMA, Q20, SIM, bronze, knn

q(
    "sample_bronze",
    lambda s, d: tb.sample_newest(s, bronze(s, d), 10).select("event_id", "value"),
    "SELECT event_id, value FROM events WHERE ts::DATE = (SELECT max(ts)::DATE FROM events) ORDER BY ts DESC, event_id LIMIT 10",
)


# ---- CSV
def broken_csv(s, d):
    """Events as CSV; the value of each seventh row is text."""
    path = new_path(s, "csv")
    value = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("bad"), "event_id")).otherwise(F.col("value").cast("string"))
    events(s, d).select("event_id", value.alias("value"), "event_type", (F.col("event_id") % 2 == 0).alias("even")).write.option("header", True).csv(path)
    return path


CSV_SCHEMA = "event_id LONG, value DOUBLE, event_type STRING, even BOOLEAN"


def by_policy(s, d):
    """What each policy keeps of a file with bad rows."""
    path = broken_csv(s, d)
    skipped = tb.read_csv(s, path, on_error="skip", schema=CSV_SCHEMA).select(F.lit("skip").alias("policy"), F.col("event_id").cast("string").alias("row"))
    good, bad = tb.quarantined(tb.read_csv(s, path, on_error="log", schema=CSV_SCHEMA))
    logged = good.select(F.lit("log").alias("policy"), F.col("event_id").cast("string").alias("row"))
    return skipped.unionByName(logged).unionByName(bad.select(F.lit("quarantine").alias("policy"), F.col(tb.CORRUPT).alias("row")))


q("csv_on_error", by_policy, """SELECT unnest(['skip', 'log']) AS policy, event_id::VARCHAR AS row FROM events WHERE event_id % 7 > 0
UNION ALL SELECT 'quarantine', event_id || ',bad' || event_id || ',' || event_type || ',' || (event_id % 2 = 0) FROM events WHERE event_id % 7 = 0""")  # fmt: skip
q(
    "scan_csv_dimension",
    lambda s, d: tb.read_dimension(s, broken_csv(s, d), {"value": "double", "event_id": "bigint", "even": "boolean"}).select("event_id", "value", "even"),
    "SELECT event_id, value, event_id % 2 = 0 AS even FROM events WHERE event_id % 7 > 0",
)


def symbols(s, d):
    """One folder per priority, read back with the places of the rows in their file."""
    path = new_path(s, "symbols")
    tb.extract_keys(table(s, d, "orders"), path, "o_orderpriority", ["1-URGENT", "2-HIGH"], "o_orderkey")
    rows = s.read.parquet(path).select("o_orderpriority", "o_orderkey", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("n"))
    w = W.partitionBy("file").orderBy("n")
    told = rows.withColumn("sorted", F.coalesce(F.col("o_orderkey") >= F.lag("o_orderkey").over(w), F.lit(True)))
    return told.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"), F.bool_and("sorted").alias("sorted"))


q("extract_symbols", symbols, "SELECT o_orderpriority, count(*) AS n, 1::BIGINT AS files, true AS sorted FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")


# ---- lifecycle of stores
def after_retention(s, d):
    path = bronze(s, d)
    tb.drop_expired(s, path, "2024-01-31 00:00:00", 7)
    return s.read.parquet(path).groupBy("day").agg(F.count("*").alias("n"))


q("retention", after_retention, "SELECT day(ts)::INT AS day, count(*) AS n FROM events WHERE ts::DATE >= DATE '2024-01-24' GROUP BY 1")


def replaced(s, d):
    path = new_path(s, "dimension")
    table(s, d, "nation").write.parquet(path)
    counts = tb.replace_table(s, table(s, d, "customer").select("c_custkey", "c_name"), path)
    return s.read.parquet(path).select("c_custkey", "c_name", *[F.lit(n).cast("long").alias(c) for c, n in counts.items()])


q("dim_truncate_load", replaced, "SELECT c_custkey, c_name, (SELECT count(*) FROM nation) AS deleted, (SELECT count(*) FROM customer) AS loaded FROM customer")
q(
    "dim_sync_log",
    lambda s, d: runs.sync_log(table(s, d, "customer").where("c_custkey % 3 > 0"), table(s, d, "customer").where("c_custkey % 4 > 0"), "customer", ["c_custkey"]),
    """SELECT 'customer' AS table_name, count(*) FILTER (WHERE c_custkey % 3 > 0) AS rows_before, count(*) FILTER (WHERE c_custkey % 4 > 0) AS rows_after,
    count(*) FILTER (WHERE c_custkey % 3 = 0 AND c_custkey % 4 > 0) AS inserted, count(*) FILTER (WHERE c_custkey % 3 > 0 AND c_custkey % 4 = 0) AS deleted, 'completed' AS status FROM customer""",
)


def loads(s, d):
    """Loads of a day of a stream; loads in which a value is out of range fail."""
    e = obs(s, d).select((F.col("user_id") % 5).alias("stream"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("batch"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.coalesce(F.col("value") > 1500, F.lit(False)).alias("bad"))
    return runs.run_rows(e, "stream", "batch", "ts", "bad")


LOADS = f"SELECT user_id % 5 AS stream, date_trunc('day', ts) AS batch, min(ts) AS a, max(ts) AS z, count(*) AS n, count(*) FILTER (WHERE value > 1500) AS bad FROM {OBS} GROUP BY 1, 2"
q("run_log", loads, f"""SELECT stream, batch, 'started' AS status, a AS at, NULL::BIGINT AS rows_read, NULL::BIGINT AS rows_failed, NULL::TIMESTAMP AS watermark FROM ({LOADS})
UNION ALL SELECT stream, batch, CASE WHEN bad > 0 THEN 'failed' ELSE 'completed' END, z, n, bad, CASE WHEN bad = 0 THEN z END FROM ({LOADS})""")  # fmt: skip
q(
    "run_durations",
    lambda s, d: runs.run_durations(loads(s, d), "stream", "batch").select("stream", "batch", "status", "rows_read", "duration_ms"),
    f"SELECT stream, batch, CASE WHEN bad > 0 THEN 'failed' ELSE 'completed' END AS status, n::BIGINT AS rows_read, ((epoch_us(z) - epoch_us(a)) // 1000)::BIGINT AS duration_ms FROM ({LOADS})",
)


def written_clean(s, d):
    """Rows whose flags don't say drop are written; how many were is read from an observation of the write."""
    from pyspark.sql import Observation

    path, seen = new_path(s, "clean"), Observation()
    dropped, score = dq.result("flags", 4, ("null_check",))
    rows = flagged(s, d).select("event_id", "event_type", dropped.alias("dropped"), score.alias("score"))
    rows.where(~F.col("dropped")).observe(seen, F.count("*").alias("written")).write.parquet(path)
    return s.read.parquet(path).select("event_id", "score", F.lit(seen.get["written"]).cast("long").alias("written"))


q("sink_batch_skip_dropped", written_clean, f"""SELECT event_id, greatest(0.0::DOUBLE, 1 - len(flags) / 4) AS score, count(*) OVER () AS written FROM ({FLAGS}) WHERE NOT list_contains(flags, 'null_check:value:missing')""")


def backfilled(s, d):
    """A store filled from a date on, day by day, by upserts; a second run of the same range changes nothing."""
    from ..operators import merge

    rows = obs(s, d).where("ts >= '2024-01-20'").select("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_id", dq.reject("value", 0.0, 500.0).alias("value"))
    empty = rows.where("false")
    once = merge.upsert(empty, rows, ["user_id", "day"], ["event_id"])
    return merge.upsert(once, rows, ["user_id", "day"], ["event_id"])


q("backfill", backfilled, f"""SELECT user_id, date_trunc('day', ts) AS day, event_id, CASE WHEN value BETWEEN 0 AND 500 THEN value END AS value FROM {OBS} WHERE ts >= '2024-01-20'
QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_id DESC) = 1""")  # fmt: skip

# ---- streams
q(
    "sink_bronze",
    lambda s, d: st.drain_by_day(st.events_stream(s, f"{d}/events.parquet"), "sink").select("event_id", "year", "month", "day"),
    "SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day FROM events",
)
TOTALS = "SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n, round(sum(value), 8) + 0 AS total FROM events"


def repaired(s, d):
    """A rollup made when a third of the rows hadn't come, refreshed two days later."""
    e = events(s, d)
    early = e.where("event_id % 3 > 0 AND ts < '2024-01-20'").withColumn("ts", F.col("ts").cast("timestamp"))
    first = early.groupBy(F.window("ts", "1 hour").start.alias("bucket"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    done = st.repaired(first, e, "2024-01-20 00:00:00", "48 HOURS", "1 HOURS", "1 hour", ["event_type"])
    return done.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "event_type", "n", r6("total").alias("total"))


q("late_data", repaired, f"""{TOTALS} WHERE ts >= '2024-01-18' AND ts < '2024-01-19 23:00:00' GROUP BY 1, 2
UNION ALL {TOTALS} WHERE event_id % 3 > 0 AND (ts < '2024-01-18' OR ts >= '2024-01-19 23:00:00' AND ts < '2024-01-20') GROUP BY 1, 2""")  # fmt: skip


def metrics(s, d):
    """Counts of a write by an observation, beside the row counts of what was written."""
    from pyspark.sql import Observation

    seen, path = Observation(), new_path(s, "subscribed")
    rows = events(s, d)
    marked = rows.withColumn("dropped", F.col("value") < 1)
    counted = marked.observe(seen, F.count_if(~F.col("dropped")).alias("processed"), F.count_if("dropped").alias("dropped"), F.max("ts").alias("high_water"))
    counted.where(~F.col("dropped")).drop("dropped").write.parquet(path)
    told = seen.get
    return s.read.parquet(path).agg(F.count("*").alias("written")).select(
        "written", F.lit(told["processed"]).cast("long").alias("processed"), F.lit(told["dropped"]).cast("long").alias("dropped"), F.lit(told["high_water"]).cast("timestamp_ntz").alias("high_water")
    )


q("subscriber_metrics", metrics, "SELECT count(*) FILTER (WHERE value >= 1) AS written, count(*) FILTER (WHERE value >= 1) AS processed, count(*) FILTER (WHERE value < 1) AS dropped, max(ts) AS high_water FROM events")


def notified(s, d):
    found = None
    for mode, fields in (("all", None), ("fields", ["k", "missing"]), ("none", [])):
        own = events(s, d).select("event_id", F.lit(mode).alias("mode"), routing.notification(F.col("props"), fields).alias("payload"))
        found = own if found is None else found.unionByName(own)
    return found


q("notify_projection", notified, """SELECT event_id, unnest(['all', 'fields', 'none']) AS mode,
unnest([props, '{"k":' || json_extract_string(props, '$.k') || '}', NULL]) AS payload FROM events""")  # fmt: skip

# ---- vectors
q(
    "knn_ann",
    lambda s, d: vx.knn_ann(Q20(s, d), table(s, d, "embeddings"), 10).groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").alias("last")),
    "SELECT vec_id AS query_id, 10::BIGINT AS n, 10 AS last FROM embeddings WHERE vec_id % 20 = 0",
)


def recall(s, d):
    exact, near = knn(s, d), vx.knn_ann(Q20(s, d), table(s, d, "embeddings"), 10)
    hits = exact.join(near.select("query_id", "vec_id"), ["query_id", "vec_id"]).agg(F.count("*").alias("hits"))
    return exact.agg(F.count("*").alias("all")).crossJoin(F.broadcast(hits)).select((F.col("hits") >= F.col("all") * 0.9).alias("enough"))


q("knn_ann_recall", recall, "SELECT true AS enough")


def stored(s, d):
    e = table(s, d, "embeddings")
    return e.select(
        "*", F.when(F.col("vec_id") % 3 == 0, "a").otherwise("b").alias("namespace"), F.when(F.col("vec_id") % 2 == 0, "metric").otherwise("event").alias("type"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("created_at"), F.when(F.col("vec_id") % 5 > 0, F.col("vec_id") * 60).alias("ttl_seconds"),
    )


q(
    "knn_filtered",
    lambda s, d: vx.knn_exact(Q20(s, d), vx.eligible(stored(s, d), "2024-01-01 02:00:00", "b", ["metric"]), 5, least=0.0).withColumn("similarity", r6("similarity")),
    f"""SELECT * FROM (SELECT a.vec_id AS query_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {SIM} DESC, b.vec_id) AS rank, b.vec_id AS vec_id, round({SIM}, 8) + 0 AS similarity
    FROM embeddings a JOIN (SELECT * FROM embeddings WHERE vec_id % 3 > 0 AND vec_id % 2 = 0 AND (vec_id % 5 = 0 OR vec_id * 60 > 7200)) b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 20 = 0 AND {SIM} >= 0) WHERE rank <= 5""",
)


def upserted(s, d):
    e = table(s, d, "embeddings").select(F.col("label").cast("long").alias("bucket"), (F.col("vec_id") % 7).alias("domain"), "vec_id", "embedding")
    old = ft.latest_per_key(e.where("vec_id % 2 = 0"), ["bucket", "domain"], ["vec_id"])
    broken = F.when(F.col("vec_id") % 11 == 1, F.array(F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding"))
    return vx.upsert_vectors(old, e.where("vec_id % 2 = 1").withColumn("embedding", broken), ["bucket", "domain"], ["vec_id"]).select("bucket", "domain", "vec_id", F.size("embedding").cast("long").alias("n"))


q("embedding_upsert", upserted, """WITH e AS (SELECT label::BIGINT AS bucket, vec_id % 7 AS domain, vec_id FROM embeddings),
o AS (SELECT bucket, domain, max(vec_id) AS vec_id FROM e WHERE vec_id % 2 = 0 GROUP BY 1, 2), n AS (SELECT bucket, domain, max(vec_id) AS vec_id FROM e WHERE vec_id % 2 = 1 AND vec_id % 11 <> 1 GROUP BY 1, 2)
SELECT bucket, domain, coalesce(n.vec_id, o.vec_id) AS vec_id, 64::BIGINT AS n FROM o FULL JOIN n USING (bucket, domain)""")  # fmt: skip

# ---- predictions: what followed the neighbours 1 and 5 steps later, under two objectives
GOALS = [("o1", ">=", 5.0, None), ("o2", "between", 2.0, 6.0)]


def goals(s):
    return s.createDataFrame(GOALS, "objective_id string, condition string, threshold double, threshold_upper double")


def outcomes(s, d):
    from ..functions.scalars import objective_violation

    steps = table(s, d, "embeddings").select("vec_id", F.col("label").cast("double").alias("level"))
    violated = objective_violation(F.col("level"), F.col("condition"), F.col("threshold"), F.col("threshold_upper"))
    return vx.neighbor_outcomes(knn(s, d, 10), steps, goals(s), [1, 5], violated)


NEAR = f"SELECT * FROM (SELECT a.vec_id AS query_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {SIM} DESC, b.vec_id) AS rank, b.vec_id AS vec_id FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank <= 10"
WRONG = "CASE objective_id WHEN 'o1' THEN e.label < 5 ELSE e.label < 2 OR e.label > 6 END"
OUTCOMES = f"""SELECT n.query_id, n.vec_id, horizon, objective_id, {WRONG} AS breached FROM ({NEAR}) n, (SELECT unnest([1, 5])::INT AS horizon) h, (SELECT unnest(['o1', 'o2']) AS objective_id) g
JOIN embeddings e ON e.vec_id = n.vec_id + horizon"""
q("neighbor_outcome_join", outcomes, OUTCOMES)
PREDICTED = ("query_id", "objective_id", "horizon")


def predictions(s, d):
    return vx.predict_breach(outcomes(s, d), keys=PREDICTED)


PREDICTIONS = f"""SELECT query_id, objective_id, horizon, n AS k_neighbors, y AS k_supporting, y / n AS confidence, y / n > 0.5 AS predicted_breach
FROM (SELECT query_id, objective_id, horizon, count(*) AS n, count(*) FILTER (WHERE breached) AS y FROM ({OUTCOMES}) GROUP BY 1, 2, 3) WHERE n >= 3 AND y / n >= 0.5"""
q("predict_breach", predictions, PREDICTIONS)


def evaluated(s, d):
    from ..functions.scalars import objective_violation

    made = predictions(s, d).withColumn("actual_breach", F.when(F.col("query_id") % 60 == 0, True))  # these are evaluated already
    steps = table(s, d, "embeddings").select(F.col("vec_id").alias("step"), F.col("label").cast("double").alias("level")).crossJoin(F.broadcast(goals(s)))
    actual = steps.select("step", "objective_id", objective_violation(F.col("level"), F.col("condition"), F.col("threshold"), F.col("threshold_upper")).alias("breached"))
    return vx.evaluate_outcomes(made, actual, 400).select("query_id", "objective_id", "horizon", "predicted_breach", "actual_breach", "correct")


EVALUATED = f"""SELECT p.query_id, p.objective_id, p.horizon, predicted_breach, {WRONG} AS actual_breach, predicted_breach = ({WRONG}) AS correct FROM ({PREDICTIONS}) p
JOIN embeddings e ON e.vec_id = p.query_id + p.horizon WHERE p.query_id % 60 > 0 AND p.query_id + p.horizon <= 400"""
q("evaluate_outcomes", evaluated, EVALUATED)
q(
    "prediction_accuracy",
    lambda s, d: evaluated(s, d).agg(F.count("*").alias("evaluated"), F.count_if("correct").alias("correct"), F.count_if(~F.col("correct")).alias("incorrect")),
    f"SELECT count(*) AS evaluated, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE NOT correct) AS incorrect FROM ({EVALUATED})",
)

# ---- embeddings of metrics and the feature matrix; a type of event is an entity, so that it has enough rows
BY_TYPE = EWMA.replace("PARTITION BY user_id", "PARTITION BY event_type").replace("SELECT event_id, user_id, value,", "SELECT event_id, event_type AS user_id, ts, value,").replace("SELECT event_id, user_id, n,", "SELECT event_id, user_id, n, ts,").replace("SELECT o.event_id, o.user_id, o.n,", "SELECT o.event_id, o.user_id, o.n, o.ts,")


def embedded(s, d):
    rows = obs(s, d).select("event_id", "event_type", "ts", "value", F.col("value").alias("again"))
    found = ft.embed_metrics(rows, "event_type", ["ts", "event_id"], "ts", [("value", "last_known"), ("again", "zero")])
    return found.select("event_id", F.size("embedding").cast("long").alias("n"), F.round(F.col("embedding")[0], 5).alias("hour_sin"), F.col("embedding")[2].alias("weekend"), F.round(F.col("embedding")[3], 5).alias("last_known"), F.round(F.col("embedding")[4], 5).alias("zero"))


q("embed_metric", embedded, BY_TYPE + """, f AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS known FROM r)
SELECT event_id, 5::BIGINT AS n, round(sin(hour(ts) * (2 * 3.141592653589793::DOUBLE / 24)), 5) AS hour_sin, (isodow(ts) > 5)::INT::DOUBLE AS weekend,
round(CASE WHEN known IS NULL OR sqrt(v) < 1e-10 THEN 0 ELSE (known - m) / sqrt(v) END, 5) AS last_known, round(CASE WHEN value IS NULL OR sqrt(v) < 1e-10 THEN 0 ELSE (value - m) / sqrt(v) END, 5) AS zero
FROM f WHERE n >= 168""")  # fmt: skip


def matrix(s, d):
    rows = events(s, d).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    found = ft.feature_matrix(rows, "event_type", ["ts", "event_id"], "ts", "value", {"humidity": "k"})
    return found.select("event_id", *[F.round(c, 5).alias(c) for c in ft.MATRIX])


RAW = """SELECT event_id, event_type, hour(ts)::DOUBLE AS hour, (isodow(ts) - 1)::DOUBLE AS day_of_week, (isodow(ts) > 5)::INT::DOUBLE AS is_weekend, value, 0.0::DOUBLE AS co2, 0.0::DOUBLE AS voc_index,
0.0::DOUBLE AS temperature, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS humidity, lag(value, 60, 0.0::DOUBLE) OVER w AS lag_1h, lag(value, 180, 0.0::DOUBLE) OVER w AS lag_3h,
lag(value, 1440, 0.0::DOUBLE) OVER w AS lag_24h, CASE WHEN count(*) OVER f = 60 THEN avg(value) OVER f END AS rolling_mean_1h, CASE WHEN count(*) OVER f = 60 THEN stddev_pop(value) OVER f END AS rolling_std_1h
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id), f AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"""
ZERO = ("co2", "voc_index", "temperature")
SCALED = ", ".join(
    f"0.0::DOUBLE AS {c}" if c in ZERO else f"coalesce(CASE WHEN {c} IS NOT NULL THEN CASE WHEN stddev_pop({c}) OVER p = 0 THEN 0 ELSE round(({c} - avg({c}) OVER p) / stddev_pop({c}) OVER p, 5) END END, 'nan'::DOUBLE) AS {c}" for c in ft.MATRIX
)
q("feature_matrix", matrix, f"SELECT event_id, {SCALED} FROM ({RAW}) WINDOW p AS (PARTITION BY event_type)")
q(
    "linear_slope",
    lambda s, d: ft.slope_over_index(events(s, d), "user_id", ["ts", "event_id"], "value").select("user_id", r6("slope").alias("slope")),
    """SELECT user_id, round(regr_slope(value, n), 8) + 0 AS slope FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events) GROUP BY 1""",
)
