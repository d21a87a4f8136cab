"""Loads that are logged, killed and run again; merges into partitions; sketches; profiles."""

import contextlib
import datetime as dt

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ann_index, bars, profiles, runs
from ..session import new_path
from ..sources import lake, tables as tb
from ..streaming import rollups as st
from .base import OBS, events, obs, q, r6
from .catalog import table
from .q_alerts import LATE
from .q_sources import Q20, bronze, knn


# ---- sketches: hours made by a stream whose rows come shuffled over all time, merged into days
def quantiles(s, d):
    rows = events(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    hours = st.drain_updates(st.turns(rows, 3, "event_id", "ts")[:3], lambda x: st.sketched(x, "1 hour", LATE, ["event_type"]), ["bucket", "event_type"], "sketches")
    days = st.merged(hours, "1 day", ["event_type"], {"p50": 0.5, "p95": 0.95})
    known = rows.select("event_type", F.window("ts", "1 day").start.alias("bucket"), "value")
    ranks = [F.avg((F.col("value") <= F.col(p)).cast("double")).alias(f"rank_{p}") for p in ("p50", "p95")]
    share = known.join(days, ["bucket", "event_type"]).groupBy("bucket", "event_type").agg(*ranks)
    near = [(F.abs(F.col(f"rank_{p}") - x) <= 0.02 + 1 / F.col("n")).alias(f"{p}_near") for p, x in (("p50", 0.5), ("p95", 0.95))]
    return days.join(share, ["bucket", "event_type"]).select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "event_type", "n", r6("total").alias("total"), "low", "high", *near)


q("stream_rollup_quantiles", quantiles, """SELECT date_trunc('day', ts) AS bucket, event_type, count(*) AS n, round(sum(value), 8) + 0 AS total, min(value) AS low, max(value) AS high,
true AS p50_near, true AS p95_near FROM events GROUP BY 1, 2""")  # fmt: skip


# ---- run logs that runs write
class Broken(Exception):
    pass


def logged(s, d):
    """Three loads of two streams; the second load of a stream breaks while it is written, then is run again."""
    log, out = new_path(s, "log"), new_path(s, "logged")
    e = obs(s, d)

    def load(stream, low, high, broken=False):
        rows = e.where((F.col("event_type") == stream) & (F.col("ts") >= low) & (F.col("ts") < high))
        if broken:
            rows = rows.withColumn("value", F.when(F.col("value") > 500, F.raise_error(F.lit("out of order"))).otherwise(F.col("value")))
        with contextlib.suppress(Exception):
            runs.logged_run(rows, log, stream, "ts", lambda df: df.write.mode("append").parquet(out), F.col("value").isNull(), "backfill" if broken else "incremental")

    for stream in ("view", "click"):
        load(stream, "2024-01-01", "2024-01-11")
        load(stream, "2024-01-11", "2024-01-21", broken=True)
        load(stream, "2024-01-11", "2024-01-21")
    return runs.read_log(s, log), s.read.parquet(out)


def written_log(s, d):
    log, out = logged(s, d)
    told = log.groupBy("stream", "status", "run_mode", "watermark_before", "watermark_after").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("rows_read", "rows_written", "rows_dropped")])
    rows = out.groupBy(F.col("event_type").alias("stream")).agg(F.count("*").alias("stored"))
    marks = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("watermark_before", "watermark_after")]
    return told.join(rows, "stream").select("stream", "status", "run_mode", *marks, "n", "rows_read", "rows_written", "rows_dropped", "stored")


q("run_log_written", written_log, f"""WITH r AS (SELECT event_type AS stream, ts, value, ts >= '2024-01-11' AS later FROM {OBS} WHERE event_type IN ('view', 'click') AND ts < '2024-01-21'),
c AS (SELECT stream, later, count(*) AS n, count(value) AS written, max(ts) AS newest FROM r GROUP BY 1, 2), m AS (SELECT stream, max(newest) FILTER (WHERE NOT later) AS one, max(newest) AS two FROM c GROUP BY 1),
l AS (SELECT stream, 'started' AS status, 'incremental' AS run_mode, NULL AS b, NULL AS a, NULL AS later FROM m UNION ALL SELECT stream, 'completed', 'incremental', NULL, one, false FROM m
UNION ALL SELECT stream, 'started', 'backfill', one, NULL, NULL FROM m UNION ALL SELECT stream, 'failed', 'backfill', one, NULL, NULL FROM m
UNION ALL SELECT stream, 'started', 'incremental', one, NULL, NULL FROM m UNION ALL SELECT stream, 'completed', 'incremental', one, two, true FROM m)
SELECT l.stream, status, run_mode, b AS watermark_before, a AS watermark_after, 1::BIGINT AS n, c.n AS rows_read, written AS rows_written, c.n - written AS rows_dropped,
(SELECT sum(written)::BIGINT FROM c x WHERE x.stream = l.stream) AS stored FROM l LEFT JOIN c ON c.stream = l.stream AND c.later = l.later""")  # fmt: skip


# ---- catching up in chunks; the run is killed after its third chunk, and in its fourth between the rows and their mark
def caught_up(s, d):
    source, target, marks = bronze(s, d), new_path(s, "caught"), new_path(s, "marks")
    newest = events(s, d).agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    common = (s, source, target, marks, "all", newest, dt.timedelta(days=10), dt.timedelta(days=2))
    lake.catch_up(*common, most=3)

    def killed(df):
        df.select("event_id", "user_id").write.mode("overwrite").parquet(f"{target}/stream=all/chunk=3")
        raise Broken

    with contextlib.suppress(Broken):
        lake.catch_up(*common, transform=killed)
    lake.catch_up(*common)
    again = lake.catch_up(*common)
    return s.read.parquet(target).select("event_id", "user_id", F.lit(again).alias("again"))


q("catch_up_replay", caught_up, "SELECT event_id, user_id, 0 AS again FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 10 DAYS")


# ---- upserts that read and write only the dates of a batch; each batch comes twice
def merged_dates(s, d):
    path = new_path(s, "dates")
    rows = events(s, d).select("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("date"), "event_id", "value")
    old, new = rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1 AND date >= '2024-01-20'")
    for name, batch in (("old", old), ("new", new), ("old", old), ("new", new)):
        lake.merge_dates(s, path, batch, ["user_id", "date"], ["event_id"], name, "date")
    return s.read.parquet(path).select("user_id", F.col("date").alias("day"), "event_id", "value")


q("sink_upsert_dates", merged_dates, """WITH r AS (SELECT user_id, date_trunc('day', ts) AS day, event_id, value FROM events), o AS (SELECT * FROM r WHERE event_id % 2 = 0
QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY event_id DESC) = 1), n AS (SELECT * FROM r WHERE event_id % 2 = 1 AND day >= '2024-01-20'
QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY event_id DESC) = 1)
SELECT user_id, day, coalesce(n.event_id, o.event_id) AS event_id, coalesce(n.value, o.value) AS value FROM o FULL JOIN n USING (user_id, day)""")  # fmt: skip


# ---- bars of rows that are bars already, by symbol and venue
def ticks(s, d):
    k = F.get_json_object("props", "$.k").cast("double")
    return events(s, d).select("event_id", F.col("ts").cast("timestamp").alias("time"), F.col("event_type").alias("symbol"), (F.col("user_id") % 3).alias("exchange"), F.col("value").alias("open"), (F.col("value") + k).alias("high"), (F.col("value") - 1).alias("low"), k.alias("close"), F.col("event_id").alias("volume"), (F.col("event_id") % 7).alias("trades_count"), (F.col("value") / 100).alias("spread_pct"))


for name, grain, volatile in (("ohlcv_1min", "1 minute", False), ("ohlcv_5min", "5 minutes", False), ("ohlcv_1hour_volatility", "1 hour", True)):
    extra = ["price_volatility"] * volatile
    q(
        name,
        lambda s, d, grain=grain, extra=extra: bars.ohlcv(ticks(s, d), grain, ["symbol", "exchange"], "time", "event_id", bool(extra)).select(
            F.col("bucket").cast("timestamp_ntz").alias("bucket"), "symbol", "exchange", "open", "high", "low", "close", "volume", "trades_count", *[r6(c).alias(c) for c in ("avg_spread_pct", *extra)]
        ),
        f"""SELECT time_bucket(INTERVAL {grain}, ts) AS bucket, event_type AS symbol, user_id % 3 AS exchange, arg_min(value, (ts, event_id)) AS open, max(value + k) AS high, min(value - 1) AS low, arg_max(k, (ts, event_id)) AS close,
        sum(event_id)::BIGINT AS volume, sum(event_id % 7)::BIGINT AS trades_count, round(avg(value / 100), 8) + 0 AS avg_spread_pct{", round(stddev_samp(k), 8) + 0 AS price_volatility" if extra else ""}
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY 1, 2, 3""",
    )


def scaled(s, d):
    """Both scalings by type and back; the values of one type are constant."""
    e = obs(s, d).withColumn("value", F.when(F.col("event_type") == "error", 7.5).otherwise(F.col("value")))
    both = e.join(bars.fit_scaler(e, "value", ["event_type"]), "event_type")
    x, mean, std, low, high = (F.col(c) for c in ("value", "mean", "std", "low", "high"))
    z, m = bars.standard(x, mean, std), bars.minmax(x, low, high)
    return both.select("event_id", r6(z).alias("z"), r6(m).alias("m"), F.round(bars.from_standard(z, mean, std), 6).alias("from_z"), F.round(bars.from_minmax(m, low, high), 6).alias("from_m"))


q("scaler_round_trip", scaled, f"""WITH e AS (SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 7.5::DOUBLE ELSE value END AS value FROM {OBS})
SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 8) + 0 END AS z, CASE WHEN event_type = 'error' THEN 0 ELSE round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 8) + 0 END AS m,
round(value, 6) AS from_z, round(value, 6) AS from_m FROM e WINDOW w AS (PARTITION BY event_type)""")  # fmt: skip

q(
    "sliding_window_stream",
    lambda s, d: st.drain(st.sliding(st.events_stream(s, f"{d}/events.parquet"), "2 hours", "1 hour", "4 hours", ["event_type"]), "sliding").select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "event_type", "n", r6("total").alias("total")),
    """SELECT date_trunc('hour', ts) - to_hours(k::INT) AS bucket, event_type, count(*) AS n, round(sum(value), 8) + 0 AS total FROM events, (SELECT unnest([0, 1]) AS k)
    WHERE date_trunc('hour', ts) - to_hours(k::INT) + INTERVAL 2 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 4 HOURS GROUP BY 1, 2""",
)


# ---- profiles of nested payloads
def nested(s, d):
    n = F.col("event_id")
    body = F.struct(
        F.when(n % 4 > 0, n).alias("a"),
        F.struct(F.when(n % 3 > 0, F.col("value")).otherwise(F.lit(None)).alias("x"), F.struct(F.lit("t").alias("z")).alias("y")).alias("o"),
        F.when(n % 2 == 0, F.array(F.struct(n.alias("q")), F.struct(F.lit(None).cast("long").alias("q")))).alias("l"),
    )
    text = F.when(n % 10 == 0, F.lit("[1]")).when(n % 10 == 5, F.lit('{"a":"text","only":true}')).otherwise(F.to_json(body, {"ignoreNullFields": "false"}))
    return events(s, d).select(text.alias("payload"))


PROFILE = """SELECT path, count(*) AS n, count(*) FILTER (WHERE t = 'null') AS n_null, array_to_string(list_sort(list(DISTINCT t)), ',') AS types FROM (
SELECT unnest(CASE WHEN event_id % 10 = 5 THEN ['a', 'only'] ELSE ['a', 'o', 'o.x', 'o.y', 'o.y.z', 'l'] || CASE WHEN event_id % 2 = 0 THEN ['l[]', 'l[]', 'l[].q', 'l[].q'] ELSE [] END END) AS path,
unnest(CASE WHEN event_id % 10 = 5 THEN ['string', 'boolean'] ELSE [CASE WHEN event_id % 4 > 0 THEN 'integer' ELSE 'null' END, 'object', CASE WHEN event_id % 3 = 0 OR value IS NULL THEN 'null' ELSE 'number' END, 'object', 'string',
CASE WHEN event_id % 2 = 0 THEN 'array' ELSE 'null' END] || CASE WHEN event_id % 2 = 0 THEN ['object', 'object', 'integer', 'null'] ELSE [] END END) AS t FROM events WHERE event_id % 10 > 0) GROUP BY 1"""
q(
    "payload_profile_nested",
    lambda s, d: profiles.payload_profile(nested(s, d), "payload").select("path", "n", "n_null", r6("null_share").alias("null_share"), F.array_join("types", ",").alias("types")),
    f"SELECT path, n, n_null, round(n_null / n, 8) + 0 AS null_share, types FROM ({PROFILE})",
)
q(
    "gap_status",
    lambda s, d: profiles.gap_report(profiles.payload_profile(nested(s, d), "payload"), ["a", "o.x", "o.y.z", "l[0].q", "gone.deep"]),
    f"""SELECT coalesce(p.field, m.field) AS field, CASE WHEN m.field IS NULL THEN 'extra' WHEN p.field IS NULL THEN 'missing' ELSE 'matching' END AS status, 'partial' AS overall
    FROM (SELECT DISTINCT regexp_extract(path, '^[^.\\[]+') AS field FROM ({PROFILE})) p FULL JOIN (SELECT unnest(['a', 'o', 'l', 'gone']) AS field) m ON p.field = m.field""",
)
q("latest_timestamp_newest", lambda s, d: tb.latest_timestamp(s, bronze(s, d)), "SELECT max(ts) AS ts FROM events")


def dimension_file(s, d):
    """A file in which some rows have too few or too many fields."""
    path, n = new_path(s, "dimension"), F.col("c_custkey")
    short, long = F.concat_ws(";", n, F.lit("x")), F.concat_ws(";", n, F.lit("x"), F.lit("yes"), F.lit("more"))
    fit = F.concat_ws(";", n, "c_mktsegment", F.when(n % 2 == 0, "Yes").otherwise("f"))
    line = F.when(n % 5 == 0, short).when(n % 7 == 0, long).otherwise(fit)
    # each file of a folder begins with the header
    lines = table(s, d, "customer").select(line.alias("line"), n.alias("n"), F.spark_partition_id().alias("p"))
    heads = lines.select("p").distinct().select(F.lit("key;segment;even").alias("line"), F.lit(-1).cast("long").alias("n"), "p")
    lines.unionByName(heads).repartition(F.col("p")).sortWithinPartitions("p", "n").select("line", "p").write.partitionBy("p").text(path)
    return f"{path}/*"


q(
    "dimension_widths",
    lambda s, d: tb.read_dimension(s, dimension_file(s, d), {"key": "bigint", "segment": "string", "even": "boolean"}, ";", "skip"),
    "SELECT c_custkey AS key, c_mktsegment AS segment, c_custkey % 2 = 0 AS even FROM customer WHERE c_custkey % 5 > 0 AND c_custkey % 7 > 0",
)


# ---- a stored index of all vectors; each twentieth one is a query
def indexed(s, d):
    path = new_path(s, "index")
    ann_index.build_index(table(s, d, "embeddings"), path)
    return path


q("knn_ann_index", lambda s, d: ann_index.search_index(Q20(s, d), indexed(s, d), 10))


def index_recall(s, d):
    """Whether nine of ten exact neighbours are found, and at most a tenth of the vectors are read whole for a query."""
    path = indexed(s, d)
    share = ann_index.open_index(s, path)[0].share
    exact, near = knn(s, d), ann_index.search_index(Q20(s, d), path, 10).select("query_id", "vec_id")
    both = exact.join(near.withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return both.agg((F.count("hit") >= 0.9 * F.count("*")).alias("enough")).withColumn("few", F.lit(share <= 0.1))


q("knn_ann_index_recall", index_recall, "SELECT true AS enough, true AS few")


# ---- one date laid out anew, and logged loads of a dimension
def laid_out(s, d):
    path = bronze(s, d)
    tb.rewrite_date(s, path, (2024, 1, 5), "user_id")
    rows = s.read.parquet(path).select("day", "user_id", "ts", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("n"))
    w = W.partitionBy("file").orderBy("n")
    before, same = F.lag("user_id").over(w), F.lag("user_id").over(w) == F.col("user_id")
    told = rows.withColumn("sorted", before.isNull() | (before < F.col("user_id")) | (same & (F.lag("ts").over(w) >= F.col("ts"))))
    files = told.groupBy("user_id", "day").agg(F.count_distinct("file").alias("files"), F.count("*").alias("n"), F.bool_and("sorted").alias("sorted"))
    of_day = F.col("day") == 5
    return files.groupBy("day").agg(F.sum("n").alias("n"), F.bool_and(F.col("sorted") | ~of_day).alias("sorted"), F.max(F.when(of_day, F.col("files")).otherwise(1)).alias("files"))


q("sort_layout_date", laid_out, "SELECT day(ts)::INT AS day, count(*)::BIGINT AS n, true AS sorted, 1::BIGINT AS files FROM events GROUP BY 1")


def dimension_runs(s, d):
    """A dimension loaded twice; the second load breaks, and readers still find the first."""
    path, log, c = new_path(s, "nations"), new_path(s, "sync"), table(s, d, "customer")
    runs.logged_run(c.where("c_custkey % 2 = 0"), log, "customer", None, lambda df: tb.replace_table(s, df, path))
    bad = c.withColumn("c_name", F.when(F.col("c_custkey") == 1, F.raise_error(F.lit("bad row"))).otherwise(F.col("c_name")))
    with contextlib.suppress(Exception):
        runs.logged_run(bad, log, "customer", None, lambda df: tb.replace_table(s, df, path), run_mode="full")
    told = runs.read_log(s, log)
    rows = told.select("status", "run_mode", "rows_written", F.lit(False).alias("latest")).unionByName(runs.latest_runs(told).select("status", "run_mode", "rows_written", F.lit(True).alias("latest")))
    return rows.withColumn("stored", F.lit(s.read.parquet(path).count()))


q("dim_sync_runs", dimension_runs, """WITH n AS (SELECT count(*) AS stored FROM customer WHERE c_custkey % 2 = 0)
SELECT status, run_mode, CASE WHEN status = 'completed' THEN stored END AS rows_written, latest, stored FROM n, (VALUES ('started', 'incremental', false), ('completed', 'incremental', false),
('started', 'full', false), ('failed', 'full', false), ('failed', 'full', true)) v(status, run_mode, latest)""")  # fmt: skip
