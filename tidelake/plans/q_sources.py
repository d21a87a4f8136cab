"""Scans, sinks, streams, vectors and predictions."""

from pyspark.sql import functions as F

from ..operators import features as ft, vectors as vx
from ..session import new_path
from ..sources import tables as tb
from ..streaming import rollups as st
from .base import OBS, events, obs, q, r6
from .catalog import table


def bronze(s, d):
    path = new_path(s, "bronze")
    tb.write_bronze(events(s, d), path)
    return path


q("scan_bronze", lambda s, d: s.read.parquet(bronze(s, d)).select("event_id", "year", "month", "day"), "SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day FROM events")
q("scan_bronze_range", lambda s, d: tb.scan_range(s, bronze(s, d), "2024-01-05 00:00:00", "2024-01-08 00:00:00").where(F.col("event_type").startswith("c")).select("event_id"), "SELECT event_id FROM events WHERE ts BETWEEN '2024-01-05' AND '2024-01-08' AND event_type LIKE 'c%'")
q("scan_since", lambda s, d: events(s, d).where("ts >= '2024-01-25'").select("event_id"), "SELECT event_id FROM events WHERE ts >= '2024-01-25'")
q("latest_timestamp", lambda s, d: events(s, d).groupBy("event_type").agg(F.max("ts").alias("ts")), "SELECT event_type, max(ts) AS ts FROM events GROUP BY 1")
q("latest_partition", lambda s, d: tb.latest_partition(s, bronze(s, d)), "SELECT year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day FROM (SELECT max(ts) AS ts FROM events)")
q("bronze_storage_stats", lambda s, d: tb.storage_stats(s, bronze(s, d)).select("year", "month", "day", "rows", "files"), "SELECT year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, count(*) AS rows, 1::BIGINT AS files FROM events GROUP BY 1, 2, 3")


def csv_copy(s, d):
    path = new_path(s, "csv")
    events(s, d).select("event_id", "value", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at")).write.option("header", True).csv(path)
    return path


q("scan_csv", lambda s, d: tb.read_csv(s, csv_copy(s, d)).select(F.col("event_id").cast("long").alias("event_id"), tb.inferred("event_id").alias("a"), tb.inferred("event_type").alias("b")), "SELECT event_id, 'int' AS a, 'string' AS b FROM events")
q("csv_timestamp_formats", lambda s, d: tb.read_csv(s, csv_copy(s, d)).select(F.col("event_id").cast("long").alias("event_id"), tb.csv_timestamp("at", "epoch_seconds").alias("ts")), "SELECT event_id, make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) AS ts FROM events")


def jsonlines(s, d):
    path = new_path(s, "json")
    events(s, d).where("event_type = 'error'").select("event_id", "user_id", F.lit("alert").alias("kind")).write.json(path)
    return s.read.schema("event_id LONG, user_id LONG, kind STRING").json(path)


q("sink_jsonlines", jsonlines, "SELECT event_id, user_id, 'alert' AS kind FROM events WHERE event_type = 'error'")
q("sort_layout", lambda s, d: tb.sort_layout(events(s, d), "user_id").groupBy("user_id").agg(F.count("*").alias("n")), "SELECT user_id, count(*) AS n FROM events GROUP BY 1")





# streams
q("stream_source", lambda s, d: st.drain(st.events_stream(s, f"{d}/events.parquet").select("event_id", "event_type"), "stream"), "SELECT event_id, event_type FROM events")
q("stream_tumbling_rollup", lambda s, d: st.drain(st.tumbling(st.events_stream(s, f"{d}/events.parquet"), "1 hour", "4 hours", ["event_type"]), "tumbling").select("bucket", "event_type", "n", r6("total").alias("total")),
  "SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n, round(sum(value), 8) + 0 AS total FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 4 HOURS GROUP BY 1, 2")
q("stream_static_enrich", lambda s, d: st.drain(st.events_stream(s, f"{d}/events.parquet").join(table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id").select("event_id", "c_name"), "enrich"), "SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey")
q("sliding_window", lambda s, d: events(s, d).groupBy(F.window("ts", "2 hours", "1 hour").start.alias("bucket"), "event_type").agg(F.count("*").alias("n")),
  "SELECT date_trunc('hour', ts) - to_hours(k::INT) AS bucket, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2")






# vectors
Q20 = lambda s, d: table(s, d, "embeddings").where("vec_id % 20 = 0")
SIM = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
KNN = f"SELECT a.vec_id AS query_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {SIM} DESC, b.vec_id) AS rank, b.vec_id AS vec_id, round({SIM}, 8) + 0 AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0"


def knn(s, d, k=10, least=-1.0):
    return vx.knn_exact(Q20(s, d), table(s, d, "embeddings"), k, least=least).withColumn("similarity", r6("similarity"))


q("knn_exact", knn, f"SELECT * FROM ({KNN}) WHERE rank <= 10")
q("knn_topk", lambda s, d: knn(s, d, 5, 0.2), f"SELECT * FROM ({KNN}) WHERE rank <= 5 AND similarity >= 0.2")


def next_vectors(s, d):
    e = table(s, d, "embeddings")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")


NEXT = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
q("cosine_similarity", lambda s, d: next_vectors(s, d).select("vec_id", r6(vx.cosine_similarity("embedding", "other")).alias("x")), f"SELECT a.vec_id, round({SIM}, 8) + 0 AS x {NEXT}")
q("l2_distance", lambda s, d: next_vectors(s, d).select("vec_id", r6(vx.l2_distance("embedding", "other")).alias("x")), f"SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 8) + 0 AS x {NEXT}")
HALF = lambda c: F.transform(c, lambda x: x.cast("double") / 2)
q("poincare_distance", lambda s, d: next_vectors(s, d).withColumn("a", HALF("embedding")).withColumn("b", HALF("other")).select("vec_id", F.round(vx.poincare_distance("a", "b"), 6).alias("x")),
  f"SELECT vec_id, round(acosh(1 + 2 * g * g / ((1 - na) * (1 - nb))), 6) AS x FROM (SELECT a.vec_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / 2 AS g, list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) / 4 AS na, list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]) / 4 AS nb {NEXT})")
GAP = "list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
BALL = "(1 - list_inner_product({0}.embedding::DOUBLE[], {0}.embedding::DOUBLE[]) / 4)"
FAR = f"acosh(1 + {GAP} * {GAP} / 2 / ({BALL.format('a')} * {BALL.format('b')}))"
q("hyperbolic_knn", lambda s, d: vx.knn_exact(Q20(s, d), table(s, d, "embeddings"), 10, least=-1e9, score=vx.poincare_similarity(0.5)).select("query_id", "rank", "vec_id", F.round(-F.col("similarity"), 6).alias("distance")),
  f"SELECT * FROM (SELECT a.vec_id AS query_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {FAR}, b.vec_id) AS rank, b.vec_id AS vec_id, round({FAR}, 6) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank <= 10")










def stats(s, d):
    return ft.ewma(obs(s, d).select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"], "value", 0.01, 64)


EWMA = f"""WITH RECURSIVE o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {OBS}),
r AS (SELECT event_id, user_id, n, value AS m, 0.0::DOUBLE AS v, value FROM o WHERE n = 1 UNION ALL
SELECT o.event_id, o.user_id, o.n, CASE WHEN o.value IS NULL THEN r.m WHEN r.m IS NULL THEN o.value ELSE r.m + 0.01::DOUBLE * (o.value - r.m) END,
CASE WHEN o.value IS NULL OR r.m IS NULL THEN r.v ELSE 0.99::DOUBLE * (r.v + 0.01::DOUBLE * (o.value - r.m) * (o.value - r.m)) END, o.value FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1) """
q("ewma_stats", lambda s, d: stats(s, d).select("event_id", F.round(F.coalesce(F.nanvl("ewma_mean", F.lit(-1.0)), F.lit(-1.0)), 6).alias("m"), F.round("ewma_var", 6).alias("v")), EWMA + "SELECT event_id, round(coalesce(m, -1), 6) AS m, round(v, 6) AS v FROM r")
q("ewma_zscore", lambda s, d: stats(s, d).select("event_id", F.round(F.when(F.col("value").isNull(), 0.0).when(F.sqrt("ewma_var") < 1e-10, 0.0).otherwise((F.col("value") - F.col("ewma_mean")) / F.sqrt("ewma_var")), 5).alias("z")),
  EWMA + "SELECT event_id, round(CASE WHEN value IS NULL OR sqrt(v) < 1e-10 THEN 0 ELSE (value - m) / sqrt(v) END, 5) AS z FROM r")
