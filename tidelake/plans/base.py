"""Shapes that the queries derive from the given tables, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import ORACLES, QUERIES, table


def q(name: str, function, sql: str | None = None) -> None:
    QUERIES[name] = function
    if sql:
        ORACLES[name] = sql


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 8) + F.lit(0.0)


def events(s, d) -> DataFrame:
    return table(s, d, "events")


def obs(s, d) -> DataFrame:
    """Observations: a seventh of the values is missing, an eleventh ten times too large."""
    value = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 11 == 0, F.col("value") * 10).otherwise(F.col("value"))
    return events(s, d).withColumn("value", value)


OBS = "(SELECT event_id, ts, user_id, event_type, props, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN value * 10 ELSE value END AS value FROM events)"


def hourly(s, d) -> DataFrame:
    """(bucket, user_id) hourly mean of events; bucket as time without zone."""
    e = events(s, d)
    return e.groupBy(F.window("ts", "1 hour").start.alias("bucket"), "user_id").agg(F.avg("value").alias("v_mean"), F.count("*").alias("sample_count"))


HOURLY = "(SELECT date_trunc('hour', ts) AS bucket, user_id, avg(value) AS v_mean, count(*) AS sample_count FROM events GROUP BY 1, 2)"


def daily(s, d) -> DataFrame:
    """One row per day: mean of events."""
    return events(s, d).groupBy(F.to_date("ts").alias("bucket")).agg(F.avg("value").alias("value"))


def gappy(s, d) -> DataFrame:
    """Hourly means of each type; hours with a number divisible by 3 or 7 are missing."""
    h = events(s, d).groupBy("event_type", F.window("ts", "1 hour").start.alias("bucket")).agg(F.avg("value").alias("v"))
    n = F.floor(F.unix_timestamp(F.col("bucket").cast("timestamp")) / 3600)
    return h.withColumn("v", F.when((n % 3 == 0) | (n % 7 == 0), None).otherwise(F.round("v", 6)))


GAPPY = ("(SELECT event_type, bucket, CASE WHEN CAST(epoch(bucket) / 3600 AS BIGINT) % 3 = 0 OR CAST(epoch(bucket) / 3600 AS BIGINT) % 7 = 0 THEN NULL ELSE round(v, 6) END AS v "
         "FROM (SELECT event_type, date_trunc('hour', ts) AS bucket, avg(value) AS v FROM events GROUP BY 1, 2))")  # fmt: skip
