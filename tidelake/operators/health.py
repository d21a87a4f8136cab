"""How fresh streams, entities and tables are, and how their runs went.

Every function takes ``as_of``, a column with the time of the report: a literal, or ``newest(df, time)``, a scalar
subquery, so no report depends on the clock. Times may be with or without zone, but both sides of one kind.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR = 3600


def newest(df: DataFrame, time: str) -> Column:
    """The largest time of a table as a scalar."""
    return df.agg(F.max(time)).scalar()


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def age_seconds(as_of: Column, time: str) -> Column:
    """Seconds between ``time`` and ``as_of``, with fractions; null where there is no time."""
    return (_micros(as_of) - _micros(F.col(time))) / 1_000_000


def graded(age: Column, grades: Iterable[tuple[str, float]], worst: str, missing: str | None = None) -> Column:
    """The first grade whose bound (in seconds, exclusive) is above the age, else ``worst``; ``missing`` (or worst) without an age."""
    found = F.when(age.isNull(), missing or worst)
    for name, bound in grades:
        found = found.when(age < bound, name)
    return found.otherwise(worst)


# ---- entities
def entity_freshness(df: DataFrame, entity: str, time: str, as_of: Column, fresh_hours: float = 18, stale_hours: float = 36) -> DataFrame:
    """``entity, last_event, hours_since_event, status`` (FRESH, STALE or CRITICAL); an entity without any time is CRITICAL."""
    age = age_seconds(as_of, "last_event")
    status = graded(age, (("FRESH", fresh_hours * HOUR), ("STALE", stale_hours * HOUR)), "CRITICAL")
    last = df.groupBy(entity).agg(F.max(time).alias("last_event"))
    return last.select(entity, "last_event", (age / HOUR).alias("hours_since_event"), status.alias("status"))


def freshness_overall(freshness: DataFrame, entity: str) -> DataFrame:
    """One row about the rows of ``entity_freshness``: the worst status, how many entities have each, and the largest age in
    hours. Rows without an entity count for the status and the age only; no rows at all are CRITICAL."""
    counts = [F.count(F.when(F.col("status") == s, F.col(entity))).alias(f"{s.lower()}_count") for s in ("CRITICAL", "STALE", "FRESH")]
    has = {s: F.count_if(F.col("status") == s) > 0 for s in ("CRITICAL", "STALE", "FRESH")}
    worst = F.when(has["CRITICAL"], "CRITICAL").when(has["STALE"], "STALE").when(has["FRESH"], "FRESH").otherwise("CRITICAL")
    return freshness.agg(
        worst.alias("overall_status"), F.count(entity).alias("entity_count"), *counts, F.round(F.max("hours_since_event"), 1).alias("max_hours_since_event")
    )


def sensor_status(df: DataFrame, entity: str, time: str, as_of: Column) -> DataFrame:
    """``entity, age_seconds`` (whole seconds) and ``status``: online below 5 minutes, degraded below 15, else offline."""
    last = df.groupBy(entity).agg(F.max(time).alias("__last"))
    age = F.floor(age_seconds(as_of, "__last"))
    return last.select(entity, age.alias("age_seconds"), graded(age, (("online", 300), ("degraded", 900)), "offline").alias("status"))


# ---- streams
@dataclass(frozen=True)
class Stream:
    """What is expected of a stream: after how many seconds without a row it is late (``warn``) and broken (``critical``). A
    sparse stream only has rows when something happens, so its newest row counts whatever its age."""

    stream: str
    display_name: str
    stream_type: str
    warn: int
    critical: int
    sparse: bool = False


def stream_health(df: DataFrame, stream: str, time: str, streams: list[Stream], as_of: Column) -> DataFrame:
    """A row for each expected stream, the worst first: its newest row, how long ago that was, its rows of the last day (of
    all days if it is sparse), HEALTHY, WARNING or CRITICAL, and its thresholds. One pass over the rows; a stream without
    rows in that time has no data and is CRITICAL."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([tuple(vars(s).values()) for s in streams], "stream string, display_name string, stream_type string, warn int, critical int, sparse boolean")
    sparse = [s.stream for s in streams if s.sparse]
    recent = F.col(time) >= as_of - F.expr("INTERVAL 24 HOURS")
    rows = df.where(F.col(stream).isin(*[s.stream for s in streams]) & (recent | F.col(stream).isin(*sparse)))
    seen = rows.groupBy(F.col(stream).alias("stream")).agg(F.max(time).alias("last_record"), F.count("*").alias("records"))
    age = age_seconds(as_of, "last_record")
    whole = F.round(age).cast("int")
    since = F.when(age.isNull(), "No Data").when(F.col("sparse"), F.format_string("%.1f hours ago", age / HOUR)).otherwise(F.format_string("%dm %ds ago", F.floor(whole / 60), whole % 60))
    unit, letter = F.when(F.col("sparse"), HOUR).otherwise(60), F.when(F.col("sparse"), "h").otherwise("m")
    bounds = F.concat_ws("/", *[F.concat(F.floor(F.col(c) / unit).cast("string"), letter) for c in ("warn", "critical")])
    status = F.when(age.isNull() | (age > F.col("critical")), "CRITICAL").when(age > F.col("warn"), "WARNING").otherwise("HEALTHY")
    rank = F.when(age.isNull(), 0).when(status == "CRITICAL", 1).when(status == "WARNING", 2).otherwise(3)
    told = wanted.join(seen, "stream", "left").select(
        "stream", "display_name", "stream_type", F.when(F.col("sparse"), "Sparse").otherwise("Regular").alias("data_pattern"), "last_record", since.alias("time_since_last"),
        F.coalesce("records", F.lit(0)).alias("records"), status.alias("status"), bounds.alias("thresholds"), rank.alias("__rank"), "sparse",
    )
    return told.orderBy("__rank", "sparse", "stream").drop("__rank", "sparse")


def health_overall(health: DataFrame) -> DataFrame:
    """One row about the rows of ``stream_health``: how many streams there are of each status, and the worst; HEALTHY without any."""
    counts = {s: F.count_if(F.col("status") == s) for s in ("HEALTHY", "WARNING", "CRITICAL")}
    worst = F.when(counts["CRITICAL"] > 0, "CRITICAL").when(counts["WARNING"] > 0, "WARNING").otherwise("HEALTHY")
    return health.agg(F.count("*").alias("total_streams"), *[c.alias(f"{s.lower()}_count") for s, c in counts.items()], worst.alias("overall_status"))


def event_metrics(df: DataFrame, time: str, kind: str, kinds: list[str], as_of: Column) -> DataFrame:
    """One row: events of the last hour, day and week, those of each kind in the last day, the newest and the seconds since it."""
    after = {h: F.col(time) > as_of - F.expr(f"INTERVAL {h} HOURS") for h in (1, 24, 168)}
    told = df.agg(
        *[F.count_if(after[h]).alias(name) for h, name in ((1, "events_last_hour"), (24, "events_last_24_hours"), (168, "events_last_7_days"))],
        *[F.count_if((F.col(kind) == k) & after[24]).alias(f"{k}_24h") for k in kinds],
        F.max(time).alias("most_recent_event"),
    )
    return told.withColumn("seconds_since_last_event", age_seconds(as_of, "most_recent_event"))


# ---- tables
FRESH = (("fresh", 300), ("stale", 1800))


def table_freshness(tables: dict[str, tuple[DataFrame, str]], as_of: Column) -> DataFrame:
    """``layer, name, latest, row_count, age_seconds, status`` of each table (name: rows and time column); empty tables are left
    out, one with rows but no time is unknown."""
    told = None
    for name, (df, time) in tables.items():
        one = df.agg(F.max(time).alias("latest"), F.count("*").alias("row_count")).select(F.lit("silver").alias("layer"), F.lit(name).alias("name"), "latest", "row_count")
        told = one if told is None else told.unionByName(one)
    if told is None:
        raise ValueError("no tables")
    age = F.floor(age_seconds(as_of, "latest"))
    return told.where("row_count > 0").select("*", age.alias("age_seconds"), graded(age, FRESH, "critical", "unknown").alias("status"))


def bronze_freshness(runs: DataFrame, as_of: Column) -> DataFrame:
    """The same columns for streams, by the watermark of their newest run that has one (``stream_id, started_at, watermark_after``)."""
    marked = runs.where("watermark_after IS NOT NULL").groupBy("stream_id").agg(F.max_by("watermark_after", F.struct("started_at", "watermark_after")).alias("latest"))
    age = F.floor(age_seconds(as_of, "latest"))
    return marked.select(
        F.lit("bronze").alias("layer"), F.col("stream_id").alias("name"), "latest", F.lit(None).cast("long").alias("row_count"), age.alias("age_seconds"),
        graded(age, FRESH, "critical", "unknown").alias("status"),
    )


def table_stats(df: DataFrame, time: str, rules: DataFrame | None = None) -> DataFrame:
    """One row: ``row_count, oldest, newest`` of a table; with its rules (one row each, column in ``column_name``, null for rules
    across columns) also ``total_rules`` and ``columns_with_rules``."""
    told = df.agg(F.count("*").alias("row_count"), F.min(time).alias("oldest"), F.max(time).alias("newest"))
    if rules is None:
        return told
    return told.select("*", rules.agg(F.count("*")).scalar().alias("total_rules"), rules.agg(F.count_distinct("column_name")).scalar().alias("columns_with_rules"))


# ---- runs: stream_id, started_at, status and whatever else a log has
def run_status(runs: DataFrame, as_of: Column, tie: str) -> DataFrame:
    """The newest run of each stream with all its columns (``tie`` decides among equal starts), and ``runs_total``,
    ``runs_succeeded`` and ``runs_failed`` of the last day, in one pass over the runs. Runs without a stream are left out."""
    rest = [c for c in runs.columns if c != "stream_id"]
    late = F.col("started_at") > as_of - F.expr("INTERVAL 24 HOURS")
    of_day = [F.count_if(late & x).alias(n) for x, n in ((F.lit(True), "runs_total"), (F.col("status") == "success", "runs_succeeded"), (F.col("status") == "failed", "runs_failed"))]
    order = F.struct(F.col("started_at").isNotNull(), "started_at", tie)
    found = runs.where("stream_id IS NOT NULL").groupBy("stream_id").agg(F.max_by(F.struct(*rest), order).alias("__run"), *of_day)
    return found.select("stream_id", *[F.col("__run")[c].alias(c) for c in rest], "runs_total", "runs_succeeded", "runs_failed")


def _runs(runs: DataFrame, stream: str, since: Column | None, status: str | None) -> DataFrame:
    rows = runs.where(F.col("stream_id") == stream)
    rows = rows if since is None else rows.where(F.col("started_at") > since)
    return rows if status is None else rows.where(F.col("status") == status)


def run_history(runs: DataFrame, stream: str, limit: int, tie: str, since: Column | None = None, status: str | None = None) -> DataFrame:
    """The newest runs of a stream, started after ``since`` and of one status if told; at most ``limit``."""
    return _runs(runs, stream, since, status).orderBy(F.desc("started_at"), F.desc(tie)).limit(limit)


def run_history_summary(runs: DataFrame, stream: str, since: Column | None = None, status: str | None = None) -> DataFrame:
    """One row about all such runs: ``total_available, oldest, newest``."""
    return _runs(runs, stream, since, status).agg(F.count("*").alias("total_available"), F.min("started_at").alias("oldest"), F.max("started_at").alias("newest"))


def latest_success(runs: DataFrame, column: str, tie: str) -> Column:
    """A column of the newest run that succeeded, as a scalar; null if none did."""
    return runs.where("status = 'success'").agg(F.max_by(column, F.struct("started_at", tie))).scalar()
