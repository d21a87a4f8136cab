"""Run logs: rows of starts, completions and failures, and what they tell."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = (
    "run_id string, stream string, status string, run_mode string, at timestamp, rows_read long, rows_written long, rows_dropped long, "
    "watermark_before timestamp, watermark_after timestamp, error string"
)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a log; no rows before the first run."""
    try:
        return spark.read.schema(LOG).parquet(path)
    except Exception as e:  # the folder comes with the first row
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LOG)


def logged_run(rows: DataFrame, log: str, stream: str, time: str | None, write: Callable[[DataFrame], None], dropped: Column | None = None, run_mode: str = "incremental") -> str:
    """Write ``rows`` (but those for which ``dropped`` holds) by ``write`` and log it; returns the run's id.

    A ``started`` row comes before the write, a ``completed`` one after it with the counts that the write itself observed, or a ``failed`` one with
    the error, which is raised again. Rows without a ``time`` (None), as those of dimensions, have no watermark. A run's ``watermark_before`` is the newest one that a completed run of the stream reached; a failed run moves none.
    """
    spark, run = rows.sparkSession, uuid.uuid4().hex
    before = read_log(spark, log).where((F.col("stream") == stream) & (F.col("status") == "completed")).agg(F.max("watermark_after")).first()[0]

    def put(status: str, counts: dict, error: str | None = None) -> None:
        after = counts.get("newest") or before if status == "completed" else None
        row = (run, stream, status, run_mode, counts.get("read"), counts.get("written"), counts.get("dropped"), before, after, error)
        names = [f.split()[0] for f in LOG.split(", ") if f.split()[0] != "at"]
        types = ", ".join(f for f in LOG.split(", ") if f.split()[0] != "at")
        one = spark.createDataFrame([row], types).withColumn("at", F.current_timestamp())
        one.select(*names[:4], "at", *names[4:]).write.mode("append").parquet(log)

    put("started", {})
    seen, out = Observation(), F.coalesce(dropped, F.lit(False)) if dropped is not None else F.lit(False)
    marked = rows.withColumn("__dropped", out)
    counted = marked.observe(
        seen, F.count("*").alias("read"), F.count_if(~F.col("__dropped")).alias("written"), F.count_if("__dropped").alias("dropped"), (F.max(F.col(time).cast("timestamp")) if time else F.max(F.lit(None).cast("timestamp"))).alias("newest")
    )
    try:
        write(counted.where(~F.col("__dropped")).drop("__dropped"))
    except Exception as e:
        put("failed", {}, str(e)[:1000])
        raise
    put("completed", seen.get)
    return run


def latest_runs(log: DataFrame) -> DataFrame:
    """The newest row of each stream's log: where it stands."""
    rest = [c for c in log.columns if c != "stream"]
    rank = F.when(F.col("status") == "started", 0).otherwise(1)
    return log.groupBy("stream").agg(F.max_by(F.struct(*rest), F.struct("at", rank)).alias("row")).select("stream", "row.*")


def run_rows(batches: DataFrame, stream: str, batch: str, time: str, failed: str) -> DataFrame:
    """The log of loading each batch of a stream: a ``started`` row, and a ``completed`` or ``failed`` one with counts and
    watermarks. A batch fails if a row of it is marked as failed; a failed batch moves no watermark."""
    done = batches.groupBy(stream, batch).agg(
        F.min(time).alias("started_at"), F.max(time).alias("completed_at"), F.count("*").alias("rows_read"), F.count_if(failed).alias("rows_failed")
    )
    bad = F.col("rows_failed") > 0
    start = done.select(stream, batch, F.lit("started").alias("status"), F.col("started_at").alias("at"), *[F.lit(None).cast("long").alias(c) for c in ("rows_read", "rows_failed")], F.lit(None).cast("timestamp_ntz").alias("watermark"))
    end = done.select(
        stream, batch, F.when(bad, "failed").otherwise("completed").alias("status"), F.col("completed_at").alias("at"), "rows_read", "rows_failed",
        F.when(~bad, F.col("completed_at").cast("timestamp_ntz")).alias("watermark"),
    )
    return start.unionByName(end)


def run_durations(log: DataFrame, stream: str, batch: str) -> DataFrame:
    """One row per run: its status, duration in ms and rows, from the rows of its log."""
    begun = F.min(F.when(F.col("status") == "started", F.col("at"))).alias("started_at")
    ended = F.max(F.when(F.col("status") != "started", F.col("at"))).alias("completed_at")
    status = F.coalesce(F.max(F.when(F.col("status") != "started", F.col("status"))), F.lit("running")).alias("status")
    found = log.groupBy(stream, batch).agg(begun, ended, status, F.sum("rows_read").alias("rows_read"))
    ms = (F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000
    return found.withColumn("duration_ms", F.floor(ms).cast("long"))


def sync_log(before: DataFrame, after: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """What a load changed in a table: rows before and after, and keys that came and went."""
    old, new = before.select(*keys, F.lit(1).alias("was")), after.select(*keys, F.lit(1).alias("now"))
    both = old.join(new, keys, "full_outer")
    return both.agg(
        F.lit(table).alias("table_name"), F.count("was").alias("rows_before"), F.count("now").alias("rows_after"),
        F.count_if(F.col("was").isNull()).alias("inserted"), F.count_if(F.col("now").isNull()).alias("deleted"),
    ).withColumn("status", F.lit("completed"))
