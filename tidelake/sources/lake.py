"""Loads that can be stopped and started again: catching up by chunks, and merging into date partitions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..session import stash
from .tables import scan_range, with_date_parts

MARKS = "stream string, chunk long, mark timestamp"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of rows that jobs append; none before the first."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def high_water_mark(spark: SparkSession, marks: str, stream: str) -> tuple[dt.datetime | None, int]:
    """Up to when a stream is caught up, and how many chunks that took."""
    row = _table(spark, marks, MARKS).where(F.col("stream") == stream).agg(F.max("mark"), F.max("chunk")).first()
    return row[0], -1 if row[1] is None else row[1]


def catch_up(
    spark: SparkSession, source: str, target: str, marks: str, stream: str, now: dt.datetime, window: dt.timedelta, step: dt.timedelta,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df, time: str = "ts", most: int | None = None,
) -> int:
    """Bring a stream's rows of a partitioned store into ``target``, in chunks of time: from its high-water mark, or where it has none from
    ``now`` less ``window``, up to ``now``. Returns how many chunks were written (at most ``most``).

    A chunk overwrites a folder of its own number, then its mark is appended. A run that was killed between the two writes the same
    chunk again, so each row comes once; only the partitions of a chunk's time are read.
    """
    since, chunk = high_water_mark(spark, marks, stream)
    low = since or now - window
    done = 0
    while low < now and (most is None or done < most):
        high, chunk = min(low + step, now), chunk + 1
        rows = scan_range(spark, source, str(low), str(high), time).where((F.col(time) > F.lit(low)) & (F.col(time) <= F.lit(high)))
        transform(rows).write.mode("overwrite").parquet(f"{target}/stream={stream}/chunk={chunk}")
        spark.createDataFrame([(stream, chunk, high)], MARKS).write.mode("append").parquet(marks)
        low, done = high, done + 1
    return done


COMMITS = "batch string"


def merge_dates(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], order: list[str], batch: str, time: str = "ts") -> bool:
    """Upsert a batch into a table that is partitioned by the date of ``time``: only the dates that the batch has are read and overwritten.
    Returns False for a batch that was committed before, which changes nothing. ``keys`` have to fix the date.

    The merged rows are written beside the table before they take their partitions' places; the commit is a row of its own
    beside the table. A run that was killed before it is simply run again. Rows can't have columns called year, month or day.
    """
    if taken := {"year", "month", "day"} & {c.lower() for c in rows.columns}:
        raise ValueError(f"columns {sorted(taken)} are those of the partitions")
    commits = path.rstrip("/") + "_commits"
    if _table(spark, commits, COMMITS).where(F.col("batch") == batch).count():
        return False
    new = with_date_parts(rows, time)
    dates = [tuple(r) for r in new.select("year", "month", "day").distinct().collect()]  # a row a date
    merged = stash(merge.upsert(affected(spark, path, dates, new), new, [*keys, "year", "month", "day"], order), "merge")
    columns = [c for c in new.columns if c not in ("year", "month", "day")]
    out = merged.select(*columns, "year", "month", "day").repartition("year", "month", "day")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month", "day").parquet(path)
    spark.createDataFrame([(batch,)], COMMITS).write.mode("append").parquet(commits)
    return True


def affected(spark: SparkSession, path: str, dates: list[tuple[int, int, int]], like: DataFrame) -> DataFrame:
    """The rows of some dates, by partition values; none where the table isn't there yet."""
    try:
        found = spark.read.schema(like.schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return like.where("false")
    number = F.col("year") * 10000 + F.col("month") * 100 + F.col("day")
    return found.where(number.isin([y * 10000 + m * 100 + d for y, m, d in dates])).select(*like.columns)
