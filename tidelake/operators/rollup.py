"""Bucketed rollups of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import time_bucket


def metric(name: str, field: str, time: str, tie: str) -> Column:
    """An aggregate by name; first and last break ties of time by ``tie``."""
    order = F.struct(time, tie)
    known = {
        "mean": lambda: F.avg(field),
        "std": lambda: F.stddev_samp(field),
        "min": lambda: F.min(field),
        "max": lambda: F.max(field),
        "count": lambda: F.count(field),
        "sum": lambda: F.sum(field),
        "p50": lambda: F.percentile(field, F.lit(0.5)),
        "p95": lambda: F.percentile(field, F.lit(0.95)),
        "p99": lambda: F.percentile(field, F.lit(0.99)),
        "first": lambda: F.min_by(field, order),
        "last": lambda: F.max_by(field, order),
    }
    return known[name]()


def rollup(df: DataFrame, granularity: str, keys: list[str], fields: dict[str, list[str]], time: str = "ts", tie: str = "event_id") -> DataFrame:
    """``bucket, keys, <field>_<metric>, sample_count`` with one shuffle on the keys and the bucket."""
    found = [metric(m, f, time, tie).alias(f"{f}_{m}") for f, names in fields.items() for m in names]
    return df.groupBy(time_bucket(time, granularity).alias("bucket"), *keys).agg(*found, F.count("*").alias("sample_count"))


def refresh_range(df: DataFrame, as_of: Column, start_offset: str, end_offset: str, granularity: str, time: str = "ts") -> DataFrame:
    """The rows whose bucket lies in [as_of - start_offset, as_of - end_offset): what an incremental refresh recomputes."""
    bucket = time_bucket(time, granularity)
    low, high = as_of - F.expr(f"INTERVAL {start_offset}"), as_of - F.expr(f"INTERVAL {end_offset}")
    return df.withColumn("__b", bucket).where((F.col("__b") >= low) & (F.col("__b") < high)).drop("__b")


COLLAPSE = {"sample_count": F.sum, "count": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.avg, "p95": F.max, "first": F.min, "last": F.max}


def bucket_collapse(df: DataFrame, bucket: str = "bucket") -> DataFrame:
    """(bucket, entity) rollups to one row per bucket; the column's suffix chooses the aggregate."""
    columns = [c for c, t in df.dtypes if c != bucket and t in ("double", "float", "int", "bigint")]
    suffix = {c: "sample_count" if c.endswith("sample_count") else c.rsplit("_", 1)[-1] for c in columns}
    return df.groupBy(bucket).agg(*[COLLAPSE.get(suffix[c], F.avg)(c).alias(c) for c in columns])


def corrected_stats(df: DataFrame, time: str, granularity: str, keys: list[str], corrected: str, raw: str) -> DataFrame:
    """``mean, high, low`` by bucket and keys of the corrected value, or the raw one where it is missing."""
    value = F.coalesce(corrected, raw)
    stats = [F.avg(value).alias("mean"), F.max(value).alias("high"), F.min(value).alias("low")]
    return df.groupBy(F.window(time, granularity).start.alias("bucket"), *keys).agg(*stats)


def aggregate(
    df: DataFrame, entity: str, ids: list | None, start: str | None, end: str | None, grain: str, metrics: dict[str, tuple[str, str]], time: str = "ts", tie: str = "event_id"
) -> DataFrame:
    """``bucket``, the entity and one column a metric (name: field and statistic) for some entities (None: all) within [start, end)
    (None: open), at any grain."""
    rows = df if ids is None else df.where(F.col(entity).isin(*ids))
    rows = rows if start is None else rows.where(F.col(time) >= start)
    rows = rows if end is None else rows.where(F.col(time) < end)
    told = [metric(statistic, field, time, tie).alias(name) for name, (field, statistic) in metrics.items()]
    return rows.groupBy(F.window(time, grain).start.alias("bucket"), entity).agg(*told)
