"""Joining streams in time: bucket alignment, as-of, range and source-priority joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import window_recommendation
from .ordering import in_ranges, last_known


def align(streams: list[DataFrame], how: str = "full_outer", bucket: str = "bucket") -> DataFrame:
    """Streams with one row per bucket side by side; a using-join keeps one bucket column."""
    return reduce(lambda a, b: a.join(b, bucket, how), streams)


def _both(left: DataFrame, right: DataFrame, left_time: str, right_time: str, keys: list[str], columns: list[str], tie: str) -> DataFrame:
    """Rows of both sides under one time: at equal times those of the right side come first."""
    own = left.select(*keys, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"))
    other = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(*columns).alias("__r"), F.col(tie).cast("long").alias("__tie"))
    return own.unionByName(other, allowMissingColumns=True)


def asof(left: DataFrame, right: DataFrame, left_time: str, right_time: str, keys: list[str], columns: list[str], tie: str) -> DataFrame:
    """Each left row with the columns of the newest right row at or before it; one shuffle, one pass, all left rows stay. A task takes
    all rows of a key; ``asof_spread`` is for keys too large for that."""
    w = W.partitionBy(*keys).orderBy("__t", "__side", "__tie").rowsBetween(W.unboundedPreceding, 0)
    found = _both(left, right, left_time, right_time, keys, columns, tie).withColumn("__last", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return found.select("__l.*", *[F.col(f"__last.{c}").alias(c) for c in columns])


def asof_spread(left: DataFrame, right: DataFrame, left_time: str, right_time: str, keys: list[str], columns: list[str], tie: str) -> DataFrame:
    """The same by ranges of key and time, so that one large key is spread over tasks; the newest right row of the ranges before is
    carried into each range."""
    rows = in_ranges(_both(left, right, left_time, right_time, keys, columns, tie), keys, ["__t", "__side", "__tie"], "asof")
    found = last_known(rows, keys, "__part", "__own", "__r", "__last").where("__side = 1")
    return found.select("__l.*", *[F.col(f"__last.{c}").alias(c) for c in columns])


def range_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, seconds: int, keys: list[str], how: str = "left") -> DataFrame:
    """Pairs whose times differ by at most so many seconds; a left join keeps rows without partner, each once.

    Cells of that width make it an equi-join: right rows are put into their own cell and both neighbours, so each
    left row meets a partner in one cell only. A left row without time, or with a null key, has no partner.
    """
    tag = "__cell"

    def cell(t: str) -> Column:
        return F.floor(F.unix_micros(F.col(t).cast("timestamp")) / F.lit(seconds * 1_000_000))

    renamed = [F.col(k).alias(f"__key_{k}") for k in keys]
    others = [c for c in right.columns if c not in keys]
    wide = right.select(*renamed, *others, F.explode(F.array(*[cell(right_time) + d for d in (-1, 0, 1)])).alias(tag))
    gap = F.abs(F.unix_micros(F.col(left_time).cast("timestamp")) - F.unix_micros(F.col(right_time).cast("timestamp")))
    same = [cell(left_time) == F.col(tag), gap <= seconds * 1_000_000, *[F.col(k) == F.col(f"__key_{k}") for k in keys]]
    return left.join(wide, same, how).select(*[left[c] for c in left.columns], *others)


def drop_secondary(secondary: DataFrame, primary: DataFrame, keys: list[str], time: str, seconds: int, always: Column) -> DataFrame:
    """Secondary points, without those that a primary point of the same key lies strictly closer to than the window."""
    marks = primary.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(time).cast("timestamp").cast("double").alias("__t"))
    cell = F.floor(F.col("__t") / seconds)
    marks = marks.withColumn("__cell", F.explode(F.array(cell - 1, cell, cell + 1))).distinct()
    own = F.col(time).cast("timestamp").cast("double")
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    near = [*same, F.floor(own / seconds) == F.col("__cell"), F.abs(own - F.col("__t")) < seconds, ~always]
    return secondary.join(marks, near, "left_anti")


def indoor_outdoor(indoor: DataFrame, outdoor: DataFrame, weather: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Indoor, outdoor and weather buckets side by side, with differences and whether to open the windows."""
    both = align([indoor, outdoor, weather], bucket=bucket)
    told = window_recommendation(F.col("indoor_pm25"), F.col("outdoor_pm25"), F.col("outdoor_temp"), F.col("outdoor_humidity"))
    return both.select(
        "*",
        (F.col("indoor_pm25") - F.col("outdoor_pm25")).alias("pm25_differential"),
        (F.col("indoor_temp") - F.col("outdoor_temp")).alias("temp_differential"),
        told.alias("recommendation"),
    )


def forecast_accuracy(forecasts: DataFrame, observations: DataFrame, keys: list[str], metrics: list[str], keep: list[str], flags: str = "dq_flags") -> DataFrame:
    """Forecasts with the observation of their valid time: values, absolute errors and biases (positive: too high) of
    each metric. Rows with quality flags on either side are left out; no flags and null flags are alike."""

    def clean(df: DataFrame) -> DataFrame:
        return df.where(F.col(flags).isNull() | (F.size(flags) == 0))

    one = clean(forecasts).select(*keys, *keep, *[F.col(m).alias(f"{m}_forecast") for m in metrics])
    two = clean(observations).select(*keys, *[F.col(m).alias(f"{m}_observed") for m in metrics])
    errors = []
    for m in metrics:
        bias = F.col(f"{m}_forecast") - F.col(f"{m}_observed")
        errors += [F.abs(bias).alias(f"{m}_error"), bias.alias(f"{m}_bias")]
    return one.join(two, keys).select("*", *errors)


def neighbors(edges: DataFrame, nodes: DataFrame, edge_type: str, types: list[str] | None = None) -> DataFrame:
    """The nodes that each source leads to, once per type of edge: ``source, edge_type`` and the node's columns."""
    wanted = edges if types is None else edges.where(F.col(edge_type).isin(*types))
    kept = wanted.select("source", F.col(edge_type).alias("edge_type"), F.col("target").alias("id")).distinct()
    return kept.join(nodes, "id").select("source", "edge_type", *nodes.columns)


def merge_sources(primary: DataFrame, secondary: DataFrame, keys: list[str], time: str, seconds: int, always: Column) -> DataFrame:
    """All primary points, and the secondary ones that no primary point of their key lies close to."""
    return primary.unionByName(drop_secondary(secondary, primary, keys, time, seconds, always))
