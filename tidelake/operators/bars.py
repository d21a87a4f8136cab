"""Price bars at any grain, and scalers that can be undone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ohlcv(df: DataFrame, grain: str, keys: list[str], time: str, tie: str, volatility: bool = False) -> DataFrame:
    """Bars of ``grain`` by symbol and venue from rows with ``open, high, low, close, volume, trades_count, spread_pct``: the first open and
    the last close in time (``tie`` decides among equal times), and with ``volatility`` the deviation of the closes."""
    order = F.struct(time, tie)
    told = [
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"),
        F.sum("volume").alias("volume"), F.sum("trades_count").alias("trades_count"), F.avg("spread_pct").alias("avg_spread_pct"),
    ]
    found = df.groupBy(F.window(time, grain).alias("__w"), *keys).agg(*told, *([F.stddev_samp("close").alias("price_volatility")] if volatility else []))
    return found.withColumn("bucket", F.col("__w.start")).drop("__w")


def coarser(bars: DataFrame, grain: str, keys: list[str]) -> DataFrame:
    """Bars of a coarser grain from ``ohlcv`` bars whose grain divides it: the same prices and sums as from the rows. Spreads are averages of the
    bars' averages weighted by their trades, and missing where no bar has trades."""
    weight = F.when(F.col("avg_spread_pct").isNotNull(), F.col("trades_count"))
    told = [
        F.min_by("open", "bucket").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bucket").alias("close"),
        F.sum("volume").alias("volume"), F.sum("trades_count").alias("trades_count"),
        (F.sum(F.col("avg_spread_pct") * weight) / F.nullif(F.sum(weight), F.lit(0))).alias("avg_spread_pct"),
    ]
    found = bars.groupBy(F.window("bucket", grain).alias("__w"), *keys).agg(*told)
    return found.withColumn("bucket", F.col("__w.start")).drop("__w")


def fit_scaler(df: DataFrame, field: str, keys: list[str]) -> DataFrame:
    """``mean, std`` (of the population), ``low`` and ``high`` of a field by keys; NaN mean and 0 deviation where there is no value."""
    x = F.col(field)
    return df.groupBy(*keys).agg(
        F.coalesce(F.avg(x), F.lit(float("nan"))).alias("mean"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias("std"), F.min(x).alias("low"), F.max(x).alias("high")
    )


def standard(x: Column, mean: Column, std: Column) -> Column:
    """z-score; 0 where the data is constant."""
    return F.when(x.isNotNull(), F.when(std == 0, F.lit(0.0)).otherwise((x - mean) / F.nullif(std, F.lit(0.0))))


def from_standard(z: Column, mean: Column, std: Column) -> Column:
    return z * std + mean


def minmax(x: Column, low: Column, high: Column) -> Column:
    """Place between the smallest and largest value, 0 to 1; 0 where the data is constant."""
    return F.when(x.isNotNull(), F.when(high == low, F.lit(0.0)).otherwise((x - low) / F.nullif(high - low, F.lit(0.0))))


def from_minmax(z: Column, low: Column, high: Column) -> Column:
    return z * (high - low) + low
