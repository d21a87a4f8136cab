"""Merging new rows into keyed tables, and incremental reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import latest_per_key


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The newest new row of each key updates the columns it provides (not ``keep``); other rows stay."""
    latest = latest_per_key(new, keys, order)
    own = [c for c in old.columns if c not in keys]
    renamed = latest.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in latest.columns if c not in keys])
    both = old.withColumn("__old", F.lit(True)).join(renamed, keys, "full_outer")

    def pick(c: str):
        if f"__n_{c}" not in renamed.columns:
            return F.col(c)
        return F.coalesce(c, f"__n_{c}").alias(c) if c in keep else F.coalesce(f"__n_{c}", c).alias(c)

    return both.select(*keys, *[pick(c) for c in own])


def skip_existing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """First wins."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A new row replaces the whole old row of its key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def since_watermark(df: DataFrame, target: DataFrame, time: str, lag: str) -> DataFrame:
    """The rows after the target's newest time less the lag; all of them for an empty target. The mark is a scalar of the plan, so no
    job runs before the rows are asked for."""
    mark = target.agg(F.max(time) - F.expr(f"INTERVAL {lag}")).scalar()
    return df.where(F.coalesce(F.col(time) > mark, mark.isNull()))
