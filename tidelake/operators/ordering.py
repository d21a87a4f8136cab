"""Numbers, carried values and neighbouring rows in order, without bringing all rows of a key into one task.

Rows are dealt by ranges of (keys, order); what has to cross a range (how many rows came before, the last value seen, the rows just before)
is small and is carried over. So a key of any size is spread over as many tasks as it has ranges or chunks.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stash

FEW = 200_000  # rows that are broadcast; more are joined


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(and_, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def _beside(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``small`` (a row for each of the keys, which may be null)."""
    own = [F.col(f"s.{c}") for c in small.columns if c not in keys]
    right = F.broadcast(small) if small.count() <= FEW else small
    return rows.alias("r").join(right.alias("s"), _same("r", "s", keys)).select("r.*", *own)


def in_ranges(df: DataFrame, keys: list[str], order: list[Column | str], label: str = "ranges") -> DataFrame:
    """``df``, written, with ``__own``: a number that ascends in the order of keys and ``order`` and has gaps between ranges, and
    ``__part``, the range. Written because ranges are drawn from a sample: all that follows has to see the same ones."""
    by = [*keys, *order, "__own"]
    first = df.withColumn("__own", F.monotonically_increasing_id())
    dealt = first.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__own", F.monotonically_increasing_id())
    return stash(dealt, label).withColumn("__part", F.shiftright("__own", 33))


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "__n") -> DataFrame:
    """``df`` with the place of each row among those of its keys, from 0; rows equal in order have any order among themselves."""
    rows = in_ranges(df, keys, order)
    sizes = rows.groupBy(*keys, "__part").agg(F.count("*").alias("__size"), F.min("__own").alias("__first"))
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select(*keys, "__part", (F.coalesce(F.sum("__size").over(before), F.lit(0)) - F.col("__first")).alias("__base"))
    return _beside(rows, stash(bases, "bases"), [*keys, "__part"]).withColumn(name, F.col("__own") + F.col("__base")).drop("__own", "__part", "__base")


def last_known(rows: DataFrame, keys: list[str], part: str, order: str, column: str, name: str) -> DataFrame:
    """``rows`` with the last value of ``column`` that isn't null up to each row, in the order of ``part`` and then ``order``: a window
    within each part, and the last value of the parts before it."""
    inside = W.partitionBy(*keys, part).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    ends = rows.where(F.col(column).isNotNull()).groupBy(*keys, part).agg(F.max_by(column, order).alias("__end"))
    parts = rows.select(*keys, part).distinct().alias("r").join(ends.alias("s"), _same("r", "s", [*keys, part]), "left").select("r.*", "s.__end")
    before = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    carried = stash(parts.select(*keys, part, F.last("__end", ignorenulls=True).over(before).alias("__carried")), "carried")
    found = _beside(rows, carried, [*keys, part])
    return found.withColumn(name, F.coalesce(F.last(column, ignorenulls=True).over(inside), "__carried")).drop("__carried")


def with_rows_before(rows: DataFrame, number: str, chunk: int, before: int) -> DataFrame:
    """Rows by chunks of ``chunk`` places (``__chunk``), each chunk together with the ``before`` rows ahead of it; those are marked
    by ``__ahead`` and are to be left out in the end. A window over a chunk then sees what one over the whole key would."""
    own = F.floor(F.col(number) / chunk).cast("long")
    reach = -(-before // chunk)
    into = F.filter(F.sequence(own, own + reach), lambda c: (c == own) | (F.col(number) >= c * chunk - before))
    return rows.withColumn("__chunk", F.explode(into)).withColumn("__ahead", F.col("__chunk") != own)
