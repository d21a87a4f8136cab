"""Connected components by repeated star contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stash


def _to_minimum(pairs: DataFrame) -> DataFrame:
    """(u, v) with each u's smallest v as ``low``; the minimum is pre-aggregated, and a join takes it back."""
    return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("low")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = _to_minimum(both).where("v > u")
    return found.select(F.col("v").alias("u"), F.least("low", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _to_minimum(down)
    moved = found.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(found.select("u", F.col("low").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node, component`` for each node with an edge to another one; the component is its smallest node.

    Alternates large and small stars until nothing changes; each round is written to the shared folder, so lost
    executors cost one round at most. Nodes may be numbers or strings. Null ends and loops are ignored.
    """
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = stash(pairs, "stars")
    before = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = mark
        if not mark[0]:
            continue
        now = stash(_small_star(_large_star(now)), "stars")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
