"""Nearest neighbours by largest inner product: a block matrix join on int8 tiles, exact after verification.

Vectors are quantised to int8 with a scale of their own; the length of the rounding error is kept. Queries and
candidates are packed into blocks, and each pair of blocks makes a tile: one matrix product gives approximate
products, and the Cauchy-Schwarz inequality bounds their errors. In a tile, and again when tiles are merged, a
query keeps the candidates whose upper bound reaches the k-th largest lower bound, so none of the k nearest can get
lost. The survivors are computed again from the original vectors in double precision.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stash

CANDIDATE_BLOCK = 8192
QUERY_BLOCK = (256, 8192)  # least and most
FAN_IN = 16  # tiles that one task merges
BLOCK = "block long, dim int, ids binary, codes binary, scales binary, lengths binary, errors binary"
FOUND = "qblock long, part long, query binary, vec binary, low binary, high binary"


def usable(vector: str) -> Column:
    """Neither null, zero, nor holding null or non-finite components."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """One block: ids, int8 codes, scales, lengths of the quantised vectors and of their errors."""
    out = []
    for dim, part in rows.groupby(rows["v"].map(len)):
        v = np.stack(part["v"].to_list()).astype(np.float64)
        scales = np.abs(v).max(axis=1) / 127
        codes = np.rint(v / scales[:, None]).astype(np.int8)
        back = codes * scales[:, None]
        lengths, errors = np.linalg.norm(back, axis=1), np.linalg.norm(v - back, axis=1)
        arrays = (part["id"].to_numpy(np.int64), codes, scales, lengths, errors)
        out.append((int(rows["block"].iloc[0]), int(dim), *[x.tobytes() for x in arrays]))
    return pd.DataFrame(out, columns=[x.split()[0] for x in BLOCK.split(", ")])


def _unpack(row) -> tuple[np.ndarray, ...]:
    codes = np.frombuffer(row.codes, np.int8).reshape(-1, row.dim)
    return np.frombuffer(row.ids, np.int64), codes, *(np.frombuffer(x, np.float64) for x in (row.scales, row.lengths, row.errors))


def _keep(query: np.ndarray, vec: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of each query's candidates those whose upper bound reaches the k-th largest lower bound."""
    order = np.lexsort((-low, query))
    query, vec, low, high = query[order], vec[order], low[order], high[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, int)
    sizes = np.diff(np.r_[first, len(query)])
    least = np.where(sizes >= k, low[np.minimum(first + k - 1, len(query) - 1)], -np.inf) if len(query) else low
    fit = high >= np.repeat(least, sizes)
    return query[fit], vec[fit], low[fit], high[fit]


def _tiles(k: int):
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q in queries.itertuples():
            for c in candidates.itertuples():
                if q.dim != c.dim:
                    continue
                qid, a, qs, ql, qe = _unpack(q)
                cid, b, cs, cl, ce = _unpack(c)
                exact = np.float32 if q.dim * 127 * 127 < 1 << 24 else np.float64  # products of codes are whole numbers
                right = b.astype(exact).T
                found = []
                for at in range(0, len(qid), 256):
                    s = slice(at, at + 256)
                    near = (a[s].astype(exact) @ right) * (qs[s, None] * cs)
                    slack = qe[s, None] * (cl + ce) + ql[s, None] * ce
                    slack = slack * (1 + 1e-9) + 1e-12 * (ql[s, None] * cl)
                    low, high = near - slack, near + slack
                    own = qid[s, None] == cid
                    low[own], high[own] = -np.inf, -np.inf
                    least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(low), -np.inf)
                    i, j = np.nonzero((high >= least[:, None]) & ~own)
                    found.append((qid[s][i], cid[j], low[i, j], high[i, j]))
                kept = [np.concatenate(x).tobytes() for x in zip(*found, strict=True)]
                out.append((q.qblock, q.part, *kept))
        return pd.DataFrame(out, columns=[x.split()[0] for x in FOUND.split(", ")])

    return run


def _merge(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.concatenate([np.frombuffer(x, t) for x in rows[c]]) for c, t in (("query", np.int64), ("vec", np.int64), ("low", float), ("high", float))]
        kept = [x.tobytes() for x in _keep(*parts, k)]
        return pd.DataFrame([(rows["qblock"].iloc[0], rows["part"].iloc[0], *kept)], columns=[x.split()[0] for x in FOUND.split(", ")])

    return run


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            yield pd.DataFrame({"query_id": np.frombuffer(row.query, np.int64), "vec_id": np.frombuffer(row.vec, np.int64)})


def _scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [float(np.dot(np.asarray(a, np.float64), np.asarray(b, np.float64))) for a, b in zip(batch["q"], batch["v"], strict=True)]
        yield pd.DataFrame({"query_id": batch["query_id"], "vec_id": batch["vec_id"], "score": found})


def _heap(k: int):
    """Per partition and query the k best pairs; partitions hold whole queries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps: dict[int, list] = {}
        for batch in batches:
            for q, v, s in zip(batch["query_id"].to_list(), batch["vec_id"].to_list(), batch["score"].to_list(), strict=True):
                heap = heaps.setdefault(q, [])
                if len(heap) < k:
                    heapq.heappush(heap, (s, -v))
                elif (s, -v) > heap[0]:
                    heapq.heapreplace(heap, (s, -v))
        rows = [(q, n + 1, -v, s) for q, heap in heaps.items() for n, (s, v) in enumerate(sorted(heap, reverse=True))]
        yield pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])

    return run


def nearest(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products of each query row with the other rows.

    Rows without an id, and vectors that are null, zero or hold null or non-finite components, take no part; vectors
    meet only vectors of their own dimension. Rows that repeat id and vector count once; all rows of a query's own
    id are left out. Equal scores rank by smaller id. With fewer than k candidates all are returned; an empty
    table gives no rows. Of equal vectors only the k + 1 smallest ids can be among the nearest of any query, so the
    others are no candidates, whatever their number. Other columns are not read.
    """
    spark = df.sparkSession
    rows = df.where(F.col(id_col).isNotNull() & usable(vector_col))
    clean = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"), queries.alias("ask"))
    clean = stash(clean.dropDuplicates(["id", "v"]), "vectors")
    same = W.partitionBy("v").orderBy("id")
    candidates = stash(clean.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).select("id", "v"), "candidates")
    asked = clean.where("ask").select("id", "v")
    n, m = candidates.count(), asked.count()
    tasks = 2 * spark.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(n / CANDIDATE_BLOCK))
    qsize = min(max(m // tasks + 1, QUERY_BLOCK[0]), QUERY_BLOCK[1])
    qblocks = max(1, math.ceil(m / qsize))

    def packed(x: DataFrame, count: int) -> DataFrame:
        dealt = x.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)))
        return stash(dealt.groupBy("block").applyInPandas(_pack, BLOCK), "blocks")

    q = packed(asked, qblocks).withColumnRenamed("block", "qblock")
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    c = packed(candidates, blocks).withColumnRenamed("block", "part")
    c = c.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1)).cast("array<long>")))
    q = q.withColumn("block", F.col("qblock"))
    c = c.withColumn("block", F.col("part"))
    found = q.groupBy("qblock", "part").cogroup(c.groupBy("qblock", "part")).applyInPandas(_tiles(k), FOUND)
    while True:
        blocks = math.ceil(blocks / FAN_IN)
        merged = found.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("qblock", "part").applyInPandas(_merge(k), FOUND)
        found = stash(merged, "merged")
        if blocks == 1:
            break
    pairs = found.mapInPandas(_pairs, "query_id long, vec_id long")
    # an id may stand for several vectors: each of the query's meets each of the candidate's, and the best counts
    ends = pairs.join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    ends = ends.join(candidates.select(F.col("id").alias("vec_id"), "v"), "vec_id").where(F.size("q") == F.size("v"))
    scored = ends.mapInPandas(_scores, "query_id long, vec_id long, score double")
    best = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.repartition("query_id").mapInPandas(_heap(k), "query_id long, rank int, vec_id long, score double")
