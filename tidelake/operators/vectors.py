"""Vector scalars, nearest neighbours and outcome predictions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stash
from .features import latest_per_key
from .merge import replace_rows


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: str) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: str, b: str) -> Column:
    """Null for a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2_distance(a: str, b: str) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda t, x: t + x))


def poincare_distance(a: str, b: str) -> Column:
    """Distance in the unit ball: arcosh(1 + 2 |a - b|^2 / ((1 - |a|^2)(1 - |b|^2)))."""
    gap = l2_distance(a, b)
    return F.acosh(1 + 2 * gap * gap / ((1 - dot(a, a)) * (1 - dot(b, b))))


def _unit(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_list()).astype(float)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.full_like(x, np.nan), where=n > 0)


def _top(found: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and ids of the k largest of each row (all, if fewer), largest first, ties to smaller ids."""
    ids = np.broadcast_to(ids, found.shape)
    if found.shape[1] <= k:
        order = np.lexsort((ids, -found), axis=1)
        return np.take_along_axis(found, order, 1), np.take_along_axis(ids, order, 1)
    row, column = np.nonzero(found >= np.partition(found, -k, axis=1)[:, -k, None])  # k of a row, and what ties with the last
    order = np.lexsort((ids[row, column], -found[row, column], row))
    row, column = row[order], column[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    at = row[kept].reshape(-1, k), column[kept].reshape(-1, k)
    return found[at], ids[at]


def _best(left: DataFrame, right: DataFrame, groups: list[str], k: int, least: float, block: int, score=None) -> DataFrame:
    """Queries (id, v) meet the rows (id, v) of their group; each group keeps k rows a query by products of ``block`` queries
    and as many rows, and the groups' results are ranked together."""

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=["query_id", "vec_id", "similarity"])]
        if not len(a) or not len(b):
            return out[0]
        qid, rid = a["id"].to_numpy(), b["id"].to_numpy()
        x, y = (np.stack(v["v"].to_list()) if score else _unit(v["v"]) for v in (a, b))
        for i in range(0, len(a), block):
            q, best = qid[i : i + block], None
            for j in range(0, len(b), block):
                r = rid[j : j + block]
                found = score(x[i : i + block], y[j : j + block]) if score else x[i : i + block] @ y[j : j + block].T
                found[(q[:, None] == r) | ~np.isfinite(found)] = -np.inf
                more = _top(found, r, k)
                best = _top(*(np.concatenate(both, axis=1) for both in zip(best, more, strict=True)), k) if best else more
            values, ids = best
            out.append(pd.DataFrame({"query_id": np.repeat(q, ids.shape[1]), "vec_id": ids.ravel(), "similarity": values.ravel()}))
            out[-1] = out[-1][out[-1]["similarity"] >= least]
        return pd.concat(out[1:])

    pairs = left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInPandas(cell, "query_id long, vec_id long, similarity double")
    w = W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "similarity")


CELLS = 32  # groups of an exact search, as long as their vectors can be held
NUMBERS = 1 << 22  # components of the queries or the rows of a group, at most


def _grid(queries: int, rows: int, dims: int, block: int) -> tuple[int, int]:
    """How many parts of queries meet how many of rows: parts are of as many blocks as leave about ``CELLS`` groups, and can be held. So
    what is dealt out grows with the rows, and only beyond that with their product."""
    nq, nr = max(1, -(-queries // block)), max(1, -(-rows // block))
    side = max(1, min(int((nq * nr / CELLS) ** 0.5), NUMBERS // (block * max(1, dims))))
    return -(-nq // side), -(-nr // side)


def knn_exact(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", least: float = -1.0, block: int = 2048, score=None) -> DataFrame:
    """``query_id, rank, vec_id, similarity``: the k rows of largest cosine, another row than the query's own.
    ``score`` may give other similarities of two matrices of vectors. Parts of queries meet parts of rows in a grid; within, blocks meet.
    """
    n, dims = rows.agg(F.count("*"), F.max(F.size(vector))).first()
    nq, nr = _grid(queries.count(), n, dims or 1, block)
    own = F.pmod(F.xxhash64(id_col), F.lit(nq)), F.pmod(F.xxhash64(id_col), F.lit(nr))
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")) for n in (nr, nq)]
    left = queries.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), own[0].alias("qb")).withColumn("rb", every[0])
    right = rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), own[1].alias("rb")).withColumn("qb", every[1])
    return _best(left, right, ["qb", "rb"], k, least, block, score)


def eligible(rows: DataFrame, as_of: str | None = None, namespace: str | None = None, types: list[str] | None = None) -> DataFrame:
    """The rows a search may find: of a namespace and of given types, and not expired: ``ttl_seconds`` after ``created_at``
    (null: never)."""
    found = rows if namespace is None else rows.where(F.col("namespace") == namespace)
    found = found if types is None else found.where(F.col("type").isin(*types))
    if as_of is None:
        return found
    alive = F.unix_timestamp(F.col("created_at").cast("timestamp")) + F.col("ttl_seconds") > F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    return found.where(F.col("ttl_seconds").isNull() | alive)


def poincare_similarity(scale: float):
    """Minus the Poincare distance of vectors that ``scale`` brings into the unit ball."""

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a.astype(float) * scale, b.astype(float) * scale
        na, nb = (a * a).sum(1), (b * b).sum(1)
        gap = np.maximum(na[:, None] + nb - 2 * a @ b.T, 0)
        return -np.arccosh(1 + 2 * gap / ((1 - na)[:, None] * (1 - nb)))

    return score


SAMPLE = 20_000  # vectors at most that the lists of an index are fitted on


def knn_ann(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", probes: float = 0.8, block: int = 2048) -> DataFrame:
    """Approximate neighbours by lists of near vectors: k-means centres, fitted on at most ``SAMPLE`` vectors, cut the
    rows into lists; a query meets the rows of the lists next to it, by the share ``probes``, and these are ranked by
    exact cosine. Queries that find fewer than k rows are searched exactly."""
    n = rows.count()
    lists = max(1, min(256, int(n**0.5)))
    share = min(1.0, SAMPLE / max(n, 1))
    some = rows.select(F.col(vector).alias("v")).where(F.rand(7) <= share).limit(SAMPLE).toPandas()["v"]
    if not len(some):
        return knn_exact(queries, rows, k, id_col, vector)
    centres = _centres(_unit(some), lists)
    near = max(1, int(np.ceil(probes * len(centres))))

    def placed(df: DataFrame, most: int) -> DataFrame:
        def run(batches):
            for batch in batches:
                if len(batch):
                    order = np.argsort(-(np.nan_to_num(_unit(batch["v"])) @ centres.T), axis=1, kind="stable")[:, :most]
                    yield pd.DataFrame({"id": batch["id"], "v": batch["v"], "lists": list(order.astype("int32"))})

        read = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        return read.mapInPandas(run, "id long, v array<double>, lists array<int>").withColumn("list", F.explode("lists")).drop("lists")

    own = stash(placed(rows, 1), "lists")
    sizes = own.groupBy("list").agg(F.ceil(F.count("*") / block).alias("parts"))  # a row per list
    parts = {r["list"]: r["parts"] for r in sizes.collect()}  # a number per list
    count = F.create_map(*[F.lit(int(x)) for pair in parts.items() for x in pair])[F.col("list")]
    right = own.withColumn("part", F.pmod(F.xxhash64("id"), count).cast("int"))
    left = placed(queries, near).withColumn("part", F.explode(F.sequence(F.lit(0), count - 1)))
    found = stash(_best(left, right, ["list", "part"], k, -1.0, block), "near")
    full = found.groupBy("query_id").count().where(F.col("count") >= min(k, max(n - 1, 0)))
    short = queries.join(full.select(F.col("query_id").alias(id_col)), id_col, "left_anti")
    rest = knn_exact(short, rows, k, id_col, vector)
    return found.join(full.select("query_id"), "query_id", "left_semi").unionByName(rest)


def _centres(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on a bounded sample."""
    x = x[np.isfinite(x).all(axis=1)]
    centres = x[np.random.default_rng(5).permutation(len(x))[:lists]].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return centres


def upsert_vectors(old: DataFrame, new: DataFrame, keys: list[str], order: list[str], vector: str = "embedding") -> DataFrame:
    """Vectors by key, new ones in place of old ones; vectors with a component that isn't finite are rejected."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return replace_rows(old, latest_per_key(new.where(finite), keys, order).select(*old.columns), keys)


def neighbor_outcomes(neighbours: DataFrame, aligned: DataFrame, objectives: DataFrame, horizons: list[int], violated: Column) -> DataFrame:
    """``query_id, vec_id, horizon, objective_id, breached``: what followed each neighbour so many steps later.

    aligned: ``vec_id`` (a step each) and the metrics; ``violated`` is a condition on a metric's row and an objective.
    """
    ahead = neighbours.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    later = aligned.withColumnRenamed("vec_id", "__step")
    both = ahead.join(later, F.col("vec_id") + F.col("horizon") == F.col("__step"))
    return both.crossJoin(F.broadcast(objectives)).select("query_id", "vec_id", "horizon", "objective_id", violated.alias("breached"))


def predict_breach(outcomes: DataFrame, least: int = 3, keys: tuple[str, ...] = ("query_id", "objective_id")) -> DataFrame:
    """Per query, objective (and horizon): share of neighbours whose outcome is a breach; kept from one half on, a breach
    above; outcomes that aren't known don't count."""
    known = outcomes.where(F.col("breached").isNotNull())
    votes = known.groupBy(*keys).agg(F.count("*").alias("k_neighbors"), F.count_if("breached").alias("k_supporting"))
    told = votes.where(F.col("k_neighbors") >= least).withColumn("confidence", F.col("k_supporting") / F.col("k_neighbors"))
    return told.where("confidence >= 0.5").withColumn("predicted_breach", F.col("confidence") > 0.5)


def evaluate_outcomes(predictions: DataFrame, actual: DataFrame, as_of: int, keys: tuple[str, ...] = ("objective_id",)) -> DataFrame:
    """Predictions that are due (query and horizon up to ``as_of``) and not evaluated yet, with what happened:
    ``actual_breach`` and ``correct``. actual: ``step``, the keys and ``breached``."""
    due = predictions.where((F.col("query_id") + F.col("horizon") <= as_of) & F.col("actual_breach").isNull()).drop("actual_breach")
    told = actual.select(F.col("step"), *keys, F.col("breached").alias("actual_breach"))
    both = due.withColumn("step", F.col("query_id") + F.col("horizon")).join(told, ["step", *keys]).drop("step")
    return both.withColumn("correct", F.col("predicted_breach") == F.col("actual_breach"))
