"""A stored index for approximate neighbours by cosine: lists of near vectors, and product codes of what is left of them.

Rows are cut into lists around centres, written partitioned by list, so a search opens only the folders of the lists it probes. What a vector
has beyond its centre is coded part by part; codes are scored by table look-ups, and only the best of them, the shortlist, have their
whole vectors read and compared exactly. How many lists to probe and how long the shortlist is, the index measures when it is built, on
its own sample against brute force, and keeps beside the lists: data without clusters get many probes and short codes' help, clustered data few probes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stash

SAMPLE = 20_000  # vectors at most that an index is fitted and measured on
TRIED = 200  # of them, as queries of the measurement
ENTRIES = 256  # of a codebook, at most
META = "name string, data binary"
FOUND = "query_id long, rank int, vec_id long, similarity double"
CELLS = 32  # groups of a search, as long as their vectors can be held
HELD = 1 << 16  # queries or rows of a group, at most
NUMBERS = 1 << 22  # their components, at most
NONE, LOW = np.iinfo(np.int64).min, (1 << 32) - 1


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(float)


def _held(rows: DataFrame, vector: str) -> str:
    """The type that vectors are held in: their own, where that is float."""
    return "array<float>" if rows.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.full_like(x, np.nan), where=n > 0)


def _means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means with squared distances."""
    centres = x[np.random.default_rng(5).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)


@dataclass
class Index:
    """What a search needs besides the lists: bounded by the number of lists and parts, not by the rows."""

    centres: np.ndarray
    books: list[np.ndarray]
    probes: int
    share: float  # of all rows, in a shortlist

    def cuts(self) -> list[slice]:
        ends = np.cumsum([b.shape[1] for b in self.books]).tolist()
        return [slice(a, b) for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code of unit vectors."""
        own = _nearest(x, self.centres)
        rest = x - self.centres[own]
        return own, np.stack([_nearest(rest[:, c], b) for c, b in zip(self.cuts(), self.books, strict=True)], axis=1).astype(np.uint8)

    def near(self, x: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(-(np.nan_to_num(x) @ self.centres.T), axis=1, kind="stable")[:, :probes]

    def scores(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """About the products of queries with coded rows."""
        about = self.centres[lists]
        for k, (c, b) in enumerate(zip(self.cuts(), self.books, strict=True)):
            about[:, c] += b[codes[:, k]]
        return x @ about.T


def fit_index(sample: np.ndarray, rows: int, parts: int, k: int, recall: float) -> Index:
    """Centres and codebooks of unit vectors, then the fewest probes and the shortest shortlist that reach the recall on the sample."""
    lists = max(1, min(1024, int(rows**0.5)))
    centres = _means(sample, lists)
    own = _nearest(sample, centres)
    rest = sample - centres[own]
    books = [_means(rest[:, c], min(ENTRIES, len(rest))) for c in np.array_split(np.arange(sample.shape[1]), parts)]
    index = Index(centres, books, len(centres), 1.0)
    own, codes = index.encode(sample)
    asked = np.random.default_rng(7).permutation(len(sample))[:TRIED]
    exact = sample[asked] @ sample.T
    exact[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return index
    best = np.argsort(-exact, axis=1, kind="stable")[:, :k]
    order = index.near(sample[asked], len(centres))
    place = np.argsort(order, axis=1)  # when each list is probed
    reached = np.take_along_axis(place, own[best], axis=1)
    index.probes = next(p for p in range(1, len(centres) + 1) if (reached < p).mean() >= recall)
    about = index.scores(sample[asked], own, codes)
    about[np.arange(len(asked)), asked] = -np.inf
    about[np.take_along_axis(place, np.broadcast_to(own, about.shape), axis=1) >= index.probes] = -np.inf
    ranks = np.argsort(np.argsort(-about, axis=1, kind="stable"), axis=1)
    there = reached < index.probes
    needed = np.sort(np.take_along_axis(ranks, best, axis=1)[there])
    index.share = min(1.0, (needed[int(np.ceil(recall * len(needed))) - 1] + 1) / len(sample))
    return index


def build_index(rows: DataFrame, path: str, id_col: str = "vec_id", vector: str = "embedding", parts: int = 32, k: int = 10, recall: float = 0.97) -> None:
    """Write the index of all rows to ``path``. Null vectors, zero ones and those with null or non-finite components are left out."""
    v, held = F.col(vector), _held(rows, vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = rows.where(v.isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.cast(held).alias("v"))
    n = kept.count()
    some = kept.orderBy(F.xxhash64("id")).limit(SAMPLE).toPandas()["v"]  # a bounded sample
    if not n:
        raise ValueError("an index needs a vector")
    sample = _unit(_matrix(some))
    index = fit_index(sample, n, min(parts, sample.shape[1]), k, recall)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch[at : at + 4096]
                own, codes = index.encode(_unit(_matrix(part["v"])))
                yield pd.DataFrame({"id": part["id"], "v": part["v"], "code": [c.tobytes() for c in codes], "list": own.astype("int32")})

    spark = rows.sparkSession
    stored = kept.mapInPandas(placed, f"id long, v {held}, code binary, list int")
    stored.repartition("list").sortWithinPartitions("list", "id").write.partitionBy("list").parquet(f"{path}/rows")
    sizes = {r["list"]: r["count"] for r in spark.read.parquet(f"{path}/rows").groupBy("list").count().collect()}  # a number a list
    about = {"probes": index.probes, "share": index.share, "sizes": sizes, "widths": [b.shape[1] for b in index.books]}
    data = [("about", json.dumps(about).encode()), ("centres", index.centres.tobytes()), *[(f"book{k}", b.tobytes()) for k, b in enumerate(index.books)]]
    spark.createDataFrame([(name, bytearray(x)) for name, x in data], META).coalesce(1).write.parquet(f"{path}/meta")


def open_index(spark: SparkSession, path: str) -> tuple[Index, dict[int, int]]:
    """The index and the size of each list."""
    found = {r["name"]: bytes(r["data"]) for r in spark.read.schema(META).parquet(f"{path}/meta").collect()}  # a row a codebook
    about = json.loads(found["about"])
    books = [np.frombuffer(found[f"book{k}"]).reshape(-1, w) for k, w in enumerate(about["widths"])]
    return Index(np.frombuffer(found["centres"]).reshape(-1, sum(about["widths"])), books, about["probes"], about["share"]), {int(x): size for x, size in about["sizes"].items()}


def _chain(centres: np.ndarray) -> list[int]:
    """The centres in such an order that neighbours in it are near each other, each time the nearest one that is left."""
    order, left = [0], np.ones(len(centres), bool)
    left[0] = False
    while left.any():
        some = np.flatnonzero(left)
        order.append(int(some[((centres[some] - centres[order[-1]]) ** 2).sum(1).argmin()]))
        left[order[-1]] = False
    return order


def _cells(centres: np.ndarray, sizes: dict[int, int], most: int) -> tuple[dict[int, int], dict[int, int]]:
    """The number of the first cell of each list and how many it has. Near lists share a cell of about ``most`` rows, a longer list has several."""
    known = sorted(sizes)
    first, parts, free, room = {}, {}, 0, 0
    for x in (known[c] for c in _chain(centres[known])):
        if sizes[x] > room:
            first[x], parts[x] = free, -(-sizes[x] // most)
            free, room = free + parts[x], most
        else:
            first[x], parts[x] = free - 1, 1
        room = room - sizes[x] if parts[x] == 1 else 0
    return first, parts


def _grid(n: int, asked: int, dims: int, block: int, asking: int) -> tuple[int, int]:
    """Into how many turns queries go, and how many rows a cell has: so that there are about ``CELLS`` groups of a turn and a cell, as long
    as a group's vectors can be held. So what is written grows with the rows, and only beyond that with their product."""
    held = max(1, min(HELD, NUMBERS // dims))
    turns = int(np.ceil(max(1, asked / held, min(asked / asking, (CELLS * asked / n) ** 0.5))))
    return turns, min(held, max(block, -(-n * turns // CELLS)))


def _shortlists(index: Index, x: np.ndarray, hit: np.ndarray, of: np.ndarray, ids: np.ndarray, lists: np.ndarray, codes: np.ndarray, length: int, block: int) -> np.ndarray:
    """Places of the rows with the best scores of codes in the lists that each query probes, but those of its own id; ties to smaller
    places; -1 where there are no more."""
    keys, at = np.full((len(x), length + block), NONE), 0
    by_list = np.argsort(lists, kind="stable")
    for places in np.split(by_list, np.flatnonzero(np.diff(lists[by_list])) + 1):
        asks = np.flatnonzero(hit[:, lists[places[0]]])
        for begin in range(0, len(places) if len(asks) else 0, block):
            p = places[begin : begin + block]
            if at + len(p) > keys.shape[1]:
                keys[:, :length] = np.partition(keys, -length, axis=1)[:, -length:]
                keys[:, length:] = NONE
                at = length
            key = (np.rint(index.scores(x[asks], lists[p], codes[p]) * 2.0**28).astype(np.int64) << 32) | (LOW - p)
            key[of[asks][:, None] == ids[p]] = NONE
            keys[asks, at : at + len(p)] = key
            at += len(p)
    best = np.partition(keys, -length, axis=1)[:, -length:]
    return np.where(best == NONE, -1, LOW - (best & LOW))


def _compared(q: np.ndarray, v: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and cosines of the k best of each query's shortlist, by whole vectors; ties to smaller places."""
    qq, vv = np.einsum("qd,qd->q", q, q), np.einsum("rd,rd->r", v, v)
    found = np.empty(places.shape)
    step = max(1, (NUMBERS // 4) // (places.shape[1] * v.shape[1]))
    for at in range(0, len(q), step):
        p = places[at : at + step]
        with np.errstate(all="ignore"):
            found[at : at + step] = np.einsum("qld,qd->ql", v[p], q[at : at + step]) / np.sqrt(qq[at : at + step, None] * vv[p])
    found[(places < 0) | ~np.isfinite(found)] = -np.inf
    order = np.lexsort((places, -found), axis=1)[:, :k]
    return np.take_along_axis(places, order, 1), np.take_along_axis(found, order, 1)


def search_index(queries: DataFrame, path: str, k: int, id_col: str = "vec_id", vector: str = "embedding", probes: int | None = None, block: int = 4096, asking: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, similarity``: about the k rows of largest cosine, another row than the query's own, ties to smaller ids.

    Codes are scored in the lists that a query probes; whole vectors are compared for its shortlist only. Queries without a usable vector find
    nothing. Near lists are cells, and turns of queries meet them in a grid; a cell scores, makes its own shortlist, compares it and gives
    k rows a query, so neither scores nor shortlists are ever written. As a cell's shortlist is as long as the whole one, all of that is in them.
    A task scores about ``block`` rows for ``asking`` queries at once.
    """
    spark = queries.sparkSession
    index, sizes = open_index(spark, path)
    n, dims = sum(sizes.values()), index.centres.shape[1]
    near = min(probes or index.probes, len(index.centres))
    length = max(4 * k, int(np.ceil(index.share * n)) + 1)

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch[at : at + 4096]
                x = _unit(_matrix(part["q"]))
                fine = np.isfinite(x).all(axis=1)
                hit = np.zeros((int(fine.sum()), len(index.centres)), bool)
                np.put_along_axis(hit, index.near(x[fine], near), True, axis=1)
                yield pd.DataFrame({"query_id": part["query_id"][fine], "q": part["q"][fine], "lists": [b.tobytes() for b in np.packbits(hit, axis=1)]})

    def unpacked(lists: pd.Series) -> np.ndarray:
        return np.unpackbits(np.frombuffer(b"".join(lists), np.uint8).reshape(len(lists), -1), axis=1, count=len(index.centres)).astype(bool)

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"n": [len(batch)], "lists": [np.packbits(unpacked(batch["lists"]).any(axis=0)).tobytes()]})

    held = _held(queries, vector)
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector).cast(held).alias("q")).where(F.size("q") == dims)
    left = stash(asked.mapInPandas(probed, f"query_id long, q {held}, lists binary"), "probes")  # a row a query
    told = left.select("lists").mapInPandas(together, "n long, lists binary").collect()  # a row a batch of queries
    some = unpacked(pd.Series([bytes(r["lists"]) for r in told])).any(axis=0) if told else np.zeros(len(index.centres), bool)
    wanted = {x: size for x, size in sizes.items() if some[x]}
    if not wanted:
        return spark.createDataFrame([], FOUND)
    turns, most = _grid(sum(wanted.values()), sum(r["n"] for r in told), dims, block, asking)
    first, parts = _cells(index.centres, wanted, most)
    meets = np.zeros((len(index.centres), max(first[x] + parts[x] for x in first)), np.float32)
    for x in first:
        meets[x, first[x] : first[x] + parts[x]] = 1

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch[at : at + 4096]
                row, cell = np.nonzero(unpacked(part["lists"]).astype(np.float32) @ meets)
                yield part.assign(cells=np.split(cell.astype("int32"), np.searchsorted(row, np.arange(1, len(part)))))

    def of_list(values: dict[int, int]):
        return F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair])[F.col("list")]

    turn = F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int")
    left = left.mapInPandas(met, f"query_id long, q {held}, lists binary, cells array<int>").select("query_id", "q", "lists", F.explode("cells").alias("cell"), turn.alias("turn"))
    right = spark.read.parquet(f"{path}/rows").where(F.col("list").isin(sorted(wanted)))  # opens the folders of these lists only
    right = right.withColumn("cell", (of_list(first) + F.pmod(F.xxhash64("id"), of_list(parts))).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame(columns=["query_id", "vec_id", "similarity"])
        if not len(a) or not len(b):
            return none
        b = b.sort_values("id")
        ids, lists, v = b["id"].to_numpy(), b["list"].to_numpy(), _matrix(b["v"])
        codes = np.frombuffer(b"".join(b["code"]), np.uint8).reshape(len(b), -1)
        most, out = min(length, len(b)), []
        step = max(1, min(asking, NUMBERS // (most + block)))
        for at in range(0, len(a), step):
            part = a[at : at + step]
            q, of = _matrix(part["q"]), part["query_id"].to_numpy()
            places = _shortlists(index, _unit(q), unpacked(part["lists"]), of, ids, lists, codes, most, block)
            places, found = _compared(q, v, places, k)
            got = np.isfinite(found)
            out.append(pd.DataFrame({"query_id": np.repeat(of, got.sum(axis=1)), "vec_id": ids[places[got]], "similarity": found[got]}))
        return pd.concat(out)

    pairs = left.groupBy("cell", "turn").cogroup(right.groupBy("cell", "turn")).applyInPandas(search, "query_id long, vec_id long, similarity double")
    w = W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "similarity")
