"""Near-duplicate texts: a self-join on the Jaccard similarity of word shingles by MinHash banding.

Each band ("tree") hashes as many MinHash values as pairs at the least similarity may have to share and still meet in
some band with the target recall; the number is the same for all texts. It takes the place of an LSH forest, whose
prefixes are shortened text by text: links are counted exactly, so every text needs the recall of the shortest prefix
anyway. Exact copies are one text here. Buckets with the same members
in several trees are kept once. Large buckets are split into tiles of blocks; each tile verifies its pairs by the
exact similarity of their shingle sets, counts links, and passes on a spanning forest of them instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stash
from .graph import components
from .names import unused
from .shingles import mix, sets, shingle_hashes

WORDS = 5
TREES, DEEPEST = 16, 8
RECALL = 0.9999
BLOCK = 192  # texts of a bucket that meet in one tile with as many others
TEXTS = 1024  # rows that a Python worker holds at once
FILTER = 1 << 20  # rows at most of the broadcast table that sorts out texts without partner
CELLS = 4 << 20  # cells of the incidence matrix held at once


def prefix_depth(least: float, recall: float = RECALL, trees: int = TREES, deepest: int = DEEPEST) -> int:
    """The longest prefix at which a pair of this similarity meets in some tree with at least the recall."""
    depth = deepest
    while depth > 1 and 1 - (1 - least**depth) ** trees < recall:
        depth -= 1
    return depth


def tree_keys(texts: list[str], depth: int, trees: int = TREES, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each text's prefix in each tree as one hash (rows without shingles hold zeros), and whether it has shingles."""
    found, where = shingle_hashes(texts, words)
    counts = np.bincount(where, minlength=len(texts))
    some = counts > 0
    keys = np.zeros((len(texts), trees), np.uint64)
    if len(found):
        firsts = np.r_[0, np.cumsum(counts[some])][:-1]
        draw = mix(np.arange(1, 2 * trees * depth + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for t in range(trees):
            path = np.full(int(some.sum()), t + 1, np.uint64)
            for d in range(depth):
                k = 2 * (t * depth + d)
                low = np.minimum.reduceat(found * (draw[k] | np.uint64(1)) + draw[k + 1], firsts)
                path = mix(path + low)
            keys[some, t] = path
    return keys, some


def _signatures(docs: DataFrame, depth: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch[at : at + 1024]
                keys, some = tree_keys(part["text"].to_list(), depth)
                rows = [x.astype(np.int64).tolist() if s else [] for x, s in zip(keys, some, strict=True)]
                yield pd.DataFrame({"node": part["node"], "keys": rows})

    return docs.select("node", "text").mapInPandas(run, "node string, keys array<long>")


def _shingle_sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch[at : at + 512]
                yield pd.DataFrame({"node": part["node"], "shingles": [x.tobytes() for x in sets(part["text"].to_list(), WORDS)]})

    return docs.mapInPandas(run, "node string, shingles binary")


def similarities(shingles: list[np.ndarray], left: int) -> np.ndarray:
    """Jaccard similarities of the first ``left`` sets (rows) with all sets (columns)."""
    sizes = np.fromiter(map(len, shingles), float, len(shingles))
    values, owner = np.concatenate(shingles), np.repeat(np.arange(len(shingles)), sizes.astype(int))
    _, place, seen = np.unique(values, return_inverse=True, return_counts=True)
    shared = seen[place] > 1
    place, owner = np.unique(place[shared], return_inverse=True)[1], owner[shared]
    common = np.zeros((left, len(shingles)))
    width = max(1, CELLS // len(shingles))
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    last = int(place[-1]) + 1 if len(place) else 0
    for low in range(0, last, width):
        a, b = np.searchsorted(place, [low, low + width])
        matrix = np.zeros((len(shingles), min(width, last - low)), np.float32)
        matrix[owner[a:b], place[a:b] - low] = 1
        common += matrix[:left] @ matrix.T
    return common / np.maximum(sizes[:left, None] + sizes - common, 1)


def _verify(tile: pd.DataFrame, least: float) -> list[tuple[str, str | None, int]]:
    """(a, b, 0) for a spanning forest of the tile's links, (a, None, copies) for the links of each text."""
    bucket, one, two = tile["bucket"].iloc[0], tile["one"].iloc[0], tile["two"].iloc[0]
    tile = tile.sort_values(["block", "node"]) if one != two else tile.sort_values("node")
    blocks = tile["block"].to_numpy()
    left = int((blocks == one).sum())
    if one != two and left in (0, len(tile)):
        return []
    found = similarities([np.frombuffer(x, np.uint64) for x in tile["shingles"]], left)
    i, j = np.nonzero(found >= least)
    fit = (j > i) if one == two else (j >= left)
    i, j = i[fit], j[fit]
    nodes, copies = tile["node"].to_list(), tile["copies"].to_list()
    buckets = [frozenset(x) for x in tile["buckets"]]
    top, links, rows = list(range(len(nodes))), [0] * len(nodes), []

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        if min(buckets[a] & buckets[b]) != bucket:
            continue  # these two meet in an earlier bucket
        links[a] += copies[b]
        links[b] += copies[a]
        x, y = find(a), find(b)
        if x != y:
            top[y] = x
            rows.append((nodes[a], nodes[b], 0))
    return rows + [(nodes[k], None, n) for k, n in enumerate(links) if n]


def _tiles(least: float):
    """Runs over partitions that are sorted by tile; holds one tile and one batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        key = None

        def done(parts: list[pd.DataFrame]) -> pd.DataFrame:
            return pd.DataFrame(_verify(pd.concat(parts), least), columns=["a", "b", "links"])

        for batch in batches:
            if not len(batch):
                continue
            ids = batch[["bucket", "one", "two"]].to_numpy()
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1), len(batch)]
            out = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                now = tuple(ids[a])
                if held and now != key:
                    out.append(done(held))
                    held = []
                key = now
                held.append(batch.iloc[a:b])
            if out:
                yield pd.concat(out)
        if held:
            yield done(held)

    return run


def similar_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``node, component`` for texts with a link to another text, and ``node, links``: how many rows the links of a
    text lead to. A node is the MD5 of a text."""
    docs = df.select(F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    depth = prefix_depth(least)
    signed = stash(_signatures(docs, depth), "signatures", TEXTS)
    texts = signed.groupBy("node").agg(F.first("keys").alias("keys"), F.count("*").alias("copies"))
    rows = texts.select("node", "copies", F.explode("keys").alias("bucket"))
    mark = F.xxhash64("node").cast("decimal(38,0)")
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.sum(mark).alias("print")).where("size > 1")
    kept = stash(shared.groupBy("print", "size").agg(F.min("bucket").alias("bucket")).select("bucket", "size"), "buckets")
    members = stash(rows.join(kept, "bucket"), "members")
    own = members.groupBy("node").agg(F.collect_set("bucket").alias("buckets"))  # at most TREES of them
    # a table of bounded size sorts out most other texts before the shuffle
    cell = F.pmod(F.xxhash64("node"), F.lit(FILTER)).alias("cell")
    near = docs.withColumn("cell", cell).join(F.broadcast(own.select(cell).distinct()), "cell", "left_semi").drop("cell")
    wanted = near.join(own.select("node"), "node", "left_semi")
    known = _shingle_sets(wanted).dropDuplicates(["node"])
    known = stash(known.join(own, "node"), "shingles", TEXTS)

    blocks = F.ceil(F.col("size") / BLOCK)
    dealt = members.withColumn("block", F.pmod(F.xxhash64("node", "bucket"), blocks))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tiles = paired.select("bucket", "node", "copies", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    filled = tiles.join(known, "node").repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two")
    found = stash(filled.mapInPandas(_tiles(least), "a string, b string, links long"), "links")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    return components(found.where("b IS NOT NULL")), links


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """``id_col, class_id, n_links, n_copies`` for each row.

    Texts are similar if the Jaccard similarity of their sets of five-word shingles (lower case, split at white
    space) is at least ``least``; equal texts always are, even empty ones; a null text counts as empty. A class is
    what links connect, also by steps; its id is the smallest id in it (null if it has none). ``n_links`` counts the
    other rows with a similar text, ``n_copies`` those among them with an equal one. Rows that repeat are copies of
    each other. An empty table gives no rows; other columns are not read.
    """
    united, links = similar_texts(df, id_col, text_col, least)
    rows = df.select(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("node"))
    texts = rows.groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    classed = texts.join(united, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classed = stash(classed, "classes")
    ids = classed.groupBy("component").agg(F.min("low").alias("class_id"))
    told = classed.join(ids, "component").select("node", "class_id", "copies", "links")
    others = F.col("copies") - 1
    return rows.join(told, "node").select(
        F.col("id").alias(id_col), "class_id", (others + F.coalesce("links", F.lit(0))).alias("n_links"), others.alias("n_copies")
    )


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """One row of each class of similar texts, with all columns: that with the smallest id.

    A class without any id keeps a row of each of its texts. Of rows that repeat id and text one stays.
    """
    united, _ = similar_texts(df, id_col, text_col, least)
    node = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    texts = df.select(F.col(id_col), node.alias("__n")).groupBy(F.col("__n").alias("node")).agg(F.min(id_col).alias("low"))
    classed = texts.join(united, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = classed.groupBy("component").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "node")).alias("first"))
    node_name, low_name = unused(df, "node", "low")
    keep = first.select(F.col("first.node").alias(node_name), F.col("first.low").alias(low_name))
    keep = stash(keep, "kept")
    same = (node == F.col(node_name)) & F.col(id_col).eqNullSafe(F.col(low_name))
    left = df.join(keep, same, "left_semi")
    once = df.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return left if once else left.withColumn(node_name, node).dropDuplicates([id_col, node_name]).drop(node_name)
