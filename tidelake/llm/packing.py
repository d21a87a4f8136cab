"""Packing token sequences into as few fixed-size sequences as possible.

The lengths make a histogram of at most ``capacity`` kinds, whatever the number of documents. On it, the
configuration linear program (how often to use each way of filling a sequence) is solved by multiplicative
weights: a kind's price falls as it gets covered, and the best configuration at the current prices is found by
dynamic programming over the capacity (knapsack). The result is rounded down, what is left rounded up by the same
prices, and a last small share is placed best fit. The plan is a table of runs whose size depends on the capacity only; Spark ranks the pieces of
each length and finds each piece's place in it.
"""

from __future__ import annotations

import base64
import json
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import stash
from .chunks import ChunkCache

ROUNDS = 192  # of multiplicative weights
TAIL = 0.002  # share of the content that is left to best fit
PULL = 0.3  # tokens at most that a sequence of longer and less covered pieces may be less full, about
TEXTS = 500  # rows that a Python worker holds at once
CHUNKS = 200_000  # chunks of which it keeps the ids during a task, some 100 MB
ROWS_PER_SALT = 20_000  # pieces of one length that a task ranks together, about


class Encoder:
    """Ids of whole texts, as ``tokenizers`` gives them for a byte-level BPE file without added special tokens.

    Merging is done by ``tiktoken`` on the same vocabulary; texts that hold the string of a special token, which
    ``tokenizers`` finds by default, are given to it.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(json_path, encoding="utf-8") as file:
            self.special = [x["content"] for x in json.load(file).get("added_tokens", ())]
        self.json_path = json_path
        self.bpe = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.library: Tokenizer | None = None
        self.cache = ChunkCache(self.chunk, CHUNKS)

    def chunk(self, chunk: str) -> bytes | None:
        """Ids of a space (or the newline it starts with) and what follows; None where the cut after it isn't safe."""
        if not chunk or chunk[-1].isspace():
            return None
        return self.whole(chunk if chunk[0] == "\n" else " " + chunk)

    def whole(self, text: str) -> bytes:
        ids = array("I", self.bpe.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if any(x in text for x in self.special):
            if self.library is None:
                self.library = Tokenizer.from_file(self.json_path)
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = (text.replace("\n", " \n") if "\n" in text else text).split(" ")
        if first and first[-1].isspace():
            return self.whole(text)
        try:
            return self.whole(first) + b"".join(map(self.cache.__getitem__, rest))
        except TypeError:  # white space before white space
            return self.whole(text)


_encoders: dict[tuple, Encoder] = {}


def _encoder(*paths: str) -> Encoder:
    if paths not in _encoders:
        _encoders[paths] = Encoder(*paths)
    return _encoders[paths]


def token_pieces(
    df: DataFrame, json_path: str, ranks_path: str, pattern: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool
) -> DataFrame:
    """Each document's ids and an end id, cut into pieces of ``capacity`` if longer; the first piece takes the rest."""
    kind = df.schema[id_col].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(json_path, ranks_path, pattern)
        try:
            for batch in batches:
                rows: list[tuple] = []
                for doc, text in zip(batch["id"], batch["text"], strict=True):
                    ids = encoder.ids(text) + end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else [0, n]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        own = ids[4 * a : 4 * b]
                        rows.append((doc, k, a, b - a, zlib.crc32(own), own) if with_ids else (doc, k, a, b - a, zlib.crc32(own)))
                yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
        finally:  # the worker goes on to other stages, where it would still hold them
            encoder.cache.clear()

    read = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = read.mapInPandas(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)
    return out.withColumnRenamed("id", id_col)


def best_configuration(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each length (ascending) make the dearest content of one sequence: unbounded knapsack."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room], taken[room] = best[room - 1], -1
        if n := fitting[room]:
            values = best[room - lengths[:n]] + prices[:n]
            k = int(values.argmax())
            if values[k] > best[room]:
                best[room], taken[room] = values[k], k
    counts, room = np.zeros(len(lengths), np.int64), capacity
    while room > 0:
        if (k := taken[room]) < 0:
            room -= 1
        else:
            counts[k] += 1
            room -= lengths[k]
    return counts


def solve_configurations(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Configurations with fractional amounts that cover about the demand, by multiplicative weights."""
    total = float((lengths * demand).sum()) / capacity
    covered, chosen = np.zeros(len(lengths)), []
    for t in range(rounds):
        prices = lengths / capacity * np.exp(-4.0 * (covered - t / rounds))
        counts = best_configuration(lengths, prices, capacity)
        covered += counts * (total / rounds) / demand
        chosen.append((counts, total / rounds))
    return chosen


def bounded_configuration(lengths: np.ndarray, room: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The dearest content of one sequence that takes no more of a length than there is: bounded knapsack."""
    parts: list[tuple[int, int]] = []  # (length by number, how many of it at once): 1, 2, 4, ... and the rest
    for k, n in enumerate(np.minimum(room, capacity // lengths).tolist()):
        size = 1
        while n > 0:
            parts.append((k, min(size, n)))
            n -= size
            size *= 2
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(parts), capacity + 1), bool)
    for n, (k, times) in enumerate(parts):
        size = int(lengths[k]) * times
        with_it = best[: capacity + 1 - size] + prices[k] * times
        taken[n, size:] = with_it > best[size:]
        np.maximum(best[size:], with_it, out=best[size:])
    counts, at = np.zeros(len(lengths), np.int64), int(best.argmax())
    for n in range(len(parts) - 1, -1, -1):
        if taken[n, at]:
            k, times = parts[n]
            counts[k] += times
            at -= int(lengths[k]) * times
    return counts


def plan(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Groups of sequences with equal content, as ({length: how many}, sequences), covering the histogram exactly.

    The fractional solution is rounded down. What it leaves is rounded up: the same prices, by how far each length is
    covered, choose configurations that fit what is left, each with the longest piece there is; each uses up a length at
    least, so there are at most as many as lengths.
    Best fit places the rest, a share of less than ``TAIL``.
    """
    left = {k: n for k, n in histogram.items() if n > 0}
    groups: list[tuple[dict[int, int], int]] = []
    if n := left.pop(capacity, 0):
        groups.append(({capacity: 1}, n))
    if left:
        lengths = np.array(sorted(left), np.int64)
        demand = np.array([left[int(k)] for k in lengths], np.int64)
        room, carry, total = demand.copy(), 0.0, int((lengths * demand).sum())

        def place(counts: np.ndarray, times: int) -> None:
            nonlocal room
            used = counts > 0
            room = room - counts * times
            groups.append(({int(k): int(c) for k, c in zip(lengths[used], counts[used], strict=True)}, times))

        for counts, amount in solve_configurations(lengths, demand, capacity, rounds):
            used = counts > 0
            carry += amount  # what isn't used yet of the fractions goes on to the next round
            times = int(min(carry, (room[used] // counts[used]).min()))
            carry -= times
            if times:
                place(counts, times)
        while (rest := int((lengths * room).sum())) > TAIL * total:
            first = int(np.flatnonzero(room)[-1])  # the longest piece is the hardest to place later
            counts = np.zeros(len(lengths), np.int64)
            counts[first] = 1
            space = capacity - int(lengths[first])
            some = np.flatnonzero((room > counts) & (lengths <= space))
            behind = (room / demand - rest / total)[some]  # lengths that are covered less than others are dearer
            # the fullest content first, and of those the one with the longest and least covered pieces
            prices = lengths[some] + PULL * (lengths[some] / capacity) ** 2 * np.exp(behind)
            counts[some] += bounded_configuration(lengths[some], (room - counts)[some], prices, space)
            used = counts > 0
            place(counts, int((room[used] // counts[used]).min()))
        groups += best_fit({int(k): int(n) for k, n in zip(lengths, room, strict=True) if n}, capacity)
    return groups


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, on counts: sequences that look alike are handled together."""
    spaces: dict[int, list[tuple[dict[int, int], int]]] = {}
    for length in sorted(left, reverse=True):
        n = left[length]
        for space in sorted(k for k in spaces if k >= length):
            keep, moved = [], []
            for content, times in spaces[space]:
                if not n:
                    keep.append((content, times))
                    continue
                each = min(space // length, n)
                full = min(times, n // each)
                n -= full * each
                moved.append((space - each * length, content | {length: content.get(length, 0) + each}, full))
                if full < times:
                    keep.append((content, times - full))
            spaces[space] = keep
            for rest, content, times in moved:
                spaces.setdefault(rest, []).append((content, times))
            if not spaces[space]:
                del spaces[space]
            if not n:
                break
        each = capacity // length
        for size, times in ((each, n // each), (n % each, 1)):
            if size and times:
                spaces.setdefault(capacity - size * length, []).append(({length: size}, times))
    return [group for space in spaces.values() for group in space if group[1]]


def runs(groups: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, pieces a sequence, first sequence, offset of the first piece)."""
    found, ranked, sequence = [], {}, 0
    for content, times in groups:
        at = 0
        for length, each in sorted(content.items(), reverse=True):
            first = ranked.get(length, 0)
            ranked[length] = first + each * times
            found.append((length, first, first + each * times, each, sequence, at))
            at += length * each
        sequence += times
    return found


def pack(
    df: DataFrame,
    json_path: str,
    ranks_path: str,
    pattern: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).

    A null text counts as empty: one piece, the end id. Repeated rows are packed as often as they occur; null ids
    stay; an empty table gives no rows; other columns are not read. Only lengths are collected, at most
    ``capacity`` numbers.
    """
    spark = df.sparkSession
    pieces = stash(token_pieces(df, json_path, ranks_path, pattern, capacity, end_id, id_col, text_col, with_ids), "pieces", TEXTS)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = 1 + sum(histogram.values()) // ROWS_PER_SALT
    table = spark.createDataFrame(
        runs(plan(histogram, capacity)), "length long, first long, after long, each long, sequence long, at long"
    )

    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(salts)))
    inner = W.partitionBy("length", "salt").orderBy(id_col, "piece", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(inner) - 1)
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = ranked.join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("own"))
    # bounded by the capacity, whatever the number of documents
    placed = numbered.join(F.broadcast(table), "length").where("rank >= first AND rank < after")
    return placed.select(
        id_col,
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.expr("sequence + (rank - first) DIV each").alias("sequence_id"),
        F.expr("at + (rank - first) % each * length").alias("offset"),
        *["ids"] * with_ids,
    )
