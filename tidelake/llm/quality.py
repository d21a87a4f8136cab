"""Quality scores: kernel ridge regression through random Fourier features, then isotonic calibration.

A document becomes a vector of statistics of its whole text. Random Fourier features make inner products that
approximate a Gaussian kernel on the standardised vectors; each partition adds up its part of the normal
equations, the sums meet row by row, and the driver solves a system whose size is the number of features.
Scores are calibrated to probabilities by isotonic regression on a fixed grid of scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stash
from .names import unused

STATISTICS = (
    "log_chars", "log_words", "word_length", "longest_word", "letters", "upper", "digits", "spaces", "marks",
    "symbols", "bars", "wide", "entropy", "distinct_words", "repeated_next", "repeated_lines", "line_length",
    "ended_lines", "capital_words", "plain_words", "short_words", "common_byte",
)
FEATURES = 320
RIDGE = 1e-3
GRID = 2000
SEED = 20240229


def _bytes(chars: str) -> np.ndarray:
    return np.frombuffer(chars.encode(), np.uint8)


LOWER, UPPER, DIGITS = _bytes("abcdefghijklmnopqrstuvwxyz"), _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("0123456789")
SPACES, MARKS, SYMBOLS = _bytes(" \n\t\r"), _bytes(".,;:?'\"()-"), _bytes("!#$%&*@^~<>=+_/\\{}[]`")


def statistics(text: str) -> list[float]:
    """The vector of STATISTICS; all zero for an empty text."""
    raw = text.encode("utf-8")
    if not raw:
        return [0.0] * len(STATISTICS)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = float(len(raw))
    share = hist / size
    seen = share[share > 0]
    words, lines = text.split(), text.split("\n")
    n = len(words) or 1
    used = [x for x in lines if x]
    lengths = list(map(len, words))
    return [
        math.log1p(len(text)),
        math.log1p(len(words)),
        sum(lengths) / n,
        math.log1p(max(lengths, default=0)),
        float(share[LOWER].sum()),
        float(share[UPPER].sum()),
        float(share[DIGITS].sum()),
        float(share[SPACES].sum()),
        float(share[MARKS].sum()),
        float(share[SYMBOLS].sum()),
        float(share[ord("|")]),
        float(share[128:].sum()),
        float(-(seen * np.log2(seen)).sum()),
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(used)) / (len(used) or 1),
        math.log1p(len(text) / (len(used) or 1)),
        sum(x[-1] in ".!?:" for x in used) / (len(used) or 1),
        sum(map(str.isupper, words)) / n,
        sum(map(str.isalpha, words)) / n,
        sum(x < 3 for x in lengths) / n,
        float(share.max()),
    ]


def document_statistics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "x": [statistics(x) for x in batch["text"]]})

    read = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return read.mapInPandas(run, f"id {kind}, x array<double>")


class FourierMap:
    """Standardised statistics -> features whose inner products approximate a Gaussian kernel, and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, seed: int = SEED):
        draw, d = np.random.default_rng(seed), len(mean)
        self.mean, self.scale = mean, scale
        self.weights = draw.normal(size=(d, features)) / math.sqrt(d)
        self.phase = draw.uniform(0, 2 * math.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        standard = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = math.sqrt(2 / len(self.phase)) * np.cos(standard @ self.weights + self.phase)
        return np.hstack([waves, np.ones((len(x), 1))])


TEXTS = 500  # rows that a Python worker holds at once
FANIN = 64  # rows that a task adds up, about


def summed(parts: DataFrame, column: str) -> DataFrame:
    """``k`` and the sum of the float64 arrays (binary ``column``) of each k. The rows of a k first meet in groups of
    about ``FANIN`` source partitions; each step adds batch by batch and holds one array."""
    schema = f"k int, {column} binary"

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, row in zip(batch["k"], batch[column], strict=True):
                own = np.frombuffer(row)
                total[k] = total[k] + own if k in total else own.copy()
        if total:
            yield pd.DataFrame({"k": list(total), column: [x.tobytes() for x in total.values()]}).astype({"k": "int32"})

    source = F.floor(F.spark_partition_id() / FANIN)
    some = parts.withColumn("source", source).repartition("k", "source").select("k", column).mapInPandas(add, schema)
    return some.repartition("k").mapInPandas(add, schema)


def normal_equations(labelled: DataFrame, fourier: FourierMap) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over rows (x, y): each partition sends one row per feature; rows are added up in two steps, so that no
    task holds as many rows as there are partitions."""
    size = len(fourier.phase) + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            if len(batch):
                z = fourier(np.stack(batch["x"]))
                total += z.T @ np.column_stack([z, batch["y"].to_numpy(float)])
        yield pd.DataFrame({"k": range(size), "row": [x.tobytes() for x in total]})

    parts = labelled.select("x", "y").mapInPandas(partial, "k int, row binary")
    found = np.zeros((size, size + 1))
    for r in summed(parts, "row").collect():
        found[r["k"]] = np.frombuffer(bytes(r["row"]))
    return found[:, :size], found[:, size]


def isotonic(values: np.ndarray, means: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing fit to the means, by pooling neighbours that violate the order."""
    blocks: list[list[float]] = []
    for mean, weight in zip(means, weights, strict=True):
        blocks.append([mean, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, n = blocks.pop()
            last = blocks[-1]
            blocks[-1] = [(last[0] * last[1] + m * w) / (last[1] + w), last[1] + w, last[2] + n]
    return np.concatenate([np.full(int(n), m) for m, _, n in blocks]) if blocks else values[:0]


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``id_col, held_out, score, predicted`` for each row.

    Labels count where they are 0 or 1 and crc32 of the id as text isn't divisible by 5; the others are held out.
    A null text counts as empty, and an empty one gets the score of its (zero) statistics. A null id is never held
    out and has no label. Repeated rows get the same score each. Without any label all scores are 0.5. An empty
    table gives no rows. Only sums whose size is the number of features reach the driver.
    """
    spark = df.sparkSession
    vectors = stash(document_statistics(df, id_col, text_col), "statistics", TEXTS)
    d = len(STATISTICS)
    moments = vectors.agg(*[f(F.col("x")[k]).alias(f"{n}{k}") for k in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([moments[f"m{k}"] or 0.0 for k in range(d)])
    scale = np.array([max(moments[f"s{k}"] or 0.0, 1e-6) for k in range(d)])
    fourier = FourierMap(mean, scale)

    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 0, F.lit(False))
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1)")
    labelled = vectors.where(~held_out).join(usable, "id").select("x", "y")
    gram, target = normal_equations(labelled, fourier)
    n = gram[-1, -1]
    weights = np.linalg.solve(gram + RIDGE * max(n, 1) / len(gram) * np.eye(len(gram)), target)

    def raw(x: pd.Series) -> np.ndarray:
        return np.clip(fourier(np.stack(x)) @ weights, -0.5, 1.5)

    @F.pandas_udf("int")
    def cell(x: pd.Series) -> pd.Series:
        return pd.Series(np.round((raw(x) + 0.5) / 2 * GRID).astype("int32"))

    cells = labelled.select(cell("x").alias("cell"), "y").groupBy("cell").agg(F.avg("y").alias("mean"), F.count("*").alias("n"))
    rows = sorted(cells.collect())
    at = np.array([r["cell"] for r in rows]) / GRID * 2 - 0.5
    fitted = isotonic(at, np.array([r["mean"] for r in rows]), np.array([r["n"] for r in rows], float))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                score = np.interp(raw(batch["x"]), at, fitted) if len(at) else np.full(len(batch), 0.5)
                yield pd.DataFrame({"id": batch["id"], "held_out": batch["held_out"], "score": np.clip(score, 0, 1)})

    kind = df.schema[id_col].dataType.simpleString()
    scored = vectors.withColumn("held_out", held_out).mapInPandas(run, f"id {kind}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows whose text scores at least ``least``, with their columns. Rows that share an id (or have none) stand or
    fall together, by their best score."""
    rejected, score = unused(df, "rejected", "score")
    scores = quality_scores(df, labels, id_col, text_col).groupBy(id_col).agg(F.max("score").alias(score))
    out = scores.where(F.col(score) < least).select(F.col(id_col).alias(rejected))
    return df.join(out, F.col(id_col).eqNullSafe(F.col(rejected)), "left_anti")
