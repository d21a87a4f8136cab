"""Product codes of vectors by integer k-means, exact at every step.

Components become integers, vectors are cut into equal parts, and each part gets the number of the nearest entry of its
codebook. Squared distances come from one matrix product, ``|x|^2 - 2 x.c + |c|^2``. The product is done in float64 by BLAS
on limbs: integers are broken into digits so small that no sum of products of two digits reaches 2^53, so each product is exact,
and the products of all pairs of limbs are put together in int64. The first of the smallest distances wins.

A round is one pass over the vectors. Each task sums the parts of each entry and gives one row an entry it met; Spark
adds those rows up. What comes to the driver is the codebook: parts x entries x components, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stash

CHUNK = 4096  # vectors of which a task holds the distances at a time
FEW_LABELS = 100_000  # label sums that are broadcast; beyond that they are joined by label and salt
SALTS = 16


def digits(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Limbs of an int64 array, lowest first, as float64: ``sum(limb << (bits * k))`` is the array. All are from 0 to
    ``2^bits - 1`` but the last, which has the sign and is at most that large."""
    found = []
    while x.size and (x.max() >= 1 << bits or x.min() < -(1 << bits)):
        found.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*found, x.astype(np.float64)]


def limb_bits(dim: int) -> int:
    """The most bits with ``dim * 2^bits * 2^bits <= 2^53``."""
    return (53 - max(dim - 1, 1).bit_length()) // 2


def exact_product(a: np.ndarray, b: np.ndarray, bits: int | None = None) -> np.ndarray:
    """``a @ b.T`` of int64 matrices, exact where the result fits int64."""
    bits = bits or limb_bits(a.shape[1])
    out = np.zeros((a.shape[0], b.shape[0]), np.int64)
    for i, x in enumerate(digits(a, bits)):
        for k, y in enumerate(digits(b, bits)):
            out += (x @ y.T).astype(np.int64) << (bits * (i + k))
    return out


def assign(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest entry of each row, the first of equally near ones, and its squared distance."""
    distances = (entries * entries).sum(axis=1)[None, :] - 2 * exact_product(parts, entries)
    nearest = distances.argmin(axis=1)
    return nearest, distances[np.arange(len(parts)), nearest] + (parts * parts).sum(axis=1)


def usable(vector: str) -> Column:
    """Neither null nor holding null or non-finite components."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & fine, F.lit(False))


def _matrix(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(flat * scale)
    if whole.size and np.abs(whole).max() >= (most := 2.0 ** ((61 - max(dim - 1, 1).bit_length()) // 2)):
        raise ValueError(f"a component times {scale} reaches {most:.0f}: squared distances of {dim} components would not fit 64 bits")
    return whole.astype(np.int64).reshape(len(column), dim)


def _cuts(dim: int, parts: int) -> list[tuple[int, int]]:
    """Consecutive parts, as equal as can be; the first ones are longer where ``parts`` doesn't divide ``dim``."""
    ends = np.cumsum([len(x) for x in np.array_split(np.arange(dim), parts)]).tolist()
    return list(zip([0, *ends], ends, strict=False))


@dataclass
class Codebooks:
    """One integer matrix (entries x components) for each part of the vectors."""

    entries: list[np.ndarray]
    dim: int
    scale: int

    def digest(self) -> str:
        """Hex SHA-256 of all components by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for x in part.ravel().tolist()).encode()).hexdigest()

    def cut(self, column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        """Rows from which a chunk starts, and its parts."""
        for at in range(0, len(column), CHUNK):
            whole = _matrix(column.slice(at, CHUNK), self.dim, self.scale)
            yield at, [np.ascontiguousarray(whole[:, a:b]) for a, b in _cuts(self.dim, len(self.entries))]


def first_codebooks(kept: DataFrame, id_col: str, vector: str, parts: int, entries: int, scale: int) -> Codebooks | None:
    """The parts of the ``entries`` smallest ids, ascending (null ids last, equal ids by their vectors); None without rows.
    The dimension is that of the first row."""
    order = [F.col(id_col).asc_nulls_last(), F.col(vector)]
    first = kept.orderBy(F.col(id_col).asc_nulls_last(), F.col(vector)).select(F.size(vector)).first()
    if first is None:
        return None
    dim = first[0]
    rows = kept.where(F.size(vector) == dim).orderBy(*order).limit(entries).select(vector).toArrow()
    whole = _matrix(rows.column(0).combine_chunks(), dim, scale)
    return Codebooks([np.ascontiguousarray(whole[:, a:b]) for a, b in _cuts(dim, parts)], dim, scale)


def refined(kept: DataFrame, vector: str, books: Codebooks) -> Codebooks:
    """One round: each entry becomes the floor of the mean of the parts assigned to it; one without parts stays."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(x.shape, np.int64) for x in books.entries]
        counts = [np.zeros(len(x), np.int64) for x in books.entries]
        for batch in batches:
            for _, parts in books.cut(batch.column(0)):
                for k, part in enumerate(parts):
                    nearest, _ = assign(part, books.entries[k])
                    np.add.at(sums[k], nearest, part)
                    counts[k] += np.bincount(nearest, minlength=len(counts[k]))
        met = [(k, int(e)) for k in range(len(counts)) for e in np.flatnonzero(counts[k])]
        yield pa.RecordBatch.from_pydict(
            {"part": [k for k, _ in met], "entry": [e for _, e in met], "n": [int(counts[k][e]) for k, e in met], "sums": [sums[k][e].tolist() for k, e in met]},
            pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]),
        )

    found = kept.select(vector).mapInArrow(partial, "part int, entry int, n long, sums array<long>")
    width = max((x.shape[1] for x in books.entries), default=0)
    added = [F.sum(F.get("sums", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
    entries = [x.copy() for x in books.entries]
    for row in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():  # no more rows than entries
        own = entries[row["part"]]
        own[row["entry"]] = [int(row[f"s{k}"]) // row["n"] for k in range(own.shape[1])]
    return Codebooks(entries, books.dim, books.scale)


def fitted(kept: DataFrame, id_col: str, vector: str, parts: int, entries: int, rounds: int, scale: int) -> Codebooks | None:
    books = first_codebooks(kept, id_col, vector, parts, entries, scale)
    if books is None:
        return None
    kept = kept.where(F.size(vector) == books.dim)
    for _ in range(rounds if books.dim else 0):
        books = refined(kept, vector, books)
    return books


def coded(kept: DataFrame, id_col: str, vector: str, label: str, books: Codebooks) -> DataFrame:
    """``id, label, code binary (one byte a part), error long`` by given codebooks of at most 256 entries."""
    kinds = [kept.schema[c].dataType.simpleString() for c in (id_col, label)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.zeros((batch.num_rows, len(books.entries)), np.uint8)
            errors = np.zeros(batch.num_rows, np.int64)
            for at, parts in books.cut(batch.column(2)):
                for k, part in enumerate(parts):
                    nearest, distances = assign(part, books.entries[k])
                    codes[at : at + len(nearest), k] = nearest
                    errors[at : at + len(nearest)] += distances
            told = pa.array([x.tobytes() for x in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), told, pa.array(errors)], names=["id", "label", "code", "error"])

    read = kept.where(F.size(vector) == books.dim).select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    return read.mapInArrow(run, f"id {kinds[0]}, label {kinds[1]}, code binary, error long")


def decoded(code: bytes, books: Codebooks) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([part[k] for part, k in zip(books.entries, code, strict=True)])


def with_label_error(rows: DataFrame, few: int = FEW_LABELS) -> DataFrame:
    """``rows`` with ``label_error``, the sum of ``error`` over equal labels, nulls together. Sums are broadcast if few; else
    they are joined by label and salt, so that a label of many rows is spread over tasks."""
    sums = stash(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    if sums.count() <= few:
        return rows.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    spread = sums.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("of_salt"))
    return salted.join(spread, same).drop("of", "salt", "of_salt")


def vector_codes(
    df: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
) -> DataFrame:
    """``id_col, code string (two hex digits a part), error long, label_error long, codebooks_sha256 string`` for each usable row.

    Rows whose vector is null or holds null or non-finite components take no part; nor do rows of another dimension than the
    row with the smallest id has. Zero vectors do. Parts are as equal as can be; a vector without components has empty parts,
    and entry 0 stands for all. With fewer rows than entries the codebooks have one entry a row. Repeated rows stay repeated and count
    each; null ids come after all others; equal ids are ordered by their vectors. An empty table gives no rows. Other columns aren't
    read. Components so large that squared distances leave 64 bits are an error, never a wrong code.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    kept = df.select(id_col, label, vector).where(usable(vector))
    books = fitted(kept, id_col, vector, parts, entries, rounds, scale)
    if books is None:
        return spark.createDataFrame([], f"`{id_col}` {kind}, code string, error long, label_error long, codebooks_sha256 string")
    rows = with_label_error(stash(coded(kept, id_col, vector, label, books), "codes"))
    return rows.select(
        F.col("id").alias(id_col), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )
