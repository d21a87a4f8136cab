"""Byte-level BPE by the ``tiktoken`` library with a local rank file: ids of whole texts, and bytes of ids.

A long text is cut before it is given to the library, only where every match of the pattern ends: between a
character that isn't white space and a space, tab or newline. No match of such a pattern goes from other characters
on into white space, and none looks back, so the ids of the parts, one after another, are those of the whole text. A very
long run of white space, on which the library's matcher runs out of stack, is taken for the one match that it is: all of
it at the end of a text, else all but its last character, which may belong to the word after it.

Ids turn into bytes, not into text, so cutting a list of ids within a character loses nothing.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG = 1 << 16  # characters of a part, about; shorter texts aren't cut
GROUP = 1 << 20  # bytes of text of which a task holds the ids at a time, about
SAFE = regex.compile(r"(?<=\P{White_Space})(?=[ \t\n\r])")
BLANK = regex.compile(r"\p{White_Space}{%d,}" % LONG)


class ByteBpe:
    """Encoder and decoder of one rank file; special tokens aren't known to it, their strings are ordinary text."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.split = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = tiktoken.Encoding("byte-bpe-match", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def parts(self, text: str, long: int = LONG) -> Iterator[tuple[str, bool]]:
        """The text in parts, and whether a part is a single match."""
        at = 0
        for blank in BLANK.finditer(text) if len(text) > long else ():
            yield from ((x, False) for x in self.cut(text[at : blank.start()], long))
            at = blank.end() - (blank.end() < len(text))
            yield text[blank.start() : at], True
        yield from ((x, False) for x in self.cut(text[at:], long))

    @staticmethod
    def cut(text: str, long: int) -> Iterator[str]:
        at = 0
        while len(text) - at > long and (place := SAFE.search(text, at + long)):
            yield text[at : place.start()]
            at = place.start()
        yield text[at:]

    def encode(self, text: str, long: int = LONG) -> np.ndarray:
        found = [np.array((self.whole if match else self.split).encode_ordinary(part), np.int32) for part, match in self.parts(text, long)]
        return found[0] if len(found) == 1 else np.concatenate(found)

    def decode(self, ids: np.ndarray | None) -> bytes | None:
        """The bytes of the ids; None for no list or one with a null or an id that the ranks don't have."""
        if ids is None:
            return None
        try:
            return self.split.decode_bytes(ids.tolist())
        except (KeyError, TypeError, OverflowError):
            return None


_coders: dict[tuple[str, str], ByteBpe] = {}


def _coder(ranks_path: str, pattern: str) -> ByteBpe:
    key = (ranks_path, pattern)
    if key not in _coders:
        _coders[key] = ByteBpe(*key)
    return _coders[key]


def encode_texts(
    df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False
) -> DataFrame:
    """``id_col, n_tokens long, ids array<int>`` for each row, and with ``with_bytes`` what the ids decode to (``bytes binary``).

    Null texts count as empty: no tokens. Repeated rows stay repeated; a null id stays null; other columns aren't read,
    so their names can't clash. Texts of any length are read whole; an empty table gives no rows. The rank file has to be at
    the same path on all executors. Rows go on in small groups, so a task holds few texts and ids at a time.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path, pattern)
        for batch in batches:
            for part in small(batch, batch.column(2).to_numpy()):
                ids = [coder.encode(x) for x in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                told = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                columns = {"id": part.column(0), "n_tokens": pa.array(np.diff(ends).astype(np.int64)), "ids": told}
                if with_bytes:
                    columns["bytes"] = pa.array([coder.decode(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    text = F.coalesce(F.col(text_col), F.lit(""))
    read = df.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n"))
    found = read.mapInArrow(run, f"id {kind}, n_tokens long, ids array<int>" + ", bytes binary" * with_bytes)
    return found.withColumnRenamed("id", id_col)


def small(batch: pa.RecordBatch, sizes: np.ndarray, most: int = GROUP) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes; a larger row is alone with what comes before it."""
    at = total = 0
    for k, size in enumerate(sizes.tolist()):
        total += size
        if total >= most or k == len(sizes) - 1:
            yield batch.slice(at, k + 1 - at)
            at, total = k + 1, 0


def decoded_bytes(ids: Column, ranks_path: str, pattern: str) -> Column:
    """The bytes of ``array<int>`` ids, null for a null list and for lists with nulls or unknown ids. Bytes needn't be whole
    characters: cast them to text only where the ids are those of a whole text."""

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(ranks_path, pattern)
        for batch in batches:
            yield pd.Series([coder.decode(x) for x in batch], dtype=object)

    return decode(ids)
