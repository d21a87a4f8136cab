"""Exact token counts at every prefix of a text.

The vocabulary is that of a sentencepiece BPE model (greedy merges, best score first, leftmost on ties, byte
fallback for characters outside it). A sequence of tokens is the encoding of its text exactly if each token
encodes to itself and each neighbouring pair encodes to that pair. So the encoding of a prefix ends in the one
vocabulary token that fits the token before it, and

    count[i] = count[i - len(token)] + 1

fills a table over all prefixes in one pass (dynamic programming over prefixes). The table is kept as one
signed byte per character: the change of the count at that character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkCache

SPACE = "▁"
SPLIT = re.compile(" +[^ \n]*|\n[^ \n]*")


class PrefixTable:
    """Prefix counts by dynamic programming over one vocabulary."""

    def __init__(self, model_path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = range(model.get_piece_size())
        self.score = {
            model.id_to_piece(i): model.get_score(i)
            for i in ids
            if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))
        }
        self.pieces = list(self.score)
        self.outside = len(self.pieces)
        self.finder = ahocorasick.Automaton()
        for k, piece in enumerate(self.pieces):
            self.finder.add_word(piece, (k, len(piece)))
        self.finder.make_automaton()
        self.edges: dict[str, tuple[list, list]] = {}
        self.alone = [bool(self.edge(piece)[0]) for piece in self.pieces]
        self.fits: dict[int, bool] = {}
        self.cache = ChunkCache(self.changes)

    def merge(self, text: str) -> list[str]:
        """The encoding of a short string as pieces; characters outside the vocabulary stay single."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def edge(self, token: str) -> tuple[list, list]:
        """What stands at the token's left and right edge while it is built: (piece, score of the merge that ends
        it), from single characters on; the whole token ends at no merge (-inf). Empty if merging gives no such token."""
        known = self.edges.get(token)
        if known is None:
            parts, left, right = list(token), [], []
            while len(parts) > 1:
                best, at = None, -1
                for k in range(len(parts) - 1):
                    score = self.score.get(parts[k] + parts[k + 1])
                    if score is not None and (best is None or score > best):
                        best, at = score, k
                if at < 0:
                    break
                if at == 0:
                    left.append((parts[0], best))
                if at == len(parts) - 2:
                    right.append((parts[-1], best))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            whole = [(token, float("-inf"))]
            known = self.edges[token] = (left + whole, right + whole) if len(parts) == 1 else ([], [])
        return known

    def pair_fits(self, key: int) -> bool:
        """Whether two tokens side by side stay two: at no moment of their building does a merge across the
        border come before the next merge at either side of it. The key holds both numbers."""
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        if key >> 20 == self.outside:
            found = self.fits[key] = self.alone[key & 0xFFFFF]
            return found
        one, two = self.pieces[key >> 20], self.pieces[key & 0xFFFFF]
        rights, lefts = self.edge(one)[1], self.edge(two)[0]
        found = bool(rights) and bool(lefts)
        i = k = 0
        while found:
            (x, x_ends), (y, y_ends) = rights[i], lefts[k]
            across = self.score.get(x + y)
            if across is not None and across >= max(x_ends, y_ends):
                found = across == max(x_ends, y_ends) and self.merge(one + two) == [one, two]
                break
            if i == len(rights) - 1 and k == len(lefts) - 1:
                break
            if x_ends >= y_ends:
                i += 1
            else:
                k += 1
        self.fits[key] = found
        return found

    def changes(self, chunk: str) -> bytes:
        """Change of the token count at the chunk's mark and at each of its characters. A chunk that does not
        start with a newline has one space mark before it."""
        text = chunk if chunk[:1] == "\n" else SPACE + chunk.replace(" ", SPACE)
        size, outside = len(text), self.outside
        last, count = [-1] * (size + 1), [0] * (size + 1)

        def fill(end: int) -> None:  # characters in no token, up to this place
            first = end
            while first > 1 and last[first - 1] < 0:
                first -= 1
            for k in range(first, end + 1):
                last[k], count[k] = outside, count[k - 1] + len(text[k - 1].encode("utf-8"))

        fits = self.fits
        for at, (token, length) in self.finder.iter(text):
            end = at + 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                before = last[start]
                if before < 0:
                    fill(start)
                    before = outside
                key = before << 20 | token
                fit = fits.get(key)
                if fit is None:
                    fit = self.pair_fits(key)
            else:
                fit = self.alone[token]
            if fit:
                last[end] = token
                count[end] = count[start] + 1
        if last[size] < 0:
            fill(size)
        return bytes([(b - a) & 255 for a, b in zip(count, count[1:], strict=False)])

    def of(self, text: str) -> bytes:
        """The table of a whole text: first the mark before it, then its characters. Empty for an empty text."""
        if not text:
            return b""
        text = text.replace(SPACE, " ")
        cut = text.replace("\n", " \n") if "\n" in text else text
        if cut[0] != " " and cut[0] != "\n" and "  " not in cut:
            return b"".join(map(self.cache.__getitem__, cut.split(" ")))
        chunks = (x[1:] if x[0] == " " else x for x in SPLIT.findall(" " + text))
        return b"".join(map(self.cache.__getitem__, chunks))


_tables: dict[str, PrefixTable] = {}


def _table(model_path: str) -> PrefixTable:
    if model_path not in _tables:
        _tables[model_path] = PrefixTable(model_path)
    return _tables[model_path]


def count_at(table: bytes, n_chars: int) -> int:
    """Tokens of the first ``n_chars`` characters, from the stored table alone."""
    return int(np.frombuffer(table, np.int8)[: n_chars + 1].sum()) if n_chars > 0 and table else 0


def longest_within(table: bytes, budget: int) -> int:
    """Characters of the longest prefix with at most ``budget`` tokens, from the stored table alone."""
    counts = np.cumsum(np.frombuffer(table, np.int8), dtype=np.int64)
    counts[:1] = 0  # the empty prefix has no tokens
    fit = np.flatnonzero(counts <= budget)
    return int(fit[-1]) if len(fit) else 0


def token_counts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes long, n_tokens long, prefix_changes binary`` for each row.

    Null texts count as empty: no bytes, no tokens, an empty table. Repeated rows stay repeated; a null id stays
    null; other columns are not read, so their names cannot clash. Texts of any length are read whole.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = _table(model_path)
        for batch in batches:
            tables = [table.of(x) for x in batch["text"]]
            sums = [int(np.frombuffer(x, np.int8).sum(dtype=np.int64)) for x in tables]
            yield pd.DataFrame({id_col: batch[id_col], "n_bytes": batch["n_bytes"], "n_tokens": sums, "prefix_changes": tables})

    text = F.coalesce(F.col(text_col), F.lit(""))
    read = df.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return read.mapInPandas(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, prefix_changes binary")


def within_budget(budget: int, n_tokens: str = "n_tokens") -> Column:
    """Whether the whole text fits a token budget."""
    return F.col(n_tokens) <= F.lit(budget)


def truncate(counted: DataFrame, texts: DataFrame, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text cut to its longest prefix of at most ``budget`` tokens, without encoding anything again.

    A text that fits stays whole. ``id_col`` has to be unique on both sides; null ids find no partner.
    """

    @F.pandas_udf("int")
    def kept(tables: pd.Series) -> pd.Series:
        return tables.map(lambda x: longest_within(x, budget)).astype("int32")

    cut = counted.select(id_col, kept("prefix_changes").alias("kept_chars"))
    return texts.select(id_col, text_col).join(cut, id_col).withColumn(text_col, F.substring(text_col, F.lit(1), F.col("kept_chars")))
