"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping passages of words. Passages are TF-IDF vectors over the words of the benchmark;
a distributed randomised SVD (one pass, Nystroem form: each partition adds its part of A'AW) gives a latent space in
which passages and benchmark items are compared by cosine. Candidates are checked by the longest common
subsequence of words with the neighbourhood of the passage; where that is only partly covered, as in a paraphrase,
the item's answer (its last words) has to be there as well.

A second, exact path needs no cosine: a passage whose neighbourhood holds ``SURE`` of an item's words holds some of
its rarest ones, and one that holds less has to hold the answer. All such passages are candidates too, so what the
check would accept is never lost to the rank of the latent space. Of all candidates of a document and an item the one
with the largest share counts, the first in the text if several have it, so how a benchmark is cut into blocks changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stash
from .names import unused
from .quality import summed
from .shingles import word_hashes

ITEMS = 2000  # benchmark items searched together; more are searched in further blocks
TEXTS = 1024  # rows that a Python worker holds at once
HALF = 16  # words of half a passage; passages overlap by half
RANK = 128
COSINE = 0.25
SURE, MAYBE = 0.8, 0.6  # share of an item's words in the longest common subsequence
ANSWER = 5  # words
COMMON = 0.1  # words in more than this share of the documents carry no weight
ROWS = 64  # terms whose sums travel in one row


class Items:
    """A block of benchmark items: vocabulary, words by number, and their bit masks."""

    def __init__(self, ids: list, texts: list[str]):
        hashes, where = word_hashes(texts)
        self.vocabulary = np.unique(hashes)
        numbers = np.searchsorted(self.vocabulary, hashes)
        cuts = np.searchsorted(where, np.arange(1, len(texts)))
        words = np.split(numbers, cuts) if texts else []
        fit = [k for k, w in enumerate(words) if len(w)]
        self.ids, self.words = [ids[k] for k in fit], [words[k].tolist() for k in fit]
        self.masks: list[dict[int, int]] = []
        for own in self.words:
            mask: dict[int, int] = {}
            for k, w in enumerate(own):
                mask[w] = mask.get(w, 0) | 1 << k
            self.masks.append(mask)

    def common(self, item: int, region: list[int]) -> int:
        """Length of the longest common subsequence, a bit per word of the item."""
        mask, n = self.masks[item], len(self.words[item])
        whole = (1 << n) - 1
        rest = whole
        for w in region:
            hit = rest & mask.get(w, 0)
            rest = ((rest + hit) | (rest - hit)) & whole
        return n - rest.bit_count()

    def members(self) -> np.ndarray:
        """Which word is in which item."""
        found = np.zeros((len(self.words), len(self.vocabulary)), bool)
        for k, own in enumerate(self.words):
            found[k, own] = True
        return found

    def match(self, item: int, region: list[int]) -> float:
        """Covered share of the item if it counts as found in the region, else 0."""
        own = self.words[item]
        share = self.common(item, region) / len(own)
        if share >= SURE:
            return share
        if share >= MAYBE:
            answer = own[-ANSWER:]
            last = len(region) - len(answer)
            if any(region[k : k + len(answer)] == answer for k in range(last + 1)):
                return share
        return 0.0


def _numbers(docs: DataFrame, items: Items) -> DataFrame:
    """Each document's words as numbers in the benchmark's vocabulary, -1 for others."""
    vocabulary = items.vocabulary
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch[at : at + 1024]
                hashes, where = word_hashes(part["text"].to_list())
                place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                number = np.where(vocabulary[place] == hashes, place, -1).astype(np.int32)
                cuts = np.searchsorted(where, np.arange(1, len(part)))
                yield pd.DataFrame({"id": part["id"], "words": [x.tobytes() for x in np.split(number, cuts)]})

    return docs.mapInPandas(run, f"id {kind}, words binary")


def _gathered(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(x, np.int32) for x in batch["words"]]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), sizes


def _slices(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for at in range(0, len(batch), 512):
        yield batch[at : at + 512]


def _document_frequencies(numbered: DataFrame, size: int) -> np.ndarray:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for part in _slices(batch):
                words, sizes = _gathered(part)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                inside = words >= 0
                pairs = np.unique(doc[inside] * size + words[inside])
                total += np.bincount(pairs % size, minlength=size)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"term": used, "n": total[used]})

    found = np.zeros(size, np.int64)
    for r in numbered.mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        found[r["term"]] = r["n"]
    return found


def _halves(words: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted words, the half passage each is in, the document of each half, and its place in the document."""
    per_doc = np.maximum(-(-sizes // HALF), 1)
    first = np.r_[0, np.cumsum(per_doc)]
    start = np.r_[0, np.cumsum(sizes)]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    half = first[doc] + (np.arange(len(words)) - start[doc]) // HALF
    owner = np.repeat(np.arange(len(sizes)), per_doc)
    use = words >= 0
    use[use] = weights[words[use]] > 0
    return words[use], half[use], owner, np.arange(len(owner)) - first[owner]


def _sums(table: np.ndarray, words: np.ndarray, half: np.ndarray, n: int) -> np.ndarray:
    """Sum of the words' rows of the table for each half passage; halves come in order. One step per place in a half."""
    total = np.zeros((n, table.shape[1]), np.float32)
    if len(half):
        edge = np.flatnonzero(np.r_[True, half[1:] != half[:-1]])
        sizes = np.diff(np.r_[edge, len(half)])
        total[half[edge]] = table[words[edge]]
        for k in range(1, int(sizes.max())):
            at = edge[sizes > k] + k
            total[half[at]] += table[words[at]]
    return total


def _passages(halves: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Each half with the next one of the same document."""
    total = halves.copy()
    same = owner[:-1] == owner[1:]
    total[:-1][same] += halves[1:][same]
    return total


def latent_space(numbered: DataFrame, weights: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (terms x rank) of the TF-IDF passages, by a one-pass randomised SVD."""
    size = len(weights)
    test = np.random.default_rng(7).normal(size=(size, rank)).astype(np.float32)
    scaled = test * weights[:, None].astype(np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, rank), np.float64)
        for batch in batches:
            for part in _slices(batch):
                words, sizes = _gathered(part)
                own, half, owner, _ = _halves(words, sizes, weights)
                if not len(own):
                    continue
                y = _passages(_sums(scaled, own, half, len(owner)), owner)  # A W
                order = np.argsort(own, kind="stable")
                own, half = own[order], half[order]
                edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                # a word is in the passage that starts at its half and in the one before
                both = y.copy()
                same = owner[:-1] == owner[1:]
                both[1:][same] += y[:-1][same]
                total[own[edge]] += np.add.reduceat(both[half], edge, axis=0)
        total *= weights[:, None]
        rows = [(k, total[k * ROWS : (k + 1) * ROWS].tobytes()) for k in range(-(-size // ROWS))]
        yield pd.DataFrame([r for r in rows if np.frombuffer(r[1]).any()], columns=["k", "part"])

    z = np.zeros((size, rank))
    for r in summed(numbered.mapInPandas(run, "k int, part binary"), "part").collect():
        z[r["k"] * ROWS : (r["k"] + 1) * ROWS] = np.frombuffer(bytes(r["part"])).reshape(-1, rank)
    core = test.T.astype(float) @ z
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-9 * max(values.max(initial=0), 1e-300)
    if not good.any():
        return np.linalg.qr(test.astype(float))[0].astype(np.float32)
    left, _, _ = np.linalg.svd(z @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return left.astype(np.float32)


class Exact:
    """Candidates without a cosine: no passage that ``Items.match`` would accept is missing."""

    PAIRS = 1 << 20  # word places looked up together; an item that alone has more is looked up by itself

    def __init__(self, items: Items, frequency: np.ndarray):
        self.sizes = np.array([len(w) for w in items.words])
        words, owners, least, codes, named = [], [], [], [], []
        for k, own in enumerate(items.words):
            n = len(own)
            need = next(c for c in range(1, n + 1) if c / n >= SURE)
            some = max(1, need // 4)
            # at most n - need words are missing, so of n - need + some words at least some are there: the rarest
            rare = set(sorted(own, key=frequency.__getitem__)[: n - need + some])
            words += rare
            owners += [k] * len(rare)
            least.append(some)
            if n >= ANSWER:  # shorter items count only as a whole
                codes.append(self._codes(np.array(own[-ANSWER:]))[0])
                named.append(k)
        self.words, self.owners, self.least = np.array(words), np.array(owners), np.array(least)
        order = np.argsort(np.array(codes, np.uint64), kind="stable")
        self.codes, self.named = np.array(codes, np.uint64)[order], np.array(named, int)[order]

    @staticmethod
    def _codes(words: np.ndarray) -> np.ndarray:
        """A hash of each run of ``ANSWER`` words."""
        base, total = np.uint64(0x9E3779B97F4A7C15), np.zeros(max(0, len(words) - ANSWER + 1), np.uint64)
        for k in range(ANSWER):
            total = total * base + (words[k : k + len(total)] + 2).astype(np.uint64)
        return total

    def _passages(self, item: np.ndarray, at: np.ndarray, run: int, doc: np.ndarray, start: np.ndarray, first: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The passages (and items) whose neighbourhoods hold ``least`` of the given runs of words."""
        d, n = doc[at], self.sizes[item]
        x = at - start[d]
        halves = first[d + 1] - first[d]
        low = first[d] + np.maximum(-((2 * HALF + n - run - x) // HALF), 0)
        high = first[d] + np.minimum((x + n) // HALF, halves - 1) + 1
        width = first[-1] + 1
        places = np.concatenate([item * width + low, item * width + high])
        keys, where = np.unique(places, return_inverse=True)
        held = np.cumsum(np.bincount(where, np.repeat([1, -1], len(item)), len(keys))).astype(int)
        good = np.flatnonzero(held >= least[keys // width])
        length = keys[np.minimum(good + 1, len(keys) - 1)] - keys[good]
        found = np.repeat(keys[good] - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(int(length.sum())) if len(good) else keys[:0]
        return found % width, found // width

    def candidates(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passages by number, and items; pairs may repeat."""
        start = np.r_[0, np.cumsum(sizes)]
        first = np.r_[0, np.cumsum(np.maximum(-(-sizes // HALF), 1))]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        found = [(np.zeros(0, int), np.zeros(0, int))]

        order = np.argsort(words, kind="stable")
        begin, end = (np.searchsorted(words[order], self.words, side) for side in ("left", "right"))
        times = end - begin
        group = np.cumsum(np.bincount(self.owners, times, len(self.sizes))).astype(int) // self.PAIRS
        for g in np.unique(group):
            use = np.flatnonzero((group[self.owners] == g) & (times > 0))
            t = times[use]
            if len(use):
                at = order[np.repeat(begin[use] - np.r_[0, np.cumsum(t)[:-1]], t) + np.arange(int(t.sum()))]
                found.append(self._passages(np.repeat(self.owners[use], t), at, 1, doc, start, first, self.least))

        codes = self._codes(words)
        begin, end = (np.searchsorted(self.codes, codes, side) for side in ("left", "right"))
        hit = np.flatnonzero(end > begin)
        hit = hit[doc[hit] == doc[hit + ANSWER - 1]]
        t = end[hit] - begin[hit]
        if len(hit):
            item = self.named[np.repeat(begin[hit] - np.r_[0, np.cumsum(t)[:-1]], t) + np.arange(int(t.sum()))]
            found.append(self._passages(item, np.repeat(hit, t), ANSWER, doc, start, first, np.ones(len(self.sizes), int)))
        return np.concatenate([p for p, _ in found]), np.concatenate([k for _, k in found])


def _held(words: np.ndarray, start: np.ndarray, length: np.ndarray, item: np.ndarray, members: np.ndarray) -> np.ndarray:
    """How many words of each candidate's region are words of the item: no subsequence can have more."""
    out = np.zeros(len(start), np.int64)
    some = np.flatnonzero(length > 0)
    for at in range(0, len(some), 8192):
        c = some[at : at + 8192]
        first = np.r_[0, np.cumsum(length[c])[:-1]]
        place = np.repeat(start[c] - first, length[c]) + np.arange(int(length[c].sum()))
        w = words[place]
        hit = members[np.repeat(item[c], length[c]), np.maximum(w, 0)] & (w >= 0)
        out[c] = np.add.reduceat(hit, first, dtype=np.int64)
    return out


def _search(numbered: DataFrame, items: Items, weights: np.ndarray, space: np.ndarray, exact: Exact) -> DataFrame:
    terms = (space * weights[:, None]).astype(np.float32)
    targets = np.stack([terms[w].sum(axis=0) for w in items.words])
    lengths = np.linalg.norm(targets, axis=1, keepdims=True)
    targets = np.divide(targets, lengths, out=np.zeros_like(targets), where=lengths > 1e-6)
    kind = numbered.schema["id"].dataType.simpleString()
    columns = ["id", "item", "share", "first_word"]
    members, sizes_of = items.members(), np.array([len(w) for w in items.words])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _slices(batch):
                words, sizes = _gathered(part)
                start = np.r_[0, np.cumsum(sizes)]
                own, half, owner, place = _halves(words, sizes, weights)
                x = _passages(_sums(terms, own, half, len(owner)), owner)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-6)
                best: dict[tuple[int, int], tuple[float, int]] = {}
                found = [np.nonzero(x[a : a + 8192] @ targets.T >= COSINE) + (a,) for a in range(0, len(x), 8192)]
                near = np.concatenate([(ps + a) * len(targets) + ks for ps, ks, a in found]).astype(int)
                ps, ks = exact.candidates(words, sizes)
                p, k = np.divmod(np.r_[near, np.setdiff1d(ps * len(targets) + ks, near)], len(targets))
                doc = owner[p]
                low = np.maximum(place[p] * HALF - sizes_of[k], 0)
                high = np.minimum(place[p] * HALF + 2 * HALF + sizes_of[k], sizes[doc])
                held = _held(words, start[doc] + low, high - low, k, members)
                fit = np.flatnonzero(held >= MAYBE * sizes_of[k])
                fit = fit[np.lexsort((low[fit], k[fit], doc[fit]))]
                most = np.minimum(held, sizes_of[k])[fit] / sizes_of[k[fit]]
                for d, item, a, b, bound in zip(doc[fit].tolist(), k[fit].tolist(), low[fit].tolist(), high[fit].tolist(), most.tolist(), strict=True):
                    if best.get((d, item), (0.0, 0))[0] >= bound:  # of equal shares the first place counts, and places ascend
                        continue
                    share = items.match(item, words[start[d] + a : start[d] + b].tolist())
                    if share > best.get((d, item), (0.0, 0))[0]:
                        best[d, item] = (share, a)
                ids = part["id"].to_list()
                rows = [(ids[d], items.ids[k], share, low) for (d, k), (share, low) in best.items()]
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return numbered.mapInPandas(run, f"id {kind}, item long, share double, first_word long")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """``id_col, item_id, share, first_word`` for each document and benchmark item found in it.

    ``share`` of the item's words stands in the longest common subsequence with the document from about the word
    ``first_word`` on. Null texts count as empty; empty items are never found; rows that repeat id and text, or
    items that repeat, give repeated rows. Empty tables give no rows. Other columns are not read.
    """
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tests = benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = max(1, -(-tests.count() // ITEMS))
    dealt = tests.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).collect()  # about ITEMS rows
        items = Items([r["item"] for r in rows], [r["text"] for r in rows])
        if not items.words:
            continue
        numbered = stash(_numbers(read, items), "words", TEXTS)
        frequency = _document_frequencies(numbered, len(items.vocabulary))
        total = max(1, numbered.count())
        # a word that no document holds still tells items apart, so it gets the largest weight
        weights = np.where(frequency > COMMON * total + 1, 0.0, np.log((total + 1) / (frequency + 0.5)))
        weights = np.maximum(weights, 0.0)
        if not weights.any():
            weights = np.ones(len(weights))
        hits = _search(numbered, items, weights, latent_space(numbered, weights, min(RANK, len(weights))), Exact(items, frequency))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        kind = docs.schema[id_col].dataType.simpleString()
        found = docs.sparkSession.createDataFrame([], f"id {kind}, item long, share double, first_word long")
    return found.select(F.col("id").alias(id_col), F.col("item").alias("item_id"), "share", "first_word")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows in which no benchmark item was found, with their columns. Rows that share an id (or have none) stand or
    fall together."""
    (name,) = unused(docs, "gone")
    gone = contaminated(docs, benchmark, id_col, text_col).select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col(name)), "left_anti")
