"""Hashes of words and word shingles, for a batch of texts at once."""

from __future__ import annotations

import numpy as np

SLAB = 1 << 20  # bytes hashed together
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)


def _powers(base: int) -> np.ndarray:
    found = np.full(SLAB + 1, base, np.uint64)
    found[0] = 1
    return np.multiply.accumulate(found)


_UP = _powers(int(_BASE))
_DOWN = _powers(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _MIX
    x = (x ^ (x >> _SHIFT)) * _MIX
    return x ^ (x >> _SHIFT)


def _slab(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, data), np.int64, len(data)) + 1
    raw = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    word = raw > 32
    edge = np.diff(np.r_[False, word].astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(raw) <= SLAB:
        up, down = _UP, _DOWN
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw * up[: len(raw)], dtype=np.uint64)])
        hashes = (sums[stops] - sums[starts]) * down[starts]
    else:  # one long text: places start anew in each word
        at = np.arange(len(raw), dtype=np.int64)
        origin = np.zeros(len(raw), np.int64)
        origin[starts] = starts
        at -= np.maximum.accumulate(origin)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw * _UP[at % SLAB], dtype=np.uint64)])
        hashes = sums[stops] - sums[starts]
    return mix(hashes), np.searchsorted(np.cumsum(sizes), starts, side="right")


def word_hashes(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (what stands between white space up to U+0020), and the text it is in."""
    hashes, docs, held, size, first = [], [], [], 0, 0
    for n, text in enumerate([*texts, None]):
        data = b"" if text is None else (text.lower() if lower else text).encode("utf-8")
        if held and (text is None or size + len(data) + 1 > SLAB):
            h, d = _slab(held)
            hashes.append(h)
            docs.append(d + first)
            held, size, first = [], 0, n
        held.append(data)
        size += len(data) + 1
    return (np.concatenate(hashes), np.concatenate(docs)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def shingle_hashes(texts: list[str], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of so many words, and the text it is in, in the order of the texts. A text with fewer
    words has one shingle of all of them; one without words has none."""
    h, doc = word_hashes(texts)
    factors = mix(np.arange(1, words + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    counts = np.bincount(doc, minlength=len(texts))
    n = len(h) - words + 1
    if n > 0:
        total = np.zeros(n, np.uint64)
        for k in range(words):
            total += h[k : k + n] * factors[k]
        inside = doc[:n] == doc[words - 1 :]
        found, where = mix(total[inside]), doc[:n][inside]
    else:
        found, where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        first = np.r_[0, np.cumsum(counts)]
        extra = np.array([int((h[first[d] : first[d] + counts[d]] * factors[: counts[d]]).sum(dtype=np.uint64)) for d in short], np.uint64)
        found, where = np.concatenate([found, mix(extra + np.uint64(1))]), np.concatenate([where, short])
        order = np.argsort(where, kind="stable")
        found, where = found[order], where[order]
    return found, where


def sets(texts: list[str], words: int = 5) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    found, where = shingle_hashes(texts, words)
    cuts = np.searchsorted(where, np.arange(1, len(texts)))
    return [np.unique(x) for x in np.split(found, cuts)]
