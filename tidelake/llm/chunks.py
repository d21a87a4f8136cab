"""Cutting texts at places that no token of a space-aware BPE vocabulary crosses.

Both vocabularies used here attach a space to the word after it and keep a newline apart, so the tokens of
a text are the tokens of its chunks, one after another, if a chunk starts at each space and at each newline.
"""

from __future__ import annotations

from collections.abc import Callable


class ChunkCache(dict):
    """``chunk -> make(chunk)``. Emptied when it reaches ``most`` entries, so that memory stays bounded;
    long chunks are not kept."""

    def __init__(self, make: Callable[[str], bytes], most: int = 800_000, longest: int = 48):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, chunk: str) -> bytes:
        value = self.make(chunk)
        if len(chunk) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = value
        return value
