"""Names for the columns that an operator joins to its input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(df: DataFrame, *stems: str) -> list[str]:
    """A name made of each stem that no column of ``df`` has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for stem in stems:
        name = f"__{stem}"
        while name in taken:
            name += "_"
        taken.add(name)
        found.append(name)
    return found
