"""Routing by topic, by source and to the dead-letter output."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings of a source id that name the kind of its source.
SOURCE_KINDS = ("Mqtt", "HttpPoll", "Http", "Webhook", "FileWatch")


@dataclass(frozen=True)
class Route:
    """A topic pattern, the stream it leads to, and the place (from 0) of the entity in the topic."""

    pattern: str
    stream: str
    entity_segment: int | None = None
    enabled: bool = True


def topic_regex(pattern: str) -> str:
    """``+`` stands for one level that isn't empty, ``#`` at the end for all the rest, also nothing after the slash."""
    if not pattern:
        raise ValueError("a topic pattern cannot be empty")
    levels = pattern.split("/")
    if "#" in levels[:-1]:
        raise ValueError(f"# must be the last level of {pattern!r}")
    return "^" + "/".join({"+": "[^/]+", "#": ".*"}.get(x) or re.escape(x) for x in levels) + "$"


def route_topics(df: DataFrame, routes: list[Route], topic: str = "topic") -> DataFrame:
    """``stream_id`` and ``entity_id`` of the first enabled route that fits; null where none does."""
    enabled = [r for r in routes if r.enabled]
    if not enabled:
        raise ValueError("no enabled route")
    t = F.when(F.col(topic) != "", F.col(topic))
    stream, entity = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(enabled):
        fits = t.rlike(topic_regex(r.pattern))
        own = F.lit(None).cast("string") if r.entity_segment is None else F.get(F.split(t, "/"), F.lit(r.entity_segment))
        stream, entity = F.when(fits, F.lit(r.stream)).otherwise(stream), F.when(fits, own).otherwise(entity)
    return df.withColumn("stream_id", stream).withColumn("entity_id", entity)


def source_to_stream(source_id: Column) -> Column:
    """The stream of a source id ``stream-Kind``."""
    return F.regexp_replace(source_id, f"-({'|'.join(SOURCE_KINDS)})$", "")


def source_id(stream: Column, kind: str, index: Column | None = None) -> Column:
    return F.concat_ws("-", stream, F.lit(kind), *([index.cast("string")] if index is not None else []))


def split_invalid(df: DataFrame, error: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """What goes on, and what goes to the dead-letter output: rows with an error are copied there; ``strict`` also
    keeps them from going on."""
    dead = df.where(F.col(error).isNotNull())
    return (df.where(F.col(error).isNull()) if strict else df), dead


def write_with_dead_letters(df: DataFrame, error: str, path: str, dead_path: str, strict: bool = False) -> None:
    """Write both outputs of ``split_invalid`` as Parquet."""
    good, dead = split_invalid(df, error, strict)
    good.drop(error).write.mode("append").parquet(path)
    dead.write.mode("append").parquet(dead_path)


def notification(payload: Column, fields: list[str] | None = None) -> Column:
    """The payload of a notification: the whole of it (no list), the listed top-level fields that it has, or null (an
    empty list)."""
    if fields is None:
        return payload
    if not fields:
        return F.lit(None).cast("string")
    own = F.map_filter(F.try_parse_json(payload).try_cast("map<string,variant>"), lambda k, _: k.isin(*fields))
    return F.to_json(own)
