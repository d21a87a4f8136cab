"""Stateful stream operators that see the rows of each key in event-time order, whatever order they come in.

A row waits in the state of its bucket (a hash of its key) until the watermark has passed it; an event-time timer then releases all rows
that are due, sorted by key and time, to the operator's step, which carries a small state of each key from release to release. Rows behind the watermark were left out before
they reached the state. So a stream gives what its batch twin gives on the rows that weren't too late, however they are cut
into micro-batches. The step's state is kept for a given time after the key's last row; after a longer silence a key starts anew.

State is kept in RocksDB, so it may be larger than an executor's memory. A stream that ends, or a source that falls silent, needs a row with
a later time (a heartbeat with a null key) to move the watermark past what still waits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

KEEP_MS = 7 * 86_400_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Calls to the state store cost far more than rows, so they are made for buckets of keys: a fixed number of calls whatever the keys.
#: A bucket's waiting rows have to fit a task.
BUCKETS = 256

#: Sorted rows, where each spell of a key starts, and the state before each spell (None: anew) give output rows, which keep their
#: index, and the state after each spell.
Step = Callable[[pd.DataFrame, np.ndarray, list], tuple[pd.DataFrame, list]]


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB, in one partition a core at most: each costs a store and a Python
    worker in every micro-batch, however few rows it has, and their number stays for the life of a stream."""
    wanted = {PROVIDER: ROCKS, PARTITIONS: str(min(int(spark.conf.get(PARTITIONS)), spark.sparkContext.defaultParallelism))}
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _packed(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


def _millis(times: pd.Series) -> pd.Series:
    """Milliseconds of event times, rounded up: a row is due once the watermark has reached its time."""
    return -(-times.astype("datetime64[us]").astype("int64") // 1000)


class InOrder(StatefulProcessor):
    """Holds the rows of a bucket of keys until they are due and gives them to ``step``, key by key in the order of ``order`` (time first)."""

    def __init__(self, step: Step, columns: list[str], flags: list[str], order: list[str], ascending: list[bool], keep_ms: int):
        self.step, self.columns, self.flags, self.order, self.ascending, self.keep_ms = step, columns, flags, order, ascending, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "first long, rows binary")
        self.kept = handle.getValueState("kept", "keys binary")  # __key, last, released
        self.clock = handle.getValueState("clock", "timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer = first = self.clock.get()[0] if self.clock.exists() else None
        for batch in rows:
            batch.columns = self.columns  # names that start with an underscore come as numbers
            at = int(_millis(batch[self.order[0]]).min())
            self.waiting.appendValue((at, _packed(batch)))
            first = at if first is None else min(first, at)
        self._set(timer, first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        ready, rest = [], []
        for first, data in self.waiting.get():
            if first > now:
                rest.append((first, data))
                continue
            rows = _unpacked(data)
            due = _millis(rows[self.order[0]])
            ready.append(rows[due <= now])
            if (later := due > now).any():
                rest.append((int(due[later].min()), _packed(rows[later])))
        kept = _unpacked(self.kept.get()[0]) if self.kept.exists() else None
        if ready:
            rows = pd.concat(ready, ignore_index=True)
            rows = rows.sort_values(["__key", *self.order], ascending=[True, *self.ascending], kind="stable", ignore_index=True)
            out, new = self._stepped(rows, kept)
            if len(out):
                yield out.assign(**{c: rows[c] for c in self.flags})
            kept = new if kept is None else pd.concat([kept[~kept["__key"].isin(new["__key"])], new], ignore_index=True)
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        if kept is not None:
            kept = kept[kept["released"] + self.keep_ms >= now]
        due = [x for x, _ in rest]
        if kept is None or kept.empty:
            self.kept.clear()
        else:
            self.kept.update((_packed(kept),))
            due.append(int(kept["released"].min()) + self.keep_ms + 1)
        if due:
            self._set(None, min(due))
        else:
            self.clock.clear()

    def _stepped(self, rows: pd.DataFrame, kept: pd.DataFrame | None) -> tuple[pd.DataFrame, pd.DataFrame]:
        """What the step gives, and the state of each key after it. A spell is a run of a key's rows without a silence for longer than
        its state is kept; a key's first spell goes on with the state before, if that isn't gone."""
        keys, at = rows["__key"].to_numpy(), _millis(rows[self.order[0]]).to_numpy()
        head = np.append(True, keys[1:] != keys[:-1])
        starts = np.flatnonzero(head | np.append(True, np.diff(at) > self.keep_ms))
        before = {} if kept is None else {k: (last, released) for k, last, released in kept[["__key", "last", "released"]].itertuples(index=False)}
        states: list = [None] * len(starts)
        for n, k in enumerate(starts.tolist()):
            if head[k] and (found := before.get(keys[k])) and at[k] - found[1] <= self.keep_ms:
                states[n] = found[0]
        out, states = self.step(rows, starts, states)
        ends = np.append(starts[1:], len(rows)) - 1
        last = np.append(keys[ends[:-1]] != keys[ends[1:]], True)  # a key's last spell
        new = pd.DataFrame({"__key": keys[ends[last]], "last": [x for x, y in zip(states, last, strict=True) if y], "released": at[ends[last]]})
        return out, new

    def _set(self, timer: int | None, at: int) -> None:
        """One timer a bucket: the earliest time at which something is due."""
        if timer is None or timer > at:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
            self.clock.update((at,))

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, keys: list[str], order: list[str], late: str, step: Step, schema: str, keep_ms: int = KEEP_MS, ascending: list[bool] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``step`` over the rows of each key (one or several columns) in order; ``late`` is how far behind the newest row a row may
    come. Rows without a time take no part. Keys are dealt to ``buckets`` by hash, and state is read and written a bucket at a time."""
    own = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})  # equal for equal keys only, nulls too
    # pandas would turn whole numbers with nulls into doubles: the nulls go beside them
    whole = [f.name for f in stream.schema if f.dataType.typeName() in ("byte", "short", "integer", "long")]
    solid = stream.where(F.col(order[0]).isNotNull()).withWatermark(order[0], late).select(
        F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("__bucket"), own.alias("__key"),
        *[F.coalesce(c, F.lit(0).cast(stream.schema[c].dataType)).alias(c) if c in whole else F.col(c) for c in stream.columns],
        *[F.col(c).isNull().alias(f"__null_{c}") for c in whole],
    )
    names = StructType.fromDDL(schema).names
    flags = [f"__null_{c}" for c in whole if c in names]
    processor = InOrder(step, solid.columns, flags, order, ascending or [True] * len(order), keep_ms)
    found = solid.groupBy("__bucket").transformWithStateInPandas(processor, ", ".join([schema, *[f"`{c}` boolean" for c in flags]]), "append", "EventTime")
    return found.select(*[F.when(~F.col(f"__null_{c}"), F.col(c)).alias(c) if f"__null_{c}" in flags else F.col(c) for c in names])


def dedup_sources(stream: DataFrame, keys: list[str], time: str, tie: str, primary: str, seconds: int, always: Column, late: str = "1 hour") -> DataFrame:
    """All points of the primary source, and those of the secondary one that don't follow a primary point of their
    keys within the window; points for which ``always`` holds pass anyway. Of points at the same time the primary ones count first."""
    marked = stream.withColumn("__always", F.coalesce(always, F.lit(False)))
    columns = stream.columns

    def step(rows: pd.DataFrame, starts: np.ndarray, states: list) -> tuple[pd.DataFrame, list]:
        spell = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
        before = np.array([float("-inf") if x is None else x for x in states])[spell]
        at = rows[time].astype("datetime64[us]").astype("int64") / 1e6
        mine = rows[primary].astype(bool)
        last = at.where(mine).groupby(spell).ffill()
        last = last.where(last.notna(), before)
        keep = mine | rows["__always"].astype(bool) | (at - last >= seconds)
        return rows.loc[keep, columns], last.iloc[np.append(starts[1:], len(rows)) - 1].tolist()

    return in_order(marked, keys, [time, primary, tie], late, step, _schema(stream), 2000 * seconds, [True, False, True])


def state_transitions(stream: DataFrame, keys: list[str], time: str, state: str, tie: str, late: str = "1 hour") -> DataFrame:
    """Changes of state of each entity, with the state before."""
    columns = [c for c in stream.columns if c != state]

    def step(rows: pd.DataFrame, starts: np.ndarray, states: list) -> tuple[pd.DataFrame, list]:
        values = rows[state].where(rows[state].notna(), None).astype(object).to_numpy()
        before = np.append(None, values[:-1])
        before[starts] = states
        changed = [a is not None and a != b for a, b in zip(before, values, strict=True)]
        return rows[columns].assign(from_state=before, to_state=values)[changed], values[np.append(starts[1:], len(rows)) - 1].tolist()

    return in_order(stream, keys, [time, tie], late, step, _schema(stream.select(*columns)) + ", from_state string, to_state string")
