"""Threshold alerts with a cooldown in event time."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

# The bounds of a rule in the order in which they are tried, as (name, severity, whether it is a minimum).
BOUNDS = (("critical", "critical", False), ("min_critical", "critical", True), ("warning", "warning", False), ("min_warning", "warning", True))


@dataclass(frozen=True)
class Rule:
    """Bounds of a field; the first one that is reached gives the alert. Bounds that are None aren't tried."""

    field: str
    critical: float | None = None
    min_critical: float | None = None
    warning: float | None = None
    min_warning: float | None = None
    cooldown_seconds: int = 300


def hit(rule: Rule) -> Column:
    """The alert of one rule as a struct, or null."""
    value, found = F.col(rule.field).cast("double"), []
    for name, severity, minimum in BOUNDS:
        bound = getattr(rule, name)
        if bound is None:
            continue
        side, sign = ("below", "<=") if minimum else ("above", ">=")
        text = F.format_string(f"{rule.field} {severity} is {side} {severity} threshold (%.2f {sign} {bound:.2f})", value)
        alert = F.struct(
            F.lit(rule.field).alias("field"), F.lit(severity).alias("severity"), value.alias("value"), F.lit(float(bound)).alias("threshold"),
            F.lit(side).alias("direction"), F.lit(rule.cooldown_seconds).cast("long").alias("cooldown"), text.alias("message"),
        )
        reached = (value <= bound) if minimum else (value >= bound) & ~F.isnan(value)  # NaN is larger than all numbers
        found.append(F.when(reached, alert))
    return F.coalesce(*found)


def rule_hits(df: DataFrame, rules: list[Rule], also: Column | None = None) -> DataFrame:
    """Rows with ``hits``: the alerts of all rules, in the order of the rules; rows without any are left out unless ``also`` holds."""
    some = F.size("hits") > 0
    return df.withColumn("hits", F.array_compact(F.array(*[hit(r) for r in rules]))).where(some if also is None else some | also)


def threshold_alerts(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The first rule that hits gives a row's alert: ``field, severity, value, threshold, direction, message``."""
    own = [F.col(c) for c in df.columns if c not in {r.field for r in rules}]
    found = rule_hits(df, rules).select(*own, F.col("hits")[0].alias("alert"))
    return found.select(*own, *[f"alert.{c}" for c in ("field", "severity", "value", "threshold", "direction", "message")])


def choose(at: float, hits: list[tuple[str, str, int]], last: dict[tuple[str, str], float]) -> int | None:
    """Which alert of a row is given, its source's rows taken in order: the first whose (field, severity) isn't in its cooldown.
    ``last`` is when each was last alerted, and is brought up to date."""
    for k, (field, severity, cooldown) in enumerate(hits):
        if at - last.get((field, severity), float("-inf")) >= cooldown:
            last[field, severity] = at
            return k
    return None


ALERT = "field string, severity string, value double, threshold double, direction string, message string"


def alert_cooldown(df: DataFrame, rules: list[Rule], source: str, time: str, tie: str) -> DataFrame:
    """At most one alert per row, and at most one of a (field, severity) of a source within the rule's cooldown, in
    event time; where a rule is suppressed, the next rule is tried.

    The choice depends on the alerts before it, so a source's alerts (not its readings) are walked in order; sources
    are spread over tasks, each of which holds one batch of rows at a time.
    """
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    hits = rule_hits(df, rules).select(source, time, tie, seconds.alias("at"), "hits")
    told = hits.withColumn("told", F.transform("hits", lambda x: F.struct(x["field"].alias("f"), x["severity"].alias("s"), x["cooldown"].alias("c"))))
    ordered = told.repartition(F.col(source)).sortWithinPartitions(source, "at", tie)
    schema = StructType([*hits.schema, StructField("pick", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, None
        for batch in batches:
            picks, columns = [], {c: batch.column(c) for c in hits_columns}
            for own, at, told in zip(*[batch.column(c).to_pylist() for c in (source, "at", "told")], strict=True):
                if last is None or own != before:
                    last, before = {}, own
                picks.append(choose(at, [(x["f"], x["s"], x["c"]) for x in told], last))
            pick = pa.array(picks, pa.int32())
            yield pa.RecordBatch.from_pydict(columns | {"pick": pick}).filter(pick.is_valid())

    hits_columns = hits.columns
    found = ordered.mapInArrow(run, schema)
    alert = F.col("hits")[F.col("pick")]
    return found.select(source, time, tie, *[alert[c].alias(c) for c in ("field", "severity", "value", "threshold", "direction", "message")])


def _read_hits(text: str) -> list[dict]:
    """Alerts from JSON, where numbers that aren't finite are text."""
    return [x | {"value": float(x["value"]), "threshold": float(x["threshold"])} for x in json.loads(text)]


def alert_cooldown_stream(stream: DataFrame, rules: list[Rule], source: str, time: str, tie: str, keep_seconds: int = 86_400, late: str = "1 hour") -> DataFrame:
    """The same for a stream: alerts wait until the watermark has passed them and are walked in event-time order. What was last
    alerted is the state of a source, which is dropped once the watermark is ``keep_seconds`` past its last alert (at least the
    longest cooldown). Rows without a source are no readings but heartbeats, which move the watermark."""
    from ..streaming.stateful import in_order

    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    keep_seconds = max(keep_seconds, *[r.cooldown_seconds for r in rules])
    hits = rule_hits(stream, rules, F.col(source).isNull()).select(source, time, tie, seconds.alias("at"), F.to_json("hits").alias("hits"))
    schema = ", ".join(f"`{c}` {hits.schema[c].dataType.simpleString()}" for c in (source, time, tie))

    def step(rows: pd.DataFrame, starts: np.ndarray, states: list) -> tuple[pd.DataFrame, list]:
        hits, at, picks, after = rows["hits"].map(_read_hits).tolist(), rows["at"].tolist(), [], []
        for low, high, state in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], states, strict=True):
            last = {tuple(k): x for k, x in json.loads(state)} if state else {}
            picks += [choose(at[k], [(x["field"], x["severity"], x["cooldown"]) for x in hits[k]], last) for k in range(low, high)]
            after.append(json.dumps(list(last.items())))
        keep = [k for k, pick in enumerate(picks) if pick is not None]
        alerts = [hits[k][picks[k]] for k in keep]
        out = rows.iloc[keep].drop(columns=["at", "hits"])
        return out.assign(**{c: [x[c] for x in alerts] for c in ("field", "severity", "value", "threshold", "direction", "message")}), after

    return in_order(hits, [source], [time, tie], late, step, f"{schema}, {ALERT}", keep_seconds * 1000)
