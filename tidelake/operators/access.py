"""What readers of a store ask for: ranges, pages, samples, the newest of each kind, and checks of graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hours of the named ranges; ``current`` is the newest row alone.
RANGES = {"last_hour": 1, "last_24h": 24, "last_7d": 168}
MOST_SAMPLED, DEFAULT_SAMPLE = 100, 10


def read_since(df: DataFrame, since: str, time: str = "ts", source: str | None = None, prefix: str | None = None) -> DataFrame:
    """Rows from ``since`` on; with ``prefix`` only those whose source begins with it."""
    rows = df.where(F.col(time) >= since)
    return rows if prefix is None else rows.where(F.col(source or "source_id").startswith(prefix))


def in_range(df: DataFrame, entity: str, wanted: object, start: str, end: str, time: str = "ts") -> DataFrame:
    """Rows of one entity within [start, end]."""
    return df.where((F.col(entity) == wanted) & (F.col(time) >= start) & (F.col(time) <= end))


def relative_range(df: DataFrame, name: str, as_of: Column, entity: str, wanted: object, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """Rows of one entity in a named range before ``as_of``; ``current`` gives its newest row. An unknown name is an error."""
    rows = df.where(F.col(entity) == wanted)
    if name == "current":
        return rows.orderBy(F.desc_nulls_last(time), F.desc(tie)).limit(1)
    if name not in RANGES:
        raise ValueError(f"no time range {name!r}")
    return rows.where(F.col(time) >= as_of - F.expr(f"INTERVAL {RANGES[name]} HOURS"))


def alerts_of(df: DataFrame, location: object, name: str, as_of: Column, key: str = "location_id", status: str = "status", time: str = "triggered_at") -> DataFrame:
    """Alerts of one location: the ``active`` ones, or those of the last day or week. Any other range has none."""
    rows = df.where(F.col(key) == location)
    if name == "active":
        return rows.where(F.col(status) == "active")
    if name not in ("last_24h", "last_7d"):
        return rows.where("false")
    return rows.where(F.col(time) >= as_of - F.expr(f"INTERVAL {RANGES[name]} HOURS"))


def sample(df: DataFrame, order: list[Column | str], n: int | None = None, since: str | None = None, until: str | None = None, time: str = "ts") -> DataFrame:
    """The first ``n`` rows (10 unless told, 100 at most) in the given order, later than ``since`` and earlier than ``until``."""
    rows = df if since is None else df.where(F.col(time) > since)
    rows = rows if until is None else rows.where(F.col(time) < until)
    return rows.orderBy(*order).limit(min(DEFAULT_SAMPLE if n is None else n, MOST_SAMPLED))


def of_domain(df: DataFrame, streams: list[str], stream: str = "stream_id") -> DataFrame:
    """Rows of the streams of a domain; the list is short, so it is a filter that reaches the scan."""
    return df.where(F.col(stream).isin(*streams))


def hybrid(hot: DataFrame, cold: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the hot store, and those of the cold one whose keys it lacks. Keys are compared with nulls equal, so a cold
    copy of a hot row never comes twice; rows repeated within one store stay."""
    same = None
    seen = hot.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    for k in keys:
        fits = F.col(k).eqNullSafe(F.col(f"__{k}"))
        same = fits if same is None else same & fits
    return hot.unionByName(cold.join(seen, same, "left_anti"))


def next_page(df: DataFrame, after: Column | str | None, order: list[str], size: int = 100) -> DataFrame:
    """The next rows in order whose first order column is beyond ``after`` (from the beginning if null or None)."""
    rows = df if after is None else df.where(F.col(order[0]) > after)
    return rows.orderBy(*order).limit(size)


def latest_readings(views: list[tuple[str, DataFrame, str, str, str | None, dict[str, str]]]) -> DataFrame:
    """``data_type, id, observation_time, location, metrics`` of the newest row of each entity of several tables. A table is told by
    its kind, rows, entity, time, location column (None: null) and the metrics that go into the JSON (name: column)."""
    told = None
    for kind, df, entity, time, location, metrics in views:
        place = F.lit(None).cast("string") if location is None else F.col(location).cast("string")
        body = F.to_json(F.struct(*[F.col(c).alias(n) for n, c in metrics.items()]), {"ignoreNullFields": "false"})
        rows = df.select(F.col(entity).cast("string").alias("id"), F.col(time).alias("observation_time"), place.alias("location"), body.alias("metrics"))
        # the text decides among equal times, so the result does not depend on the order of rows
        order = F.struct(F.col("observation_time").isNotNull(), "observation_time", "metrics", F.coalesce("location", F.lit("")))
        last = rows.groupBy("id").agg(F.max_by(F.struct("observation_time", "location", "metrics"), order).alias("r"))
        one = last.select(F.lit(kind).alias("data_type"), "id", "r.observation_time", "r.location", "r.metrics")
        told = one if told is None else told.unionByName(one)
    if told is None:
        raise ValueError("no tables")
    return told


def latest_text(fields: list[tuple[str, DataFrame, str, list[str]]]) -> DataFrame:
    """``time, source_stream, field_name, value``: the newest text of each text column of several tables (stream, rows, time column, text columns).
    Each table is read once for all its columns; the largest text decides among equal times."""
    told = None
    for stream, df, time, columns in fields:
        long = df.select(F.col(time).alias("time"), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(["time"], columns, "field_name", "value").where("value IS NOT NULL")
        order = F.struct(F.col("time").isNotNull(), "time", "value")
        last = long.groupBy("field_name").agg(F.max_by(F.struct("time", "value"), order).alias("r"))
        one = last.select("r.time", F.lit(stream).alias("source_stream"), "field_name", "r.value")
        told = one if told is None else told.unionByName(one)
    if told is None:
        raise ValueError("no tables")
    return told


def unpivot_reading(df: DataFrame, keep: list[str], metrics: dict[str, str], metric: str = "metric", value: str = "value") -> DataFrame:
    """A row for each metric (name: column) that a wide reading has, with the columns to keep."""
    wide = df.select(*keep, *[F.col(c).cast("double").alias(n) for n, c in metrics.items()])
    return wide.unpivot(keep, list(metrics), metric, value).where(F.col(value).isNotNull())


def recent_signals(signals: DataFrame, models: DataFrame, as_of: Column, time: str = "signal_time", key: str = "model_id") -> DataFrame:
    """Signals of the last day with what is known of their models; a signal of an unknown model stays."""
    return signals.where(F.col(time) > as_of - F.expr("INTERVAL 24 HOURS")).join(models, key, "left")


def position_summary(df: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Open quantity, mean entry price of open positions, and what was and would be gained, by symbol."""
    is_open = F.col("status") == "OPEN"
    return df.groupBy(symbol).agg(
        F.sum(F.when(is_open, F.col("quantity")).otherwise(0)).alias("open_quantity"), F.avg(F.when(is_open, F.col("entry_price"))).alias("avg_entry_price"),
        F.sum("realized_pnl").alias("total_realized_pnl"), F.sum(F.when(is_open, F.col("unrealized_pnl")).otherwise(0)).alias("total_unrealized_pnl"),
    )


def events_hourly(df: DataFrame, time: str, kind: str, kinds: dict[str, Column], entity: str, stream: str) -> DataFrame:
    """``bucket, total_events``, a count for each condition, and how many entities and streams had events, by hour."""
    return df.groupBy(F.window(time, "1 hour").start.alias("bucket")).agg(
        F.count("*").alias("total_events"), *[F.count_if(c).alias(n) for n, c in kinds.items()],
        F.count_distinct(entity).alias("distinct_entities_with_events"), F.count_distinct(stream).alias("distinct_streams_with_events"),
    )


# ---- graphs
def checked_edges(edges: DataFrame, nodes: DataFrame, source: str = "source", target: str = "target", node: str = "id") -> DataFrame:
    """All edges with ``missing``, the node that isn't there: the source if it is missing, else the target; null for valid edges."""
    known = nodes.select(F.col(node).alias("__node"), F.lit(True).alias("__there")).where("__node IS NOT NULL").distinct()
    found = edges
    for end in (source, target):
        side = known.select(F.col("__node").alias(f"__{end}"), F.col("__there").alias(f"__has_{end}"))
        found = found.join(side, F.col(end) == F.col(f"__{end}"), "left")
    there = [F.coalesce(f"__has_{end}", F.lit(False)) for end in (source, target)]
    lost = F.when(~there[0], F.coalesce(F.col(source).cast("string"), F.lit("null"))).when(~there[1], F.coalesce(F.col(target).cast("string"), F.lit("null")))
    return found.select(*edges.columns, lost.alias("missing"))


def count_by_type(df: DataFrame, kind: str, wanted: str | None = None) -> DataFrame:
    """``n``: how many nodes or edges there are, of one type if told."""
    rows = df if wanted is None else df.where(F.col(kind) == wanted)
    return rows.agg(F.count("*").alias("n"))
