"""Window features per entity: lags, rolling statistics, trends, null handling."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..session import stash
from .ordering import last_known, numbered, with_rows_before


def _by(entity: str | None, order: str | list[str]):
    order = [order] if isinstance(order, str) else order
    return (W.partitionBy(entity) if entity else W).orderBy(*order)


def lag_features(df: DataFrame, field: str, lags: list[int], entity: str, order: str | list[str], diff: bool = False) -> DataFrame:
    """Row lags, and differences to them."""
    w = _by(entity, order)
    for n in lags:
        df = df.withColumn(f"{field}_lag_{n}h", F.lag(field, n).over(w))
        if diff:
            df = df.withColumn(f"{field}_diff_{n}h", F.col(field) - F.col(f"{field}_lag_{n}h"))
    return df


def rolling_features(df: DataFrame, field: str, rows: int, entity: str, order: str | list[str], stats: tuple = ("mean", "std", "min", "max")) -> DataFrame:
    frame = _by(entity, order).rowsBetween(-(rows - 1), 0)
    known = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    return df.select("*", *[known[s](field).over(frame).alias(f"{field}_rolling_{s}_{rows}") for s in stats])


def rolling_full_window(field: str, rows: int, entity: str, order: str | list[str]) -> tuple[Column, Column]:
    """Mean and population deviation, NaN until the window is full."""
    frame = _by(entity, order).rowsBetween(-(rows - 1), 0)
    full = F.count(F.lit(1)).over(frame) == rows
    nan = F.lit(float("nan"))
    return F.when(full, F.avg(field).over(frame)).otherwise(nan), F.when(full, F.stddev_pop(field).over(frame)).otherwise(nan)


def trend_simple(field: str, rows: int, entity: str, order: str | list[str]) -> Column:
    frame = _by(entity, order).rowsBetween(-(rows - 1), 0)
    return (F.last(field).over(frame) - F.first(field).over(frame)) / F.lit(rows)


def trend_direction(field: str, entity: str, order: str | list[str], back: int = 4) -> Column:
    old = F.lag(field, back).over(_by(entity, order))
    return F.when(F.col(field) > old * 1.1, "rising").when(F.col(field) < old * 0.9, "falling").otherwise("stable")


def with_trend(df: DataFrame, field: str, entity: str, order: str | list[str], back: int = 4) -> DataFrame:
    """``trend``, the change over so many rows, and that change per row (an hour each)."""
    change = F.col(field) - F.lag(field, back).over(_by(entity, order))
    return df.select("*", trend_direction(field, entity, order, back).alias("trend"), change.alias("change"), (change / back).alias("rate_per_hour"))


def severity_sort(df: DataFrame, severity: str, order: list[str], levels: tuple[str, ...] = ("critical", "warning", "info"), spread: int = 64) -> DataFrame:
    """``rank`` of each row, from 1: by severity, then ``order``. No task sorts everything: rows are ranked within the
    range partitions of a sort, and the counts before each partition are added."""
    level = F.lit(len(levels))
    for n, name in reversed(list(enumerate(levels))):
        level = F.when(F.col(severity) == name, n).otherwise(level)
    dealt = df.withColumn("__level", level).repartitionByRange(spread, "__level", *order).withColumn("__part", F.spark_partition_id())
    dealt = stash(dealt, "ranked")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))  # as many rows as partitions
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__part", before.alias("__before")))
    own = F.row_number().over(W.partitionBy("__part").orderBy("__level", *order))
    return dealt.join(starts, "__part").withColumn("rank", F.col("__before") + own).select(*df.columns, "rank")


def carry_forward(field: str, order: str | list[str], entity: str | None = None, most: int = 6) -> Column:
    """The last value of at most so many rows before; one window instead of a chain of lags."""
    return F.last(field, ignorenulls=True).over(_by(entity, order).rowsBetween(-most, 0))


def interpolate(field: str, order: str | list[str], entity: str | None = None) -> Column:
    """A gap becomes the middle of its neighbours, or the one neighbour that exists."""
    w = _by(entity, order)
    before, after = F.lag(field).over(w), F.lead(field).over(w)
    both = (before + after) / 2
    return F.coalesce(F.col(field), both, before, after)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, by map-side aggregation rather than a sort."""
    rest = [c for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return found.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def hour_dow_weekend(ts: str) -> tuple[Column, Column, Column]:
    day = F.weekday(ts)
    return F.hour(ts), day, day.isin(5, 6)


def ewma(df: DataFrame, entity: str, order: list[str], field: str, alpha: float = 0.01, chunk: int = 4096) -> DataFrame:
    """Exponentially weighted mean and variance including each row, as a scan of affine maps.

    Rows are numbered by ranges (or have their number ``__n`` already) and cut into chunks of each entity, so no task takes a whole
    entity; a chunk's effect on (mean) and (variance) is an affine map, so chunks
    are summarised in parallel, chained over their few summaries, and replayed from the state they start with.
    Non-finite and null values leave the state as it is.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    placed = df if "__n" in df.columns else numbered(df, [entity], order)
    placed = placed.withColumn("__c", F.floor(F.col("__n") / chunk))
    kind, columns = df.schema[entity].dataType, df.columns
    none = float("nan")

    def same(a, b) -> bool:
        return a == b or (a != a and b != b)

    def values(batch: pa.RecordBatch, name: str) -> list[float]:
        """Numbers of a column; null is NaN."""
        return [none if x is None else float(x) for x in batch.column(name).to_pylist()]

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """mean' = a mean + b; var' = a var + p mean^2 + q mean + r, for a chunk that starts with a known mean; m0 and v0 for one that doesn't."""
        own, now, done = None, None, []
        for batch in batches:
            for key, c, x in zip(batch.column(entity).to_pylist(), batch.column("__c").to_pylist(), values(batch, field), strict=True):
                if now is None or c != own[1] or not same(key, own[0]):
                    if now is not None:
                        done.append((*own, *now))
                    own, now = (key, c), (1.0, 0.0, 1.0, 0.0, 0.0, 0.0, none, none, 0.0)
                if x - x != 0:
                    continue
                a, b, v, p, q, r, first, m, w = now
                y = x - b  # d = x - (a m + b)
                v, p, q, r = v * (1 - alpha), (1 - alpha) * (p + alpha * a * a), (1 - alpha) * (q - 2 * alpha * a * y), (1 - alpha) * (r + alpha * y**2)
                if m != m:
                    first, m = x, x
                else:
                    d = x - m
                    m, w = m + alpha * d, (1 - alpha) * (w + alpha * d * d)
                now = a * (1 - alpha), b * (1 - alpha) + alpha * x, v, p, q, r, first, m, w
            yield told(done, maps_type)
            done = []
        yield told(done if now is None else [*done, (*own, *now)], maps_type)

    def told(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row[k] for row in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    names = ("a", "b", "v", "p", "q", "r", "first", "m0", "v0")
    maps_schema = StructType([StructField(entity, kind), StructField("__c", LongType()), *[StructField(c, DoubleType()) for c in names]])
    starts_schema = StructType([StructField(entity, kind), StructField("__c", LongType()), StructField("__m", DoubleType()), StructField("__v", DoubleType())])
    maps_type, starts_type = to_arrow_schema(maps_schema), to_arrow_schema(starts_schema)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, started, mean, var = None, False, none, 0.0
        for batch in batches:
            done = []
            for key, c, a, b, v, p, q, r, first, m0, v0 in zip(*[batch.column(x).to_pylist() for x in batch.schema.names], strict=True):
                if not started or not same(key, own):
                    own, started, mean, var = key, True, none, 0.0
                done.append((key, c, mean, var))
                if mean != mean:
                    mean, var = (m0, v0) if first == first else (none, 0.0)
                else:
                    mean, var = a * mean + b, v * var + p * mean**2 + q * mean + r
            yield told(done, starts_type)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mean, var = None, none, 0.0
        for batch in batches:
            means, variances = [], []
            for key, c, x, m, v in zip(*[batch.column(y).to_pylist() for y in (entity, "__c")], *[values(batch, y) for y in (field, "__m", "__v")], strict=True):
                if own is None or c != own[1] or not same(key, own[0]):
                    own, mean, var = (key, c), m, v
                if x - x == 0:
                    if mean != mean:
                        mean = x
                    else:
                        d = x - mean
                        mean, var = mean + alpha * d, (1 - alpha) * (var + alpha * d * d)
                means.append(mean)
                variances.append(var)
            kept = {c: batch.column(c) for c in columns}
            yield pa.RecordBatch.from_pydict(kept | {"ewma_mean": pa.array(means, pa.float64()), "ewma_var": pa.array(variances, pa.float64())})

    # sorted batches, not a group a chunk: a call for each of many small groups costs more than its rows
    laid = placed.select(entity, "__c", "__n", field).repartition(entity, "__c").sortWithinPartitions(entity, "__c", "__n")
    maps = laid.mapInArrow(summaries, maps_schema)
    starts = maps.repartition(F.col(entity)).sortWithinPartitions(entity, "__c").mapInArrow(chain, starts_schema)
    with_start = placed.alias("r").join(starts.alias("s"), F.col(f"r.{entity}").eqNullSafe(F.col(f"s.{entity}")) & (F.col("r.__c") == F.col("s.__c"))).select("r.*", "s.__m", "s.__v")
    ordered = with_start.repartition(entity, "__c").sortWithinPartitions(entity, "__c", "__n")
    return ordered.mapInArrow(replay, StructType([*df.schema, StructField("ewma_mean", DoubleType()), StructField("ewma_var", DoubleType())]))


# Observations before a vector is given, and the smallest deviation that a value is divided by.
WARM_UP, FLAT = 168, 1e-10


def embed_metrics(df: DataFrame, entity: str, order: list[str], time: str, fields: list[tuple[str, str]], alpha: float = 0.01, chunk: int = 4096) -> DataFrame:
    """``embedding`` of each row from the entity's ``WARM_UP``-th observation on: sine and cosine of the hour, whether
    it is a weekend, and each field's z-score by exponentially weighted statistics that include the row.

    fields: (column, null strategy). A missing value becomes 0 (``zero``, ``mean``) or the z-score of the last value
    (``last_known``; 0 without one).
    """
    found, scores = stash(numbered(df, [entity], order), "numbered"), []
    for field, strategy in fields:
        if strategy == "last_known":
            found = last_known(found.withColumn("__chunk", F.floor(F.col("__n") / chunk)), [entity], "__chunk", "__n", field, f"__k_{field}").drop("__chunk")
    for field, strategy in fields:
        found = ewma(found, entity, order, field, alpha, chunk).withColumnsRenamed({"ewma_mean": f"__m_{field}", "ewma_var": f"__v_{field}"})
        used = F.col(f"__k_{field}" if strategy == "last_known" else field)
        deviation = F.sqrt(f"__v_{field}")
        scores.append(F.when(used.isNull() | (deviation < FLAT), 0.0).otherwise((used - F.col(f"__m_{field}")) / deviation))
    angle = F.hour(time) * (2 * math.pi / 24)
    vector = F.array(F.sin(angle), F.cos(angle), F.weekday(time).isin(5, 6).cast("double"), *scores)
    return found.withColumn("embedding", vector).where(F.col("__n") + 1 >= WARM_UP).select(*df.columns, "embedding")


# The columns of the feature matrix in their order, the lags and the window in rows.
MATRIX = ("hour", "day_of_week", "is_weekend", "value", "co2", "voc_index", "temperature", "humidity", "lag_1h", "lag_3h", "lag_24h", "rolling_mean_1h", "rolling_std_1h")
MATRIX_CHUNK = 16_384  # rows of an entity that a task takes
MATRIX_LAGS, MATRIX_ROWS = {"lag_1h": 60, "lag_3h": 180, "lag_24h": 1440}, 60


def feature_matrix(df: DataFrame, entity: str, order: list[str], time: str, value: str, others: dict[str, str] | None = None) -> DataFrame:
    """``MATRIX`` of each row, each column scaled by its mean and population deviation over the entity (0 where it
    doesn't vary). Lags before the first row are 0; rolling statistics are NaN until the window is full, and NaN stays out of the
    scaling. Columns that ``others`` doesn't name are 0. Windows run over chunks of an entity with the rows before them."""
    rows = with_rows_before(numbered(df, [entity], order), "__n", MATRIX_CHUNK, max(MATRIX_LAGS.values()))
    w = W.partitionBy(entity, "__chunk").orderBy("__n")
    full = w.rowsBetween(1 - MATRIX_ROWS, 0)
    whole = F.count("*").over(full) == MATRIX_ROWS
    mean, deviation = (F.when(whole, f(F.col(value)).over(full)).otherwise(F.lit(float("nan"))) for f in (F.avg, F.stddev_pop))
    hour, day, weekend = hour_dow_weekend(time)
    raw = {"hour": hour, "day_of_week": day, "is_weekend": weekend.cast("int"), "value": F.col(value), "rolling_mean_1h": mean, "rolling_std_1h": deviation}
    raw |= {name: F.lag(value, n, 0.0).over(w) for name, n in MATRIX_LAGS.items()}
    raw |= {name: F.coalesce(F.col((others or {}).get(name)), F.lit(0.0)) if name in (others or {}) else F.lit(0.0) for name in ("co2", "voc_index", "temperature", "humidity")}
    keep = [c for c in df.columns if c not in MATRIX]
    wide = rows.select(*keep, "__ahead", *[raw[c].cast("double").alias(c) for c in MATRIX]).where(~F.col("__ahead")).drop("__ahead")
    known = {c: F.when(~F.isnan(c), F.col(c)) for c in MATRIX}
    stats = wide.groupBy(entity).agg(*[f(known[c]).alias(f"__{n}_{c}") for c in MATRIX for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = [F.when(F.isnan(c), F.col(c)).when(F.col(f"__s_{c}") == 0, 0.0).otherwise((F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).alias(c) for c in MATRIX]
    return wide.join(stats, entity).select(*keep, *scaled)


def slope_over_index(df: DataFrame, entity: str, order: list[str], field: str) -> DataFrame:
    """``slope`` of a least-squares line through the values of each entity over their place (0, 1, ...)."""
    placed = numbered(df, [entity], order, "__x")
    return placed.groupBy(entity).agg(F.regr_slope(field, "__x").alias("slope"))
