"""Payload parsers: JSON text to narrow points ``location_id, metric, unit, value``, in the JVM.

A payload that isn't an object, and one without the location it needs, gives no points; ``rejected`` finds those rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ts_plus_duration, unit_linear, unit_named

NUMERIC = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"


@dataclass(frozen=True)
class Field:
    """Where a metric stands in the payload, and how it is told. ``path`` is dotted, with ``[i]`` for places of arrays."""

    path: str
    metric: str
    unit: str | None = None
    transform: str | None = None
    scale: float = 1.0
    offset: float = 0.0


def _kind(x: Column) -> Column:
    return F.schema_of_variant(x)


def at_path(payload: Column, path: str) -> Column:
    """The value at a dotted path as text."""
    return F.get_json_object(payload, f"$.{path}")


def _shape(paths: dict[str, str]) -> str:
    """The struct type that has each dotted path as its type."""
    below: dict[str, dict[str, str]] = {}
    for path, kind in paths.items():
        head, _, rest = path.partition(".")
        below.setdefault(head, {})[rest] = kind
    return "struct<" + ",".join(f"`{head}`:{rest[''] if '' in rest else _shape(rest)}" for head, rest in below.items()) + ">"


def _at(read: str, path: str) -> Column:
    return F.col(".".join([read, *[f"`{x}`" for x in path.split(".")]]))


def _exploded(df: DataFrame, keep: list[str], points: Column, first: str) -> DataFrame:
    """A row for each point, of which ``first`` isn't null. The outer form infers no filter below, which would parse payloads twice."""
    return df.select(*keep, F.inline_outer(points)).where(F.col(first).isNotNull())


def location(read: Column, field: str, default: str | None) -> Column:
    """The location in a parsed object where it is text, else the default (or null)."""
    found = read[field]
    return F.coalesce(F.when(_kind(found) == "STRING", found.try_cast("string")), F.lit(default))


def _point(metric: Column, unit: str | None, value: Column) -> Column:
    return F.struct(metric.alias("metric"), F.lit(unit).cast("string").alias("unit"), value.cast("double").alias("value"))


def _points(df: DataFrame, payload: str, keep: list[str], field: str, default: str | None, points: Column) -> DataFrame:
    found = F.try_variant_get(F.try_parse_json(payload), f"$.{field}", "variant")
    own = F.coalesce(F.when(_kind(found) == "STRING", found.try_cast("string")), F.lit(default))
    placed = df.withColumn("__location", own).where("__location IS NOT NULL")
    return placed.select(*keep, F.col("__location").alias("location_id"), F.inline(points))


def flat_json(df: DataFrame, payload: str, keep: list[str], location_field: str, default: str | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """A point for each top-level key whose value is a JSON number; numbers in quotes are text and give none."""
    read = df.select(*keep, F.from_json(payload, "map<string,variant>").alias("__read"))
    placed = read.withColumn("location_id", location(F.col("__read"), location_field, default))
    some = F.explode_outer(F.when(F.col("location_id").isNotNull(), F.col("__read"))).alias("metric", "__value")
    # the type of an object is costly to tell, so values that are no number anyway go first
    number = F.col("__value").try_cast("double").isNotNull()
    each = placed.select(*keep, "location_id", some).where(number & _kind(F.col("__value")).rlike(NUMERIC))
    each = each.where(~F.col("metric").isin(*skip)) if skip else each
    return each.select(*keep, "location_id", "metric", F.lit(None).cast("string").alias("unit"), F.col("__value").try_cast("double").alias("value"))


def json_path(df: DataFrame, payload: str, keep: list[str], fields: list[Field], location_field: str, default: str | None = None) -> DataFrame:
    """A point for each configured path with a number, also one in quotes; named transforms change the value."""

    def point(f: Field) -> Column:
        value = F.trim(at_path(F.col(payload), f.path)).try_cast("double")
        value = unit_named(value, f.transform) if f.transform else value
        return F.when(value.isNotNull(), _point(F.lit(f.metric), f.unit, value))

    return _points(df, payload, keep, location_field, default, F.array_compact(F.array(*[point(f) for f in fields])))


def array_iterator(df: DataFrame, payload: str, keep: list[str], path: str, element: str) -> DataFrame:
    """A row per element of the payload's array at ``path``, with the fields of the struct type ``element`` and ``position``."""
    items = F.from_json(at_path(F.col(payload), path), f"array<struct<{element}>>")
    return df.select(*keep, F.posexplode(items).alias("position", "item")).select(*keep, "position", "item.*")


def column_oriented(df: DataFrame, payload: str, keep: list[str], base: str, fields: list[Field]) -> DataFrame:
    """A row per entry of each metric's ``values`` array: ``metric, valid_time, value``.

    An entry has a ``validTime`` (a time, or a time and a duration after a slash) and a ``value``; entries without a
    number or a valid time, and metrics that are missing, give no rows. Linear conversions are applied per field.
    """

    read = df.select(*keep, F.from_json(payload, _shape({f"{base}.{f.path}.values": "array<struct<validTime:string,value:double>>" for f in fields})).alias("__read"))

    def entries(f: Field) -> Column:
        rows = F.transform(
            _at("__read", f"{base}.{f.path}.values"),
            lambda x: F.struct(
                F.lit(f.metric).alias("metric"),
                F.try_to_timestamp(F.element_at(F.split(x["validTime"], "/"), 1)).alias("valid_time"),
                unit_linear(x["value"], f.scale, f.offset).alias("value"),
            ),
        )
        return F.coalesce(rows, F.array().cast("array<struct<metric:string,valid_time:timestamp,value:double>>"))

    return _exploded(read, keep, F.concat(*[entries(f) for f in fields]), "metric").where("value IS NOT NULL AND valid_time IS NOT NULL")


def interval_end(text: Column) -> Column:
    """The end of an interval ``start/duration``."""
    parts = F.split(text, "/")
    return ts_plus_duration(F.try_to_timestamp(F.element_at(parts, 1)), F.element_at(parts, 2))


# The fields of a weather response, as (path, metric, unit), and whether a response must have them.
WEATHER = (
    ("main.temp", "temperature", "celsius", True),
    ("main.feels_like", "feels_like", "celsius", True),
    ("main.pressure", "pressure", "hpa", True),
    ("main.humidity", "humidity", "percent", True),
    ("wind.speed", "wind_speed", "m/s", True),
    ("wind.deg", "wind_deg", "degrees", True),
    ("wind.gust", "wind_gust", "m/s", False),
    ("clouds.all", "clouds", "percent", True),
    ("visibility", "visibility", "meters", False),
    ("rain.1h", "rain_1h", "mm", False),
    ("rain.3h", "rain_3h", "mm", False),
    ("snow.1h", "snow_1h", "mm", False),
    ("snow.3h", "snow_3h", "mm", False),
)
# The components of a pollution response, all in micrograms per cubic metre.
POLLUTANTS = ("co", "no", "no2", "o3", "so2", "pm2_5", "pm10", "nh3")


def owm_weather(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Points of a weather response; a response without one of the required fields is an error and gives none."""
    read = df.select(*keep, F.from_json(payload, _shape({p: "double" for p, *_ in WEATHER})).alias("__read"))
    whole = reduce(and_, [_at("__read", p).isNotNull() for p, _, _, needed in WEATHER if needed])
    points = [F.when(_at("__read", p).isNotNull(), _point(F.lit(m), u, _at("__read", p))) for p, m, u, _ in WEATHER]
    return _exploded(read, keep, F.when(whole, F.array_compact(F.array(*points))), "metric")


def owm_pollution(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Points of the first item of a pollution response; an empty list is an error and gives none."""
    places = [("main.aqi", "aqi", "1-5_scale"), *[(f"components.{c}", c, "ug/m3") for c in POLLUTANTS]]
    items = F.from_json(payload, f"struct<list:array<{_shape({p: 'double' for p, *_ in places})}>>")
    read = df.select(*keep, F.get(items["list"], F.lit(0)).alias("__read"))
    whole = reduce(and_, [_at("__read", p).isNotNull() for p, *_ in places])
    return _exploded(read, keep, F.when(whole, F.array(*[_point(F.lit(m), u, _at("__read", p)) for p, m, u in places])), "metric")


# The fields of a sensor payload with their types.
SENSOR = (
    "serialno string, wifi int, bootCount int, boot int, ledMode string, firmware string, model string, "
    "pm01 float, pm02 float, pm10 float, pm02Compensated float, pm01Standard float, pm02Standard float, pm10Standard float, "
    "pm003Count float, pm005Count float, pm01Count float, pm02Count float, pm50Count float, pm10Count float, "
    "tvocIndex int, tvocRaw float, noxIndex int, noxRaw float, "
    "atmp float, atmpCompensated float, rhum float, rhumCompensated float, rco2 int"
)


def sensor_payload(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """The typed reading of a device; a payload without a serial number gives none, every other field may be missing."""
    read = df.withColumn("__reading", F.from_json(payload, SENSOR))
    return read.where("__reading.serialno IS NOT NULL").select(*keep, "__reading.*")


def rejected(df: DataFrame, payload: str, field: str = "serialno") -> DataFrame:
    """The rows whose payload has no such field: they go to the dead-letter output."""
    return df.where(at_path(F.col(payload), field).isNull())


def metric_inventory(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """The metrics that each entity has any value of, sorted."""
    present = F.array_compact(F.array(*[F.when(F.col(m).isNotNull(), F.lit(m)) for m in metrics]))
    return df.select(key, F.explode_outer(present).alias("metric")).groupBy(key).agg(F.sort_array(F.collect_set("metric")).alias("metrics"))
