"""Scalar column functions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Conversions by name as (scale, offset).
UNITS = {
    "kelvin_to_celsius": (1.0, -273.15),
    "kelvin_to_fahrenheit": (1.8, -459.67),
    "mps_to_mph": (2.237, 0.0),
    "mps_to_kmh": (3.6, 0.0),
}
# PM2.5 segments as (low, high, index low, index high).
AQI_PM25 = (
    (0.0, 9.0, 0, 50),
    (9.1, 35.4, 51, 100),
    (35.5, 55.4, 101, 150),
    (55.5, 125.4, 151, 200),
    (125.5, 225.4, 201, 300),
    (225.5, 325.4, 301, 500),
)
AQI_BEYOND = 500
# Mould risk by humidity below the bound, in per cent.
MOLD_RISK = ((50, "LOW"), (60, "MODERATE"), (65, "ELEVATED"), (80, "HIGH"))


def time_bucket(ts: Column | str, granularity: str) -> Column:
    """Start of the fixed bucket ('5 minutes', '1 hour', '1 day'); weeks start on Monday."""
    start = "4 days" if "week" in granularity else "0 seconds"
    return F.window(ts, granularity, granularity, start).start


def unit_linear(value: Column, scale: float, offset: float) -> Column:
    return value * F.lit(scale) + F.lit(offset)


def unit_named(value: Column, name: str) -> Column:
    """A named conversion; an unknown name changes nothing."""
    return unit_linear(value, *UNITS[name]) if name in UNITS else value


def ts_plus_duration(ts: Column, duration: Column) -> Column:
    """Time plus an ISO 8601 duration of days, hours, minutes and seconds."""

    def part(unit: str, after_t: bool) -> Column:
        found = F.regexp_extract(duration, ("T.*?" if after_t else "^P[^T]*?") + rf"(\d+){unit}", 1)
        return F.when(found == "", 0).otherwise(found.cast("int"))

    return ts + F.make_dt_interval(part("D", False), part("H", True), part("M", True), part("S", True))


def linear_interpolate(x: Column, x0: float, x1: float, y0: float, y1: float, share_first: bool = False) -> Column:
    """Null where the bounds are equal; rounds halves to even. The slope is taken first, as the SQL functions do, or the share of the
    way (``share_first``): near halves the two orders round apart."""
    if x0 == x1:
        return F.lit(None).cast("double")
    if share_first:
        return F.bround((x - F.lit(x0)) / F.lit(x1 - x0) * F.lit(y1 - y0) + F.lit(y0))
    return F.bround(F.lit((y1 - y0) / (x1 - x0)) * (x - F.lit(x0)) + F.lit(y0))


def aqi_pm25(value: Column) -> Column:
    """The air-quality index of a PM2.5 concentration; beyond the last segment it stays at its largest value."""
    found = F.when(value.isNull(), None)
    for low, high, a, b in AQI_PM25:
        found = found.when(value <= high, linear_interpolate(value, low, high, a, b).cast("int"))
    return found.otherwise(AQI_BEYOND)


def mold_risk(humidity: Column) -> Column:
    """Risk by relative humidity; without it the risk is unknown."""
    found = F.when(humidity.isNull(), "UNKNOWN")
    for bound, label in MOLD_RISK:
        found = found.when(humidity < bound, label)
    return found.otherwise("CRITICAL")


def health_label(pm25: Column, co2: Column) -> Column:
    """A missing concentration counts as 0."""
    pm25, co2 = F.coalesce(pm25, F.lit(0.0)), F.coalesce(co2, F.lit(0.0))
    good, moderate = (pm25 < 12.0) & (co2 < 1000.0), (pm25 < 35.4) & (co2 < 1500.0)
    return F.when(good, "Good").when(moderate, "Moderate").otherwise("Unhealthy")


def window_recommendation(indoor: Column, outdoor: Column, temperature: Column, humidity: Column) -> Column:
    """Open for clearly cleaner, mild and not too humid air outside; closed for clearly worse air."""
    mild = temperature.between(18, 26) & (humidity < 80)
    return F.when((outdoor < indoor * 0.8) & mild, "OPEN_WINDOWS").when(outdoor > indoor * 1.2, "KEEP_CLOSED").otherwise("NEUTRAL")


def objective_violation(value: Column, condition: Column, threshold: Column, upper: Column) -> Column:
    """Whether a value misses its objective; null for unknown conditions or values. A missing upper bound is the threshold."""
    return (
        F.when(condition == "<", value >= threshold)
        .when(condition == "<=", value > threshold)
        .when(condition == ">", value <= threshold)
        .when(condition == ">=", value < threshold)
        .when(condition == "==", value != threshold)
        .when(condition == "!=", value == threshold)
        .when(condition == "between", (value < threshold) | (value > F.coalesce(upper, threshold)))
    )


def age_display(seconds: Column, sparse: Column) -> Column:
    """How long ago the last record came: hours for sparse streams, else minutes and seconds."""
    whole = F.bround(seconds).cast("long")
    hours = F.concat(F.format_string("%.1f", F.round(seconds.cast("decimal(20,6)") / 3600, 1).cast("double")), F.lit(" hours ago"))
    short = F.concat(F.floor(whole / 60), F.lit("m "), whole % 60, F.lit("s ago"))
    return F.when(seconds.isNull(), "No Data").when(sparse, hours).otherwise(short)


def array_parse(text: Column) -> Column:
    """The elements of an array literal ``{a,b}`` (or without braces), without outer spaces."""
    bare = F.trim(text)
    braced = bare.startswith("{") & bare.endswith("}")
    inner = F.when(braced, F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)
    parts = F.transform(F.split(inner, ","), lambda x: F.trim(x))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(parts)


def event_details(kind: Column, transition: Column, crossing: Column, stored: Column) -> Column:
    """Details of an event as JSON: those of its type, updated by stored ones; other types have the stored ones only. Numbers,
    booleans, nulls, lists and objects stay what they are.

    ``transition`` and ``crossing`` are structs; ``stored`` is JSON text of an object or null.
    """

    def pairs(x: Column) -> Column:
        return F.coalesce(F.try_parse_json(x).try_cast("map<string,variant>"), F.try_parse_json(F.lit("{}")).try_cast("map<string,variant>"))

    def merged(own: Column) -> Column:
        known = F.map_filter(pairs(F.to_json(own, {"ignoreNullFields": "false"})), lambda k, _: ~F.map_contains_key(pairs(stored), k))
        return F.to_json(F.to_variant_object(F.map_concat(known, pairs(stored))))

    return F.when(kind == "state_transition", merged(transition)).when(kind == "threshold_crossing", merged(crossing)).otherwise(stored)


def register_sql_functions(spark: SparkSession) -> None:
    """SQL functions that Catalyst inlines: ``linear_interpolate``, ``calculate_aqi_pm25`` and ``calculate_mold_risk``."""
    whens = " ".join(f"WHEN pm25 <= {high}D THEN linear_interpolate(pm25, {low}D, {high}D, {a}D, {b}D)" for low, high, a, b in AQI_PM25)
    bands = " ".join(f"WHEN humidity < {bound} THEN '{label}'" for bound, label in MOLD_RISK)
    for signature, body in (
        ("linear_interpolate(x DOUBLE, x0 DOUBLE, x1 DOUBLE, y0 DOUBLE, y1 DOUBLE) RETURNS INT",
         "CASE WHEN x0 <> x1 THEN CAST(bround((y1 - y0) / (x1 - x0) * (x - x0) + y0) AS INT) END"),
        ("calculate_aqi_pm25(pm25 DOUBLE) RETURNS INT", f"CASE WHEN pm25 IS NULL THEN NULL {whens} ELSE {AQI_BEYOND} END"),
        ("calculate_mold_risk(temperature DOUBLE, humidity DOUBLE) RETURNS STRING",
         f"CASE WHEN humidity IS NULL THEN 'UNKNOWN' {bands} ELSE 'CRITICAL' END"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
