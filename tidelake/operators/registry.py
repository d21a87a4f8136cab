"""Named extension points: feature generators and payload parsers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from . import features, parsers

#: name -> (df, config) -> df
FEATURES: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "lag": lambda df, c: features.lag_features(df, c["field"], c["lags"], c["entity"], c["order"], c.get("diff", False)),
    "rolling": lambda df, c: features.rolling_features(df, c["field"], c["rows"], c["entity"], c["order"], c.get("stats", ("mean", "std", "min", "max"))),
    "trend": lambda df, c: df.withColumn(f"{c['field']}_trend", features.trend_simple(c["field"], c["rows"], c["entity"], c["order"])),
}
#: name -> (df, payload column, columns to keep, config) -> points
PARSERS: dict[str, Callable[[DataFrame, str, list[str], dict], DataFrame]] = {
    "flat_json": lambda df, p, keep, c: parsers.flat_json(df, p, keep, c["location_field"], c.get("default"), tuple(c.get("skip", ()))),
    "json_path": lambda df, p, keep, c: parsers.json_path(df, p, keep, [parsers.Field(**f) for f in c["fields"]], c["location_field"], c.get("default")),
    "array_iterator": lambda df, p, keep, c: parsers.array_iterator(df, p, keep, c["path"], c["element"]),
    "column_oriented": lambda df, p, keep, c: parsers.column_oriented(df, p, keep, c["base"], [parsers.Field(**f) for f in c["fields"]]),
    "owm_weather": lambda df, p, keep, c: parsers.owm_weather(df, p, keep),
    "owm_pollution": lambda df, p, keep, c: parsers.owm_pollution(df, p, keep),
    "sensor": lambda df, p, keep, c: parsers.sensor_payload(df, p, keep),
}


def register_parser(name: str, function: Callable[[DataFrame, str, list[str], dict], DataFrame]) -> None:
    """Make a parser known by name; a name that is taken is an error."""
    if name in PARSERS:
        raise ValueError(f"a parser {name!r} is there already")
    PARSERS[name] = function


def add_features(df: DataFrame, configs: list[dict]) -> DataFrame:
    """Apply generators in order; an unknown name is an error."""
    for config in configs:
        if config["name"] not in FEATURES:
            raise ValueError(f"no feature generator {config['name']!r}")
        df = FEATURES[config["name"]](df, config)
    return df


def parse(df: DataFrame, name: str, payload: str, keep: list[str], config: dict | None = None) -> DataFrame:
    """Points of a payload by a named parser; an unknown name is an error."""
    if name not in PARSERS:
        raise ValueError(f"no parser {name!r}")
    return PARSERS[name](df, payload, keep, config or {})
