"""Configured projections: payload paths to typed columns, identity fields, row rules and schema checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import unit_linear, unit_named
from . import dq, merge
from .features import latest_per_key

# Type names of a mapping and the types they stand for.
TYPES = {
    "double_precision": "double", "real": "float", "integer": "int", "bigint": "bigint", "smallint": "smallint", "text": "string",
    "varchar": "string", "boolean": "boolean", "timestamptz": "timestamp", "jsonb": "string", "date": "date",
}


def source(df: DataFrame, path: str) -> Column:
    """A column, or a path into the JSON text of one: ``column.key[0].key``."""
    head, _, rest = path.partition(".")
    if head not in df.columns:
        raise ValueError(f"no column {head!r} for the path {path!r}")
    return F.get_json_object(F.col(head), f"$.{rest}") if rest else F.col(head)


def transformed(value: Column, config: dict | str | None) -> Column:
    """The value after a configured transform: a named conversion, a linear or factor formula, a lookup table, a JSON path, or a
    time. Expressions and computed fields refer to columns and are compiled by ``field_mapping``."""
    if not config:
        return value
    if isinstance(config, str):
        return _timed(value, config) if config in TIMES else unit_named(value.try_cast("double"), config)
    kind = config["type"]
    if kind == "unit_conversion":
        formula = config["formula"]
        if formula["type"] == "linear":
            return unit_linear(value.try_cast("double"), formula.get("scale", 1.0), formula.get("offset", 0.0))
        return value.try_cast("double") * F.lit(formula["factor"])
    if kind == "lookup":
        table = F.create_map(*[F.lit(x) for pair in config["values"].items() for x in pair])
        return F.coalesce(table[value], F.lit(config.get("default")))
    if kind == "timestamp":
        return _timed(value, config["format"])
    raise ValueError(f"unknown transform {kind!r}")


def _typed(value: Column, kind: str) -> Column:
    """The value as a type, null where it doesn't fit; text of a number with decimals becomes an integer too."""
    return value.try_cast("decimal(38,9)").try_cast(kind) if kind in ("int", "bigint", "smallint") else value.try_cast(kind)


TIMES = ("microseconds_to_timestamp", "iso8601_to_timestamp", "unix_seconds_to_timestamp")


def _timed(value: Column, name: str) -> Column:
    if name == "microseconds_to_timestamp":
        return F.timestamp_micros(value.try_cast("bigint"))
    return F.timestamp_seconds(value.try_cast("bigint")) if name == "unix_seconds_to_timestamp" else F.try_to_timestamp(value)


def identity_fields(df: DataFrame, config: list[dict]) -> list[Column]:
    """The key columns of a mapping, as text."""
    return [source(df, c["source"]).cast("string").alias(c["target"]) for c in config]


def _names(expression: str) -> set[str]:
    """The words of an expression, without text in quotes."""
    return set(re.findall(r"[A-Za-z_]\w*", re.sub(r"'[^']*'", "", expression)))


def _kind(field: dict) -> str | None:
    transform = field.get("transform")
    return transform["type"] if isinstance(transform, dict) else None


def _source_of(df: DataFrame, field: dict) -> Column:
    """Where a field's value is read: its path, or for a JSON path that path in the column that its source begins with."""
    if _kind(field) == "json_extract":
        return F.get_json_object(F.col(field["source_path"].partition(".")[0]), field["transform"]["path"])
    return source(df, field["source_path"])


def _in_order(fields: list[dict]) -> list[dict]:
    """Computed fields so that each comes after those that its expression names; a circle is an error."""
    left, done = {f["target_column"]: f for f in fields}, []
    while left:
        free = [f for n, f in left.items() if not (_names(f["transform"]["expression"]) & left.keys()) - {n} and n not in _names(f["transform"]["expression"])]
        if not free:
            raise ValueError(f"computed fields {sorted(left)} depend on each other")
        for f in free:
            done.append(left.pop(f["target_column"]))
    return done


def _once(df: DataFrame) -> DataFrame:
    """``df`` whose columns are computed once a row: an expression over them, or a filter pushed below them, would otherwise repeat
    theirs wherever it names them, and theirs repeat others in turn."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def field_mapping(df: DataFrame, config: dict, ingested: Column | None = None) -> DataFrame:
    """The table that a mapping describes: the time, the identity fields, each mapped field as its type, and the flags.

    config: ``timestamp`` (source_field, target_field, transform), ``identity_fields`` (source, target), ``field_mappings``
    (source_path, target_column, type, nullable, transform, dq_rules), ``dq_rules`` over the whole row (each with its ``field``) and
    ``dq_output`` (enabled, target_column). Fields are read first, then ``expression`` transforms over ``value``, then ``computed``
    fields in the order of what they name. Rules judge the values before any action; then each rule's action applies: ``flag``
    and ``warn`` keep the value, ``clamp`` moves it to the bound (null stays null), ``reject`` makes it null, ``drop`` leaves the row out.
    Rows without a value for a field that isn't nullable are left out. ``ingested`` is the time that freshness refers to.
    """
    time, fields = config["timestamp"], config["field_mappings"]
    read = [transformed(source(df, time["source_field"]), time.get("transform")).alias(time["target_field"]), *identity_fields(df, config.get("identity_fields", []))]
    later: dict[str, str] = {}
    for n, f in enumerate(fields):
        name, kind = f["target_column"], _kind(f)
        if kind == "computed":
            continue
        if kind == "expression":
            later[name] = f"`__in{n}`"
            read.append(_source_of(df, f).alias(f"__in{n}"))
        else:
            transform = None if kind == "json_extract" else f.get("transform")
            read.append(_typed(transformed(_source_of(df, f), transform), TYPES[f["type"]]).alias(name))
    found = _once(df.select(*read, *([ingested.alias("ingestion_time")] if ingested is not None else [])))
    for f in fields:
        if f["target_column"] in later:
            name = later[f["target_column"]]  # in place of the word, but not of text in quotes
            expression = re.sub(r"'[^']*'|\bvalue\b", lambda m, name=name: name if m[0] == "value" else m[0], f["transform"]["expression"])
            found = found.withColumn(f["target_column"], _typed(F.expr(expression), TYPES[f["type"]]))
    for f in _in_order([f for f in fields if _kind(f) == "computed"]):
        found = found.withColumn(f["target_column"], _typed(F.expr(f["transform"]["expression"]), TYPES[f["type"]]))
    for f in fields:
        if not f.get("nullable", True):
            found = found.where(F.col(f["target_column"]).isNotNull())
    found = _once(found)
    rules = [{"field": f["target_column"]} | r for f in fields for r in f.get("dq_rules", [])] + config.get("dq_rules", [])
    output = config.get("dq_output", {})
    flags = output.get("target_column", "dq_flags")
    order = [c["target"] for c in config.get("identity_fields", [])], time["target_field"]
    told = [rule_column(r, *order) for r in rules]
    found = found.withColumn(flags, dq.flags(*told) if told else F.array().cast("array<string>"))
    found = _once(found)
    for r in rules:
        if r.get("action") == "drop":
            prefix = f"cross_field_check:{r['name']}" if r["rule"] == "cross_field_check" else f"{r['rule']}:{r['field']}:"
            found = found.where(~_has(flags, prefix))
    kept = [time["target_field"], *order[0], *[f["target_column"] for f in fields]]
    changed = {n: acted(F.col(n), [r for r in rules if r.get("field") == n]).alias(n) for n in kept}
    return found.select(*changed.values(), *([flags] if output.get("enabled", True) else []))


def _has(flags: str, prefix: str) -> Column:
    return F.exists(flags, lambda x: x.startswith(prefix))


def acted(value: Column, rules: list[dict]) -> Column:
    """The value after the actions of its rules, in order."""
    for r in rules:
        low, high = r.get("min", float("-inf")), r.get("max", float("inf"))
        if r["rule"] == "range_check" and r.get("action") == "clamp":
            value = F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))
        elif r["rule"] == "range_check" and r.get("action") == "reject":
            value = F.when(value.between(low, high), value)
        elif r["rule"] == "enum_check" and r.get("action") == "reject":
            fold = not r.get("case_sensitive", True)
            allowed = [x.upper() for x in r["allowed_values"]] if fold else r["allowed_values"]
            value = F.when((F.upper(value) if fold else value).isin(allowed), value)
        elif r["rule"] == "pattern_check" and r.get("action") == "reject":
            value = F.when(value.rlike(r["pattern"]), value)
    return value


def rule_column(rule: dict, entity: list[str] | None = None, time: str | None = None) -> Column:
    """The flag of a configured rule; ``entity`` and ``time`` order the rows for rules that look back."""
    name, field = rule["rule"], rule.get("field")
    if name == "range_check":
        return dq.range_check(field, rule.get("min", float("-inf")), rule.get("max", float("inf")), rule.get("action") == "clamp")
    if name == "null_check":
        return dq.null_check(field)
    if name == "enum_check":
        return dq.enum_check(field, rule["allowed_values"], not rule.get("case_sensitive", True))
    if name == "pattern_check":
        return dq.pattern_check(field, rule["pattern"])
    if name == "cross_field_check":
        return dq.cross_field(rule["expression"], rule["name"])
    if name == "freshness_check":
        return dq.freshness_check(field, F.col(rule.get("reference", "ingestion_time")), rule.get("max_age"), rule.get("max_future"))
    if name == "rate_of_change":
        return dq.rate_of_change(field, time, rule["max_change_per_minute"], entity, time)
    if name == "monotonic":
        return dq.monotonic(field, entity, [time], rule.get("reset"))
    raise ValueError(f"unknown rule {name!r}")


def load(df: DataFrame, target: DataFrame, config: dict, ingested: Column | None = None) -> DataFrame:
    """The target after a run of a mapping: rows newer than its newest time less the lag (``incremental``), mapped and judged,
    the newest of each key, merged by the strategy (``deduplication``: upsert, skip or replace). Running it again changes nothing."""
    mapped = field_mapping(df, config, ingested)
    incremental, dedup = config.get("incremental", {}), config.get("deduplication", {})
    if incremental.get("enabled"):
        column = incremental["watermark_column"]
        lag = F.expr(f"INTERVAL {incremental.get('lag_interval', '0 seconds')}")
        newest = target.agg((F.max(column) - lag).alias("__mark"))  # a row
        mapped = mapped.join(F.broadcast(newest), F.col("__mark").isNull() | (F.col(column) > F.col("__mark"))).drop("__mark")
    if not dedup.get("enabled"):
        return target.unionByName(mapped)
    keys = dedup["key_columns"]
    order = [config["timestamp"]["target_field"], *[c for c in mapped.columns if c not in keys and dict(mapped.dtypes)[c] != "array<string>"]]
    newest_rows = latest_per_key(mapped, keys, order)
    if dedup["strategy"] == "upsert":
        return merge.upsert(target, newest_rows, keys, order)
    return {"skip": merge.skip_existing, "replace": merge.replace_rows}[dedup["strategy"]](target, newest_rows, keys)


def virtual_view(df: DataFrame, ranges: dict[str, tuple[float, float, int]], time: str, keep: list[str]) -> DataFrame:
    """Rows with a time; each column rounded to its places where it is within its range, else null."""
    columns = [F.when(F.col(c).between(low, high), F.round(c, places)).alias(c) for c, (low, high, places) in ranges.items()]
    return df.where(F.col(time).isNotNull()).select(*keep, *columns)


def row_constraints(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``violations``: the names of the rules (SQL conditions) that a row breaks; an unknown condition passes."""
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(~F.expr(c), F.lit(n)) for n, c in rules.items()])))


# Physical ranges of a reading by field, bounds included.
RANGES = {
    "rco2": (380, 10_000), "pm01": (0.0, 500.0), "pm02": (0.0, 500.0), "pm10": (0.0, 500.0), "tvocIndex": (1, 500), "noxIndex": (1, 500),
    "atmp": (-10.0, 50.0), "atmpCompensated": (-10.0, 50.0), "rhum": (0.0, 100.0), "rhumCompensated": (0.0, 100.0), "wifi": (-100, 0),
}


def validate_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]] = RANGES) -> DataFrame:
    """``errors``: the fields of a reading whose value lies outside its range; missing values aren't validated."""
    found = [F.when(~F.col(c).between(low, high), F.lit(c)) for c, (low, high) in ranges.items() if c in df.columns]
    return df.withColumn("errors", F.array_compact(F.array(*found)))


def validate_points(df: DataFrame, schema: list[dict], metric: str = "metric", value: str = "value", strict: bool = False) -> DataFrame:
    """``error`` of each point, or null: ``type_mismatch``, ``out_of_range`` or (strict) ``unknown_field``.

    schema: ``name``, ``type`` (float, int, string, bool, json) and an optional ``range`` of two bounds. A number is told without
    a point if it is whole, so whole doubles pass as integers; a value that comes as text is taken as it stands, so "29.0" does not.
    """
    found, text = F.lit(None).cast("string"), F.col(value).cast("string")
    if df.schema[value].dataType.typeName() != "string":
        number = F.col(value).try_cast("double")
        whole = (number == F.floor(number)) & (F.abs(number) < 2.0**63)
        text = F.when(whole, number.try_cast("bigint").cast("string")).otherwise(text)
    for f in schema:
        found = F.when(F.col(metric) == f["name"], value_error(text, f)).otherwise(found)
    known = F.col(metric).isin(*[f["name"] for f in schema])
    return df.withColumn("error", F.when(~known, F.lit("unknown_field")).otherwise(found) if strict else found)


def validate_tags(df: DataFrame, schema: list[dict], tags: str = "tags", strict: bool = False) -> DataFrame:
    """``error`` of a row whose fields are the entries of a map of text: a required field that is missing comes first,
    then the fields in the order of the schema, then (strict) an unknown field."""
    missing = [F.when(~F.map_contains_key(tags, f["name"]), F.lit("required_field_missing")) for f in schema if not f.get("nullable", True)]
    values = [F.when(F.map_contains_key(tags, f["name"]), value_error(F.col(tags)[f["name"]], f)) for f in schema]
    unknown = F.exists(F.map_keys(tags), lambda k: ~k.isin(*[f["name"] for f in schema]))
    extra = [F.when(unknown, F.lit("unknown_field"))] if strict else []
    return df.withColumn("error", F.coalesce(*missing, *values, *extra, F.lit(None).cast("string")))


def value_error(text: Column, field: dict) -> Column:
    kind = field["type"]
    if kind == "string":
        return F.lit(None).cast("string")
    if kind == "bool":
        bad = ~text.isin("true", "false")
    elif kind == "json":
        bad = F.try_parse_json(text).isNull()
    else:
        bad = text.try_cast("double" if kind == "float" else "bigint").isNull() | (text.contains(".") if kind == "int" else F.lit(False))
    error = F.when(text.isNull() | bad, "type_mismatch")
    if field.get("range") and kind in ("float", "int"):
        low, high = field["range"]
        error = error.when(~text.try_cast("double").between(low, high), "out_of_range")
    return error
