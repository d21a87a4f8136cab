"""Data-quality rules: each gives a flag column that is null where the rule holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def flag(bad: Column, name: str) -> Column:
    return F.when(bad, F.lit(name))


def range_check(field: str, low: float, high: float, clamp: bool = False) -> Column:
    c = F.col(field)
    return flag((c < low) | (c > high), f"range_check:{field}:{'clamped' if clamp else 'out_of_bounds'}")


def clamp(field: str, low: float, high: float) -> Column:
    """Null stays null: greatest and least would skip it."""
    return F.when(F.col(field).isNotNull(), F.least(F.greatest(F.col(field), F.lit(low)), F.lit(high)))


def reject(field: str, low: float, high: float) -> Column:
    return F.when(F.col(field).between(low, high), F.col(field))


def null_check(field: str) -> Column:
    return flag(F.col(field).isNull(), f"null_check:{field}:missing")


def enum_check(field: str, allowed: list[str], ignore_case: bool = False) -> Column:
    c = F.upper(field) if ignore_case else F.col(field)
    return flag(~c.isin([a.upper() for a in allowed] if ignore_case else allowed), f"enum_check:{field}:invalid_value")


def pattern_check(field: str, pattern: str) -> Column:
    return flag(~F.col(field).rlike(pattern), f"pattern_check:{field}:pattern_mismatch")


def freshness_check(field: str, reference: Column, oldest: str | None = None, newest: str | None = None) -> Column:
    """Stale before the reference less ``oldest``, from the future after the reference plus ``newest``; a bound that
    isn't given isn't checked."""
    c, found = F.col(field), []
    if oldest:
        found.append(flag(c < reference - F.expr(f"INTERVAL {oldest}"), f"freshness_check:{field}:stale"))
    if newest:
        found.append(flag(c > reference + F.expr(f"INTERVAL {newest}"), f"freshness_check:{field}:future"))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def rate_of_change(field: str, time: str, most: float, entity: str | list[str], tie: str) -> Column:
    """Change per minute to the row before; equal times never flag."""
    w = W.partitionBy(entity).orderBy(time, tie)
    minutes = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))) / 60e6
    return flag(F.abs(F.col(field) - F.lag(field).over(w)) / F.nullif(minutes, F.lit(0.0)) > most, f"rate_of_change:{field}:exceeded")


def cross_field(condition: str, name: str, strict: bool = False) -> Column:
    """An unknown condition passes; with ``strict`` it counts as violated."""
    holds = F.expr(condition)
    return flag(~F.coalesce(holds, F.lit(False)) if strict else ~holds, f"cross_field_check:{name}")


def monotonic(field: str, entity: str | list[str], order: list[str], reset: float | None = None) -> Column:
    before = F.lag(field).over(W.partitionBy(entity).orderBy(*order))
    bad = F.col(field) < before
    return flag(bad if reset is None else bad & (F.col(field) > reset), f"monotonic:{field}:decreased")


def conditional(when: str, rule: Column) -> Column:
    return F.when(F.expr(when), rule)


def flags(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules))


def result(flags_col: str, rules: int, dropping: tuple[str, ...]) -> tuple[Column, Column]:
    """Whether the row should be dropped, and its score."""
    bad = F.exists(flags_col, lambda x: F.element_at(F.split(x, ":"), 1).isin(*dropping))
    return bad, F.greatest(F.lit(0.0), 1 - F.size(flags_col) / F.lit(rules))


def completeness(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[(F.count(f) / F.count(F.lit(1))).alias(f"{f}_share") for f in fields])


def violations(df: DataFrame, rules: list[tuple[str, Column, str, Column | None]], keep: list[str]) -> DataFrame:
    """One row per violation: ``keep``, ``column_name, rule_name, original_value, action_taken, result_value``.

    A rule is (column, flag, action, value after the action); the value is null for rejections, and the original
    one where none is given.
    """
    logged = []
    for column, found, action, after in rules:
        original = F.col(column).cast("string")
        result_value = F.lit(None).cast("string") if action == "reject" else original if after is None else after.cast("string")
        row = F.struct(
            F.lit(column).alias("column_name"),
            F.element_at(F.split(found, ":"), 1).alias("rule_name"),
            original.alias("original_value"),
            F.lit(action).alias("action_taken"),
            result_value.alias("result_value"),
        )
        logged.append(F.when(found.isNotNull(), row))
    return df.select(*keep, F.inline(F.array_compact(F.array(*logged))))


def rule_summary(df: DataFrame, table_name: str, flags_col: str = "flags") -> DataFrame:
    """Counts per table, column and rule; rules over several columns have no column and the scope ``cross-field``."""
    parts = F.split("flag", ":")
    cross = F.element_at(parts, 1) == "cross_field_check"
    each = df.select(F.explode(flags_col).alias("flag"))
    named = each.select(
        F.lit(table_name).alias("table_name"),
        F.when(~cross, F.element_at(parts, 2)).alias("column_name"),
        F.when(cross, "cross-field").otherwise("column").alias("rule_scope"),
        F.element_at(parts, 1).alias("rule_name"),
    )
    return named.groupBy("table_name", "column_name", "rule_scope", "rule_name").agg(F.count("*").alias("n"))
