"""State transitions, threshold crossings and the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def direction(before: Column, after: Column, labels: dict[str, str] | None = None, states: tuple[str, str] | None = None) -> Column:
    """Configured ``a_to_b`` labels, else activating or deactivating for two states, else changed or unchanged.

    A state without one before it is initial.
    """
    if labels is None and states is None:
        return F.when(before.isNull(), "initial").when(before.eqNullSafe(after), "unchanged").otherwise("changed")
    if labels is None:
        on, off = states
        labels = {f"{off}_to_{on}": "activating", f"{on}_to_{off}": "deactivating"}
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.when(before.isNull(), "initial").otherwise(F.coalesce(known[F.concat(before, F.lit("_to_"), after)], F.lit("unknown")))


def state_transitions(
    df: DataFrame, entity: str, time: str, state: str, tie: str, labels: dict[str, str] | None = None, states: tuple[str, str] | None = None
) -> DataFrame:
    """Each row with the state before it, whether it changed, and how long that state lasted in ms.

    The first state of an entity, and one after a missing state, count as transitions.
    """
    w = W.partitionBy(entity).orderBy(time, tie)
    before, since = F.lag(state).over(w), F.lag(time).over(w)
    ms = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 1000
    found = df.select("*", before.alias("from_state"), F.col(state).alias("to_state"), ms.cast("long").alias("duration_ms"))
    changed = F.col("from_state").isNull() | ~F.col("from_state").eqNullSafe(F.col("to_state"))
    told = direction(F.col("from_state"), F.col("to_state"), labels, states)
    return found.withColumn("is_actual_transition", changed).withColumn("direction", told)


def transitions_since(df: DataFrame, entity: str, time: str, state: str, tie: str, since: str) -> DataFrame:
    """Changes of state from a time on. The newest row of each entity before it gives the state to start with, so no
    change is lost at the cut and older rows aren't sorted."""
    recent = df.where(F.col(time) >= since)
    seeds = df.where(F.col(time) < since).groupBy(entity).agg(F.max_by(F.struct(time, tie, state), F.struct(time, tie)).alias("__seed"))
    start = seeds.select(entity, "__seed.*").join(recent.select(entity).distinct(), entity, "left_semi")
    both = recent.unionByName(start, allowMissingColumns=True)
    found = state_transitions(both, entity, time, state, tie)
    return found.where((F.col(time) >= since) & F.col("from_state").isNotNull() & F.col("is_actual_transition"))


def device_type(entity: Column, rules: list[tuple[str, str]]) -> Column:
    """The label of the first LIKE pattern that fits, else ``other``."""
    (pattern, label), *rest = rules
    found = F.when(entity.like(pattern), label)
    for pattern, label in rest:
        found = found.when(entity.like(pattern), label)
    return found.otherwise("other")


def validity_intervals(df: DataFrame, entity: str, time: str, tie: str) -> DataFrame:
    """From when to when each state held; the last one is open."""
    return df.withColumn("valid_from", F.col(time)).withColumn("valid_to", F.lead(time).over(W.partitionBy(entity).orderBy(time, tie)))


def crossing(before: Column, now: Column, condition: Column, threshold: Column, upper: Column) -> Column:
    """The kind of crossing between two values under an objective's condition, or null.

    ``rising`` is entering violation and ``falling`` leaving it, whatever way the value moves.
    """
    inside, was = now.between(threshold, upper), before.between(threshold, upper)

    def moved(good_before: Column, good_now: Column) -> Column:
        return F.when(good_before & ~good_now, "rising").when(~good_before & good_now, "falling")

    ranges = F.when(~was & inside, "entering_range").when(was & (now < threshold), "exiting_range_low").when(was & (now > upper), "exiting_range_high")
    return (
        F.when(condition == "<", moved(before < threshold, now < threshold))
        .when(condition == "<=", moved(before <= threshold, now <= threshold))
        .when(condition == ">", moved(before > threshold, now > threshold))
        .when(condition == ">=", moved(before >= threshold, now >= threshold))
        .when(condition == "between", ranges)
    )


def simple_crossing(before: Column, now: Column, threshold: Column) -> Column:
    """``rising`` upwards over the threshold, ``falling`` downwards under it, whatever the condition."""
    return F.when((before < threshold) & (now >= threshold), "rising").when((before >= threshold) & (now < threshold), "falling")


def threshold_crossings(
    long: DataFrame, objectives: DataFrame, entity: str, time: str, tie: str, metric: str = "metric", value: str = "value", simple: bool = False
) -> DataFrame:
    """Crossings of (metric, value) rows under the objectives of their metric: the lag is taken once per metric,
    then the small table of objectives is joined."""
    w = W.partitionBy(entity, metric).orderBy(time, tie)
    lagged = long.withColumn("previous", F.lag(value).over(w)).where(F.col("previous").isNotNull() & F.col(value).isNotNull())
    both = lagged.join(objectives, metric)
    before, now, threshold = F.col("previous"), F.col(value), F.col("threshold")
    kind = simple_crossing(before, now, threshold) if simple else crossing(before, now, F.col("condition"), threshold, F.col("threshold_upper"))
    return both.withColumn("crossing", kind).where("crossing IS NOT NULL")


def crossing_frequency(found: DataFrame, entity: str, time: str, value: str = "value") -> DataFrame:
    """Crossings by day, objective, metric and direction, with how many entities and what values."""
    stats = [F.count("*").alias("n"), F.count_distinct(entity).alias("entities")]
    stats += [f(value).alias(n) for n, f in (("mean", F.avg), ("low", F.min), ("high", F.max))]
    return found.groupBy(F.date_trunc("day", time).alias("day"), "objective_id", "metric", "crossing").agg(*stats)


def crossing_oscillations(found: DataFrame, entity: str, time: str, tie: str) -> DataFrame:
    """Per day, entity and objective: crossings soon after the one before, and those of them in another direction.

    First crossings don't count; days without a crossing within two hours of the one before are left out.
    """
    w = W.partitionBy(entity, "objective_id").orderBy(time, tie)
    seconds = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))) / 1e6
    gaps = found.withColumn("__gap", seconds).withColumn("__other", F.lag("crossing").over(w) != F.col("crossing")).where("__gap IS NOT NULL")
    keys = [F.date_trunc("day", time).alias("day"), entity, "objective_id", "metric", "threshold"]
    counted = gaps.groupBy(*keys).agg(
        F.count_if(F.col("__gap") < 3600).alias("rapid_1h"),
        F.count_if(F.col("__gap") < 7200).alias("rapid_2h"),
        F.count("*").alias("n"),
        F.count_if((F.col("__gap") < 3600) & F.col("__other")).alias("oscillations"),
    )
    return counted.where("rapid_2h > 0")


def with_context(found: DataFrame, aligned: DataFrame, time: str, columns: list[str], keys: list[str] | None = None, bucket: str = "bucket") -> DataFrame:
    """Events with the aligned row of their hour as JSON, or ``{}`` without one; missing values stay as nulls."""
    packed = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    rows = aligned.select(*(keys or []), F.col(bucket).cast("timestamp").alias("__hour"), packed.alias("context"))
    joined = found.withColumn("__hour", F.date_trunc("hour", F.col(time).cast("timestamp"))).join(rows, [*(keys or []), "__hour"], "left")
    return joined.drop("__hour").withColumn("context", F.coalesce("context", F.lit("{}")))


def crossing_context(found: DataFrame, fields: list[str]) -> DataFrame:
    """What held at the crossings of an objective in a direction: averages of context fields."""
    means = [F.avg(F.get_json_object("context", f"$.{c}").cast("double")).alias(f"avg_{c}") for c in fields]
    return found.groupBy("objective_id", "metric", "crossing").agg(F.count("*").alias("n"), *means)


def event_key(*parts: Column | str) -> Column:
    """The same event has the same key in every run, so appending it again is a no-op."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def append_new(found: DataFrame, log: DataFrame, key: str = "event_key") -> DataFrame:
    return found.join(log.select(key), key, "left_anti")


def crossings_since(long: DataFrame, objectives: DataFrame, entity: str, time: str, tie: str, since: str, metrics: list[str] | None = None) -> DataFrame:
    """Crossings from a time on, of the metrics of one domain (or all)."""
    own = long if metrics is None else long.where(F.col("metric").isin(*metrics))
    return threshold_crossings(own, objectives, entity, time, tie).where(F.col(time) >= since)


def detect(
    states: DataFrame, long: DataFrame, objectives: DataFrame, entity: str, time: str, state: str, tie: str,
    start: str | None = None, end: str | None = None, aligned: DataFrame | None = None, context: list[str] | None = None, log: DataFrame | None = None,
    lookback: str | None = None,
) -> DataFrame:
    """The event log of a time range: actual transitions and threshold crossings, each with its key; with ``aligned``
    also what held in its hour, with ``log`` only what isn't there yet.

    What stood before the range counts as the state before it, so a range gives the same events as a full run. With ``lookback`` only
    that much history before ``start`` is read, so older files are pruned; an entity silent for longer then begins anew.
    """
    if end:
        states, long = states.where(F.col(time) <= end), long.where(F.col(time) <= end)
    if start and lookback:
        oldest = F.lit(start).cast(states.schema[time].dataType) - F.expr(f"INTERVAL {lookback}")
        states, long = states.where(F.col(time) >= oldest), long.where(F.col(time) >= oldest)
    moves = state_transitions(states, entity, time, state, tie).where("from_state IS NOT NULL AND is_actual_transition")
    change = F.concat("from_state", F.lit(">"), F.coalesce("to_state", F.lit("null")))
    one = moves.select(entity, time, F.lit("state_transition").alias("event_type"), change.alias("detail"), F.lit(None).cast("double").alias("metric_value"))
    found = threshold_crossings(long, objectives, entity, time, tie)
    kind = F.concat("objective_id", F.lit(":"), "crossing")
    two = found.select(entity, time, F.lit("threshold_crossing").alias("event_type"), kind.alias("detail"), F.col("value").alias("metric_value"))
    both = one.unionByName(two)
    if start:
        both = both.where(F.col(time) >= start)
    stamp = F.unix_micros(F.col(time).cast("timestamp")).cast("string")
    keyed = both.withColumn("event_key", event_key(stamp, F.col(entity).cast("string"), "event_type", "detail"))
    if aligned is not None:
        keyed = with_context(keyed, aligned, time, context or [], [entity])
    return keyed if log is None else append_new(keyed, log)
