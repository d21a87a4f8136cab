"""Streams with state: rows in any order and in any micro-batches give what the batch twins give."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelake.operators.alerts import Rule, alert_cooldown, alert_cooldown_stream
from tidelake.streaming import rollups as st, stateful

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


POINT = "id long, k string, ts timestamp, state string, primary boolean, v double"


def points(spark, n=400):
    rows = [
        (i, "abc"[i * 7 % 3] if i % 50 else None, T0 + dt.timedelta(minutes=i * 3 // 2), None if i % 9 == 0 else "on" if i * 5 % 7 < 4 else "off", i * 11 % 5 == 0, float(i * 37 % 100))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, POINT)


def transitions(rows):
    found, before = [], {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["id"])):
        old = before.get(r["k"])
        if old is not None and old != r["state"]:
            found.append((r["id"], old, r["state"]))
        before[r["k"]] = r["state"]
    return sorted(found, key=str)


def told(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_transitions_in_shuffled_turns(spark):
    df = points(spark)
    found = st.drain_turns(st.turns(df, 4, "id", "ts"), lambda x: stateful.state_transitions(x, ["k"], "ts", "state", "id", "10 days"), "t")
    assert told(found, "id", "from_state", "to_state") == transitions(df.collect())


def test_rows_are_released_as_the_watermark_passes_and_late_ones_are_left_out(spark):
    df = points(spark)
    in_time = [df.where(F.col("id").between(a, a + 99)) for a in range(0, 400, 100)]  # each turn goes on 150 minutes
    late = df.where("id = 5").withColumn("id", F.lit(9000).cast("long"))
    beat = st.turns(df, 1, "id", "ts")[1]
    build = lambda x: stateful.state_transitions(x, ["k"], "ts", "state", "id", "10 minutes")
    before_end = st.drain_turns([in_time[0].union(in_time[1])], build, "t")
    whole = st.drain_turns([*in_time, late, beat], build, "t")
    wanted = transitions(df.collect())
    assert told(whole, "id", "from_state", "to_state") == wanted
    early = told(before_end, "id", "from_state", "to_state")
    assert 0 < len(early) < len(wanted) and set(early) < set(wanted)


def test_state_is_dropped_after_its_time(spark):
    rows = [(1, "a", T0, "on", True, 1.0), (2, "a", T0 + dt.timedelta(days=30), "off", True, 1.0), (3, "a", T0 + dt.timedelta(days=31), "on", True, 1.0)]
    other = [(9, "b", T0 + dt.timedelta(days=20), "on", True, 1.0)]
    parts = [spark.createDataFrame(x, POINT) for x in (rows[:1], other, rows[1:])]
    beat = st.turns(parts[0], 1, "id", "ts")[1]
    found = st.drain_turns([*parts, beat], lambda x: stateful.state_transitions(x, ["k"], "ts", "state", "id", "1 hour"), "t")
    assert told(found, "id", "from_state", "to_state") == [(3, "off", "on")]  # the first state of a was 30 days old


def test_sources_of_composite_keys_with_ties_and_nulls(spark):
    df = points(spark).withColumn("m", (F.col("id") % 2).cast("string"))
    found = st.drain_turns(st.turns(df, 2, "id", "ts"), lambda x: stateful.dedup_sources(x, ["k", "m"], "ts", "id", "primary", 600, F.col("v") > 95, "10 days"), "t")
    rows, wanted = df.collect(), []
    for r in rows:
        near = [p for p in rows if p["primary"] and (p["k"], p["m"]) == (r["k"], r["m"]) and 0 <= (r["ts"] - p["ts"]).total_seconds() < 600]
        if r["primary"] or r["v"] > 95 or not near:
            wanted.append((r["id"],))
    assert told(found, "id") == sorted(wanted, key=str)


def test_whole_numbers_with_nulls_as_keys_stay_exact(spark):
    big = 2**60
    df = points(spark).select((F.col("id") + big).alias("id"), (F.col("id") % 3 + big).alias("u"), F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("m"), "ts", "primary", "v")
    found = st.drain_turns(st.turns(df, 2, "id", "ts"), lambda x: stateful.dedup_sources(x, ["u", "m"], "ts", "id", "primary", 1200, F.col("v") > 95, "10 days"), "t")
    rows, wanted = df.collect(), []
    for r in rows:
        near = [p for p in rows if p["primary"] and (p["u"], p["m"]) == (r["u"], r["m"]) and 0 <= (r["ts"] - p["ts"]).total_seconds() < 1200]
        if r["primary"] or r["v"] > 95 or not near:
            wanted.append((r["id"], r["u"], r["m"]))
    assert 0 < len(wanted) < len(rows)
    assert told(found.where("id IS NOT NULL"), "id", "u", "m") == sorted(wanted, key=str)


def test_state_is_called_for_buckets_not_for_keys(spark):
    calls = spark.sparkContext.accumulator(0)

    def step(rows, starts, states):
        calls.add(1)
        return rows[["id"]], [0.0] * len(starts)

    df = points(spark).withColumn("u", F.col("id"))  # as many keys as rows
    found = st.drain_turns(st.turns(df, 1, "id", "ts"), lambda x: stateful.in_order(x, ["u"], ["ts", "id"], "10 days", step, "id long", buckets=4), "t")
    assert told(found.where("id IS NOT NULL"), "id") == told(df, "id") and calls.value <= 8


def test_cooldown_in_shuffled_turns(spark):
    rules = [Rule("v", 90.0, None, 60.0, None, 1800)]
    df = points(spark).select("id", "k", "ts", F.when(F.col("id") % 40 == 0, float("nan")).when(F.col("id") % 41 == 0, float("inf")).otherwise(F.col("v")).alias("v"))
    df = df.where("k IS NOT NULL")
    found = st.drain_turns(st.turns(df, 2, "id", "ts"), lambda x: alert_cooldown_stream(x, rules, "k", "ts", "id", late="10 days"), "t")
    batch = alert_cooldown(df, rules, "k", "ts", "id")
    assert told(found, "id", "severity", "value", "message") == told(batch, "id", "severity", "value", "message") and found.count() > 5
    assert batch.where("isnan(value)").count() == 0


def test_packed_rows_keep_their_types():
    rows = pd.DataFrame({"t": pd.to_datetime(["2024-01-01 00:00:00.000001"]), "x": [None], "n": [3]})
    back = stateful._unpacked(stateful._packed(rows))
    assert back["t"][0] == rows["t"][0] and back["x"][0] is None and back["n"][0] == 3
    assert stateful._millis(rows["t"])[0] == 1704067200001
