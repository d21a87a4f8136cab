"""Edge rows of the operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidelake.functions import scalars as sc
from tidelake.operators import align, alerts, dq, events, features, mapping, merge, parsers, routing
from tidelake.operators.vectors import cosine_similarity, knn_exact, predict_breach
from tidelake.session import shared_dir
from tidelake.sources import tables

T0 = dt.datetime(2024, 1, 1)


def at(minutes: float) -> dt.datetime:
    return T0 + dt.timedelta(minutes=minutes)


def test_entry_imports_without_the_corpus_operators():
    import __spark_entry__ as entry

    assert "rollup_bucket" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


def test_range_bounds_are_inclusive_and_null_stays_null(spark):
    rows = spark.createDataFrame([(0.0,), (500.0,), (500.1,), (None,)], "v double")
    assert [r["x"] for r in rows.select(dq.reject("v", 0, 500).alias("x")).collect()] == [0.0, 500.0, None, None]
    assert [r["x"] for r in rows.select(dq.clamp("v", 1.0, 99.0).alias("x")).collect()] == [1.0, 99.0, 99.0, None]


def test_rate_of_change_with_equal_times(spark):
    rows = spark.createDataFrame([(1, at(0), 1.0), (2, at(0), 9.0), (3, at(1), 9.5), (4, at(2), 99.0)], "event_id long, ts timestamp, v double").withColumn("e", F.lit(1))
    got = rows.select("event_id", dq.rate_of_change("v", "ts", 5.0, "e", "event_id").alias("x")).orderBy("event_id").collect()
    assert [r["x"] is not None for r in got] == [False, False, False, True]


def test_crossings_at_the_threshold_and_of_ranges(spark):
    values = [1.0, 5.0, 5.0, 4.0, None, 6.0, 12.0, 7.0, 1.0]
    rows = spark.createDataFrame([(k, "a", "m", at(k), v) for k, v in enumerate(values)], "event_id long, entity string, metric string, ts timestamp, value double")
    schema = "metric string, objective_id string, condition string, threshold double, threshold_upper double"
    goals = spark.createDataFrame([("m", "a", ">=", 5.0, None), ("m", "b", "between", 5.0, 10.0), ("m", "c", "<", 5.0, None)], schema)
    got = events.threshold_crossings(rows, goals, "entity", "ts", "event_id").orderBy("event_id", "objective_id").collect()
    # leaving the good side is rising, also where the value falls
    assert [(r["event_id"], r["objective_id"], r["crossing"]) for r in got] == [
        (1, "a", "falling"), (1, "b", "entering_range"), (1, "c", "rising"), (3, "a", "rising"), (3, "b", "exiting_range_low"), (3, "c", "falling"),
        (6, "b", "exiting_range_high"), (7, "b", "entering_range"), (8, "a", "rising"), (8, "b", "exiting_range_low"), (8, "c", "falling"),
    ]
    plain = events.threshold_crossings(rows, goals, "entity", "ts", "event_id", simple=True).where("objective_id = 'a'").orderBy("event_id").collect()
    assert [(r["event_id"], r["crossing"]) for r in plain] == [(1, "rising"), (3, "falling"), (8, "falling")]


def test_transitions_of_first_repeated_and_null_states(spark):
    rows = spark.createDataFrame([(k, 1, at(k), s) for k, s in enumerate(["on", "on", "off", None, "on"])], "event_id long, e long, ts timestamp, state string")
    got = events.state_transitions(rows, "e", "ts", "state", "event_id").orderBy("event_id").collect()
    assert [r["is_actual_transition"] for r in got] == [True, False, True, True, True]
    assert got[2]["duration_ms"] == 60_000 and [r["direction"] for r in got] == ["initial", "unchanged", "changed", "changed", "initial"]
    two = events.state_transitions(rows, "e", "ts", "state", "event_id", states=("on", "off")).orderBy("event_id").collect()
    assert [r["direction"] for r in two] == ["initial", "unknown", "deactivating", "unknown", "initial"]
    since = events.transitions_since(rows, "e", "ts", "state", "event_id", "2024-01-01 00:02:00").collect()
    assert [(r["event_id"], r["from_state"], r["to_state"]) for r in since] == [(2, "on", "off"), (3, "off", None)]


def test_range_join_keeps_rows_with_nulls_once(spark):
    left = spark.createDataFrame([(1, None, at(0)), (2, "x", at(60)), (3, None, None)], "id long, note string, t timestamp")
    right = spark.createDataFrame([(10, at(4)), (11, at(-5)), (12, at(5.01))], "rid long, u timestamp")
    got = align.range_join(left, right, "t", "u", 300, []).collect()
    assert sorted((r["id"], r["rid"] or 0) for r in got) == [(1, 10), (1, 11), (2, 0), (3, 0)]
    assert align.range_join(left, right, "t", "u", 300, [], "inner").count() == 2


def test_asof_without_earlier_row_with_tie_and_several_issues(spark):
    left = spark.createDataFrame([(1, "a", at(0)), (2, "a", at(5)), (3, "a", at(9)), (4, "b", at(9))], "id long, k string, t timestamp")
    right = spark.createDataFrame([(10, "a", at(5), 1.0), (11, "a", at(5), 2.0), (12, "a", at(7), None)], "rid long, k string, issued timestamp, v double")
    got = align.asof(left, right, "t", "issued", ["k"], ["rid", "v"], "rid").orderBy("id").collect()
    assert [(r["rid"], r["v"]) for r in got] == [(None, None), (11, 2.0), (12, None), (None, None)]


def test_gaps_longer_than_six_buckets_are_not_carried(spark):
    rows = spark.createDataFrame([(k, 1.0 if k == 0 else None) for k in range(9)], "b long, v double")
    got = [r["x"] for r in rows.select("b", features.carry_forward("v", "b").alias("x")).orderBy("b").collect()]
    assert got == [1.0] * 7 + [None, None]


def test_merge_strategies(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, x string, y long")
    new = spark.createDataFrame([(2, None, 9), (2, "c", 8), (3, "d", 7)], "k long, x string, y long")
    assert sorted(map(tuple, merge.upsert(old, new, ["k"], ["y"]).collect())) == [(1, "a", 1), (2, "b", 9), (3, "d", 7)]
    assert sorted(r["k"] for r in merge.skip_existing(old, new.dropDuplicates(["k"]), ["k"]).collect()) == [1, 2, 3]
    again = merge.upsert(merge.upsert(old, new, ["k"], ["y"]), new, ["k"], ["y"])
    assert sorted(map(tuple, again.collect())) == [(1, "a", 1), (2, "b", 9), (3, "d", 7)]


def test_ewma_is_the_recurrence_whatever_the_chunk(spark):
    values = [5.0, None, 7.0, float("nan"), 3.0, 3.0, 8.0, 1.0]
    rows = spark.createDataFrame([(k, 1, at(k), v) for k, v in enumerate(values)], "event_id long, e long, ts timestamp, v double")
    mean, var, wanted = None, 0.0, []
    for v in values:
        if v is not None and math.isfinite(v):
            if mean is None:
                mean = v
            else:
                d = v - mean
                mean, var = mean + 0.2 * d, 0.8 * (var + 0.2 * d * d)
        wanted.append((mean, var))
    for chunk in (1, 3, 100):
        got = features.ewma(rows, "e", ["ts", "event_id"], "v", 0.2, chunk).orderBy("event_id").collect()
        assert all(abs(g["ewma_mean"] - m) < 1e-9 and abs(g["ewma_var"] - s) < 1e-9 for g, (m, s) in zip(got, wanted, strict=True))


def test_ewma_of_many_entities_and_of_rows_without_one(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3000 > 0, F.col("id") % 3000).alias("e"), F.when(F.col("id") % 7 > 0, F.col("id") * 1.0).alias("v"))
    got = features.ewma(rows, "e", ["id"], "v", 0.5, 1)
    means = {r["id"]: r["ewma_mean"] for r in got.collect()}
    assert len(means) == 6000  # also those of the null entity
    assert means[3001] == 3001.0 - 1500.0 and math.isnan(means[0]) and means[3000] == 3000.0 and math.isnan(means[7])
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()  # no call a group


def test_cooldown_tries_the_next_rule(spark):
    rules = [alerts.Rule("a", critical=90.0, min_critical=0.0, warning=70.0, cooldown_seconds=300), alerts.Rule("b", warning=1.0, cooldown_seconds=60)]
    rows = [(0, 0, 95.0, 0.0), (1, 1, 95.0, 2.0), (2, 1.5, 95.0, 2.0), (3, 2, 75.0, 0.0), (4, 3, -1.0, 0.0), (5, 5, -1.0, 2.0), (6, 6, None, None)]
    frame = spark.createDataFrame([(k, 1, at(m), a, b) for k, m, a, b in rows], "event_id long, user_id long, ts timestamp, a double, b double")
    got = alerts.alert_cooldown(frame, rules, "user_id", "ts", "event_id").orderBy("event_id").collect()
    # a minimum shares severity and cooldown with the maximum
    assert [(r["event_id"], r["field"], r["severity"], r["direction"]) for r in got] == [
        (0, "a", "critical", "above"), (1, "b", "warning", "above"), (3, "a", "warning", "above"), (5, "a", "critical", "below"),
    ]
    assert got[0]["message"] == "a critical is above critical threshold (95.00 >= 90.00)" and got[3]["message"].endswith("(-1.00 <= 0.00)")


def test_neighbours_with_zero_vector_and_too_few_rows(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = knn_exact(rows, rows, 5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 2), (2, 0)]
    assert rows.select(cosine_similarity("embedding", "embedding").alias("x")).collect()[1]["x"] is None
    votes = spark.createDataFrame([(1, "o", b) for b in (True, True, False, False)] + [(2, "o", True)] * 2, "query_id long, objective_id string, breached boolean")
    assert [tuple(r) for r in predict_breach(votes).select("query_id", "confidence", "predicted_breach").collect()] == [(1, 0.5, False)]


def test_scalars(spark):
    row = spark.range(1).select(
        sc.linear_interpolate(F.lit(5.0), 1.0, 1.0, 0.0, 9.0).alias("a"), sc.aqi_pm25(F.lit(600.0)).alias("b"), sc.unit_named(F.lit(1.0), "none").alias("c"),
        sc.ts_plus_duration(F.lit(T0), F.lit("P1DT2H")).alias("d"),
    ).first()
    assert tuple(row) == (None, 500, 1.0, at(26 * 60))
    odd = spark.createDataFrame([(567.0,), (-1999.0,), (-1985.0,)], "x double")  # both orders of the operations come near a half
    found = odd.select(sc.linear_interpolate(F.col("x"), 0.0, 100.0, 10.0, 60.0, share_first=True)).collect()
    assert [r[0] for r in found] == [round(x / 100 * 50 + 10) for x in (567.0, -1999.0, -1985.0)] == [294, -989, -983]


def test_numbers_as_text_keep_their_point(spark):
    schema = [{"name": "n", "type": "int", "range": [10, 90]}]
    rows = spark.createDataFrame([("n", 29.0), ("n", 29.5), ("n", None)], "metric string, value double")
    assert [r["error"] for r in mapping.validate_points(rows, schema).collect()] == [None, "type_mismatch", "type_mismatch"]
    text = rows.withColumn("value", F.col("value").cast("string"))
    assert [r["error"] for r in mapping.validate_points(text, schema).collect()] == ["type_mismatch"] * 3
    whole = spark.createDataFrame([("n", "29"), ("n", "95")], "metric string, value string")
    assert [r["error"] for r in mapping.validate_points(whole, schema).collect()] == [None, "out_of_range"]


def values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_bands_and_labels(spark):
    none = F.lit(None).cast("double")
    assert values(spark, *[sc.aqi_pm25(F.lit(x)) for x in (0.0, 9.0, 9.1, 35.4, 55.4, 125.4, 225.4, 325.4, 325.5)]) == [0, 50, 51, 100, 150, 200, 300, 500, 500]
    assert values(spark, *[sc.mold_risk(F.lit(x)) for x in (49.9, 50.0, 60.0, 64.9, 65.0, 79.9, 80.0)], sc.mold_risk(none)) == ["LOW", "MODERATE", "ELEVATED", "ELEVATED", "HIGH", "HIGH", "CRITICAL", "UNKNOWN"]
    labels = [sc.health_label(a, b) for a, b in ((none, none), (F.lit(11.9), F.lit(999.0)), (F.lit(12.0), none), (F.lit(35.3), F.lit(1499.0)), (F.lit(35.4), none), (none, F.lit(1500.0)))]
    assert values(spark, *labels) == ["Good", "Good", "Moderate", "Moderate", "Unhealthy", "Unhealthy"]
    air = [sc.window_recommendation(F.lit(10.0), F.lit(o), F.lit(t), F.lit(h)) for o, t, h in ((7.9, 18.0, 79.0), (7.9, 17.9, 79.0), (7.9, 26.0, 80.0), (8.0, 20.0, 10.0), (12.1, 20.0, 10.0))]
    assert values(spark, *air) == ["OPEN_WINDOWS", "NEUTRAL", "NEUTRAL", "NEUTRAL", "KEEP_CLOSED"]
    missed = [sc.objective_violation(F.lit(5.0), F.lit("between"), F.lit(5.0), u) for u in (none, F.lit(9.0))] + [sc.objective_violation(F.lit(6.0), F.lit("between"), F.lit(5.0), none)]
    assert values(spark, *missed) == [False, False, True]
    assert values(spark, sc.array_parse(F.lit(" {a, b} ")), sc.array_parse(F.lit("{}")), sc.array_parse(F.lit("a{b"))) == [["a", "b"], [], ["a{b"]]
    assert values(spark, sc.age_display(F.lit(125.4), F.lit(False)), sc.age_display(F.lit(5400.0), F.lit(True)), sc.age_display(none, F.lit(False))) == ["2m 5s ago", "1.5 hours ago", "No Data"]


def test_rule_names_in_flags(spark):
    row = spark.createDataFrame([("x", 1.0, at(0))], "kind string, v double, ts timestamp")
    rules = [dq.enum_check("kind", ["a"]), dq.pattern_check("kind", "^a"), dq.cross_field("v > 2", "big"), dq.freshness_check("ts", F.lit(at(-10)), newest="5 MINUTES"), dq.freshness_check("ts", F.lit(at(-3)), newest="5 MINUTES")]
    got = row.select(*[r.alias(f"r{k}") for k, r in enumerate(rules)]).first()
    assert list(got) == ["enum_check:kind:invalid_value", "pattern_check:kind:pattern_mismatch", "cross_field_check:big", "freshness_check:ts:future", None]


def test_topic_patterns():
    assert routing.topic_regex("home/+/devices/#") == r"^home/[^/]+/devices/.*$"
    with pytest.raises(ValueError, match="empty"):
        routing.topic_regex("")


def test_payload_parsers(spark):
    rows = spark.createDataFrame([(1, '{"serialno":"a","n":1,"q":"2","t":true,"o":{"n":3}}'), (2, '{"serialno":5,"n":1.5}'), (3, "[]"), (4, None), (5, "{")], "id long, p string")
    flat = parsers.flat_json(rows, "p", ["id"], "serialno", skip=("skipped",)).collect()
    assert [(r["id"], r["location_id"], r["metric"], r["value"]) for r in flat] == [(1, "a", "n", 1.0)]
    assert {(r["id"], r["metric"]) for r in parsers.flat_json(rows, "p", ["id"], "serialno", "d").collect()} == {(1, "n"), (2, "n"), (2, "serialno")}
    path = parsers.json_path(rows, "p", ["id"], [parsers.Field("q", "quoted"), parsers.Field("o.n", "inner", transform="mps_to_kmh")], "serialno").collect()
    assert sorted((r["metric"], r["value"]) for r in path) == [("inner", pytest.approx(10.8)), ("quoted", 2.0)]
    assert parsers.owm_pollution(spark.createDataFrame([('{"list":[]}',)], "p string"), "p", []).count() == 0
    assert parsers.sensor_payload(rows, "p", ["id"]).select("id").collect()[0]["id"] == 1


def test_dimension_files(spark, tmp_path):
    (tmp_path / "d.csv").write_text("id,extra,ok,n\n1,x,yes,2\n2,x,F,bad\n3,x,,\n")
    got = tables.read_dimension(spark, str(tmp_path), {"n": "int", "id": "bigint", "ok": "boolean"}).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(2, 1, True), (None, 3, None)]
    with pytest.raises(ValueError, match="missing"):
        tables.read_dimension(spark, str(tmp_path), {"missing": "int"})


def test_replacing_a_table_leaves_one_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.replace_table(spark, spark.range(3), path) == {"deleted": 0, "loaded": 3}
    assert tables.replace_table(spark, spark.range(5), path) == {"deleted": 3, "loaded": 5}
    assert spark.read.parquet(path).count() == 5 and sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_shared_folder_is_read_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_a_mapping_computes_its_columns_once(spark):
    from tidelake.plans import q_rules

    mapped = mapping.field_mapping(q_rules.micros(spark, "/root/testdata/sf0.001"), q_rules.FULL, F.lit(T0))
    plan = mapped._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("timestamp_micros") == 1 and plan.count("inline(") == 3
