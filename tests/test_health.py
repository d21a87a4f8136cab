"""Reports of freshness and health, run histories, ranges, pages and graph checks on edge rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidelake.operators import access as ac, bars, events as ev, health as he, merge
from tidelake.session import new_path
from tidelake.sources import tables

T = dt.datetime(2024, 1, 10)
def as_of():
    return F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00"))



def before(**span):
    return T - dt.timedelta(**span)


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def seen(spark):
    rows = [("a", before(hours=18)), ("a", before(days=9)), ("b", before(hours=17, minutes=59)), ("c", before(hours=36)), ("d", None), (None, before(days=5))]
    return spark.createDataFrame(rows, "entity string, ts timestamp_ntz")


def test_bounds_of_freshness_are_exclusive_and_no_time_is_critical(seen):
    told = dict(rows_of(he.entity_freshness(seen, "entity", "ts", as_of()).select("entity", "status"), "entity"))
    assert told == {"a": "STALE", "b": "FRESH", "c": "CRITICAL", "d": "CRITICAL", None: "CRITICAL"}


def test_the_worst_status_is_told_and_the_nameless_entity_is_not_counted(seen):
    (row,) = he.freshness_overall(he.entity_freshness(seen, "entity", "ts", as_of()), "entity").collect()
    assert tuple(row) == ("CRITICAL", 4, 2, 1, 1, 120.0)
    (none,) = he.freshness_overall(he.entity_freshness(seen.where("false"), "entity", "ts", as_of()), "entity").collect()
    assert tuple(none) == ("CRITICAL", 0, 0, 0, 0, None)


def test_status_of_sensors(spark):
    df = spark.createDataFrame([("a", before(seconds=299)), ("b", before(seconds=300)), ("c", before(seconds=900)), ("d", None)], "e string, ts timestamp_ntz")
    assert rows_of(he.sensor_status(df, "e", "ts", as_of()), "e") == [("a", 299, "online"), ("b", 300, "degraded"), ("c", 900, "offline"), ("d", None, "offline")]


def test_streams_without_rows_and_sparse_ones(spark):
    rows = [("x", before(seconds=180)), ("x", before(days=2)), ("y", before(seconds=181)), ("z", before(hours=30)), ("z", None), ("old", before(hours=30)), ("other", T), (None, T)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz")
    names = ("x", "y", "z", "old", "gone")
    streams = [he.Stream(n, n.upper(), "observation", 90, 180) if n != "z" else he.Stream("z", "Z", "event", 64800, 129600, True) for n in names]
    health = he.stream_health(df, "k", "ts", streams, as_of())
    told = [(r["stream"], r["status"], r["records"], r["time_since_last"], r["thresholds"]) for r in health.collect()]
    assert told == [
        ("gone", "CRITICAL", 0, "No Data", "1m/3m"),
        ("old", "CRITICAL", 0, "No Data", "1m/3m"),
        ("y", "CRITICAL", 1, "3m 1s ago", "1m/3m"),
        ("x", "WARNING", 1, "3m 0s ago", "1m/3m"),
        ("z", "WARNING", 2, "30.0 hours ago", "18h/36h"),
    ]
    assert tuple(he.health_overall(health).first()) == (5, 0, 2, 3, "CRITICAL")
    assert he.health_overall(health.where("false")).first()["overall_status"] == "HEALTHY"


def test_event_metrics_leave_the_bounds_out(spark):
    rows = [("t", before(hours=1)), ("t", before(minutes=59)), ("c", before(hours=24)), ("c", before(days=6)), ("c", None)]
    (row,) = he.event_metrics(spark.createDataFrame(rows, "k string, ts timestamp_ntz"), "ts", "k", ["t", "c"], as_of()).collect()
    assert tuple(row) == (1, 2, 4, 2, 0, before(minutes=59), 3540.0)


def test_empty_tables_are_left_out_and_tables_without_times_are_unknown(spark):
    df = spark.createDataFrame([(before(seconds=300),)], "ts timestamp_ntz")
    blank = spark.createDataFrame([(None,)], "ts timestamp_ntz")
    told = he.table_freshness({"a": (df, "ts"), "b": (blank, "ts"), "c": (df.where("false"), "ts")}, as_of())
    assert rows_of(told.select("name", "row_count", "age_seconds", "status"), "name") == [("a", 1, 300, "stale"), ("b", 1, None, "unknown")]
    with pytest.raises(ValueError):
        he.table_freshness({}, as_of())


@pytest.fixture(scope="module")
def runs(spark):
    rows = [
        (1, "a", before(days=2), "success", before(days=3)),
        (2, "a", before(hours=1), "failed", None),
        (3, "a", before(hours=1), "running", None),
        (4, "b", before(days=9), "failed", None),
        (5, "b", None, "success", None),
        (6, None, before(hours=2), "success", T),
    ]
    return spark.createDataFrame(rows, "id long, stream_id string, started_at timestamp_ntz, status string, watermark_after timestamp_ntz")


def test_status_of_runs(runs):
    told = he.run_status(runs, as_of(), "id").select("stream_id", "id", "status", "runs_total", "runs_succeeded", "runs_failed")
    assert rows_of(told, "stream_id") == [("a", 3, "running", 2, 0, 1), ("b", 4, "failed", 0, 0, 0)]


def test_history_of_runs(runs):
    assert [r["id"] for r in he.run_history(runs, "a", 2, "id").collect()] == [3, 2]
    assert [r["id"] for r in he.run_history(runs, "a", 9, "id", as_of() - F.expr("INTERVAL 2 DAYS"), "failed").collect()] == [2]
    assert tuple(he.run_history_summary(runs, "a").first()) == (3, before(days=2), before(hours=1))
    assert tuple(he.run_history_summary(runs, "none").first()) == (0, None, None)
    assert [r["name"] for r in he.bronze_freshness(runs.where("stream_id IS NOT NULL"), as_of()).collect()] == ["a"]
    assert runs.select(he.latest_success(runs, "id", "id")).first()[0] == 6
    assert runs.select(he.latest_success(runs.where("id = 4"), "id", "id")).first()[0] is None


def test_named_ranges(spark):
    df = spark.createDataFrame([(1, "a", before(hours=1)), (2, "a", before(hours=2)), (3, "b", T), (4, "a", None), (5, "a", before(hours=1))], "event_id long, e string, ts timestamp_ntz")
    ids = lambda name, who="a": sorted(r["event_id"] for r in ac.relative_range(df, name, as_of(), "e", who).collect())
    assert (ids("current"), ids("last_hour"), ids("last_24h"), ids("current", "none")) == ([5], [1, 5], [1, 2, 5], [])
    with pytest.raises(ValueError):
        ids("last_year")


def test_alerts_of_a_location(spark):
    df = spark.createDataFrame([(1, "l", "active", before(days=30)), (2, "l", "resolved", before(hours=24)), (3, "l", "resolved", before(days=7)), (4, "m", "active", T)], "id long, location_id string, status string, triggered_at timestamp_ntz")
    ids = lambda name: sorted(r["id"] for r in ac.alerts_of(df, "l", name, as_of()).collect())
    assert [ids(x) for x in ("active", "last_24h", "last_7d", "always")] == [[1], [2], [2, 3], []]


def test_samples_are_bounded(spark):
    df = spark.range(300).select(F.col("id"), (F.lit(T).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"))
    assert ac.sample(df, ["id"]).count() == 10
    assert ac.sample(df, ["id"], 5000).count() == 100
    assert [r["id"] for r in ac.sample(df, [F.desc("id")], 2, "2024-01-10 00:01:00", "2024-01-10 00:05:00").collect()] == [4, 3]


def test_cold_rows_with_null_keys_come_once(spark):
    hot = spark.createDataFrame([(1, "a", 1), (2, None, 1), (3, None, 1)], "id long, s string, t long")
    cold = spark.createDataFrame([(4, "a", 1), (5, None, 1), (6, "a", None), (7, "a", None)], "id long, s string, t long")
    assert sorted(r["id"] for r in ac.hybrid(hot, cold, ["s", "t"]).collect()) == [1, 2, 3, 6, 7]


def test_pages(spark):
    df = spark.createDataFrame([(n // 2, n) for n in range(10)], "bucket long, id long")
    assert [r["id"] for r in ac.next_page(df, None, ["bucket", "id"], 3).collect()] == [0, 1, 2]
    assert [r["id"] for r in ac.next_page(df, F.lit(2), ["bucket", "id"], 3).collect()] == [6, 7, 8]


def test_latest_readings_by_kind(spark):
    one = spark.createDataFrame([(1, T, "x", 1.5), (1, T, "x", None), (2, None, "y", 2.0)], "id long, ts timestamp_ntz, place string, v double")
    told = ac.latest_readings([("one", one, "id", "ts", "place", {"v": "v"}), ("two", one.where("id = 2"), "id", "ts", None, {"v": "v"})])
    assert rows_of(told, "data_type", "id") == [("one", "1", T, "x", '{"v":null}'), ("one", "2", None, "y", '{"v":2.0}'), ("two", "2", None, None, '{"v":2.0}')]


def test_edges_name_the_node_that_is_missing(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "x"), ("x", "y"), ("a", None), ("a", "b")], "source string, target string")
    nodes = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "id string")
    told = sorted((r["source"], r["target"] or "", r["missing"] or "") for r in ac.checked_edges(edges, nodes).collect())
    assert told == [("a", "", "null"), ("a", "b", ""), ("a", "b", ""), ("a", "x", "x"), ("x", "y", "x")]
    assert ac.count_by_type(nodes, "id", "b").first()["n"] == 2


def test_positions_without_open_ones(spark):
    rows = [("s", "CLOSED", 5.0, 10.0, 2.0, 1.0), ("t", "OPEN", 3.0, 7.0, None, 4.0), ("t", None, 9.0, 9.0, None, 9.0)]
    df = spark.createDataFrame(rows, "symbol string, status string, quantity double, entry_price double, realized_pnl double, unrealized_pnl double")
    assert rows_of(ac.position_summary(df), "symbol") == [("s", 0.0, None, 2.0, 0.0), ("t", 3.0, 7.0, None, 4.0)]


def write_lines(spark, lines):
    path = new_path(spark, "lines")
    spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.text(path)
    return path


def test_types_of_csv_values(spark):
    kinds = {"5": "int", "+5": "int", " 5": "string", "1d": "string", "1f": "string", "0x1p3": "string", "1e5": "float", ".5": "float", "1.": "float", ".": "string",
             "9223372036854775808": "float", "nan": "float", "-Infinity": "float", "TRUE": "bool", "": "null", None: "null", "null": "string", 'a"b': "string"}
    df = spark.createDataFrame([(x,) for x in kinds], "v string")
    told = df.select("v", tables.inferred("v").alias("kind"), tables.inferred_json("v").alias("text")).collect()
    assert {r["v"]: r["kind"] for r in told} == kinds
    texts = {r["v"]: r["text"] for r in told}
    assert [texts[x] for x in ("+5", "nan", "-Infinity", "TRUE", "", None, 'a"b', "1d")] == ["5", "0", "0", "true", "null", "null", '"a\\"b"', '"1d"']


def test_times_of_csv_values(spark):
    df = spark.createDataFrame([(x,) for x in ("2024-01-10T00:00:00", "2024-01-10t00:00:00.5z", "2024-01-10 01:00:00+01:00", "2024-01-10 00:00:00", "2024-01-10", "", None)], "v string")
    assert [r["t"] for r in df.select(tables.csv_timestamp("v", "iso8601").alias("t")).collect()] == [T, T + dt.timedelta(milliseconds=500), T, None, None, None, None]
    seconds = spark.createDataFrame([("10",), (" 10",), ("1e1",)], "v string")
    assert [r["t"] is not None for r in seconds.select(tables.csv_timestamp("v", "epoch_seconds").alias("t")).collect()] == [True, False, False]


def test_csv_points_and_their_policies(spark):
    path = write_lines(spark, ["at,name", "2024-01-10T00:00:00Z,1", "later,2", "2024-01-10T00:00:00Z,3,more", '2024-01-10T00:00:00Z,"x,]"'])
    bodies = lambda **how: [r["payload"].split('"name":')[1] for r in tables.csv_points(spark, path, "at", **how).collect()]
    assert bodies() == ["1}", '"x,]"}']
    assert bodies(limit=2) == ["1}"]
    told = tables.csv_points(spark, path, "at", on_error="log").collect()
    assert [(r["error"] or "").split(":")[0] for r in told] == ["", "no time", "another number of fields", ""]
    with pytest.raises(Exception, match="no time"):
        bodies(on_error="fail")
    with pytest.raises(ValueError):
        tables.csv_points(spark, path, "gone")
    bare = write_lines(spark, ["10;a", "20;"])
    assert [r["payload"] for r in tables.csv_points(spark, bare, "col_0", "epoch_seconds", ";", False).collect()] == ['{"col_0":10,"col_1":"a"}', '{"col_0":20,"col_1":null}']


def test_an_empty_target_has_no_mark(spark):
    df = spark.createDataFrame([(1, T), (2, before(hours=2)), (3, None)], "id long, ts timestamp_ntz")
    ids = lambda target: sorted(r["id"] for r in merge.since_watermark(df, target, "ts", "1 HOUR").collect())
    assert ids(df.where("false")) == [1, 2, 3] and ids(df) == [1] and ids(df.where("id = 3")) == [1, 2, 3]


def test_coarser_bars_weigh_spreads_by_trades(spark):
    rows = [(T, "s", 1.0, 5.0, 1.0, 2.0, 10, 1, 0.1), (T + dt.timedelta(minutes=1), "s", 2.0, 9.0, 0.5, 3.0, 20, 3, 0.5), (T + dt.timedelta(minutes=61), "s", 4.0, 4.0, 4.0, 4.0, 5, 0, None)]
    fine = spark.createDataFrame(rows, "bucket timestamp, k string, open double, high double, low double, close double, volume long, trades_count long, avg_spread_pct double")
    told = bars.coarser(fine, "1 hour", ["k"]).select("open", "high", "low", "close", "volume", "trades_count", F.round("avg_spread_pct", 6), "bucket")
    assert rows_of(told, "bucket") == [(1.0, 9.0, 0.5, 3.0, 30, 4, 0.4, T), (4.0, 4.0, 4.0, 4.0, 5, 0, None, T + dt.timedelta(hours=1))]


def test_a_short_look_back_sees_the_state_before(spark):
    states = spark.createDataFrame([(1, "a", before(days=3), "on"), (2, "a", before(hours=20), "off"), (3, "a", T, "on"), (4, "b", before(days=3), "on"), (5, "b", T, "off"), (6, "a", T + dt.timedelta(days=9), "off")], "id long, e string, ts timestamp_ntz, s string")
    long = states.select("id", "e", "ts", F.lit("m").alias("metric"), F.lit(1.0).alias("value"))
    goals = spark.createDataFrame([("o", "m", ">", 5.0, None)], "objective_id string, metric string, condition string, threshold double, threshold_upper double")
    who = lambda **more: sorted(r["e"] for r in ev.detect(states, long, goals, "e", "ts", "s", "id", "2024-01-10 00:00:00", "2024-01-11 00:00:00", **more).collect())
    assert who() == ["a", "b"] and who(lookback="1 DAY") == ["a"]


def test_latest_texts_and_unpivoted_readings(spark):
    df = spark.createDataFrame([(1, T, "x", None), (2, before(hours=1), "y", "old"), (3, None, "z", "none")], "id long, ts timestamp_ntz, a string, b string")
    assert rows_of(ac.latest_text([("s", df, "ts", ["a", "b"])]).select("field_name", "value"), "field_name") == [("a", "x"), ("b", "old")]
    assert rows_of(ac.unpivot_reading(df.withColumn("v", F.lit("2.5")).withColumn("w", F.when(F.col("id") == 1, 7)), ["id"], {"m": "v", "n": "w"}), "id", "metric") == [(1, "m", 2.5), (1, "n", 7.0), (2, "m", 2.5), (3, "m", 2.5)]
