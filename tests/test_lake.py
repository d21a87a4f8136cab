"""Large keys spread over tasks, logged and killed runs, merges of dates, sketches, compiled mappings."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelake.operators import align, ann_index, bars, features, mapping, ordering, parsers, profiles, registry, runs, vectors
from tidelake.session import stash
from tidelake.sources import lake, tables
from tidelake.streaming import rollups as st

T0 = dt.datetime(2024, 1, 1)


def series(spark, n, keys="1"):
    times = "TIMESTAMP '2024-01-01' + make_dt_interval(0, 0, 0, CAST(id * 7919 % 100000 AS DOUBLE)) AS ts"
    return spark.range(n).selectExpr("id", f"{keys} AS k", times, "IF(id % 5 = 0, NULL, id % 97 * 1.0) AS v")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_numbers_of_one_key_and_of_null_keys(spark):
    for keys in ("1", "IF(id % 3 = 0, NULL, id % 3)"):
        df = series(spark, 20_000, keys)
        wanted = df.withColumn("__n", F.row_number().over(W.partitionBy("k").orderBy("ts", "id")) - 1)
        found = ordering.numbered(df, ["k"], ["ts", "id"])
        assert found.exceptAll(wanted.select(*found.columns)).isEmpty() and found.count() == 20_000


def test_ranges_spread_one_key(spark):
    parts = ordering.in_ranges(series(spark, 1_000_000), ["k"], ["ts", "id"]).groupBy("__part").count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 250_000


def test_asof_of_one_key(spark):
    left, right = series(spark, 8000).where("id % 2 = 0").drop("v"), series(spark, 8000).where("id % 7 = 1").select("k", F.col("ts").alias("at"), F.col("id").alias("other"), "v")
    args = (left, right, "ts", "at", ["k"], ["at", "other", "v"], "other")
    found = align.asof_spread(*args)
    assert rows(found) == rows(align.asof(*args)) and found.count() == 4000
    assert align.asof_spread(left.where("false"), *args[1:]).count() == 0
    assert align.asof_spread(left, right.where("false"), *args[2:]).where("other IS NULL").count() == 4000


def test_values_carried_over_parts_without_any(spark):
    df = spark.createDataFrame([("a", p, n, v) for p, n, v in [(0, 1, None), (0, 2, 5), (1, 3, None), (2, 4, None), (2, 5, 7), (3, 6, None)]] + [(None, 0, 1, None), (None, 2, 2, 9)], "k string, p long, n long, v long")
    found = ordering.last_known(df, ["k"], "p", "n", "v", "x").orderBy("k", "n").collect()
    assert [r["x"] for r in found] == [None, 9, None, 5, 5, 5, 7, 7]


def test_chunked_windows_are_whole_windows(spark, monkeypatch):
    df = series(spark, 4000, "id % 2").withColumn("v", F.coalesce("v", F.lit(3.5)))
    whole = features.feature_matrix(df, "k", ["ts", "id"], "ts", "v")
    monkeypatch.setattr(features, "MATRIX_CHUNK", 700)
    cut = features.feature_matrix(df, "k", ["ts", "id"], "ts", "v")

    def told(found):
        return [str(r) for r in rows(found.select("id", *[(F.round(c, 6) + 0.0).alias(c) for c in features.MATRIX]))]

    assert told(cut) == told(whole) and len(told(cut)) == 4000


def test_logged_runs(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    df = series(spark, 100)
    with pytest.raises(Exception, match="broken"):
        runs.logged_run(df.withColumn("v", F.when(F.col("id") == 50, F.raise_error(F.lit("broken"))).otherwise(F.col("v"))), log, "s", "ts", lambda x: x.write.parquet(out))
    runs.logged_run(df, log, "s", "ts", lambda x: x.write.mode("append").parquet(out), F.col("v").isNull())
    runs.logged_run(df.where("false"), log, "s", "ts", lambda x: x.write.mode("append").parquet(out))
    found = runs.read_log(spark, log).orderBy("at").collect()
    assert [r["status"] for r in found] == ["started", "failed", "started", "completed", "started", "completed"]
    newest = df.agg(F.max("ts")).first()[0]
    assert [(r["rows_read"], r["rows_written"], r["rows_dropped"], r["watermark_before"], r["watermark_after"]) for r in found if r["status"] == "completed"] == [(100, 80, 20, None, newest), (0, 0, 0, newest, newest)]
    assert "broken" in found[1]["error"] and spark.read.parquet(out).count() == 80
    assert runs.latest_runs(runs.read_log(spark, log)).first()["status"] == "completed"


def test_catching_up_after_kills(spark, tmp_path):
    source, target, marks = (str(tmp_path / x) for x in ("source", "target", "marks"))
    df = series(spark, 3000).withColumn("ts", F.col("ts") + F.make_dt_interval(F.col("id").cast("int") % 9))
    tables.write_bronze(df, source)
    common = (spark, source, target, marks, "s", T0 + dt.timedelta(days=12), dt.timedelta(days=8), dt.timedelta(days=1))

    def broken(rows):
        rows.write.mode("overwrite").parquet(f"{target}/stream=s/chunk=2")
        raise RuntimeError

    assert lake.catch_up(*common, most=2) == 2
    with pytest.raises(RuntimeError):
        lake.catch_up(*common, transform=broken)
    assert lake.catch_up(*common) == 6 and lake.catch_up(*common) == 0
    wanted = df.where(F.col("ts") > F.lit(T0 + dt.timedelta(days=4)))
    assert rows(spark.read.parquet(target).select("id")) == rows(wanted.select("id"))


def test_merging_reads_and_writes_only_the_dates_of_the_batch(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.createDataFrame([(k, T0 + dt.timedelta(days=k % 5), k) for k in range(50)], "k long, ts timestamp, v long")
    assert lake.merge_dates(spark, path, df, ["k", "ts"], ["v"], "one")
    files = {f for f in spark.read.parquet(path).inputFiles() if "day=1/" in f or "day=2/" in f}
    batch = df.where("k % 5 = 3").withColumn("v", F.col("v") + 1000)
    assert lake.merge_dates(spark, path, batch, ["k", "ts"], ["v"], "two") and not lake.merge_dates(spark, path, batch.withColumn("v", F.lit(-1).cast("long")), ["k", "ts"], ["v"], "two")
    found = spark.read.parquet(path)
    assert files <= set(found.inputFiles())
    assert rows(found.select("k", "v")) == sorted(((k, k + 1000 if k % 5 == 3 else k) for k in range(50)), key=str)
    plan = lake.affected(spark, path, [(2024, 1, 4)], found)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan and lake.affected(spark, path, [(2024, 1, 4)], found).count() == 10
    with pytest.raises(ValueError, match="day"):
        lake.merge_dates(spark, path, df.withColumn("day", F.lit(1)), ["k"], ["v"], "three")


def test_late_rows_update_their_bucket(spark):
    rows_ = [(1, T0, 1.0), (2, T0 + dt.timedelta(hours=3), 5.0), (3, T0 + dt.timedelta(minutes=30), 3.0), (4, T0 + dt.timedelta(hours=9), 1.0), (5, T0 + dt.timedelta(minutes=40), 100.0)]
    parts = [spark.createDataFrame([r], "id long, ts timestamp, value double") for r in rows_]
    found = st.drain_updates(parts, lambda x: st.sketched(x, "1 hour", "4 hours", []), ["bucket"], "late").orderBy("bucket").collect()
    assert [(r["bucket"].hour, r["n"], r["high"]) for r in found] == [(0, 2, 3.0), (3, 1, 5.0), (9, 1, 1.0)]  # the last row was too late


def test_merged_sketches_keep_their_error(spark):
    hours = spark.range(50_000).selectExpr("TIMESTAMP '2024-01-01' + make_dt_interval(0, CAST(id % 24 AS INT)) AS ts", "CAST(id * 7919 % 50000 AS DOUBLE) AS value")
    rollup = hours.groupBy(F.window("ts", "1 hour").start.alias("bucket")).agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"), F.kll_sketch_agg_double("value", F.lit(200)).alias("sketch")
    )
    day = st.merged(rollup, "1 day", [], {"p50": 0.5, "p95": 0.95, "p99": 0.99}).first()
    assert (day["n"], day["low"], day["high"]) == (50_000, 0.0, 49_999.0)
    assert all(abs(day[p] / 50_000 - x) < 0.02 for p, x in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))


def field(name, expression=None, **more):
    transform = {"transform": {"type": "computed", "expression": expression}} if expression else {}
    return {"source_path": more.pop("path", "j.a"), "target_column": name, "type": "double_precision", **transform, **more}


def test_mappings_are_ordered_and_circles_are_errors(spark):
    df = spark.createDataFrame([(1, '{"a": 150, "b": "x"}'), (2, '{"a": null}'), (3, "{"), (4, None)], "id long, j string").withColumn("at", F.lit(0).cast("long"))
    time = {"source_field": "at", "target_field": "t", "transform": "microseconds_to_timestamp"}
    rules = [{"rule": "range_check", "min": 0.0, "max": 100.0}]
    fields = [field("z", "y + 1"), field("y", "c * 2"), *[field(n, dq_rules=[rules[0] | {"action": a}]) for n, a in (("c", "clamp"), ("r", "reject"), ("f", "flag"))]]
    config = {"timestamp": time, "identity_fields": [{"source": "id", "target": "id"}], "field_mappings": fields}
    found = mapping.field_mapping(df, config).orderBy("id").collect()
    assert [(r["z"], r["y"], r["c"], r["r"], r["f"]) for r in found] == [(301.0, 300.0, 100.0, None, 150.0)] + [(None,) * 5] * 3
    assert found[0]["dq_flags"] == ["range_check:c:clamped", "range_check:r:out_of_bounds", "range_check:f:out_of_bounds"] and found[1]["dq_flags"] == []
    dropping = config | {"dq_rules": [{"rule": "null_check", "field": "c", "action": "drop"}], "dq_output": {"enabled": False}}
    assert [r["id"] for r in mapping.field_mapping(df, dropping).collect()] == ["1"] and "dq_flags" not in mapping.field_mapping(df, dropping).columns
    with pytest.raises(ValueError, match="depend on each other"):
        mapping.field_mapping(df, config | {"field_mappings": [field("a", "b + 1"), field("b", "a + 1")]})
    with pytest.raises(ValueError, match="unknown rule"):
        mapping.field_mapping(df, config | {"dq_rules": [{"rule": "nothing", "field": "c"}]})


def test_parsers_by_name_and_odd_payloads(spark):
    texts = ['{"d":"x","a":1,"b":"2","c":{"e":3},"n":null,"t":true,"f":-2.5e1}', "[1]", "7", "bad", "", None, '{"a":1}']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, p string")
    flat = {"location_field": "d"}
    assert rows(registry.parse(df, "flat_json", "p", ["id"], flat).select("id", "metric", "value")) == [(0, "a", 1.0), (0, "f", -25.0)]
    assert registry.parse(df, "flat_json", "p", ["id"], flat | {"default": "y", "skip": ["f"]}).count() == 2
    assert all(registry.parse(df, name, "p", ["id"]).count() == 0 for name in ("owm_weather", "owm_pollution", "sensor"))
    registry.register_parser("first", lambda d, p, keep, c: parsers.flat_json(d, p, keep, "d").where("metric = 'a'"))
    assert registry.parse(df, "first", "p", ["id"]).count() == 1
    for name, call in (("first", registry.register_parser), ("none", registry.parse)):
        with pytest.raises(ValueError, match=name):
            call(name, None) if call is registry.register_parser else call(df, name, "p", ["id"])


def test_index_prunes_clustered_data_and_takes_odd_rows(spark, tmp_path):
    rand = np.random.default_rng(3)
    centres = rand.normal(size=(40, 16)) * 8
    x = centres[rand.integers(0, 40, 3000)] + rand.normal(size=(3000, 16))
    data = [(k, v.tolist()) for k, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] * 16)]
    df, path = spark.createDataFrame(data, "vec_id long, embedding array<double>"), str(tmp_path / "index")
    ann_index.build_index(df, path)
    index, sizes = ann_index.open_index(spark, path)
    assert sum(sizes.values()) == 3000 and index.probes <= 0.1 * len(index.centres) and index.share <= 0.1
    queries = df.where("vec_id % 30 = 0 OR vec_id > 9000")
    found = {(r["query_id"], r["vec_id"]) for r in ann_index.search_index(queries, path, 10, block=20).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = unit[::30] @ unit.T
    scores[np.arange(100), np.arange(0, 3000, 30)] = -2
    wanted = {(30 * q, int(v)) for q, row in enumerate(np.argsort(-scores, axis=1)[:, :10]) for v in row}
    assert len(found & wanted) >= 0.9 * len(wanted) and len(found) == 1000
    assert ann_index.search_index(queries.where("false"), path, 10).count() == 0
    small = str(tmp_path / "small")
    ann_index.build_index(df.limit(3), small)
    ranked = ann_index.search_index(df.where("vec_id < 2"), small, 10).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"]) for r in ranked] == [(0, 1), (0, 2), (1, 1), (1, 2)]
    assert {r["vec_id"] for r in ranked if r["query_id"] == 0} == {1, 2}
    with pytest.raises(ValueError, match="needs a vector"):
        ann_index.build_index(df.where("vec_id > 9000"), str(tmp_path / "none"))


def test_index_scores_a_bounded_part_of_the_queries_at_once(spark, tmp_path, monkeypatch):
    """The same rows by whatever parts, and no task sees all queries of a list."""
    x = np.random.default_rng(4).normal(size=(400, 8))
    df, path = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"), str(tmp_path / "index")
    ann_index.build_index(df, path)
    whole = ann_index.search_index(df, path, 5).collect()

    def scores(self, x, lists, codes, of=ann_index.Index.scores):
        if len(x) > 60:
            raise MemoryError(len(x))
        return of(self, x, lists, codes)

    opened = ann_index.open_index(spark, path)
    bounded = type("Bounded", (ann_index.Index,), {"scores": scores})
    monkeypatch.setattr(ann_index, "open_index", lambda *_: (bounded(*vars(opened[0]).values()), opened[1]))
    assert sorted(ann_index.search_index(df, path, 5, asking=20).collect()) == sorted(whole) and len(whole) == 2000


def dealt(spark):
    """How many records shuffles have written so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (stages.apply(k) for k in range(stages.size()))}


def test_index_search_writes_neither_probes_nor_shortlists(spark, tmp_path, monkeypatch):
    """What is kept and dealt out grows with the vectors; it was a row a list that a query probes, and a row a place of its shortlists."""
    x = np.random.default_rng(6).normal(size=(2000, 8))
    df, path = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"), str(tmp_path / "index")
    ann_index.build_index(df, path)
    kept, before = [], dealt(spark)
    monkeypatch.setattr(ann_index, "stash", lambda df, label: kept.append(stash(df, label)) or kept[-1])
    found = ann_index.search_index(df, path, 10, block=500).collect()
    assert len(found) == 20000 and [k.count() for k in kept] == [2000]
    # 2000 queries and their 10 finds for each of 4 or 5 cells, 2000 rows for each of 6 turns of queries
    assert sum(n for stage, n in dealt(spark).items() if stage not in before) < 2000 * 11 * 6 + 2000 * 6


def test_index_cells_hold_whole_lists_and_parts_of_long_ones():
    centres = np.array([[0.0, 1], [9, 1], [0, 2], [9, 2], [5, 5]])
    first, parts = ann_index._cells(centres, {0: 4, 1: 5, 2: 5, 3: 3, 4: 25}, 10)
    assert parts == {0: 1, 2: 1, 1: 1, 3: 1, 4: 3} and first[0] == first[2] and first[1] == first[3] and first[0] != first[1]
    assert len({first[0], first[1], *range(first[4], first[4] + 3)}) == 5
    assert ann_index._grid(600_000, 30_000, 64, 4096, 256) == (2, 37_500) and ann_index._grid(2000, 100, 64, 4096, 256) == (1, 4096)
    turns, most = ann_index._grid(10**9, 10**8, 64, 4096, 256)
    assert most == 1 << 16 and 10**8 / turns <= 1 << 16  # bounded in memory, whatever the numbers


def test_index_ties_go_to_smaller_ids_in_whatever_cells(spark, tmp_path):
    """More equal vectors than a shortlist and than a cell: the smallest ids are found, but never the query's own."""
    x = np.random.default_rng(8).normal(size=(20, 8))
    data = [(k, x[0 if k < 300 else k % 20].tolist()) for k in range(600)]
    df, path = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(5), str(tmp_path / "index")
    ann_index.build_index(df, path)
    for block in (20, 4096):
        found = ann_index.search_index(df.where("vec_id IN (3, 500)"), path, 5, block=block).orderBy("query_id", "rank").collect()
        assert [r["vec_id"] for r in found if r["query_id"] == 3] == [0, 1, 2, 4, 5] and [r["rank"] for r in found] == [1, 2, 3, 4, 5] * 2
        assert [r["vec_id"] for r in found if r["query_id"] == 500] == [0, 1, 2, 3, 4]
    twice = str(tmp_path / "twice")  # an id of two rows, neither of which is another row than the query's own
    ann_index.build_index(df.where("vec_id < 3").union(df.where("vec_id = 2")), twice)
    assert [r["vec_id"] for r in ann_index.search_index(df.where("vec_id = 2"), twice, 5).orderBy("rank").collect()] == [0, 1]


def test_exact_neighbours_meet_in_groups_of_blocks(spark):
    """Vectors were dealt out once for each block of the other side; ties and the rows are those of brute force."""
    x = np.random.default_rng(9).normal(size=(2000, 8))
    x[1000:1100] = x[0]
    x[7] = 0
    df, before = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"), dealt(spark)
    found = vectors.knn_exact(df, df, 5, block=50).collect()
    assert sum(n for stage, n in dealt(spark).items() if stage not in before) < 2000 * 6 * (1 + 1 + 5) + 100
    got = {q: [r["vec_id"] for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])) if r["query_id"] == q] for q in (0, 1050, 7, 13)}
    assert got[0] == [1000, 1001, 1002, 1003, 1004] and got[1050] == [0, 1000, 1001, 1002, 1003] and got[7] == []
    unit = np.delete(x, 7, axis=0) / np.linalg.norm(np.delete(x, 7, axis=0), axis=1, keepdims=True)
    scores = unit @ unit.T
    np.fill_diagonal(scores, -2)
    wanted = np.sort(scores, axis=1)[:, :-6:-1].ravel()
    assert np.allclose([r["similarity"] for r in sorted(found, key=lambda r: (r["query_id"], r["rank"]))], wanted, atol=1e-12)
    assert vectors._grid(100, 2000, 64, 2048) == (1, 1) and vectors._grid(30_769, 615_384, 64, 2048) == (2, 26)


def test_profiles_and_gaps_of_odd_payloads(spark):
    texts = ['{"a":{"b":[1,[2.5,null],{"c":"x"}]},"d":null}', '{"d":9,"a":[]}', "[1]", "5", "bad", "", None, "{}"]
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    found = {r["path"]: (r["n"], r["n_null"], r["types"]) for r in profiles.payload_profile(df, "p").collect()}
    assert found == {
        "a": (2, 0, ["array", "object"]), "a.b": (1, 0, ["array"]), "d": (2, 1, ["integer", "null"]), "a.b[]": (3, 0, ["array", "integer", "object"]),
        "a.b[][]": (2, 1, ["null", "number"]), "a.b[].c": (1, 0, ["string"]),
    }
    profile = profiles.payload_profile(df, "p")
    assert {r["overall"] for r in profiles.gap_report(profile, ["a.b", "d"]).collect()} == {"match"}
    assert {(r["field"], r["status"], r["overall"]) for r in profiles.gap_report(profile, ["x", "y[0]"]).collect()} == {(f, s, "mismatch") for f, s in (("a", "extra"), ("d", "extra"), ("x", "missing"), ("y", "missing"))}
    assert profiles.payload_profile(df.where("false"), "p").count() == 0


def test_dimension_rows_of_another_width(spark, tmp_path):
    (tmp_path / "d.csv").write_text("a,b,c\n1,x,yes\n2,y\n3,z,no,more\n4,,n\n")
    columns = {"a": "bigint", "c": "boolean"}
    found = tables.read_dimension(spark, str(tmp_path / "d.csv"), columns, width="skip")
    assert rows(found) == [(1, True), (4, False)]
    with pytest.raises(Exception, match="another number of fields"):
        tables.read_dimension(spark, str(tmp_path / "d.csv"), columns).collect()


def test_statistics_open_no_file(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_bronze(spark.createDataFrame([(k, T0 + dt.timedelta(days=k % 3)) for k in range(9)], "k long, ts timestamp"), path)
    for f in (tmp_path / "t").rglob("*.parquet"):
        f.write_bytes(b"no parquet file")
    assert tuple(tables.latest_partition(spark, path).first()) == (2024, 1, 3)
    assert tables.drop_expired(spark, path, "2024-01-05 00:00:00", 2) == ["year=2024/month=1/day=1", "year=2024/month=1/day=2"]


def test_scalers_of_constant_and_missing_values(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", None), ("c", 1.0), ("c", 3.0)], "k string, v double")
    both = df.join(bars.fit_scaler(df, "v", ["k"]), "k").orderBy("k", "v")
    x, mean, std, low, high = (F.col(c) for c in ("v", "mean", "std", "low", "high"))
    z = both.select(bars.standard(x, mean, std).alias("z"), bars.minmax(x, low, high).alias("m"), bars.from_standard(bars.standard(x, mean, std), mean, std).alias("back")).collect()
    assert [(r["z"], r["m"], r["back"]) for r in z] == [(0.0, 0.0, 2.0)] * 2 + [(None,) * 3, (-1.0, 0.0, 1.0), (1.0, 1.0, 3.0)]
