"""Files of metrics that stand alone, hot keys in slices, and streams with state."""

import random

import pytest
from conftest import rows as sorted_rows
from pyspark.sql import functions as F

from quern import queries as registry
from quern.operators import monitors, prefix, series, versions
from quern.operators.store import Store
from quern.session import workspace
from quern.sources import exposition, files
from quern.streaming import ingest


@pytest.mark.parametrize("rows_per_file", [2, 10, 1000])
def test_exposition_files_stand_alone(spark, rows_per_file):
    
    rows = [("hot", i % 7, i // 7, float(i)) for i in range(200)] + [(f"m{i}", 1, 5, float(i)) for i in range(4)]
    made = spark.createDataFrame(rows, "metric string, host int, s bigint, value double").selectExpr("metric", "map('host', string(host)) AS labels", "'gauge' AS kind", "timestamp_seconds(s) AS ts", "value")
    path = workspace(spark, "metrics")
    exposition.write(exposition.emit(made), path, rows_per_file)
    got = sorted((r["tags"], r["kind"], r["ts"].timestamp(), r["value"]) for r in exposition.read(spark, path).collect())
    assert got == sorted((f":__name__={m}:host={h}:", "gauge", float(s), v) for m, h, s, v in rows)
    files = {}
    for r in spark.read.text(path).selectExpr("_metadata.file_path AS f", "value").collect():
        files.setdefault(r["f"], []).append(r["value"])
    for lines in files.values():
        metrics = {x.split("{")[0] for x in lines if x[0] != "#"}
        assert len(lines) <= rows_per_file and {x.split()[2] for x in lines if x[0] == "#"} == metrics


def test_exposition_readings_at_one_time_share_a_file(spark):
    
    made = spark.range(40).selectExpr("'hot' AS metric", "map('host', string(id % 5)) AS labels", "'gauge' AS kind", "timestamp_seconds(1) AS ts", "double(id) AS value")
    path = workspace(spark, "metrics")
    exposition.write(exposition.emit(made), path, 6)
    parsed = exposition.parse(spark.read.text(path).selectExpr("value", "_metadata.file_path AS file")).filter("what = 'reading'")
    assert parsed.groupBy("labels").agg({"file": "collect_set"}).selectExpr("max(size(`collect_set(file)`))").first()[0] == 1


@pytest.fixture(scope="module")
def hot(spark):
    """Versions of which one key has most; times collide and are null, values too."""
    r = random.Random(8)
    data = [(r.choice(["hot", "hot", "hot", "b", None]), r.choice([r.randrange(-50, 3000), r.randrange(20), None]), r.choice([f"v{r.randrange(9)}", None])) for _ in range(3000)]
    return data, spark.createDataFrame(data, "k string, ts bigint, value string").cache()


def test_previous_rows_over_slices(spark, hot):
    df = hot[1].distinct()
    got = [sorted_rows(prefix.previous(df, ["k"], "ts", ["ts", "value"], "p", ["value"], bits=b).select("k", "ts", "value", "p.ts", "p.value")) for b in (0, 5)]
    assert got[0] == got[1] and len(got[0]) == len({*hot[0]})


def test_retention_over_slices(spark, hot):
    for policy in ("versions = 2", "any(versions = 3, ttl_micros = 500)", "all(versions = 40, ttl_micros = 900)"):
        got = [sorted_rows(versions.collect_garbage(hot[1], ["k"], policy, 2900, bits=b)) for b in (0, 6)]
        assert got[0] == got[1] and got[0]


def test_a_policy_of_ones_own(spark, hot):
    own = versions.collect_garbage(hot[1], ["k"], lambda cost, at, now: (cost <= 2) | (at >= now - 500), 2900)
    assert sorted_rows(own) == sorted_rows(versions.collect_garbage(hot[1], ["k"], "any(versions = 2, ttl_micros = 500)", 2900))


def test_as_of_join_over_slices_is_brute_force(spark, hot):
    r = random.Random(9)
    asked = [(i, r.choice(["hot", "hot", "b", "none", None]), r.choice([r.randrange(-60, 3100), None])) for i in range(800)]
    probes = spark.createDataFrame(asked, "id bigint, k string, at bigint")
    want = []
    for i, k, at in asked:
        before = [] if k is None or at is None else [(t, v is not None, v) for kk, t, v in hot[0] if kk == k and t is not None and t <= at]
        want.append((i, k, at, max(before)[2] if before else None))
    for b in (0, 5):
        got = [tuple(x) for x in versions.as_of_join(probes, hot[1], ["k"], "at", bits=b).select("id", "k", "at", "value").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_carried_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix, "CHUNK_BITS", 2)
    df = spark.createDataFrame([(i, i % 2, i * 3 % 11) for i in range(200)], "slot bigint, g int, v bigint")
    for how, fold in (("sum", sum), ("max", max)):
        for x in prefix.carried(df, ["g"], "slot", "v", "out", how).collect():
            before = [i * 3 % 11 for i in range(x["slot"]) if i % 2 == x["g"]]
            if how == "sum":
                assert x["out"] == (sum(before) if before else None)


def test_deviation_of_a_long_series_is_linear(spark):
    import time

    df = spark.range(100_000).selectExpr("':a=1:' AS tags", "id AS k", "timestamp_seconds(id) AS ts", "double(id * 7919 % 100003) AS value")
    began = time.time()
    for how in ("median", "median_absolute_deviation"):
        own = [r[0] for r in series.uniform(df, how).select("value").distinct().collect()]
        values = sorted(float(i * 7919 % 100003) for i in range(100_000))
        median = values[50_000]
        assert own == [median if how == "median" else sorted(abs(v - median) for v in values)[50_000]]
    assert time.time() - began < 60


def test_median_of_equal_values(spark):
    df = spark.range(1000).selectExpr("0 AS k", "timestamp_seconds(0) AS ts", "double(if(id < 700, 5, id)) AS value", "string(id) AS tags")
    assert [r["value"] for r in series.aggregate(df, "median").collect()] == [5.0]


def test_a_store_knows_its_history(spark, tmp_path):
    own = Store(spark, str(tmp_path / "s"))
    put = lambda pairs: own.write(spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v)) for k, v in pairs], "key binary, value binary"))
    assert own.verify().count() == 0
    put([(b"a", b"1"), (b"b", b"2")])
    put([(b"a", b"3"), (b"b", None)])
    assert own.compact("versions = 1", now=10)["kept"] == 1
    put([(b"c", b"4")])
    assert own.verify().count() == 0 and {bytes(r["key"]): bytes(r["value"]) for r in own.scan().collect()} == {b"a": b"3", b"c": b"4"}
    assert len(own.vacuum(keep=1)) == 2 and own.verify().count() == 0 and own.scan().count() == 2
    run = own.head()[1]["runs"][0]
    spark.createDataFrame([(bytearray(b"a"), 2, bytearray(b"x"))], "key binary, ts bigint, value binary").write.mode("overwrite").parquet(f"{own.path}/{run}")
    assert [r["fault"] for r in own.verify().collect()] == [f"{run} isn't what was written"]


def test_batches_of_one_token_come_once(spark, tmp_path):
    own = Store(spark, str(tmp_path / "s"))
    run = spark.createDataFrame([(bytearray(b"a"), 1, bytearray(b"x"))], "key binary, ts bigint, value binary")
    for token in (("f", 0), ("f", 0), ("f", 1), ("g", 0), ("f", 1)):
        own.ingest(run, token=token)
    assert own.records().count() == 3


def test_manifests_roll_over_and_are_verified(spark, tmp_path):
    path = str(tmp_path / "m")
    edits = lambda *x: spark.createDataFrame([(i, *e) for i, e in enumerate(x)], "edit_id bigint, op string, item string")
    assert files.read_manifest(spark, path).count() == 0 and files.verify_manifest(spark, path).count() == 0
    for items in (["a", "b"], ["c"], []):
        files.rollover(spark, edits(*[("add", i) for i in items]), path)
        assert [r["item"] for r in files.read_manifest(spark, path).orderBy("item").collect()] == items and files.verify_manifest(spark, path).count() == 0
    log = files.committed(spark, f"{path}/commits")[1]["log"]
    edits(("add", "z"), ("add", "z"), ("remove", "y")).write.mode("overwrite").parquet(f"{path}/{log}")
    assert files.verify_manifest(spark, path).count() == 3


def test_alerts_of_all_monitors_keep_their_state(spark, tmp_path):
    schema = "key string, at bigint, a double, b double, reset boolean"
    batches = [[("x", 1, 5.0, 1.0, False), ("y", 1, None, 0.0, False), (None, 1, 1.0, 1.0, False)], [("x", 3, 9.0, 9.0, None), ("x", 2, 8.0, 2.0, False)], [("x", 4, 10.0, 9.0, True)]]
    want = {"stationary": [(1, 5.0, 9.0), (1, 5.0, 9.0), (None, None, None)], "success_rate": [(None, None, None), (3, 0.125, 0.125), (None, None, None)], "below": [(None, None, None), (2, 8.0, 9.0), (None, None, None)]}
    for kind, threshold in (("stationary", 0.0), ("success_rate", 0.5), ("below", 7.0)):
        path, out, progress = (str(tmp_path / kind / n) for n in ("in", "out", "progress"))
        for i, batch in enumerate(batches):
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
            stream = ingest.alerts(spark.readStream.schema(schema).parquet(path), kind, threshold)
            stream.writeStream.foreachBatch(lambda b, _, i=i: b.write.mode("overwrite").parquet(f"{out}/n={i}")).outputMode("update").option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
        got = [tuple(r) for r in spark.read.parquet(out).filter("key = 'x'").orderBy("n").select("fired_at", "first_condition", "latest_condition").collect()]
        if kind == "stationary":
            want[kind][0] = (1, 5.0, 5.0)
        assert got == want[kind]
        if kind == "below":
            assert spark.read.parquet(out).filter("key = 'y' and firing and value is null").count() == 1


def test_latched_alerts_have_a_lasting_id(spark):
    rows = spark.createDataFrame([("a", 1, True, 5), ("a", 2, False, 6), ("b", 1, True, 7)], "k string, at int, firing boolean, c int")
    later = rows.unionByName(spark.createDataFrame([("a", 9, True, 8)], rows.schema))
    one, two = ({r["k"]: r["alert_id"] for r in monitors.latch(x, ["k"], "at", "c").collect()} for x in (rows, later))
    assert one == two and len(set(one.values())) == 2


def test_user_functions(spark):
    df = spark.createDataFrame([(":a=1:", k, float(v)) for k, v in enumerate([3, 1, 4, 1, 5])], "tags string, k bigint, value double").withColumn("ts", F.timestamp_seconds("k"))
    values = lambda x: [r["value"] for r in x.orderBy("k").collect()]
    assert values(series.rollup(df, lambda a: F.array_max(a) - a[0], 1)) == [0.0, 0.0, 3.0, 0.0, 4.0]
    assert values(series.uniform(df, lambda a: F.element_at(a, -1) * 10)) == [50.0] * 5
    assert values(series.aggregate(df.unionByName(df), F.count)) == [2.0] * 5


def test_open_feed_holds_a_batch_cut_by_the_watermark(spark, tmp_path):
    changes = [(1, "s", b"a", 1, 0, "put", b"1"), (2, "s", b"b", 2, 0, "put", b"2"), (4, "s", b"c", 2, 1, "put", b"3"), (9, "s", b"a", 1, 0, "put", b"1")]
    spark.createDataFrame([(*c, None) for c in changes], "change_id bigint, keyspace string, kv_key binary, ts bigint, batch_pos int, op string, val binary, log_name string").write.parquet(f"{tmp_path}/kv_changes.parquet")
    assert [(r["key_hex"], r["val_hex"]) for r in registry.all_queries()["p5_open_state"](spark, str(tmp_path)).collect()] == [("61", "31")]


def test_a_streamed_feed_waits_for_its_gaps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "RUNS", 2)
    schema = "seq bigint, k string, ts bigint, batch_pos int, op string, val string"
    batches = [[(1, "a", 1, 0, "put", "1"), (2, "b", 1, 1, "put", "2")], [(4, "a", 3, 0, "put", "4"), (5, "c", 3, 1, "put", "5")], [(3, "a", 2, 0, "del", None), (3, "a", 2, 0, "del", None), (7, "c", 3, 2, "put", "7")], [(9, None, 9, 0, "put", "9"), (10, "d", 9, 1, "put", "x")]]
    want = [{"a": "1", "b": "2"}, {"a": "1", "b": "2"}, {"b": "2"}, {"b": "2"}, {"a": "4", "b": "2", "c": "7", "d": "x"}]
    path, state, progress = (str(tmp_path / n) for n in ("in", "state", "progress"))
    for i in range(5):
        if i < 4:
            spark.createDataFrame(batches[i], schema).coalesce(1).write.mode("append").parquet(path)
            ingest.apply_changes(spark.readStream.schema(schema).parquet(path), ["k"], state, progress, txn=["ts"], seq="seq").awaitTermination()
        else:
            ingest.seal(spark, state, ["k"], txn=["ts"], seq="seq")
        assert {r["k"]: r["val"] for r in ingest.read_state(spark, state, ["k"]).collect()} == want[i]
    ingest.seal(spark, state, ["k"], txn=["ts"], seq="seq")
    assert {r["k"]: r["val"] for r in ingest.read_state(spark, state, ["k"]).collect()} == want[4]
