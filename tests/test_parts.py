"""Keys of several elements, schemaless values, lines of logs and sketches, against brute force."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import tuples, values
from quern.operators import logs, records, sketches, statistics, text
from quern.session import workspace
from quern.sources import exposition, files


@pytest.mark.parametrize("falling", list(itertools.product([False, True], repeat=3)))
def test_keys_sort_as_their_elements(spark, falling):
    r = random.Random(1)
    data = [(r.choice(["", "a", "a\x00", "a\x00b", "b", "é", None]), r.choice([0, 1, -1, 2**63 - 1, -(2**63), 255, 256, None]), r.choice([b"", b"\x00", b"\x00\xff", b"\xff", b"ab", None])) for _ in range(400)]
    df = spark.createDataFrame(data, "s string, n bigint, b binary")
    kinds = list(zip(("string", "int", "bytes"), falling, strict=True))
    key = tuples.encode([(F.col(c), k, d) for c, (k, d) in zip("snb", kinds, strict=True)])
    made = df.select("*", key.alias("key"))
    own = lambda row: tuple((0,) if x is None else (1, x.encode() if isinstance(x, str) else bytes(x) if isinstance(x, bytearray) else x) for x in row)

    def less(a, b):
        for x, y, d in zip(own(a[:3]), own(b[:3]), falling, strict=True):
            if x != y:
                return (x < y) != d
        return False

    rows = sorted(made.collect(), key=lambda x: bytes(x["key"]))
    assert not any(less(b, a) for a, b in zip(rows, rows[1:], strict=False))
    back = made.select("s", "n", "b", *[c.alias(f"r{i}") for i, c in enumerate(tuples.decode(F.col("key"), kinds))])
    assert all(tuple(x[:3]) == tuple(x[3:]) for x in back.collect())
    broken = made.select(*[c.alias(f"r{i}") for i, c in enumerate(tuples.decode(F.substring("key", 1, 1), kinds))]).collect()
    assert all(x[2] is None for x in broken)


def test_keys_of_times(spark):
    df = spark.createDataFrame([(-5,), (0,), (1_700_000_000_123_456,), (None,)], "us bigint").select(F.timestamp_micros("us").alias("t"))
    for falling in (False, True):
        key = tuples.encode([(F.col("t"), "timestamp", falling)])
        got = df.select("t", tuples.decode(key, [("timestamp", falling)])[0].alias("r"), F.hex(key).alias("k")).collect()
        assert all(x["t"] == x["r"] for x in got)
        order = [x["t"] for x in sorted(got, key=lambda x: x["k"])]
        assert (order[::-1] if falling else order) == [x["t"] for x in got[3:] + got[:3]]


VALUES = ['{"a.b": {"x": [1, 2.5, {"y": null}, [], {}]}, "c[0]": "t\\n", "d": true, "e\\\\f": -0.0}', "[[1], [[2, 3]], []]", "3", '"s"', "null", "{}", "[]", "not json", None, '{"a": 1}']


def test_values_are_rebuilt_from_their_leaves(spark):
    df = spark.createDataFrame(list(enumerate(VALUES)), "i int, v string")
    flat = logs.leaves(df, "v", ["i", "v"], indexed=True)
    for x in flat.select("i", "v", values.rebuild(F.col("leaves")).alias("r"), values.display(F.col("v")).alias("d")).collect():
        if x["v"] in (None, "not json"):
            assert x["r"] is None and x["d"] is None
        else:
            assert json.loads(x["r"]) == json.loads(x["d"]) == json.loads(x["v"])


def test_display_is_for_people(spark):
    row = spark.createDataFrame([('{"a":[1,2],"b":"x\\ny\\u0001é\\u007f"}',)], "v string").select(values.display(F.col("v"))).first()
    assert row[0] == '{"a": [1, 2], "b": "x\\ny\\u0001é\\u007f"}'


def test_typed_parts_say_why_they_lack(spark):
    df = spark.createDataFrame([('{"a": {"b": 7, "s": "7", "f": 1.5, "t": true, "n": null}}',)], "v string").select(F.parse_json("v").alias("v"))
    cases = {("$.a.b", "bigint"): (7, None), ("$.a.s", "bigint"): (None, "mismatch"), ("$.a.f", "bigint"): (None, "mismatch"), ("$.a.b", "double"): (7.0, None), ("$.a.b", "string"): (None, "mismatch"), ("$.a.s", "string"): ("7", None), ("$.a.t", "boolean"): (True, None), ("$.a.s", "boolean"): (None, "mismatch"), ("$.a.n", "bigint"): (None, "mismatch"), ("$.a.z", "bigint"): (None, "missing"), ("$.z.b", "string"): (None, "missing"), ("$.a.t", "double"): (None, "mismatch")}
    for (path, kind), want in cases.items():
        got = df.select(values.extract(F.col("v"), path, kind).alias("x")).first()["x"]
        assert tuple(got) == want, (path, kind)
    with pytest.raises(Exception, match="mismatch"):
        df.select(values.require(F.col("v"), "$.a.s", "bigint")).collect()


def test_camel_case(spark):
    df = spark.createDataFrame([("some_odd__name_", "SomeOddName"), ("", ""), ("_", ""), ("x", "X"), ("aB_cD", "ABCD"), (None, None)], "a string, b string")
    assert all(x[0] == x[1] for x in df.select(values.camel_case(F.col("a")), "b").collect())


def test_lines_of_files_are_numbered(spark):
    path = workspace(spark, "lines")
    spark.range(500).selectExpr("concat('line ', id) AS value").repartition(3).write.text(path)
    got = text.newline_records(spark, path).collect()
    for f in {x["file"] for x in got}:
        own = sorted((x["record"], x["text"]) for x in got if x["file"] == f)
        with open("/" + f.removeprefix("file:").lstrip("/")) as lines:
            assert [t for _, t in own] == lines.read().splitlines() and [n for n, _ in own] == list(range(len(own)))


def test_dumped_records_become_a_run(spark, tmp_path):
    data = [(bytearray(b"b"), 2, bytearray(b"\x00")), (bytearray(b"a"), 1, None), (bytearray(b""), 9, bytearray(b"")), (bytearray(b"b"), 5, bytearray(b"x"))]
    df = spark.createDataFrame(data, "key binary, ts bigint, value binary")
    lines = files.dump(df).unionByName(spark.createDataFrame([("61 2",), ("6 3 DEL",), ("",), (None,)], "value string"))
    files.log_to_run(lines, str(tmp_path / "run"))
    got = [(bytes(x["key"]), x["ts"], None if x["value"] is None else bytes(x["value"])) for x in files.read_run(spark, str(tmp_path / "run")).orderBy("key", F.desc("ts")).collect()]
    assert got == [(b"", 9, b""), (b"a", 1, None), (b"b", 5, b"x"), (b"b", 2, b"\x00")]


def test_readings_a_line_each(spark):
    rows = [("c", "counter", 1, 5.0, None, None), ("m", "moments", 2, None, (3, 1.5, 2.0, float("nan"), 0.0), None), ("h", "histogram", 3, None, None, [(1.0, 2), (20.0, 1)]), ("e", "histogram", 3, None, None, [])]
    df = spark.createDataFrame(rows, "label string, kind string, s bigint, value double, moments struct<n:bigint,m1:double,m2:double,m3:double,m4:double>, hist array<struct<boundary:double,n:bigint>>").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r[0] for r in exposition.plain(df).collect()) == ["c 1000 5.0", "h 3000 {approx=1.0} 2", "h 3000 {approx=20.0} 1", "m 2000 3 1.5 2.0 NaN 0.0"]


def test_crc32c_of_published_texts(spark):
    known = [(b"", 0), (b"123456789", 0xE3069283), (bytes(32), 0x8A9136AA), (b"\xff" * 32, 0x62A8AB43), (bytes(range(32)), 0x46DD794E), (None, None)]
    df = spark.createDataFrame([(None if b is None else bytearray(b), c) for b, c in known], "b binary, c bigint")
    assert all(x[0] == x[1] for x in df.select(sketches.crc32c(F.col("b")), "c").collect())


def test_sums_of_many_and_negative_items(spark):
    items = spark.createDataFrame([("a", 1), ("b", 1), ("a", -1), ("c", 3)], "x string, s bigint")
    for native in (False, True):
        whole = sketches.multiset_sum(items, "x", sign="s", native=native).first()[0]
        same = sketches.multiset_sum(spark.createDataFrame([("b",), ("c",), ("c",), ("c",)], "x string"), "x", native=native).first()[0]
        assert whole == same != sketches.EMPTY
        assert sketches.multiset_sum(items.limit(0), "x", native=native).first()[0] == sketches.EMPTY


def test_moments_agree_with_their_definition(spark):
    r = random.Random(3)
    data = [(g, r.gauss(1e6, 3)) for g in ("a", "b") for _ in range(500)] + [("one", 4.0), ("none", None), ("flat", 2.0), ("flat", 2.0), (None, 1.0)]
    got = {x["g"]: x for x in statistics.describe(statistics.moments(spark.createDataFrame(data, "g string, v double"), ["g"], "v")).collect()}
    assert set(got) == {"a", "b", "one", "flat", None}
    for g in ("a", "b"):
        own = [v for k, v in data if k == g]
        mean = sum(own) / 500
        m2, m3, m4 = (sum((v - mean) ** p for v in own) for p in (2, 3, 4))
        for name, want in (("m1", mean), ("m2", m2), ("m3", m3), ("m4", m4), ("variance", m2 / 499), ("kurtosis", 500 * m4 / m2**2)):
            assert got[g][name] == pytest.approx(want, rel=1e-6)
    assert [got["flat"][c] for c in ("n", "m2", "m3", "m4")] == [2, 0, 0, 0] and got["one"]["variance"] != got["one"]["variance"]


def test_a_parameter_that_lacks_is_an_error(spark):
    df = spark.createDataFrame([(1, {"a": "x", "b": "y"})], "i int, parameters map<string,string>")
    assert tuple(statistics.project(df, ["b", "a"], ["i"]).first()) == (1, "y", "x")
    with pytest.raises(Exception, match="no parameter c"):
        statistics.project(df, ["c"]).collect()


def test_postings_find_what_has_all_tags(spark):
    df = spark.createDataFrame([(1, ":a=1:b=2:"), (2, ":b=2:a=1:"), (3, ":a=1:"), (4, "broken:"), (5, None), (6, ":a=1:a=1:")], "id int, tags string")
    index = records.tag_index(df, "id")
    assert sorted(x[0] for x in records.search_index(index, "id", {"a": "1", "b": "2"}).collect()) == [1, 2]
    assert sorted(x[0] for x in records.search_index(index, "id", {"a": "1"}).collect()) == [1, 2, 3]
    met = records.meeting_all(spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (None, "x"), (3, None)], "k int, v string"), "k", [F.col("v") == "x", F.col("v") == "y"])
    assert [x[0] for x in met.collect()] == [1]
