"""Series, versions, text, logs, statistics, monitors, sketches and sources on small fixtures."""

import hashlib
import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quern.functions import histogram, tags
from quern.functions.math import POINTWISE
from quern.operators import logs, monitors, series, sketches, statistics, store, text, versions
from quern.plans import series_language, stack_language
from quern.session import workspace
from quern.sources import exposition

E = 1_000_000


def sampled(spark, points):
    return spark.createDataFrame(points, "tags string, t bigint, value double").select("tags", F.timestamp_micros("t").alias("ts"), "value")


def test_resample_is_the_naive_one(spark):
    r = random.Random(1)
    p = series.Params(100 * E, 160 * E, 7 * E)
    points = [(f":s={s}:", r.randrange(80 * E, 180 * E, E // 2), r.random()) for s in range(12) for _ in range(r.choice([1, 2, 9, 40]))]
    points += [(":s=late:", 160 * E - 1, 5.0), (None, 110 * E, 1.0), (":s=none:", 90 * E, 1.0)]
    got = {(x["tags"], x["k"]): x["value"] for x in series.resample(sampled(spark, points), p).collect()}
    want = {}
    for s in {t for t, _, _ in points if t}:
        inside = sorted((t, v) for tag, t, v in points if tag == s and p.start <= t < p.limit)
        for k in range(p.steps if inside else 0):
            past = [v for t, v in inside if t <= p.start + k * p.step]
            want[(s, k)] = past[-1] if past else inside[0][1]
    assert got == want


def test_fixture_series(spark):
    a, b = [math.e, math.e, math.pi], [math.e, math.pi, math.pi]
    df = spark.createDataFrame([(s, k, v) for s, vs in (("x", a), ("y", b)) for k, v in enumerate(vs)], "tags string, k bigint, value double").withColumn("ts", F.timestamp_seconds("k"))
    values = lambda d: [x["value"] for x in d.orderBy("k").collect()]
    assert values(series.aggregate(df, "mean"))[1] == pytest.approx(2.929937241024419)
    assert values(series.aggregate(df, "stdvar"))[1] == pytest.approx(0.089596, abs=1e-5)
    assert values(series.aggregate(df, "median")) == [math.e, math.pi, math.pi]
    fib = [1, 1]
    while len(fib) < 20:
        fib.append(fib[-1] + fib[-2])
    df = spark.createDataFrame([("f", k - 1, float(v)) for k, v in enumerate(fib)], "tags string, k bigint, value double").withColumn("ts", F.timestamp_seconds("k"))
    assert values(series.rollup(df, "range", 1)) == [float(b - a) for a, b in zip(fib, fib[1:], strict=False)]
    steps = spark.createDataFrame([("f", k, float(v)) for k, v in enumerate([0, 2.5, 2.5, 2.5, 5])], "tags string, k bigint, value double").withColumn("ts", F.timestamp_seconds("k"))
    assert values(series.rollup(steps, "changes", 2, 2)) == [1.0, 0.0, 1.0]


def test_empty_series(spark):
    none = sampled(spark, [])
    p = series.Params(0, 10 * E, E)
    for q in ("counters(a)", "aggregate(median, counters(a))", "uniform(mean, counters(a))", "rollup(mean, counters(a), 2s)"):
        if "rollup" not in q:
            assert series_language.compile_query(q, none, p).count() == 0
    assert series_language.compile_query("time(weekday)", none, p).count() == 10


def test_pointwise_edges(spark):
    xs = [0.0, -0.5, -1.0, 2.5, -2.5, 1e300, float("inf"), float("-inf"), float("nan"), None]
    row = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *[f(F.col("x")).alias(n) for n, f in POINTWISE.items()]).collect()
    at = {x["x"] if x["x"] is None or x["x"] == x["x"] else "nan": x for x in row}
    assert at[0.0]["ln"] == -math.inf and math.isnan(at[-0.5]["log10"]) and at[-1.0]["ln_1p"] == -math.inf
    assert at[0.0]["recip"] == math.inf and at[0.0]["signum"] == 1 and at[0.0]["sign"] == 0
    assert at[2.5]["round"] == 3 and at[-2.5]["round"] == -3 and at[-2.5]["trunc"] == -2
    assert at[1e300]["ceil"] == 1e300 and math.isnan(at["nan"]["signum"]) and at["nan"]["sign"] == 0
    assert all(at[None][n] is None for n in POINTWISE)


KV = "key string, ts bigint, value string"


@pytest.mark.parametrize(
    "policy, history, kept",
    [
        ("versions = 2", [(4, None), (3, None), (2, None), (1, "v")], [(1, "v"), (2, None)]),
        ("versions = 2", [(4, "v"), (3, None), (2, None), (1, None)], [(4, "v")]),
        ("ttl_micros = 1", [(4, "v"), (3, None), (2, None), (1, None)], [(4, "v")]),
        ("versions = 1", [(2, None), (1, "v")], []),
    ],
)
def test_retention(spark, policy, history, kept):
    df = spark.createDataFrame([("k", t, v) for t, v in history + history[:1]] + [("k", None, "z")], KV)
    assert sorted((x["ts"], x["value"]) for x in versions.collect_garbage(df, ["key"], policy, 5).collect()) == kept


def test_prune_and_as_of(spark):
    df = spark.createDataFrame([("A", 0, "a"), ("AA", 0, "x"), ("AA", 1, None), ("B", None, "b")], KV)
    assert [x["key"] for x in versions.prune(df, ["key"], 10).collect()] == ["A"]
    assert rows(versions.prune(df, ["key"], 0).select("key", "value")) == [("A", "a"), ("AA", "x")]
    probes = spark.createDataFrame([("AA", 0, "p"), ("AA", 5, "q"), ("A", -1, "r")], "key string, at bigint, value_of string")
    assert rows(versions.as_of_join(probes, df, ["key"], "at").select("value_of", "value")) == [("p", "x"), ("q", None), ("r", None)]
    assert versions.prune(df.limit(0), ["key"]).count() == 0


def test_store(spark):
    own = store.Store(spark, workspace(spark, "store"))
    put = lambda pairs: own.write(spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v)) for k, v in pairs], "key binary, value binary"))
    assert own.scan().count() == 0
    first = put([(b"a", b"1"), (b"b", b"2")])
    put([(b"a", None), (b"c", b"")])
    assert own.get(b"a") is None and own.get(b"a", first) == b"1" and own.get(b"c") == b""
    before = rows(own.scan())
    report = own.compact("versions = 1", now=100)
    assert rows(own.scan()) == before and report["read"] == report["kept"] + report["dropped"]
    with pytest.raises(ValueError):
        put([(b"x" * 20000, b"")])


def test_text(spark):
    df = spark.createDataFrame([(0, "aaaa"), (1, ""), (2, None), (3, "banana")], "id bigint, text string")
    assert {x["id"]: x["n"] for x in df.select("id", text.count(F.col("text"), "aa").alias("n")).collect()} == {0: 3, 1: 0, 2: None, 3: 0}
    assert rows(text.search(df, "an").select("id", "offset")) == [(3, 1), (3, 3)]
    odd = spark.createDataFrame([(1, "a.b\n..c.")], "id bigint, text string")
    assert odd.select(text.count(F.col("text"), "..")).first()[0] == 1 and rows(text.next_symbols(odd, ".")) == [(".", 1), ("b", 1), ("c", 1)]
    assert text.search(df, "").count() == 10
    probes = spark.createDataFrame([(0,), (4,), (5,), (6,), (9,)], "at bigint")
    assert rows(text.lookup(df, probes, "id")) == [(0, 0, 0), (4, 0, 4), (5, 1, 0), (6, 2, 0), (9, 3, 2)]


def test_logs(spark):
    texts = ['{"a": 1, "b": [{"x": 1, "y": 2}, {"x": 3, "y": 4}], "t": true}', '{"a": 1.0, "b": [{"x": 1, "y": 4}], "t": "true"}', "not json", None, "{}", '{"a": {"deep": null}}']
    flat = logs.leaves(spark.createDataFrame(list(enumerate(texts)), "id bigint, j string"), "j", ["id"])
    hit = lambda q: [x["id"] for x in logs.query(flat, q).orderBy("id").collect()]
    assert hit('{"a": 1}') == [0, 1] and hit('{"t": true}') == [0] and hit('{"t": "true"}') == [1]
    assert hit('{"b": [{"x": 1, "y": 4}]}') == [0, 1] and hit('{"a"}') == [0, 1, 5] and hit('{"zz": 1}') == []
    assert hit('{"a": 2} or {"b": [{"y": 2}]}') == [0]
    assert logs.exemplars(flat, 1).collect()[0]["n"] == 2


def test_histogram_table(spark):
    xs = [1.0, 10.0, 0.0, 0.5, 99.4, 999.0, 1000.0, 123.0, float("nan"), -1.0]
    got = [x[0] for x in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(histogram.bucket_for(F.col("x"), 2)).collect()]
    assert got == [0, 90, 0, 0, 179, 270, 270, 182, 0, None]
    back = spark.range(1000).select(F.col("id"), histogram.bucket_for(histogram.boundary_for(F.col("id"), 3), 3).alias("b"))
    assert back.filter("id <> b").count() == 0


def test_moments_merge_and_subtract(spark):
    r = random.Random(1)
    xs = [r.gauss(5, 2) for _ in range(50)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)] + [(99, None)], "i int, x double")
    m = lambda d: statistics.moments(d, [], "x")
    whole = m(df).first()
    parts = [m(df.filter(c)).select(F.struct(*statistics.MOMENTS).alias(n), F.lit(1).alias("j")) for c, n in (("i < 20", "a"), ("i >= 20", "b"))]
    both = parts[0].join(parts[1], "j").select(statistics.merge_pair(F.col("a"), F.col("b")).alias("m"), "a").select("m.*", statistics.subtract(F.col("m"), F.col("a")).alias("rest"), "a")
    got = both.first()
    later = m(df.filter("i >= 20")).first()
    for c in statistics.MOMENTS:
        assert got[c] == pytest.approx(whole[c]) and got["rest"][c] == pytest.approx(later[c])


def test_t_test_without_freedom(spark):
    m = statistics.moments(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, x double"), ["g"], "x")
    assert {x["g"]: x["margin"] for x in statistics.t_test(m, "g", "a").collect()} == {"a": None, "b": None}
    assert all(not x["significant"] for x in statistics.t_test(m, "g", "missing").collect())


def test_monitors(spark):
    df = spark.createDataFrame([("a", 1, 5, 0), ("a", 2, 5, 0), ("a", 3, 9, 1), ("a", 4, 2, 1)], "k string, t int, ok bigint, bad bigint")
    assert [x["firing"] for x in monitors.stationary(df, ["k"], "t", "ok").orderBy("t").collect()] == [True, False, True, True]
    assert [x["firing"] for x in monitors.success_rate(df, ["k"], "t", "ok", "bad", 0.8).orderBy("t").collect()] == [False, True, False, True]
    nan = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "v double").select(monitors.above_threshold(F.col("v"), 0.0).alias("a"), monitors.below_threshold(F.col("v"), 0.0).alias("b"))
    assert [tuple(x) for x in nan.collect()] == [(True, True), (True, True), (False, True)]


def test_multiset_sum(spark):
    items = [b"a", b"b", b"b", b"", None]
    want = [0] * 8
    for x in items:
        if x is not None:
            d = hashlib.sha3_256(x).digest()
            want = [(w + int.from_bytes(d[4 * i : 4 * i + 4], "little")) % p for i, (w, p) in enumerate(zip(want, sketches.PRIMES, strict=True))]
    got = sketches.multiset_sum(spark.createDataFrame([(None if x is None else bytearray(x),) for x in items], "x binary"), "x").first()[0]
    assert got == b"".join(w.to_bytes(4, "little") for w in want).hex()
    assert sketches.multiset_sum(spark.createDataFrame([], "x binary"), "x").first()[0] == sketches.EMPTY


def test_tags(spark):
    df = spark.createDataFrame([(":b=2:a=1:",), (":a=1:a=2:",), (":x:",), (None,), ("",)], "t string")
    got = [tuple(x) for x in df.select(tags.canonical(F.col("t")), tags.parse(F.col("t"))).collect()]
    assert got[0] == (":a=1:b=2:", {"a": "1", "b": "2"}) and got[1][1] is None and got[2][1] is None and got[3] == (None, None) and got[4][1] == {}


def test_exposition_labels(spark):
    lines = spark.createDataFrame([('m{p="a:b=c",q="x\\ny"} 1 5',), ("# TYPE m gauge",), ("m 2",)], "value string").withColumn("file", F.lit("f"))
    got = exposition.load(exposition.parse(lines)).collect()
    assert len(got) == 1 and got[0]["tags"] == ":__name__=m:p=a%3Ab%3Dc:q=x\ny:" and got[0]["kind"] == "gauge"


def test_stack_words(spark):
    df = spark.createDataFrame([(3.0, 4.0)], "a double, b double")
    value = lambda p: df.select(stack_language.Machine(["a", "b"]).column(p)).first()[0]
    cases = {"a b SWAP -": 1.0, "1 2 3 ROT DROP DROP": 2.0, "a [1 +] [2 *] BI -": -2.0, "a b [DUP *] BI@ +": 25.0, "1 2 [10 +] DIP +": 13.0, "5 [3 +] [2 *] COMPOSE CALL": 16.0, "2 5 [-] CURRY CALL": -3.0, "a 3 = [7] [8] IF": 7.0, "a b > [a] [b] IF": 4.0, "2 true [1 +] WHEN": 3.0, "1 5 2 3 [+] 2DIP - -": 7.0, "1 2 OVER - -": 0.0, "1 2 TUCK + -": -1.0, "1 2 3 4 2SWAP + - -": 2.0, "6 [1 +] KEEP -": 1.0}
    for program, want in cases.items():
        assert value(program) == want, program
    for bad in ("+", "1 CALL", "true [1] [1 2] IF", "5 >x 6 >x"):
        with pytest.raises(stack_language.StackError):
            stack_language.Machine().run(bad)
