"""Operators of the llm subpackage against brute force on small, dirty fixtures."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import langid, mixing, packing, percentiles, seen, tokens, topn
from quern.session import local_session


@pytest.fixture(scope="module")
def spark():
    session = local_session(4, shuffle=4, memory="4g", app="tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


def test_order_keys(spark):
    r = random.Random(1)
    xs = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 1.7976931348623157e308, float("inf"), float("-inf"), 0.1, 1 / 3]
    xs += [math.ldexp(1, e) for e in range(-1074, 1024, 7)] + [math.nextafter(math.ldexp(1, e), 0) for e in range(-1000, 1024, 13)] + [struct.unpack("d", r.randbytes(8))[0] for _ in range(2000)]
    xs = [x for x in xs if x == x]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for row in df.select("x", percentiles.order_key(F.col("x")).alias("k"), percentiles.key_value(percentiles.order_key(F.col("x"))).alias("v")).collect():
        bits = struct.unpack("q", struct.pack("d", abs(row["x"])))[0]
        assert row["k"] == (-bits if row["x"] < 0 else bits) and row["v"] == row["x"]
    none = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(percentiles.order_key(F.col("x"))).collect()
    assert [x[0] for x in none] == [None, None]


def rank(values, pct):
    values = sorted(values)
    k = next(k for k in range(1, len(values) + 1) if round(k * 100_000_000) >= round(pct * 1_000_000) * len(values) or k == len(values))
    return values[k - 1]


def test_percentiles_from_combined_states_and_exact(spark):
    r = random.Random(2)
    data = [("hot", r.randrange(3), r.lognormvariate(3, 2)) for _ in range(3000)] + [("few", 0, v) for v in (1.0, 1.0, 2.0)] + [("neg", 1, r.gauss(0, 5)) for _ in range(500)] + [(None, 0, 1.0), ("few", 0, None), ("few", 1, float("nan")), ("nothing", 0, None)]
    df = spark.createDataFrame(data, "g string, day int, value double")
    daily = percentiles.states(df, ["g", "day"])
    state = percentiles.combine(daily, ["g"])
    pcts = (0.0, 50.0, 90.0, 99.9, 100.0)
    targets = spark.createDataFrame([(g, p) for g in ("hot", "few", "neg", "nothing") for p in pcts], "g string, pct double")
    found = percentiles.select(state, targets, ["g"])
    ends = {(x["g"], x["pct"]): (x["lo"], x["hi"]) for x in found.select("g", "pct", percentiles.key_value(F.col("least")).alias("lo"), percentiles.key_value(F.col("greatest")).alias("hi")).collect()}
    rows = df.select("g", percentiles.order_key(F.col("value")).alias("__key"), F.lit(1).cast("bigint").alias("__n")).filter("__key is not null")
    values = {(x["g"], x["pct"]): x["value"] for x in percentiles.exact(rows, found, ["g"]).collect()}
    for g in ("hot", "few", "neg"):
        own = [v for k, _, v in data if k == g and v is not None and v == v]
        for p in pcts:
            want = rank(own, p)
            lo, hi = ends[(g, p)]
            assert lo <= want <= hi and abs(hi - lo) <= abs(want) * 2**-7
            assert values[(g, p)] == want
    assert not [k for k in values if k[0] in ("nothing", None)]
    assert percentiles.select(state.limit(0), targets, ["g"]).count() == 0


def test_histogram_boundaries(spark):
    df = spark.createDataFrame([(float(b), float(s)) for s in (1, 2, 3) for b in (0, 1, 89, 90, 200, 1000)], "b double, s double")
    for x in df.select("b", "s", percentiles.boundary(F.col("b"), F.col("s")).alias("v")).collect():
        per = 9 * 10 ** (int(x["s"]) - 1)
        assert x["v"] == pytest.approx((int(x["b"]) % per + per // 9) * 10.0 ** (int(x["b"]) // per - int(x["s"]) + 1))


def arrivals(n=4000):
    r = random.Random(3)
    keys = [b"hot", b"", b"\xff\xfe", "é".encode(), "é".encode(), None] + [bytes([i % 256, i // 256]) for i in range(700)]
    data = [(i, r.choice([b"hot", r.choice(keys)]), "clash", True) for i in range(n)] + [(None, b"hot", "x", False), (n, b"same", "x", False), (n, b"same", "x", False)]
    r.shuffle(data)
    return data


@pytest.mark.parametrize("parts", [1, 7])
def test_seen_before_is_brute_force(spark, parts):
    data = arrivals()
    warm = [b"\xff\xfe", b"other", None]
    df = spark.createDataFrame(data, "arrival_id bigint, last_key binary, hash string, settled boolean").repartition(parts)
    got = sorted((x["arrival_id"], x["seen"]) for x in seen.seen_before(df, "last_key", warm=spark.createDataFrame([(w,) for w in warm], "last_key binary")).collect())
    first = {}
    for i, k, *_ in data:
        if i is not None and k is not None:
            first[k] = min(first.get(k, i), i)
    want = sorted((i, k in warm or i > first[k]) for i, k, *_ in data if i is not None and k is not None)
    assert got == want
    assert seen.seen_before(df.limit(0), "last_key").count() == 0


def test_short_hashes_only_err_towards_seen(spark):
    df = spark.createDataFrame([(i, f"k{i}") for i in range(2000)], "arrival_id bigint, last_key string")
    row = seen.report(df, "last_key", "arrival_id", spark.createDataFrame([], "last_key string"), "last_key", bits=16).first()
    assert row["exact_seen"] == 0 and 5 < row["wrong"] < 90 and row["answered"] == 2000
    assert seen.report(df.limit(0), "last_key", "arrival_id", df.limit(0), "last_key").first()["answered"] == 0


@pytest.mark.parametrize("groups", [0, 10])
def test_top_n_is_brute_force(spark, monkeypatch, groups):
    monkeypatch.setattr(topn, "BROADCAST_GROUPS", groups)
    r = random.Random(4)
    data = [(i, r.choice(["hot", "hot", "hot", "a", "b", None]), r.choice([r.randrange(5), r.randrange(1000), None]), "__n") for i in range(3000)]
    data += data[::2] + data[::5]
    limits = {"hot": 25, "a": 3, "b": 10_000}
    df = spark.createDataFrame([(*d, limits.get(d[1])) for d in data], "id bigint, g string, score bigint, place_name string, n int")
    got = sorted((x["g"], x["place"], x["id"]) for x in topn.top_n(df, ["g"], "score", ["id"], "n", 10_000).collect())
    want = []
    for g, n in limits.items():
        own = sorted({(-s, i) for i, k, s, _ in data if k == g and s is not None})
        want += [(g, p, i) for p, (_, i) in enumerate(own[:n], 1)]
    assert got == sorted(want)
    good = df.filter("score is not null and g is not null")
    marks = {x["g"]: x["__least"] for x in topn.thresholds(good, ["g"], "score", ["id"], "n", topn.ceiling(good, "score")).collect()}
    assert {"hot", "a"} == set(marks)  # small groups too, but not one that keeps all its rows
    kept = good.filter("g = 'hot'").filter(topn.bucket(F.col("score"), 999.0) >= marks["hot"]).count()
    assert kept < 0.2 * good.filter("g = 'hot'").count()
    assert topn.top_n(df.limit(0), ["g"], "score", ["id"], "n", 5).count() == 0


def test_top_n_of_odd_scores(spark):
    odd = [float("nan"), float("inf"), float("-inf"), -0.0, 0.0, 1e300, -1e300, 5e-324, 3.0]
    data = [(g, i, x) for g in range(20) for i, x in enumerate(odd[g % 3 :] * 3)]
    df = spark.createDataFrame([(*d, 4) for d in data], "g int, id int, score double, n int")
    got = sorted((x["g"], x["place"], x["id"]) for x in topn.top_n(df, ["g"], "score", ["id"], "n", 4).collect())
    want = []
    for g in range(20):
        own = sorted((((1, 0) if x != x else (0, x + 0.0)), -i, i) for k, i, x in data if k == g)[::-1]
        want += [(g, p, o[2]) for p, o in enumerate(own[:4], 1)]
    assert got == sorted(want)


def test_objectives_within_a_cell_are_decided_by_the_values(spark):
    vals = [(i, ":b=1:a=2:", 1000.0 + i / 100) for i in range(101)]
    samples = spark.createDataFrame([(*v, None) for v in vals] + [(5, ":c=1:", 0.5, None)], "sample_id bigint, tags string, val double, arrived_at timestamp")
    readings = spark.createDataFrame([(1, ":r=1:", "histogram", 2, [0, 0, 5])], "reading_id bigint, tags string, kind string, sig_figs int, bucket_counts array<bigint>")
    asked = [(1, "samples", ":a=2:b=1:", 50.0, 1000.49), (2, "samples", ":a=2:b=1:", 50.0, 1000.5), (3, "samples", ":a=2:b=1:", 100.0, 1.0), (4, "samples", ":a=2:b=1:", 50.0, None), (5, "readings", ":r=1:", 50.0, 1.15), (6, "samples", ":no=1:", 50.0, 1.0)]
    got = {x["objective_id"]: x["above"] for x in percentiles.exceeded(samples, readings, spark.createDataFrame(asked, "objective_id bigint, origin string, tags string, pct double, max_val double")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: None, 5: True}


def test_repeats_that_differ_stay_whole_rows(spark):
    data = [(1, ":a=1:", 5.0), (1, ":b=2:", 3.0), (1, ":c=3:", 4.0)]
    df = spark.createDataFrame(data, "sample_id bigint, tags string, val double")
    row = percentiles.sample_keys(df).first()
    own = {tuple(x) for x in df.select(*percentiles.tag_ids(F.col("tags")), percentiles.order_key(F.col("val"))).collect()}
    assert (row["g1"], row["g2"], row["__key"]) in own and percentiles.sample_keys(df).count() == 1


def test_sets_kept_between_batches(spark, tmp_path):
    data = arrivals()
    schema = "arrival_id bigint, last_key binary, hash string, settled boolean"
    batches = [[d for d in data if d[0] is not None and d[0] % 5000 // 1500 == b] for b in range(3)]
    kept, first, got, want = seen.SeenTable(spark, str(tmp_path / "seen")), {}, [], []
    for rows in batches:
        got += [(x["arrival_id"], x["seen"]) for x in kept.answer(spark.createDataFrame(rows, schema), "last_key").collect()]
    for rows in batches:
        for i, k, *_ in rows:
            if k is not None:
                first[k] = min(first.get(k, i), i)
        want += [(i, i > first[k]) for i, k, *_ in rows if k is not None]
    assert sorted(got) == sorted(want) and kept.keys() == len(first)
    assert seen.SeenTable(spark, str(tmp_path / "seen")).answer(spark.createDataFrame([], schema), "last_key").count() == 0
    assert kept.keys() == len(first)


def test_packing_keeps_documents_whole(spark):
    r = random.Random(5)
    sizes = [(i, max(0, int(r.lognormvariate(4, 1.2)))) for i in range(1500)] + [(5000, 64), (5001, 65), (5002, 640), (5003, 0), (5003, 7), (5003, 7)]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint")
    packs = spark.createDataFrame([(1, 64), (2, 640), (3, 0), (None, 9)], "pack_id int, capacity_tokens int")
    out = packing.pack(df, packs)
    got = out.collect()
    for pack, capacity in ((1, 64), (2, 640)):
        own = [x for x in got if x["pack_id"] == pack]
        fill = {}
        for x in own:
            fill[x["bin_id"]] = fill.get(x["bin_id"], 0) + x["n_tokens"]
        assert max(fill.values()) <= capacity and sum(fill.values()) == sum(n for _, n in sizes)
        want = sorted((i, p, min(capacity, n - p * capacity)) for i, n in sizes for p in range(-(-n // capacity)))
        assert sorted((x["doc_id"], x["piece"], x["n_tokens"]) for x in own) == want
        assert sum(fill.values()) / (len(fill) * capacity) > 0.97
    report = {x["pack_id"]: x for x in packing.fill_report(out, packs).collect()}
    assert report[1]["fullest"] == 64 and report[1]["bins"] >= report[1]["least_bins"]
    assert packing.pack(df.limit(0), packs).count() == 0


def test_mixing_reaches_its_shares(spark):
    r = random.Random(6)
    data = [(i, r.choice(["Big source", "big_source", "BIG-SOURCE", "big_source"]), r.randrange(1, 40)) for i in range(4000)] + [(10_000 + i, "small", r.randrange(1, 40)) for i in range(300)] + [(20_000 + i, "other", 5) for i in range(50)] + [(30_000, None, 5), (None, "small", 5), (30_001, "small", 0)]
    df = spark.createDataFrame(data, "doc_id bigint, source string, n_tokens bigint")
    goals = spark.createDataFrame([("big_source", 0.7, 1), ("Small", 0.3, 3), ("absent", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(df, goals)
    shares = {x["source"]: x for x in mixing.shares(mixed, goals).collect()}
    assert shares["big_source"]["reached_share"] / shares["small"]["reached_share"] == pytest.approx(7 / 3, rel=0.01)
    assert shares["absent"]["tokens"] == 0 and shares["small"]["most_repeats"] <= 3 and shares["big_source"]["most_repeats"] == 1
    got = mixing.positions(mixed).orderBy("position").collect()
    assert [x["position"] for x in got] == list(range(len(got)))
    assert all(a["due"] <= b["due"] for a, b in zip(got, got[1:], strict=False))
    assert len({(x["doc_id"], x["repeat"]) for x in got}) == len(got)
    half = [x for x in got if x["due"] < 0.5]
    early = sum(x["n_tokens"] for x in half if x["source"] == "big_source") / sum(x["n_tokens"] for x in half)
    assert early > shares["big_source"]["reached_share"]  # larger sources start heavier
    assert mixing.mix(df.limit(0), goals).count() == 0


def test_a_schedule_sets_when_a_source_comes(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", 10) for i in range(2000)], "doc_id bigint, source string, n_tokens bigint")
    goals = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    plan = spark.createDataFrame([("A", 0.0, 0.0), ("A", 0.25, 0.0), ("a", 0.25, 4.0), ("a", 0.75, 0.0), ("b", 0.5, 2.0), ("b", 7.0, 1.0), ("c", 0.1, 1.0), (None, 0.0, 1.0)], "source string, at double, weight double")
    got = mixing.mix(df, goals, schedule=plan).collect()
    a, b = (sorted(x["due"] for x in got if x["source"] == s) for s in "ab")
    assert len(a) == len(b) == 1000 and mixing.shares(mixing.mix(df, goals, schedule=plan), goals).filter("reached_share <> 0.5").count() == 0
    for i in range(0, 1000, 37):
        done = (i + 0.5) / 1000
        assert b[i] == pytest.approx(done)  # one weight all the time
        assert 0 <= a[i] <= 0.75 + 1e-9
    early = sum(x < 0.5 for x in a) / 1000
    rise, fall = 0.25 * 4 / 2, 0.5 * 4 / 2  # the rise from 0 at 0 to 4 at 0.25, as the greatest weight at a time counts
    assert early == pytest.approx((rise + (4 + 2) / 2 * 0.25) / (rise + fall), abs=0.01)
    assert all(x <= y for x, y in zip(a, a[1:], strict=False))


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world", "a"), (2, None, "b"), (3, "", None)], "doc_id bigint, text string, n string")
    assert {x["doc_id"]: x["n_tokens"] for x in tokens.token_counts(df, ["doc_id", "n"]).collect()} == {1: tokens.count_tokens("hello world"), 2: 0, 3: 0}


WORDS = {
    "en": "the house of this parliament should never forget what people have asked for when they came here with their questions and hopes".split(),
    "de": "das Haus dieses Parlaments sollte niemals vergessen worum die Leute gebeten haben als sie hierher kamen mit ihren Fragen und Hoffnungen".split(),
    "es": "la casa de este parlamento nunca debería olvidar lo que la gente pidió cuando vino aquí con sus preguntas y esperanzas".split(),
}


def sentence(r, code, n=14):
    return " ".join(r.choice(WORDS[code]) for _ in range(n)) + "."


def test_language_codes(spark):
    labels = ["en", "EN", "en-GB", "eng", "English", " german ", "deu", "ger", "de_AT", "??", "", None, "und", "spanish", "xx", "Japanese", "jpn", "uk-UA", "nb"]
    got = [x[0] for x in spark.createDataFrame([(i, s) for i, s in enumerate(labels)], "i int, s string").orderBy("i").select(langid.language_code(F.col("s"))).collect()]
    assert got == ["en", "en", "en", "en", "en", "de", "de", "de", "de", None, None, None, None, "es", None, "ja", "ja", "uk", "no"]


def test_languages_of_held_out_documents(spark):
    r = random.Random(7)
    docs, truth, lines = [], {}, {}
    for i in range(300):
        main = r.choice(list(WORDS))
        text = [sentence(r, main) for _ in range(4)]
        if i % 10 == 0:
            other = r.choice([c for c in WORDS if c != main])
            text[2] = sentence(r, other)
            lines[(i, 4)] = other
            text.insert(1, "")
        label = {0: None, 1: r.choice([c for c in WORDS if c != main])}.get(i % 12, main)
        docs.append((i, "\n".join(text), label, "clash"))
        truth[i] = (main, label)
    docs += [(900, None, "en", ""), (901, "", "en", ""), (902, "123 456 ... 789 000 111 222", "en", ""), (903, "\r\n", None, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, seg_no string")
    net = langid.train(langid.training_rows(df), steps=240)
    found = {(x["doc_id"], x["seg_no"]): x["found_lang"] for x in langid.mislabelled(langid.find_languages(df, net)).collect()}
    want = {(i, 0): main for i, (main, label) in truth.items() if label != main} | lines
    right = sum(found.get(k) == v for k, v in want.items())
    assert right >= 0.97 * len(want) and len(found) <= len(want) + 3
    assert not {k for k in found if k[0] >= 900}
    assert langid.find_languages(df.limit(0)).count() == 0


def test_a_network_is_kept_by_path(spark, tmp_path):
    net = langid.BiGRU(["a", "b", "c"], 5, 2)
    langid.save(spark, net, str(tmp_path / "net"))
    again = langid.load(spark, str(tmp_path / "net"))
    assert again.classes == net.classes and all((p == q).all() for p, q in zip(net.parameters(), again.parameters(), strict=True))


def test_labels_do_not_depend_on_what_stands_together():
    net = langid.BiGRU(["a", "b"], 4, 3)
    data = np.frombuffer(b"some words and more words, again and again. " * 20, np.uint8)
    whole = np.concatenate([p for _, p in langid.label_bytes(net, data)])
    assert whole.shape == (len(data), 2) and np.allclose(whole.sum(1), 1, atol=1e-5)
