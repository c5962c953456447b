"""Consolidation of files and change feeds, against brute force on small, dirty fixtures."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quern.operators import changefeed, compaction
from quern.operators.prefix import prefix_sums
from quern.session import workspace

RECORD = "rec_id bigint, file_id bigint, store string, kv_key binary, ts bigint, val binary, bin_id string, size_class int"
IDENTITY = ["store", "kv_key", "ts", "val"]


def records(seed=1, n=400):
    r = random.Random(seed)
    pick = lambda xs: r.choice(xs)
    return [(i, pick([1, 2, 3, 4, 50, None]), pick(["a", "b", None]), pick([b"", b"k", b"\xff\xfe", b"hot", b"hot", None]), pick([1, 2, None]), pick([b"", b"x", b"y" * 300, None]), "z", 7) for i in range(n)]


def test_compaction_keeps_each_record_once(spark):
    data = records()
    df = spark.createDataFrame(data, RECORD)
    manifest = spark.createDataFrame([(1, "p"), (1, "./p"), (99, "gone"), (None, "q")], "file_id bigint, rank string")
    done = compaction.compact(df, manifest, IDENTITY, "rec_id", target_bytes=2048)
    want = {}
    for x in data:
        want.setdefault(x[2:6], []).append(x)
    got = done.records.collect()
    assert sorted(x["rec_id"] for x in got) == sorted(min(v)[0] for v in want.values())
    assert all(x["copies"] == len(want[(x["store"], None if x["kv_key"] is None else bytes(x["kv_key"]), x["ts"], None if x["val"] is None else bytes(x["val"]))]) for x in got)
    assert done.report["rows_read"] == len(data) and done.report["rows_written"] == len(want)


def test_compaction_of_nothing(spark):
    df = spark.createDataFrame([], RECORD)
    done = compaction.compact(df, spark.createDataFrame([], "file_id bigint"), IDENTITY, "rec_id")
    assert done.records.count() == 0 and done.report["rows_read"] == 0


def test_bins_hold_their_size(spark):
    r = random.Random(2)
    sizes = [(i, r.choice([0, 1, 5, 5, 5, 300, 999, 1000, 2500, None])) for i in range(500)]
    files = spark.createDataFrame(sizes, "file_id bigint, size_bytes bigint")
    bins, _ = compaction.assign_bins(files, 1000)
    got = bins.collect()
    assert sorted(x["file_id"] for x in got) == list(range(500))
    fill = {}
    for x in got:
        assert x["parts"] == (3 if x["size_bytes"] == 2500 else 1)
        if x["parts"] == 1:
            fill[x["bin_id"]] = fill.get(x["bin_id"], 0) + x["size_bytes"]
    assert max(fill.values()) <= 1000
    assert rows(bins) == rows(compaction.assign_bins(files.repartition(7), 1000)[0])


def test_many_tiny_files_fill_one_bin(spark):
    tiny = spark.range(20_000).selectExpr("id AS file_id", "1000L AS size_bytes")
    bins, n = compaction.assign_bins(tiny)
    assert n == 1 and bins.count() == 20_000 and {r[0] for r in bins.select("bin_id").distinct().collect()} == {0}


@pytest.mark.parametrize("target", [100_000, 1 << 20])
def test_bins_of_all_sizes_are_full_and_never_too_full(spark, target):
    r = random.Random(6)
    sizes = [(i, int(min(3 * target, r.lognormvariate(4, 3)))) for i in range(8000)]
    bins, n = compaction.assign_bins(spark.createDataFrame(sizes, "file_id bigint, size_bytes bigint"), target)
    got = bins.collect()
    fill, cut = {}, 0
    for x in got:
        if x["parts"] == 1:
            fill[x["bin_id"]] = fill.get(x["bin_id"], 0) + x["size_bytes"]
        else:
            cut += x["parts"]
    assert sorted(x["file_id"] for x in got) == list(range(8000)) and max(fill.values()) <= target
    assert set(fill) == set(range(len(fill))) and n == len(fill) + cut
    assert len(fill) <= 1.03 * sum(fill.values()) / target + 1


def test_rewriting_in_waves(spark, monkeypatch):
    monkeypatch.setattr(compaction, "WAVE", 3)
    df = spark.createDataFrame(records(), RECORD)
    done = compaction.compact(df, spark.createDataFrame([], "file_id bigint"), IDENTITY, "rec_id", target_bytes=700)
    assert done.report["bins"] > 3 and done.records.count() == done.report["rows_written"] == len({x[2:6] for x in records()})
    files = done.records.selectExpr("bin_id", "_metadata.file_name AS f").distinct()
    assert files.count() == files.select("bin_id").distinct().count() == files.select("f").distinct().count()


def test_a_folder_of_files_keeps_every_row(spark):
    source, target = workspace(spark, "source"), workspace(spark, "target")
    rows = spark.range(3000).selectExpr("id % 1000 AS a", "CASE WHEN id % 7 = 0 THEN NULL ELSE repeat('x', int(id % 50)) END AS bin_id_text", "map('k', id) AS m")
    rows.repartition(30).write.option("maxRecordsPerFile", 9).parquet(source)
    done = compaction.compact_folder(spark, source, target, 40_000)
    count = lambda df: sorted(df.selectExpr("a", "bin_id_text", "m.k").collect(), key=str)
    assert count(done.records) == count(spark.read.parquet(source)) and done.bins.count() > 300
    names = [r[0] for r in done.records.selectExpr("_metadata.file_name").distinct().collect()]
    assert len(names) <= done.report["bins"] < 40
    with pytest.raises(Exception, match="exists|EXISTS"):
        compaction.compact_folder(spark, source, target, 40_000)


def test_a_file_that_goes_meanwhile_is_missed(spark, monkeypatch):
    source, target = workspace(spark, "source"), workspace(spark, "target")
    spark.range(100).repartition(5).write.parquet(source)
    own = compaction.assign_bins

    def and_lose(files, size):
        out = own(files, size)
        spark.range(7).write.mode("overwrite").parquet(source)
        return out

    monkeypatch.setattr(compaction, "assign_bins", and_lose)
    with pytest.raises(Exception):
        compaction.compact_folder(spark, source, target)
    assert compaction.committed(spark, target) == (0, {})


def test_a_second_commit_fails(spark):
    path = workspace(spark, "commit")
    compaction.commit(spark, f"{path}/C", {"a": 1})
    with pytest.raises(FileExistsError):
        compaction.commit(spark, f"{path}/C", {"a": 2})


CHANGE = "change_id bigint, keyspace string, kv_key binary, ts bigint, batch_pos int, op string, val binary, t string"


def naive(changes):
    last = {}
    for c in changes:
        if c[1] is None or c[2] is None or c[3] is None:
            continue
        order = (c[3], -(2**62) if c[4] is None else c[4])
        dead = c[6] is None or (c[5] or "").strip().lower() in ("d", "del", "delete")
        entry = (order, dead, c[6] if not dead else b"", c)
        if (c[1], c[2]) not in last or entry[:3] > last[(c[1], c[2])][:3]:
            last[(c[1], c[2])] = entry
    return sorted((k[0], k[1], e[3][3], e[3][6]) for k, e in last.items() if not e[1])


def feed(seed=3, n=500):
    r = random.Random(seed)
    made = []
    for i in range(n):
        made.append((i + 1, r.choice(["a", "b", None]), r.choice([b"hot", b"hot", b"k", b"", None]), r.choice([*range(40), None]), r.choice([0, 1, None]), r.choice(["put", "DELETE", "d", " Del", "U", None]), r.choice([b"1", b"", None]), "clash"))
    return made + made[::3]


def test_replay_is_the_last_change_in_any_order(spark):
    changes = feed()
    random.Random(4).shuffle(changes)
    state = changefeed.replay(spark.createDataFrame(changes, CHANGE), ["keyspace", "kv_key"])
    assert sorted((x[0], bytes(x[1]), x[2], bytes(x[4 - 1])) for x in state.select("keyspace", "kv_key", "ts", "val").collect()) == naive(changes)
    none = spark.createDataFrame([], CHANGE)
    assert changefeed.replay(none, ["keyspace", "kv_key"]).count() == 0
    assert changefeed.replay(none, ["keyspace", "kv_key"], txn=["keyspace", "ts"], seq="change_id", declared=changefeed.gaps(none, "change_id")).count() == 0


@pytest.mark.parametrize("numbers, want", [([], 0), ([2, 3], 0), ([1, 1, 2, 4], 2), ([None, 1, 2, 3], 3), ([*range(1, 65537)], 65536), ([*range(1, 70000), 70005], 69999), ([*range(65537, 65600)], 0), ([*range(1, 65)], 64), ([*range(1, 64)], 63), ([*range(1, 129), 200], 128), ([*range(1, 300_000), 10**12], 299_999), ([0, -5, 1], 1)])
def test_contiguous_watermark(spark, numbers, want):
    df = spark.createDataFrame([(x,) for x in numbers], "n bigint")
    assert [x[0] for x in changefeed.contiguous_watermark(df, "n").collect()] == [want]


def test_gaps_and_incomplete_transactions_are_held(spark):
    changes = [(1, "a", b"x", 10, 0, "put", b"1", "t"), (2, "a", b"y", 11, 0, "put", b"2", "t"), (4, "a", b"x", 12, 0, "put", b"3", "t"), (3, "a", b"z", 12, 1, "put", b"4", "t"), (6, "a", b"y", 13, 0, "del", None, "t")]
    df = spark.createDataFrame(changes, CHANGE)
    keys = ["keyspace", "kv_key"]
    val = lambda s: sorted((bytes(x["kv_key"]), bytes(x["val"])) for x in s.collect())
    assert val(changefeed.replay(df, keys, seq="change_id")) == [(b"x", b"3"), (b"y", b"2"), (b"z", b"4")]
    assert val(changefeed.replay(df.filter("change_id <> 3"), keys, txn=["ts"], seq="change_id")) == [(b"x", b"1"), (b"y", b"2")]
    assert val(changefeed.replay(df, keys, txn=["keyspace", "ts"], seq="change_id", declared=changefeed.gaps(df, "change_id"))) == [(b"x", b"3"), (b"z", b"4")]
    sized = df.filter("change_id <> 3").withColumn("size", F.when(F.col("ts") == 12, 2).otherwise(1))
    assert val(changefeed.replay(sized, keys, txn=["ts"], txn_size="size")) == [(b"x", b"1")]


def test_a_lost_change_holds_what_lies_behind_it(spark):
    changes = [c for c in feed() if c[0] != 57]
    keys, txn = ["keyspace", "kv_key"], ["keyspace", "ts"]
    df = spark.createDataFrame(changes, CHANGE)
    out = lambda **k: sorted((x[0], bytes(x[1]), x[2], bytes(x[3])) for x in changefeed.replay(df, keys, txn=txn, seq="change_id", **k).select("keyspace", "kv_key", "ts", "val").collect())
    assert out(declared=changefeed.gaps(df, "change_id")) == naive(changes)
    mark = 56
    first = {}
    for c in changes:
        dead = c[6] is None or (c[5] or "").strip().lower() in ("d", "del", "delete")
        if None not in (c[1], c[2], c[3]):
            part = (c[1], c[2], c[3], c[4], dead, None if dead else c[6])
            first[part] = min(first.get(part, 10**9), c[0])
    late = {(p[0], p[2]) for p, s in first.items() if s > mark}
    shown = [c for c in changes if c[0] <= mark and (c[1], c[3]) not in late]
    assert out() == naive(shown) != naive(changes)
    assert changefeed.contiguous_watermark(df, "change_id").first()[0] == mark
    assert [tuple(x) for x in changefeed.gaps(df, "change_id").collect()] == [(57, 57)]


@pytest.mark.parametrize("seed", range(4))
def test_gaps_and_watermarks_are_brute_force(spark, seed):
    r = random.Random(seed)
    numbers = sorted({x for a in (r.randrange(1, 3000) for _ in range(60)) for x in range(a, a + r.choice([1, 1, 2, 63, 64, 65, 130]))})
    df = spark.createDataFrame([(x,) for x in numbers * 2], "n bigint")
    have, want = set(numbers), []
    for x in range(1, max(numbers)):
        if x not in have:
            if want and want[-1][1] == x - 1:
                want[-1][1] = x
            else:
                want.append([x, x])
    assert sorted(list(g) for g in changefeed.gaps(df, "n").collect()) == want
    void = [(a, a + r.choice([0, 1, 60, 63, 64, 127, 128, 400])) for a in (r.randrange(-50, 3000) for _ in range(40))]
    covered = have | {x for a, b in void for x in range(a, b + 1)}
    mark = next(x for x in range(1, 10_000) if x not in covered) - 1
    assert changefeed.contiguous_watermark(df, "n", declared=spark.createDataFrame(void, "first bigint, last bigint")).first()[0] == mark
    assert changefeed.contiguous_watermark(df, "n", declared=changefeed.gaps(df, "n")).first()[0] == max(numbers)


def test_declared_runs_need_not_fit_the_gaps(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 5, 6, 9, 200_000)], "n bigint")
    void = spark.createDataFrame([(3, 5), (7, 7), (-4, 1), (8, 8), (12, 10), (10, 150_000)], "first bigint, last bigint")
    assert changefeed.contiguous_watermark(df, "n", declared=void).first()[0] == 150_000
    assert changefeed.contiguous_watermark(df, "n", declared=void.limit(0)).first()[0] == 2


def test_order_does_not_depend_on_the_slices(spark):
    df = spark.range(500).selectExpr("id", "id % 3 AS g")
    got = [rows(prefix_sums(df, ["g"], ["id"], bits=b)) for b in (1, 4, 9)]
    assert got[0] == got[1] == got[2]


def test_prefix_sums(spark):
    r = random.Random(5)
    data = [(i, r.choice(["hot", "hot", "hot", "b", None]), r.choice([1, 2, None])) for i in range(300)]
    df = spark.createDataFrame(data, "id bigint, g string, w int")
    got = {x["id"]: (x["g"], x["before"], x["w"]) for x in prefix_sums(df, ["g"], ["id"], F.col("w"), bits=3).collect()}
    assert len(got) == 300
    for g in ("hot", "b", None):
        own = sorted((v[1], v[2] or 0) for v in got.values() if v[0] == g)
        total = 0
        for before, w in sorted(own, key=lambda x: (x[0], x[1] > 0)):
            assert before == total
            total += w
