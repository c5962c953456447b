"""Queries of statistics, monitors, sketches and joins."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import histogram
from quern.operators import monitors, records, sketches, statistics
from quern.session import table

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, keep: list[str], values: list[str], places: int = 6) -> DataFrame:
    return df.select(*keep, *[(F.round(c, places) + 0.0).alias(c) for c in values])


_M = """WITH m AS (SELECT event_type, value AS v, avg(value) OVER (PARTITION BY event_type) AS mu FROM events),
s AS (SELECT event_type, count(*) AS n, max(mu) AS m1, sum((v - mu) ** 2) AS m2, sum((v - mu) ** 3) AS m3, sum((v - mu) ** 4) AS m4 FROM m GROUP BY event_type)
"""
_DESCRIBED = "round(m1, 4) AS \"mean\", round(m2 / (n - 1), 4) AS variance, round(sqrt(n) * m3 / m2 ** 1.5, 4) AS skewness, round(n * m4 / (m2 * m2), 4) AS kurtosis"


@_query(_M + f"SELECT event_type, n, {_DESCRIBED} FROM s")
def stat_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = statistics.describe(statistics.moments(table(spark, sf_dir, "events"), ["event_type"], "value"))
    return _rounded(m, ["event_type", "n"], ["mean", "variance", "skewness", "kurtosis"], 4)


@_query(_M + f"SELECT event_type, n, {_DESCRIBED} FROM s")
def stat_moments_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments by user, merged into moments by type."""
    parts = statistics.moments(table(spark, sf_dir, "events"), ["event_type", "user_id"], "value")
    return _rounded(statistics.describe(statistics.merge_moments(parts, ["event_type"])), ["event_type", "n"], ["mean", "variance", "skewness", "kurtosis"], 4)


@_query(_M.replace("FROM events)", "FROM events WHERE event_id >= 3000)") + f"SELECT event_type, n, {_DESCRIBED} FROM s")
def stat_moments_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moments of the later events, as the whole less the earlier ones."""
    events = table(spark, sf_dir, "events")
    packed = [statistics.moments(e, ["event_type"], "value").select("event_type", F.struct(*statistics.MOMENTS).alias(n)) for e, n in ((events, "later"), (events.filter("event_id < 3000"), "earlier"))]
    left = packed[0].join(packed[1], "event_type").select("event_type", statistics.subtract(F.col("later"), F.col("earlier")).alias("m")).select("event_type", "m.*").filter("n > 0")  # types without later events have none
    return _rounded(statistics.describe(left), ["event_type", "n"], ["mean", "variance", "skewness", "kurtosis"], 4)


@_query("WITH m AS (SELECT value AS v, avg(value) OVER () AS mu FROM events WHERE event_type IN ('click', 'view')), s AS (SELECT count(*) AS n, max(mu) AS m1, sum((v - mu) ** 2) AS m2, sum((v - mu) ** 3) AS m3, sum((v - mu) ** 4) AS m4 FROM m) SELECT n, " + _DESCRIBED + " FROM s")
def stat_moments_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups' moments combined row by row."""
    m = statistics.moments(table(spark, sf_dir, "events"), ["event_type"], "value").withColumn("s", F.struct(*statistics.MOMENTS))
    a, b = (m.filter(F.col("event_type") == t).select(F.col("s").alias(n), F.lit(1).alias("j")) for t, n in (("click", "a"), ("view", "b")))
    both = a.join(b, "j").select(statistics.merge_pair(F.col("a"), F.col("b")).alias("m")).select("m.*")
    return _rounded(statistics.describe(both), ["n"], ["mean", "variance", "skewness", "kurtosis"], 4)


def _student(z: float, v: str) -> str:
    """Student's critical value by the series about the normal one."""
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    return " + ".join([repr(z), *(f"CAST({t!r} AS DOUBLE) / pow({v}, {i})" for i, t in enumerate(terms, 1))])


def _bucket_sql(v: str, sf: int) -> str:
    tens, per = 10 ** (sf - 1), 9 * 10 ** (sf - 1)
    decade = f"CAST(floor(log10({v})) AS INTEGER)"
    fixed = f"(CASE WHEN pow(10.0, {decade}) > {v} THEN {decade} - 1 WHEN pow(10.0, {decade} + 1) <= {v} THEN {decade} + 1 ELSE {decade} END)"
    return f"CAST(CASE WHEN {v} < 1 THEN 0 ELSE floor({v} * {tens} / pow(10.0, {fixed}) + {per} * {fixed} - {tens} + 0.5) END AS INTEGER)"


def _boundary_sql(b: str, sf: int) -> str:
    tens, per = 10 ** (sf - 1), 9 * 10 ** (sf - 1)
    return f"(({b} % {per} + {tens}) * pow(10.0, {b} // {per} - {sf - 1}))"


_H = f"h AS (SELECT event_type, {_bucket_sql('value', 2)} AS bucket, count(*) AS n FROM events WHERE value >= 0 GROUP BY 1, 2)"


def _hist(spark: SparkSession, sf_dir: str, figs: int = 2) -> DataFrame:
    return statistics.observe(table(spark, sf_dir, "events"), ["event_type"], "value", figs)


@_query(f"WITH {_H} SELECT event_type, bucket, n, round({_boundary_sql('bucket', 2)}, 6) AS boundary FROM h")
def stat_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_hist(spark, sf_dir).withColumn("boundary", histogram.boundary_for(F.col("bucket"), 2)), ["event_type", "bucket", "n"], ["boundary"])


@_query(f"WITH {_H} SELECT event_type, bucket, n FROM h")
def stat_histogram_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    parts = [statistics.observe(events.filter(f"event_id % 3 = {i}"), ["event_type"], "value", 2) for i in range(3)]
    return statistics.merge_histograms(*parts)


@_query(f"WITH {_H.replace(', 2)', ', 2)')} SELECT event_type, {_bucket_sql(_boundary_sql('bucket', 2), 1)} AS bucket, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1, 2")
def stat_histogram_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.downsample(_hist(spark, sf_dir), ["event_type"], 2, 1)


@_query(f"SELECT event_type, count(*) FILTER (WHERE value < 0) AS negative, count(*) FILTER (WHERE value >= 0 AND {_bucket_sql('value', 2)} >= 180) AS beyond FROM events GROUP BY 1")
def stat_histogram_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.rejected(table(spark, sf_dir, "events"), ["event_type"], "value", 2, 180)


@_query(f"WITH {_H} SELECT event_type, bucket, CAST(sum(n) OVER w AS BIGINT) AS running, CAST(sum(n) OVER (PARTITION BY event_type) AS BIGINT) AS total, round(sum(n) OVER w / sum(n) OVER (PARTITION BY event_type), 6) AS share FROM h WINDOW w AS (PARTITION BY event_type ORDER BY bucket)")
def stat_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(statistics.cumulative(_hist(spark, sf_dir), ["event_type"], 2), ["event_type", "bucket", "running", "total"], ["share"])


_S = f"{_H}, b AS (SELECT event_type, {_boundary_sql('bucket', 2)} AS v, n FROM h), mu AS (SELECT event_type, sum(v * n) / sum(n) AS mu FROM b GROUP BY 1), s AS (SELECT event_type, CAST(sum(n) AS BIGINT) AS n, max(mu) AS m1, sum(n * (v - mu) ** 2) AS m2, sum(n * (v - mu) ** 3) AS m3, sum(n * (v - mu) ** 4) AS m4 FROM b JOIN mu USING (event_type) GROUP BY 1)"


@_query(f"WITH {_S} SELECT event_type, n, {_DESCRIBED} FROM s")
def stat_summarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = statistics.describe(statistics.summarize(_hist(spark, sf_dir), ["event_type"], 2))
    return _rounded(m, ["event_type", "n"], ["mean", "variance", "skewness", "kurtosis"], 4)


@_query(f"WITH h AS (SELECT event_type, user_id % 7 AS size, {_bucket_sql('value', 2)} AS bucket, count(*) AS n FROM events GROUP BY 1, 2, 3) SELECT event_type, size, round(sum({_boundary_sql('bucket', 2)} * n) / sum(n), 6) AS \"mean\" FROM h GROUP BY 1, 2")
def stat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each type: the mean against a parameter."""
    runs = table(spark, sf_dir, "events").withColumn("size", F.col("user_id") % 7)
    hist = statistics.observe(runs, ["event_type", "size"], "value", 2)
    return _rounded(statistics.lines(hist, ["event_type"], "size", 2), ["event_type", "size"], ["mean"])


@_query(_M + """, b AS (SELECT n AS n0, m1 AS a0, m2 AS q0 FROM s WHERE event_type = 'click')
SELECT event_type, n, round(m1, 6) AS "mean", round(m1 - a0, 6) AS difference, round(z * sqrt((m2 + q0) / (n + n0 - 2) * (1.0 / n + 1.0 / n0)), 4) AS margin, round((m1 - a0) * 100 / abs(a0), 4) + 0.0 AS percent, round(z * sqrt((m2 + q0) / (n + n0 - 2) * (1.0 / n + 1.0 / n0)) * 100 / abs(a0), 4) AS percent_margin, abs(m1 - a0) > z * sqrt((m2 + q0) / (n + n0 - 2) * (1.0 / n + 1.0 / n0)) AS significant
FROM (SELECT *, CASE WHEN n + n0 - 2 >= 1000 THEN CAST(1.96 AS DOUBLE) ELSE """ + _student(1.96, "(n + n0 - 2)") + """ END AS z FROM s, b)""")
def stat_t_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    tested = statistics.t_test(statistics.moments(table(spark, sf_dir, "events"), ["event_type"], "value"), "event_type", "click")
    return tested.select("event_type", "n", F.round("mean", 6).alias("mean"), (F.round("difference", 6) + 0.0).alias("difference"), F.round("margin", 4).alias("margin"), (F.round("percent", 4) + 0.0).alias("percent"), F.round("percent_margin", 4).alias("percent_margin"), "significant")


@_query("SELECT * FROM (VALUES (1, 12.706), (2, 4.303), (3, 3.182), (4, 2.776), (5, 2.571), (6, 2.447), (8, 2.306), (10, 2.228), (20, 2.086), (30, 2.042), (60, 2.0), (120, 1.98), (5000, 1.96)) t(degrees, t95)")
def stat_t_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Critical values at 95 %, as tables of the distribution print them."""
    degrees = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 6, 8, 10, 20, 30, 60, 120, 5000)], "degrees int")
    return degrees.select("degrees", (F.round(statistics.critical_t(F.col("degrees"), 95.0), 3) + 0.0).alias("t95"))


@_query(f"WITH {_H}, c AS (SELECT event_type, {_boundary_sql('bucket', 2)} AS v, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) / sum(n) OVER (PARTITION BY event_type) AS s FROM h) SELECT event_type, round(v, 6) AS \"value\", round(s, 6) AS share FROM c UNION ALL SELECT DISTINCT event_type, 0.0, 0.0 FROM h")
def stat_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of each type's distribution function, from (0, 0)."""
    return _rounded(statistics.distribution(_hist(spark, sf_dir), ["event_type"], 2), ["event_type"], ["value", "share"])


@_query("SELECT event_id, CAST(user_id AS VARCHAR) AS user, event_type AS kind FROM events")
def stat_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three parameters, in the order asked for."""
    made = F.create_map(F.lit("kind"), "event_type", F.lit("user"), F.col("user_id").cast("string"), F.lit("size"), F.lit("1"))
    return statistics.project(table(spark, sf_dir, "events").withColumn("parameters", made), ["user", "kind"], ["event_id"])


@_query("SELECT a AS size, b AS mode, c AS threads FROM (VALUES (1), (2), (4)) x(a), (VALUES ('r'), ('w')) y(b), (VALUES (1), (8)) z(c)")
def stat_parameter_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.sweep(spark, {"size": [1, 2, 4], "mode": ["r", "w"], "threads": [1, 8]})


@_query("SELECT l_returnflag, round(sum(l_quantity), 2) AS quantity, max(l_discount) AS discount, count(*) AS n FROM lineitem GROUP BY 1")
def stat_map_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reduction of keyed rows onto a part of their key."""
    folds = {"quantity": F.round(F.sum("l_quantity"), 2), "discount": F.max("l_discount"), "n": F.count(F.lit(1))}
    return statistics.map_fold(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_returnflag"], folds)


# Monitors: a reading for each event; counters run on by user.


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    along = Window.partitionBy("user_id").orderBy("event_id")
    ok, bad = (F.sum((F.col("event_type") == t).cast("bigint")).over(along) for t in ("purchase", "error"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", "value", ok.alias("ok"), bad.alias("bad"))


_READ = "r AS (SELECT user_id, event_id, value, CAST(sum((event_type = 'purchase')::INT) OVER w AS BIGINT) AS ok, CAST(sum((event_type = 'error')::INT) OVER w AS BIGINT) AS bad FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"
_LAST = "lag({c}, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id)"


@_query(f"WITH {_READ}, d AS (SELECT event_id, ok - {_LAST.format(c='ok')} AS g, bad - {_LAST.format(c='bad')} AS b FROM r) SELECT event_id, round(CASE WHEN g + b > 0 THEN g / (g + b) END, 6) AS rate, g + b <= 0 OR g / (g + b) < 0.5 AS firing FROM d")
def mon_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = monitors.success_rate(_readings(spark, sf_dir), ["user_id"], "event_id", "ok", "bad", 0.5)
    return out.select("event_id", F.round("rate", 6).alias("rate"), "firing")


@_query(f"WITH {_READ} SELECT event_id, ok <> {_LAST.format(c='ok')} AS firing FROM r")
def mon_stationary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitors.stationary(_readings(spark, sf_dir), ["user_id"], "event_id", "ok").select("event_id", "firing")


@_query("SELECT event_id, NOT (value < 100) AS firing FROM events")
def mon_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", monitors.below_threshold(F.col("value"), 100.0).alias("firing"))


@_query("SELECT sample_id, val IS NULL OR isnan(val) OR NOT (val > 100) AS firing FROM samples")
def mon_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "samples").select("sample_id", monitors.above_threshold(F.col("val"), 100.0).alias("firing"))


@_query("""WITH reset AS (SELECT user_id, max(event_id) AS r FROM events WHERE event_type = 'signup' GROUP BY 1), f AS (SELECT e.* FROM events e LEFT JOIN reset USING (user_id) WHERE NOT (value < 100) AND (r IS NULL OR event_id > r))
    SELECT user_id, substr(sha256(user_id || chr(0) || min(event_id)), 1, 32) AS alert_id, min(event_id) AS fired_at, arg_min(value, event_id) AS first_condition, max(event_id) AS latest_at, arg_max(value, event_id) AS latest_condition FROM f GROUP BY 1""")
def mon_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts that fired since the last reset, with their first and latest conditions."""
    events = table(spark, sf_dir, "events")
    resets = events.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("reset_at"))
    return monitors.latch(events.withColumn("firing", monitors.below_threshold(F.col("value"), 100.0)), ["user_id"], "event_id", "value", resets)


@_query(f"WITH {_READ}, d AS (SELECT event_id, ok - bad - lag(ok - bad) OVER (PARTITION BY user_id ORDER BY event_id) AS delta FROM r) SELECT event_id, delta, coalesce(delta < 0, false) AS regressed FROM d")
def mon_counter_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitors.counter_deltas(_readings(spark, sf_dir).withColumn("net", F.col("ok") - F.col("bad")), ["user_id"], "event_id", "net").select("event_id", "delta", "regressed")


# Checksums and sketches.


@_query()
def sum_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksum of every file's records."""
    items = table(spark, sf_dir, "file_records").withColumn("item", F.concat(F.hex("kv_key"), F.lit("@"), F.coalesce("ts", F.lit(0)).cast("string"), F.lit("="), F.coalesce(F.hex("val"), F.lit("~"))))
    return sketches.multiset_sum(items, "item", ["file_id"])


_WORDS = ", ".join(f"(('0x' || h[{8 * i + 7}:{8 * i + 8}] || h[{8 * i + 5}:{8 * i + 6}] || h[{8 * i + 3}:{8 * i + 4}] || h[{8 * i + 1}:{8 * i + 2}])::UBIGINT % {p})::HUGEINT" for i, p in enumerate(sketches.PRIMES))
_LITTLE = " || ".join(f"substr(x{i}, 7, 2) || substr(x{i}, 5, 2) || substr(x{i}, 3, 2) || substr(x{i}, 1, 2)" for i in range(8))
_SUMS = ", ".join(f"lpad(lower(hex((sum(w[{i + 1}]) % {p})::UBIGINT)), 8, '0') AS x{i}" for i, p in enumerate(sketches.PRIMES))


@_query(f"WITH i AS (SELECT file_id, hex(kv_key) || '@' || coalesce(ts, 0) || '=' || coalesce(hex(val), '~') AS item FROM file_records), d AS (SELECT file_id, sha256(item) AS h FROM i WHERE item IS NOT NULL), w AS (SELECT file_id, [{_WORDS}] AS w FROM d), s AS (SELECT file_id, {_SUMS} FROM w GROUP BY 1) SELECT file_id, {_LITTLE} AS checksum FROM s")
def sum_files_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the hash that Spark has itself."""
    items = table(spark, sf_dir, "file_records").withColumn("item", F.concat(F.hex("kv_key"), F.lit("@"), F.coalesce("ts", F.lit(0)).cast("string"), F.lit("="), F.coalesce(F.hex("val"), F.lit("~"))))
    return sketches.multiset_sum(items, "item", ["file_id"], native=True)


@_query("SELECT store, true AS same, true AS differs FROM file_records GROUP BY store")
def sum_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the checksums of two halves of each store add up to that of the whole, and take away again."""
    items = table(spark, sf_dir, "file_records").withColumn("item", F.concat(F.hex("kv_key"), F.col("ts").cast("string")))
    whole = sketches.multiset_sum(items, "item", ["store"])
    halves = [sketches.multiset_sum(items.filter(f"rec_id % 2 = {i}"), "item", ["store"]).withColumnRenamed("checksum", f"s{i}") for i in (0, 1)]
    both = whole.join(halves[0], "store", "left").join(halves[1], "store", "left").fillna(sketches.EMPTY, ["s0", "s1"])
    same = (sketches.add_sums(F.col("s0"), F.col("s1")) == F.col("checksum")) & (sketches.add_sums(F.col("checksum"), F.col("s1"), -1) == F.col("s0"))
    return both.select("store", same.alias("same"), (F.col("checksum") != F.lit(sketches.EMPTY)).alias("differs"))


@_query("SELECT (SELECT CAST(coalesce(sum(n - m), 0) AS BIGINT) FROM d WHERE n > m) AS missing, (SELECT CAST(coalesce(sum(m - n), 0) AS BIGINT) FROM d WHERE m > n) AS extra FROM (SELECT 1)".replace("FROM d", "FROM (SELECT store, kv_key, count(*) FILTER (WHERE rec_id % 3 < 2) AS n, count(*) FILTER (WHERE rec_id % 3 > 0) AS m FROM file_records GROUP BY 1, 2)"))
def sum_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multiset difference of two overlapping parts, both ways."""
    rows = table(spark, sf_dir, "file_records")
    return sketches.equal_multisets(*[rows.filter(c).select("store", "kv_key") for c in ("rec_id % 3 < 2", "rec_id % 3 > 0")])


@_query("SELECT p_partkey, round(bpk * ln(2), 6) AS k, round(-n * ln(p) / ln(2) ** 2, 4) + 0.0 AS m, round(CASE WHEN n > 0 THEN exp(-(ln(2) ** 2) * m / n) ELSE 0 END, 6) + 0.0 AS rate FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS bpk, CAST(p_partkey AS DOUBLE) AS n, 0.01::DOUBLE AS p, p_partkey * 10.0::DOUBLE AS m FROM part)")
def sketch_bloom_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(sketches.bloom_keys(F.col("p_size").cast("double")), 6).alias("k"), (F.round(sketches.bloom_bits(n, F.lit(0.01)), 4) + 0.0).alias("m"), F.round(sketches.bloom_rate(n, n * 10), 6).alias("rate"))


@_query("SELECT CAST(0 AS BIGINT) AS missed, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS held, (SELECT count(*) FROM lineitem) AS others, true AS rare")
def sketch_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split-block filter of 16 bits a key misses none of its keys, and takes less than 1 in 200 of as many other rows for one of them (0.1 % are to be expected)."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey")
    blocks = max(1, items.distinct().count() * 16 // 256)
    filter_ = sketches.bloom_build(items, "l_orderkey", blocks)
    own = sketches.bloom_probe(items.distinct(), "l_orderkey", filter_, blocks).agg(F.count_if(~F.col("maybe")).alias("missed"), F.count(F.lit(1)).alias("held"), F.lit(0).cast("bigint").alias("others"), F.lit(0).cast("bigint").alias("wrong"))
    strange = table(spark, sf_dir, "lineitem").select((-(F.col("l_orderkey") * 10 + F.col("l_linenumber")) - 1).alias("l_orderkey"))
    rest = sketches.bloom_probe(strange, "l_orderkey", filter_, blocks).agg(F.lit(0).cast("bigint").alias("missed"), F.lit(0).cast("bigint").alias("held"), F.count(F.lit(1)).alias("others"), F.count_if("maybe").alias("wrong"))
    whole = own.unionByName(rest).agg(*[F.sum(c).alias(c) for c in ("missed", "held", "others", "wrong")])
    return whole.select("missed", "held", "others", (F.col("wrong") * 200 < F.col("others")).alias("rare"))


@_query("SELECT CAST(0 AS BIGINT) AS missed, (SELECT count(DISTINCT file_id) FROM file_records WHERE kv_key = (SELECT min(kv_key) FROM file_records WHERE kv_key IS NOT NULL AND file_id IS NOT NULL) AND file_id IS NOT NULL) AS held, true AS few")
def sketch_skip_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that may hold the smallest key, by a filter a file: none that does is missed, and of the others less than 1 in 20 is opened for nothing."""
    records = table(spark, sf_dir, "file_records").filter("file_id is not null")
    wanted = records.agg(F.min("kv_key")).first()[0]
    filters = sketches.skipping(records, records, "file_id", "kv_key", 64)
    maybe = sketches.candidate_files(filters, "file_id", wanted, 64).withColumn("maybe", F.lit(True))
    real = records.groupBy("file_id").agg(F.max(F.col("kv_key").eqNullSafe(F.lit(wanted))).alias("real"))
    both = real.join(maybe, "file_id", "left").select("real", F.coalesce("maybe", F.lit(False)).alias("maybe"))
    return both.agg(F.count_if(F.col("real") & ~F.col("maybe")).alias("missed"), F.count_if(F.col("real") & F.col("maybe")).alias("held"), (F.count_if(F.col("maybe") & ~F.col("real")) * 20 <= F.count(F.lit(1))).alias("few"))


@_query("SELECT true AS never_less, true AS close, true AS closer, count(DISTINCT l_orderkey) AS \"keys\" FROM lineitem")
def sketch_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of a count-min sketch are never below the counts and above them by e rows / width for 1 key in 50 at most; those of a conservative one lie between."""
    items, width = table(spark, sf_dir, "lineitem"), 1 << 14
    plain = sketches.estimate(items, "l_orderkey", sketches.frequencies(items, "l_orderkey", width=width), width=width)
    less = sketches.estimate(items, "l_orderkey", sketches.conservative(items, "l_orderkey", width=width), width=width).withColumnRenamed("estimate", "less")
    both = items.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).join(plain, "l_orderkey").join(less, "l_orderkey")
    each = both.select(F.col("less") >= F.col("n"), F.col("less") <= F.col("estimate"), "n", "estimate").toDF("never_less", "closer", "n", "estimate")
    bound = items.count() * math.e / width
    return each.agg(F.min("never_less").alias("never_less"), (F.count_if(F.col("estimate") - F.col("n") > bound) * 50 <= F.count(F.lit(1))).alias("close"), F.min("closer").alias("closer"), F.count(F.lit(1)).alias("keys"))


@_query("SELECT 3808858755 AS crc, count(*) AS n FROM events")
def sum_crc32c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Castagnoli checksum of the digits 1 to 9, whose value is published, for every event beside other texts."""
    text = F.when(F.col("event_id") % 2 == 0, "123456789").otherwise(F.concat(F.lit("123456789"), F.repeat(F.lit("x"), (F.col("event_id") % 40).cast("int"))))
    own = table(spark, sf_dir, "events").select("event_id", sketches.crc32c(text).alias("crc"))
    return own.agg(F.min(F.when(F.col("event_id") % 2 == 0, F.col("crc"))).alias("crc"), F.count("crc").alias("n"))


@_query("WITH d AS (SELECT user_id, sum(pow(0.5, ((SELECT max(event_id) FROM events) - event_id) // 2000)) AS c FROM events GROUP BY 1) SELECT count(*) AS pairs, count(*) FILTER (WHERE b.c > a.c) AS replaced FROM d a JOIN d b ON b.user_id = a.user_id + 1")
def sketch_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission by frequencies that halve with every 2,000 events: each key against the one before it."""
    events = table(spark, sf_dir, "events")
    guess = sketches.estimate(events, "user_id", sketches.frequencies(events, "user_id", "event_id", 2000, width=1 << 20), width=1 << 20)
    nxt = guess.select((F.col("user_id") - 1).alias("user_id"), F.col("estimate").alias("candidate"))
    return guess.join(nxt, "user_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(sketches.should_replace(F.col("estimate"), F.col("candidate"))).alias("replaced"))


@_query("SELECT CAST(200000 AS BIGINT) AS n, 200000 AS uuids, true AS in_range, 0.5 AS uniform, 0.0 AS normal, 1.0 AS spread, 1.0 AS exponential, 3.0 AS poisson, 0.5 AS coin, 'abcde' AS picks, true AS shuffled, true AS again")
def gen_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of 200,000 generated rows, to one place, that their values lie in range, that a shuffle is a permutation, and that the same seed makes the same rows."""
    made, again = sketches.generate(spark, 200_000, 7), sketches.generate(spark, 200_000, 7)
    sums = [d.agg(F.sum(F.xxhash64("uniform", "normal", "exponential", "poisson", "coin", "pick", "text", "place").cast("decimal(20,0)"))).first()[0] for d in (made, again)]
    mean = lambda c: (F.round(F.avg(c), 1) + 0.0)
    out = made.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("uuid").cast("int").alias("uuids"), F.min((F.col("uniform") >= 0) & (F.col("uniform") < 1) & (F.col("exponential") >= 0) & F.col("text").rlike("^[a-z]{8}$")).alias("in_range"),
                   mean("uniform").alias("uniform"), mean("normal").alias("normal"), (F.round(F.stddev("normal"), 1) + 0.0).alias("spread"), mean("exponential").alias("exponential"), mean("poisson").alias("poisson"), mean(F.col("coin").cast("double")).alias("coin"), F.array_join(F.array_sort(F.collect_set("pick")), "").alias("picks"),
                   ((F.count_distinct("place") == F.count(F.lit(1))) & (F.min("place") == 0) & (F.max("place") == F.count(F.lit(1)) - 1)).alias("shuffled"))
    return out.withColumn("again", F.lit(sums[0] == sums[1]))


# Joins.


@_query("SELECT c.c_custkey, n.n_name, r.r_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey")
def join_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup joins; Spark broadcasts a side by its size."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("c_custkey", "n_name", "r_name")


@_query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def join_semi_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose orders meet every condition, in one pass over the orders."""
    met = records.meeting_all(table(spark, sf_dir, "orders"), "o_custkey", [F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT"])
    return table(spark, sf_dir, "customer").join(met.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left_semi").select("c_custkey")


@_query("SELECT id FROM (SELECT user_id AS id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'error') UNION SELECT user_id FROM events WHERE event_type = 'signup'")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection and union of record ids."""
    ids = {t: table(spark, sf_dir, "events").filter(F.col("event_type") == t).select(F.col("user_id").alias("id")) for t in ("click", "error", "signup")}
    return records.union_ids(records.intersect_ids(ids["click"], ids["error"]), ids["signup"])


