"""Queries of problems 1, 3 and 4: percentiles, seen keys, newest versions."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import percentiles, seen, topn
from quern.session import materialize, table, workspace


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = percentiles.exceeded(table(spark, sf_dir, "samples"), table(spark, sf_dir, "readings"), table(spark, sf_dir, "objectives"))
    return checked.filter("above").select("objective_id")


def p1_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values themselves of every tag set's median, 90 %, 99 % and 99.9 % over samples."""
    rows = materialize(percentiles.sample_keys(table(spark, sf_dir, "samples")), "keys")
    by = ["g1", "g2"]
    state = materialize(percentiles.key_states(rows, by), "states")
    names = table(spark, sf_dir, "samples").filter("tags is not null").select(percentiles.canonical_tags(F.col("tags")).alias("tag_set")).distinct()
    names = names.select("tag_set", *percentiles.tag_ids(F.col("tag_set")))
    targets = state.select(*by).distinct().withColumn("pct", F.explode(F.array(*[F.lit(p) for p in (50.0, 90.0, 99.0, 99.9)])))
    values = percentiles.exact(rows, percentiles.select(state, targets, by), by)
    return values.join(names, by).select("tag_set", "pct", "value")


def p1_daily_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians over all days from states made day by day: the percentile's bounds and the values counted."""
    good = table(spark, sf_dir, "samples").filter("tags is not null and val >= 0 and not isnan(val) and val < double('infinity')")
    one = F.struct(percentiles.canonical_tags(F.col("tags")).alias("tag_set"), F.col("val").alias("value"), F.to_date("ts").alias("day"))
    once = good.groupBy("sample_id").agg(F.min(one).alias("__one")).select("__one.*")
    daily = percentiles.states(once, ["tag_set", "day"])
    whole = materialize(percentiles.combine(daily, ["tag_set"]), "states")
    found = percentiles.select(whole, whole.select("tag_set", F.lit(50.0).alias("pct")).distinct(), ["tag_set"])
    bounds = (percentiles.key_value(F.col(c)).alias(c) for c in ("least", "greatest"))
    return found.select("tag_set", F.col("total").alias("n"), F.col("n").alias("in_cell"), *bounds)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = seen.seen_before(table(spark, sf_dir, "key_arrivals"), "last_key", warm=table(spark, sf_dir, "warm_keys"))
    return answers.filter("seen").select("arrival_id")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen.report(table(spark, sf_dir, "key_arrivals"), "last_key", "arrival_id", table(spark, sf_dir, "warm_keys"), "last_key")


def p3_short_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a hash of 24 bits, where wrong answers can be counted."""
    return seen.report(table(spark, sf_dir, "key_arrivals"), "last_key", "arrival_id", table(spark, sf_dir, "warm_keys"), "last_key", bits=24)


def _newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = table(spark, sf_dir, "keyspaces").groupBy("keyspace").agg(F.max("versions_number").alias("versions_number"))
    versions = table(spark, sf_dir, "kv_versions").select("version_id", "keyspace", "kv_key", "ts").filter("ts is not null")
    most = limits.agg(F.max("versions_number")).first()[0] or 0
    return topn.top_n(versions.join(limits, "keyspace"), ["keyspace", "kv_key"], "ts", ["version_id"], "versions_number", most)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _newest(spark, sf_dir).select("version_id")


def p4_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _newest(spark, sf_dir).select("keyspace", F.hex("kv_key").alias("key_hex"), "version_id", "ts", "place")


def p3_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same arrivals in four batches by their number, against sets that are kept in files between them."""
    arrivals = table(spark, sf_dir, "key_arrivals")
    low, high = arrivals.agg(F.min("arrival_id"), F.max("arrival_id")).first()
    kept = seen.SeenTable(spark, workspace(spark, "seen"))
    kept.answer(table(spark, sf_dir, "warm_keys").select(F.lit(0).cast("bigint").alias("arrival_id"), "last_key"), "last_key")
    if low is None:
        return spark.createDataFrame([], "arrival_id bigint")
    quarter = F.floor((F.col("arrival_id") - low) * 4 / (high - low + 1))
    told = [kept.answer(arrivals.filter(quarter == i), "last_key") for i in range(4)]
    return functools.reduce(DataFrame.unionByName, told).filter("seen").select("arrival_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_exact, p1_daily_states, p3_found, p3_report, p3_short_hash, p3_batches, p4_found, p4_places)}

_TAGS = "array_to_string(list_sort(list_filter(string_split(tags, ':'), lambda t: t <> '')), ':')"
_SAMPLES = f"SELECT sample_id, min({_TAGS}) AS tag_set, min(val) AS v FROM samples WHERE tags IS NOT NULL AND val IS NOT NULL AND NOT isnan(val) AND NOT isinf(val) AND val >= 0 GROUP BY sample_id"
_VALUES = f"""
vals AS (
  SELECT 'samples' AS origin, tag_set, v, 1 AS n FROM ({_SAMPLES})
  UNION ALL
  SELECT 'readings', tag_set, ((b % per) + CAST(per / 9 AS BIGINT)) * pow(10.0, b // per - sf + 1), n
  FROM (SELECT tag_set, sf, CAST(9 * pow(10, sf - 1) AS BIGINT) AS per, unnest(range(len(c))) AS b, unnest(c) AS n
        FROM (SELECT reading_id, min({_TAGS}) AS tag_set, min(sig_figs) AS sf, any_value(bucket_counts) AS c FROM readings
              WHERE kind = 'histogram' AND sig_figs BETWEEN 1 AND 4 AND tags IS NOT NULL AND bucket_counts IS NOT NULL GROUP BY reading_id))
  WHERE n > 0),
cum AS (
  SELECT origin, tag_set, v, sum(sum(n)) OVER (PARTITION BY origin, tag_set ORDER BY v) AS c, sum(sum(n)) OVER (PARTITION BY origin, tag_set) AS total
  FROM vals GROUP BY origin, tag_set, v)
"""
_HELD = "held AS (SELECT k, max(w) AS warm, count(*) FILTER (WHERE w = 0) AS n FROM (SELECT last_key AS k, 0 AS w FROM key_arrivals WHERE last_key IS NOT NULL UNION ALL SELECT last_key, 1 FROM warm_keys WHERE last_key IS NOT NULL) GROUP BY k)"
_RANKED = """
SELECT keyspace, kv_key, version_id, ts, versions_number, row_number() OVER (PARTITION BY keyspace, kv_key ORDER BY ts DESC, version_id) AS place
FROM (SELECT DISTINCT version_id, keyspace, kv_key, ts FROM kv_versions WHERE ts IS NOT NULL AND kv_key IS NOT NULL) JOIN keyspaces USING (keyspace)
"""

SQL = {
    "p1_found": f"""WITH {_VALUES}
        SELECT objective_id FROM (SELECT *, {_TAGS} AS tag_set FROM objectives) o JOIN cum USING (origin, tag_set)
        WHERE CAST(c AS DECIMAL(20,0)) * 100 >= CAST(pct AS DECIMAL(12,6)) * CAST(total AS DECIMAL(20,0)) GROUP BY objective_id, max_val HAVING min(v) > max_val""",
    "p1_exact": f"""WITH s AS ({_SAMPLES}), r AS (SELECT tag_set, v, row_number() OVER (PARTITION BY tag_set ORDER BY v) AS k, count(*) OVER (PARTITION BY tag_set) AS total FROM s)
        SELECT tag_set, CAST(pct AS DOUBLE) AS pct, min(v) AS "value" FROM r, (VALUES (50.0), (90.0), (99.0), (99.9)) p(pct)
        WHERE k * 100 >= pct * total GROUP BY tag_set, pct""",
    # A cell is a value's exponent and the leading eight bits of its fraction.
    "p1_daily_states": f"""WITH s AS ({_SAMPLES}), e AS (SELECT tag_set, v, CAST(floor(log2(nullif(v, 0))) AS INTEGER) AS g FROM s),
        x AS (SELECT tag_set, v, CASE WHEN v = 0 THEN NULL WHEN pow(2.0, g) > v THEN g - 1 WHEN pow(2.0, g + 1) <= v THEN g + 1 ELSE g END AS ex FROM e),
        c AS (SELECT *, coalesce(ex, -5000) AS e0, coalesce(CAST(floor(v / pow(2.0, ex) * 256) AS BIGINT), 0) AS f0, row_number() OVER (PARTITION BY tag_set ORDER BY v) AS k, count(*) OVER (PARTITION BY tag_set) AS total FROM x),
        m AS (SELECT tag_set, max(total) AS n, min(k) AS k FROM c WHERE k * 100 >= 50 * total GROUP BY tag_set)
        SELECT m.tag_set, m.n, count(*) AS in_cell, min(a.v) AS least, max(a.v) AS greatest FROM m JOIN c b USING (tag_set, k) JOIN c a ON a.tag_set = b.tag_set AND a.e0 = b.e0 AND a.f0 = b.f0 GROUP BY 1, 2""",
    "p3_found": """SELECT arrival_id FROM (SELECT arrival_id, last_key, min(arrival_id) OVER (PARTITION BY last_key) AS first FROM key_arrivals WHERE last_key IS NOT NULL)
        WHERE arrival_id > first OR last_key IN (SELECT last_key FROM warm_keys WHERE last_key IS NOT NULL)""",
    "p3_report": f"""WITH {_HELD}, t AS (SELECT sum(n) AS answered, sum(CASE WHEN warm = 1 THEN n ELSE n - 1 END) AS seen, count(*) AS d FROM held)
        SELECT CAST(answered AS BIGINT) AS answered, CAST(seen AS BIGINT) AS seen, CAST(seen AS BIGINT) AS exact_seen, CAST(0 AS BIGINT) AS wrong, CAST(0 AS DOUBLE) AS wrong_rate, d / pow(2.0, 64) AS expected_rate FROM t""",
    "p3_batches": """SELECT arrival_id FROM (SELECT arrival_id, last_key, min(arrival_id) OVER (PARTITION BY last_key) AS first FROM key_arrivals WHERE last_key IS NOT NULL)
        WHERE arrival_id > first OR last_key IN (SELECT last_key FROM warm_keys WHERE last_key IS NOT NULL)""",
    "p4_found": f"SELECT version_id FROM ({_RANKED}) WHERE place <= versions_number",
    "p4_places": f"SELECT keyspace, hex(kv_key) AS key_hex, version_id, ts, place FROM ({_RANKED}) WHERE place <= versions_number",
}
