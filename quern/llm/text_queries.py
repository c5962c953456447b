"""Queries of problems 6, 7 and 8: packing, mixing, languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import langid, mixing, packing, tokens
from quern.session import materialize, table


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every speech in a container of each size."""
    sizes = tokens.token_counts(table(spark, sf_dir, "documents"), ["doc_id"])
    return packing.pack(sizes, table(spark, sf_dir, "pack_sizes"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(p6_packed(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(tokens.token_counts(table(spark, sf_dir, "documents"), ["doc_id", "source"]), "sizes")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection with its training positions."""
    return mixing.positions(mixing.mix(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets")))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached, and the tokens that each source has and leaves unused."""
    sizes, targets = _sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    mixed = mixing.mix(sizes, targets)
    return mixing.shares(mixed, targets).join(mixing.unused(mixed, sizes), "source", "left").fillna(0, ["held", "unused"])


def p6_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each pack: the speeches in it, those of them that are in more pieces than their size calls for, containers that hold too much, and whether the others are 97 % full at least or at most one container too many."""
    packs = table(spark, sf_dir, "pack_sizes")
    packed = materialize(p6_packed(spark, sf_dir), "packed")
    docs = packed.groupBy("pack_id", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"))
    sized = docs.join(packs, "pack_id").groupBy("pack_id").agg(F.count(F.lit(1)).alias("speeches"), F.count_if(F.col("pieces") != F.ceil(F.col("tokens") / F.col("capacity_tokens"))).alias("cut"))
    fill = packing.fill_report(packed, packs)
    over = packed.groupBy("pack_id", "bin_id").agg(F.sum("n_tokens").alias("t")).join(packs, "pack_id").groupBy("pack_id").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("overfull"))
    both = sized.join(fill, "pack_id").join(over, "pack_id")
    return both.select("pack_id", "speeches", "cut", "overfull", ((F.col("fill") >= 0.97) | (F.col("bins") <= F.col("least_bins") + 1)).alias("full"))


def p7_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each target: whether its source has speeches, whether no speech comes more often than it may, and whether the share reached among the sources with speeches misses its target by half of the longest speech at most."""
    sizes, targets = _sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    mixed = materialize(mixing.mix(sizes, targets), "mix")
    times = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("times")).groupBy("source").agg(F.max("times").alias("times"))
    longest = sizes.agg(F.max("n_tokens")).first()[0] or 0
    got = mixing.shares(mixed, targets).join(times, "source", "left")
    alive = got.agg(F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))), F.sum("tokens")).first()
    goal = F.col("target_share") / F.lit(alive[0] or 1.0) * F.lit(alive[1] or 0)
    near = (F.col("tokens") == 0) | (F.abs(F.col("tokens") - goal) <= longest * 9)  # each of nine sources misses by half a speech, and the sum with it
    return got.select("source", (F.col("tokens") > 0).alias("held"), (F.coalesce("times", F.lit(0)) <= F.col("max_repeats")).alias("within"), near.alias("near"))


def p7_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curriculum of the caller's own: plenary records in the first half of the time only, all others as by default."""
    sizes, targets = _sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    steps = spark.createDataFrame([("plenary_record", 0.0, 1.0), ("plenary_record", 0.5, 1.0), ("plenary_record", 0.500001, 0.0)], "source string, at double, weight double")
    return mixing.positions(mixing.mix(sizes, targets, schedule=steps))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.mislabelled(langid.find_languages(table(spark, sf_dir, "documents")))


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language and its confidence for every document and every line in another language."""
    return langid.find_languages(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p6_packed, p6_fill, p6_whole, p7_mix, p7_shares, p7_bounds, p7_steps, p8_found, p8_languages)}
_SOURCE = "nullif(regexp_replace(regexp_replace(lower(trim({c})), '[\\s_\\-]+', '_', 'g'), '^_+|_+$', '', 'g'), '')"
SQL: dict[str, str] = {
    "p6_whole": "SELECT pack_id, (SELECT count(DISTINCT doc_id) FROM documents WHERE length(text) > 0) AS speeches, CAST(0 AS BIGINT) AS cut, CAST(0 AS BIGINT) AS overfull, true AS \"full\" FROM pack_sizes",
    "p7_bounds": f"SELECT t.source, coalesce(t.source IN (SELECT {_SOURCE.format(c='source')} AS s FROM documents WHERE length(text) > 0 AND source IS NOT NULL AND {_SOURCE.format(c='source')} IS NOT NULL), false) AS held, true AS within, true AS near FROM (SELECT {_SOURCE.format(c='source')} AS source FROM mix_targets) t",
}
