"""Percentiles of very large numeric columns by radix selection over combinable states.

A double is mapped to an integer of the same order (its bits, negated below zero). A state counts, for
each group, the values that share the leading digits of that integer: the sign and exponent as the first
digit, the leading bits of the mantissa as the second. States are made by map-side combining, and states
of days or partitions are combined by adding them. A percentile follows, digit by digit, only the digit
that holds its rank. With M mantissa bits the answer is within 2^-M of the true value, relatively; each
cell also keeps its least and greatest value, which narrows that further. `exact` reads the rows of the
chosen cells once more, with the next digits, until the value itself is reached.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.histogram import boundary
from quern.functions.ordering import MANTISSA, key_value, order_key
from quern.functions.tags import pairs
from quern.session import materialize

#: Bits of the mantissa in a state: relative error below 2^-8, 0.4 %.
STATE_BITS = 8
#: Bits followed by each further pass of the exact selection: 8 + 4 x 11 reaches all 52.
PASS_BITS = 11


def states(values: DataFrame, by: Sequence[str], value: str = "value", weight: str | None = None, bits: int = STATE_BITS) -> DataFrame:
    """(by..., cell, n, least, greatest): the combinable state of each group; `least` and `greatest` are order keys.

    Null and NaN values and weights that are null or below 1 don't count; an empty input has an empty state.
    A group column `day` or the like among `by` keeps states of days apart until `combine`.
    """
    n = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    rows = values.select(*by, order_key(F.col(value).cast("double")).alias("__key"), n.alias("__n")).filter("__key is not null and __n > 0")
    return key_states(rows, by, bits)


def key_states(rows: DataFrame, by: Sequence[str], bits: int = STATE_BITS) -> DataFrame:
    cell = F.shiftright("__key", MANTISSA - bits).alias("cell")
    return rows.groupBy(*by, cell).agg(F.sum("__n").alias("n"), F.min("__key").alias("least"), F.max("__key").alias("greatest"))


def combine(state: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds up states that agree in `by`: over days, partitions or sources."""
    return state.groupBy(*by, "cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))


def _follow(cells: DataFrame, wanted: DataFrame, by: Sequence[str], digit: str) -> DataFrame:
    """For (by..., pct, rank) the digit that holds the rank, and the rank within that digit."""
    digits = cells.groupBy(*by, digit).agg(F.sum("n").alias("__in"))
    ahead = F.coalesce(F.sum("__in").over(Window.partitionBy(*by).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    digits = digits.withColumn("__ahead", ahead)
    hit = (F.col("rank") > F.col("__ahead")) & (F.col("rank") <= F.col("__ahead") + F.col("__in"))
    return wanted.join(digits, list(by)).filter(hit).withColumn("rank", F.col("rank") - F.col("__ahead")).drop("__in", "__ahead")


def select(state: DataFrame, targets: DataFrame, by: Sequence[str], pct: str = "pct", bits: int = STATE_BITS) -> DataFrame:
    """(by..., pct, total, rank, cell, n, least, greatest): the cell that holds each wanted percentile.

    `targets` has distinct (by..., pct); groups without values get no row. The percentile is the value of
    the smallest rank k with k >= pct/100 x total, and at least 1, worked out in decimals, so that 99.9 %
    of 1,000 is 999. A group has at most 4,096 first digits and 2^bits second ones, so a window over the
    digits of a group is bounded whatever the group's rows.
    """
    state = state.withColumn("__first", F.shiftright("cell", bits))
    own = Window.partitionBy(*by)
    digits = state.groupBy(*by, "__first").agg(F.sum("n").alias("__in"))
    ahead = F.coalesce(F.sum("__in").over(own.orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    digits = digits.withColumns({"__ahead": ahead, "total": F.sum("__in").over(own)})
    exact = F.ceil(F.col(pct).cast("decimal(12,6)") * F.col("total").cast("decimal(20,0)") / F.lit(100)).cast("bigint")
    wanted = targets.join(digits, list(by)).withColumn("rank", F.greatest(F.lit(1).cast("bigint"), F.least(exact, F.col("total"))))
    wanted = wanted.filter((F.col("rank") > F.col("__ahead")) & (F.col("rank") <= F.col("__ahead") + F.col("__in")))
    wanted = wanted.withColumn("rank", F.col("rank") - F.col("__ahead")).drop("__ahead", "__in")
    along = Window.partitionBy(*by, "__first").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = state.withColumn("__ahead", F.coalesce(F.sum("n").over(along), F.lit(0)))
    both = wanted.join(cells, [*by, "__first"])
    hit = both.filter((F.col("rank") > F.col("__ahead")) & (F.col("rank") <= F.col("__ahead") + F.col("n")))
    return hit.withColumn("rank", F.col("rank") - F.col("__ahead")).select(*by, pct, *[c for c in targets.columns if c not in (*by, pct)], "total", "rank", "cell", "n", "least", "greatest")


def exact(rows: DataFrame, found: DataFrame, by: Sequence[str], pct: str = "pct", bits: int = STATE_BITS) -> DataFrame:
    """(by..., pct, value): carries `select` on to the value itself.

    `rows` (by..., __key, __n) must be the rows behind the state; they should be a written table, as each
    pass reads them again, joined with the cells that are still open: those whose least and greatest value
    differ. Every pass follows 11 more bits of at most 52, so there are at most four.
    """
    done = found.filter("least = greatest").select(*by, pct, F.col("least").alias("key"))
    open_ = found.filter("least <> greatest")
    at = bits
    while at < MANTISSA:
        shift = MANTISSA - at
        step = min(PASS_BITS, shift)
        cells = open_.select(*by, "cell").distinct()
        inside = rows.withColumn("cell", F.shiftright("__key", shift)).join(cells, [*by, "cell"])
        finer = inside.withColumn("__next", F.shiftright("__key", shift - step)).groupBy(*by, "cell", "__next").agg(F.sum("__n").alias("n"), F.min("__key").alias("least"), F.max("__key").alias("greatest"))
        finer = materialize(finer, "digits")
        wanted = open_.select(*by, pct, "cell", "rank")
        hit = _follow(finer, wanted, [*by, "cell"], "__next").join(finer, [*by, "cell", "__next"])
        hit = materialize(hit.select(*by, pct, "rank", F.col("__next").alias("cell"), "n", "least", "greatest"), "digits")
        done = done.unionByName(hit.filter("least = greatest").select(*by, pct, F.col("least").alias("key")))
        open_ = hit.filter("least <> greatest")
        at += step
        if open_.isEmpty():
            break
    return done.select(*by, pct, key_value(F.col("key")).alias("value"))


def canonical_tags(tags: Column) -> Column:
    """The pairs of a tag set `:k=v:k=v:` in order; null stays null."""
    return F.array_join(pairs(tags), ":")


def tag_ids(tags: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a tag set, so that shuffles carry 16 bytes: equal only by a chance of 2^-128 a pair."""
    own = canonical_tags(tags)
    return [F.xxhash64(own).alias("g1"), F.xxhash64(F.lit(0x5EED), own).alias("g2")]


def sample_keys(samples: DataFrame) -> DataFrame:
    """(g1, g2, __key, __n): finite values that aren't negative, each sample_id once: of repeats that differ one whole row, the same on every run."""
    good = samples.filter("tags is not null and val >= 0 and not isnan(val) and val < double('infinity')")
    keyed = good.select("sample_id", *tag_ids(F.col("tags")), order_key(F.col("val")).alias("__key"))
    # One number orders the repeats, so that the aggregate keeps numbers only and needs no sort.
    mark = F.xxhash64("g1", "g2", "__key")
    once = keyed.groupBy("sample_id").agg(*[F.min_by(c, mark).alias(c) for c in ("g1", "g2", "__key")])
    return once.select("g1", "g2", "__key", F.lit(1).cast("bigint").alias("__n"))


def reading_keys(readings: DataFrame) -> DataFrame:
    """(g1, g2, __key, __n): the bucket boundaries of valid histogram rows, weighted by their counts; each reading_id once, of repeats that differ the least row."""
    good = readings.filter("kind = 'histogram' and sig_figs between 1 and 4 and tags is not null and bucket_counts is not null")
    once = good.groupBy("reading_id").agg(F.min(F.struct(*tag_ids(F.col("tags")), "sig_figs", "bucket_counts")).alias("__one")).select("__one.*")
    cells = once.select("g1", "g2", "sig_figs", F.posexplode("bucket_counts").alias("bucket", "__n")).filter("__n > 0")
    return cells.select("g1", "g2", order_key(boundary(F.col("bucket").cast("double"), F.col("sig_figs").cast("double"))).alias("__key"), "__n")


def objective_states(samples: DataFrame, readings: DataFrame) -> DataFrame:
    """The states of both origins: (origin, g1, g2, cell, n, least, greatest)."""
    by = ["g1", "g2"]
    a = key_states(sample_keys(samples), by).withColumn("origin", F.lit("samples"))
    b = key_states(reading_keys(readings), by).withColumn("origin", F.lit("readings"))
    return a.unionByName(b)


def exceeded(samples: DataFrame, readings: DataFrame, objectives: DataFrame) -> DataFrame:
    """(objective_id, least, greatest, max_val, above): objectives that have values, and whether the percentile lies above.

    Where max_val falls within the cell of the percentile (0.4 % wide at most) the states can't tell; then
    `exact` decides over the rows of those cells, and both bounds are the value itself. `above` is null for a
    null max_val only. Objectives with a null origin, tags or pct have no row.
    """
    by = ["origin", "g1", "g2"]
    asked = objectives.filter("origin is not null and tags is not null and pct is not null")
    asked = asked.select("objective_id", "origin", *tag_ids(F.col("tags")), F.col("pct").cast("double").alias("pct"), F.col("max_val").cast("double").alias("max_val"))
    state = materialize(objective_states(samples, readings), "states")
    found = select(state, asked.select(*by, "pct").distinct(), by)
    both = asked.join(found.select(*by, "pct", key_value(F.col("least")).alias("least"), key_value(F.col("greatest")).alias("greatest")), [*by, "pct"])
    above = F.when(F.col("least") > F.col("max_val"), True).when(F.col("greatest") <= F.col("max_val"), False)
    checked = materialize(both.select("objective_id", *by, "pct", "least", "greatest", "max_val", above.alias("above")), "objectives")
    open_ = checked.filter("above is null and max_val is not null")
    if open_.isEmpty():
        return checked
    # The states can't tell: the rows behind these cells are followed through the remaining digits.
    asked = open_.select(*by, "pct").distinct()
    rows = sample_keys(samples).withColumn("origin", F.lit("samples")).unionByName(reading_keys(readings).withColumn("origin", F.lit("readings")))
    rows = materialize(rows.join(asked.select(*by).distinct(), by, "left_semi"), "keys")
    values = exact(rows, found.join(asked, [*by, "pct"], "left_semi"), by)
    told = checked.join(values, [*by, "pct"], "left")
    sure = F.coalesce("above", F.col("value") > F.col("max_val"))
    ends = [F.when(F.col("above").isNull() & F.col("value").isNotNull(), F.col("value")).otherwise(F.col(c)).alias(c) for c in ("least", "greatest")]
    return told.select("objective_id", *by, "pct", *ends, "max_val", sure.alias("above"))
