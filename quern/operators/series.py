"""Tagged time series: samples to a regular grid, and what is computed along and across series.

Samples are rows (tags, ts, value); tags are canonical tag sets. Series on a grid are rows (tags, k, ts,
value) with k the number of the step. The grid is complete: a series that has any sample in the window
has a row at every step, so series never differ in length and zip by k.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import calendar, math, ordering, tags
from quern.operators.prefix import prefix_sums, previous, same_keys

MICROS = 1_000_000


def micros(text: str | datetime | int) -> int:
    if isinstance(text, int):
        return text
    when = datetime.fromisoformat(text.replace("Z", "+00:00")) if isinstance(text, str) else text
    when = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
    return round((when - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * MICROS)


@dataclass(frozen=True)
class Params:
    """A window [start, limit) in microseconds, cut into whole steps, and how far to look back before it."""

    start: int
    limit: int
    step: int
    lookback: int = 0

    def __post_init__(self) -> None:
        if self.start >= self.limit or self.step <= 0:
            raise ValueError("a window needs start < limit and a positive step")

    @property
    def steps(self) -> int:
        return (self.limit - self.start) // self.step

    def back(self, lookback: int) -> Params:
        if self.lookback:
            raise ValueError("a rollup can't stand in another one")
        if lookback <= 0 or lookback % self.step or lookback > self.start:
            raise ValueError("a lookback is a positive multiple of the step, at most the start")
        return replace(self, lookback=lookback)

    def with_step(self, step: int) -> Params:
        if self.step % step and step % self.step:
            raise ValueError("the new step must divide the old one, or the old the new")
        return replace(self, step=step)

    @staticmethod
    def rendering(start: int, limit: int, buckets: int) -> Params:
        """Steps of whole seconds, the last of which ends at the limit."""
        step = max(MICROS, (limit - start) // max(1, buckets) // MICROS * MICROS)
        return Params(limit - (limit - start) // step * step, limit, step)


def round_to_seconds(low: Column, high: Column) -> tuple[Column, Column]:
    """An extent in whole seconds; the limit lies a second behind even where it is aligned."""
    return F.date_trunc("second", low), F.timestamp_micros(F.unix_micros(F.date_trunc("second", high)) + MICROS)


def extent(samples: DataFrame) -> DataFrame:
    """One row (start, limit): whole seconds around the samples, nulls without any."""
    low, high = round_to_seconds(F.col("low"), F.col("high"))
    return samples.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).select(low.alias("start"), high.alias("limit"))


def last_write(samples: DataFrame, order: str) -> DataFrame:
    """Of the samples of one series at one time the one with the greatest `order`."""
    return samples.groupBy("tags", "ts").agg(F.max_by("value", order).alias("value"))


def resample(samples: DataFrame, params: Params) -> DataFrame:
    """Samples (tags, ts, value) on the grid: at each step the last value at or before it.

    Only samples within the window, widened by the lookback, count. Steps before the first sample take the
    first one's value; values carry forward over gaps and to the end. Null times, tags or values don't
    count; of values at one time the greatest wins (see `last_write`). Samples are combined per step before
    anything moves, and a series has at most one row a step after that.
    """
    start = params.start - params.lookback
    n = (params.limit - start) // params.step
    inside = samples.filter((F.col("ts") >= F.timestamp_micros(F.lit(start))) & (F.col("ts") < F.timestamp_micros(F.lit(params.limit))))
    inside = inside.filter(F.col("tags").isNotNull() & F.col("value").isNotNull())
    at = F.unix_micros("ts")
    bucket = F.ceil((at - start) / F.lit(params.step)).cast("bigint")
    exact = F.when((bucket - 1) * params.step >= at - start, bucket - 1).when(bucket * params.step < at - start, bucket + 1).otherwise(bucket)
    value = F.col("value").cast("double")
    per = inside.withColumn("k", exact).groupBy("tags", "k").agg(F.max(F.struct(at.alias("t"), value.alias("v"))).alias("hi"), F.min(F.struct(at.alias("t"), value.alias("v"))).alias("lo"))
    along = Window.partitionBy("tags").orderBy("k")
    runs = per.select("tags", "k", F.col("hi.v").alias("value"), F.col("lo.v").alias("first"), F.lead("k", 1, n).over(along).alias("next"), F.row_number().over(along).alias("r"))
    runs = runs.withColumn("next", F.least("next", F.lit(n)))
    forward = F.when(F.col("k") < F.col("next"), F.transform(F.sequence("k", F.col("next") - 1), lambda k: F.struct(k.alias("k"), F.col("value").alias("v"))))
    ahead = F.when((F.col("r") == 1) & (F.col("k") > 0), F.transform(F.sequence(F.lit(0).cast("bigint"), F.least("k", F.lit(n)) - 1), lambda k: F.struct(k.alias("k"), F.col("first").alias("v"))))
    none = F.array().cast("array<struct<k:bigint,v:double>>")
    grid = runs.select("tags", F.explode(F.concat(F.coalesce(ahead, none), F.coalesce(forward, none))).alias("p"))
    return grid.select("tags", (F.col("p.k") - params.lookback // params.step).alias("k"), F.timestamp_micros(F.lit(start) + F.col("p.k") * params.step).alias("ts"), F.col("p.v").alias("value"))


def select(samples: DataFrame, wanted: str) -> DataFrame:
    """Samples of the series that hold all wanted tags: a name, or a tag set `:k=v:...`."""
    pairs = tags.parse_wanted(wanted) if wanted.startswith(":") and wanted.endswith(":") else {"__name__": wanted}
    return samples.filter(tags.covers(F.col("tags"), pairs))


def fetch(samples: DataFrame, kind: str, wanted: str, start: int, limit: int) -> DataFrame:
    """The samples of counters, gauges or histograms (what they are is in `kind`) that hold the wanted tags, within [start, limit) microseconds. Nulls never match."""
    inside = (F.col("ts") >= F.timestamp_micros(F.lit(start))) & (F.col("ts") < F.timestamp_micros(F.lit(limit)))
    return select(samples.filter((F.col("kind") == kind) & inside), wanted)


def upper_median(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """The element of rank n/2 (from 0) of each group, however large; nulls don't count.

    Equal values are counted task by task first, and the counts summed up in slices of the values' own order.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    sizes = counts.groupBy(*by).agg(F.sum("__c").alias("__n"))
    ranked = prefix_sums(counts, by, [value], weight=F.col("__c"), out="__rank", spread=ordering.slices(F.col(value), 10))
    half = F.floor(F.col("__n") / 2)
    hit = (F.col("__rank") <= half) & (half < F.col("__rank") + F.col("__c"))
    sizes = sizes.select(*[F.col(c).alias(f"__g_{c}") for c in by], "__n")
    return ranked.join(sizes, same_keys(by, "__g_")).filter(hit).select(*by, value)


def _stdvar(v: Column) -> Column:
    return F.coalesce(F.var_samp(v), F.lit(math.NAN))


#: What collapses a group of points by partial aggregation; the median has `upper_median`.
ACROSS: dict[str, Callable[[Column], Column]] = {
    "maximum": F.max,
    "mean": F.avg,
    "minimum": F.min,
    "stddev": lambda v: F.sqrt(_stdvar(v)),
    "stdvar": _stdvar,
}


def aggregate(series: DataFrame, how: str | Callable[[Column], Column]) -> DataFrame:
    """All series collapsed to one, step by step; its tags are null. Without series there is no row.

    `how` is a name, or any aggregate of Spark as a function of the values' column.
    """
    if how == "median":
        out = upper_median(series.select("k", "ts", "value"), ["k", "ts"])
    else:
        out = series.groupBy("k", "ts").agg((ACROSS[how] if isinstance(how, str) else how)(F.col("value")).cast("double").alias("value"))
    return out.select(F.lit(None).cast("string").alias("tags"), "k", "ts", "value")


def _sorted_at_half(values: Column) -> Column:
    return F.when(F.size(values) == 0, math.NAN).otherwise(F.element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1))


def _deviation(values: Column) -> Column:
    """The median of the distances from the median, which is worked out once."""
    return F.transform(F.array(_sorted_at_half(values)), lambda m: _sorted_at_half(F.transform(values, lambda x: F.abs(x - m))))[0]


def _over(frame, how: str | Callable[[Column], Column]) -> Column:
    v = F.col("value")
    collected = F.collect_list(v).over(frame)
    if not isinstance(how, str):
        return how(collected).cast("double")
    return {
        "maximum": lambda: F.max(v).over(frame),
        "minimum": lambda: F.min(v).over(frame),
        "mean": lambda: F.avg(v).over(frame),
        "sum": lambda: F.sum(v).over(frame),
        "range": lambda: F.max(v).over(frame) - F.min(v).over(frame),
        "stdvar": lambda: F.coalesce(F.var_samp(v).over(frame), F.lit(math.NAN)),
        "stddev": lambda: F.sqrt(F.coalesce(F.var_samp(v).over(frame), F.lit(math.NAN))),
        "median": lambda: _sorted_at_half(collected),
        "median_absolute_deviation": lambda: _deviation(collected),
        "first": lambda: F.min_by(v, "k").over(frame),
        "last": lambda: F.max_by(v, "k").over(frame),
    }[how]()


ROLLUPS = ("changes", "maximum", "mean", "median", "median_absolute_deviation", "minimum", "range", "stddev", "stdvar")
UNIFORMS = ("first", "last", "maximum", "mean", "median", "median_absolute_deviation", "minimum", "stddev", "stdvar", "sum")


def rollup(series: DataFrame, how: str | Callable[[Column], Column], frame_steps: int, keep_from: int = 0) -> DataFrame:
    """Each point from the frame of itself and `frame_steps` points before it; only steps from `keep_from` on stay.

    `changes` is 1 where neighbours in the frame differ, else 0: a flag. `how` is a name, or a function of the
    frame's values as one array column in the order of the steps. A series is at most the grid long,
    and a frame, which is what medians and functions get, no longer than the lookback.
    """
    if isinstance(how, str) and how not in ROLLUPS:
        raise ValueError(f"no rollup: {how}")
    along = Window.partitionBy("tags").orderBy("k")
    if how == "changes":
        before = F.lag("value").over(along)
        flagged = series.withColumn("__c", F.when(F.col("value").eqNullSafe(before), 0.0).otherwise(1.0))
        out = flagged.withColumn("value", F.max("__c").over(along.rowsBetween(-frame_steps + 1, 0))).drop("__c")
    else:
        out = series.withColumn("value", _over(along.rowsBetween(-frame_steps, 0), how))
    return out.filter(F.col("k") >= keep_from)


def uniform(series: DataFrame, how: str | Callable[[Column], Column]) -> DataFrame:
    """Each series' single value at all of its steps.

    `how` is a name, or a function of the series' values as one array column in the order of its steps. The
    medians sort a series once or twice and collect nothing; a series is at most the grid long.
    """
    if isinstance(how, str) and how not in UNIFORMS:
        raise ValueError(f"no uniform function: {how}")
    if how == "median":
        return _whole_median(series, "value", "__median").withColumn("value", F.col("__median")).drop("__median")
    if how == "median_absolute_deviation":
        far = _whole_median(series, "value", "__median").withColumn("__far", F.abs(F.col("value") - F.col("__median")))
        return _whole_median(far, "__far", "value").drop("__far", "__median").select(*series.columns)
    whole = Window.partitionBy("tags")
    if not isinstance(how, str):
        whole = whole.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return series.withColumn("value", _over(whole, how))


def _whole_median(series: DataFrame, value: str, out: str) -> DataFrame:
    """Adds each series' upper median of a column: the one at rank n/2, seen from all its rows."""
    own = Window.partitionBy("tags")
    rank, n = F.row_number().over(own.orderBy(value)) - 1, F.count(F.lit(1)).over(own)
    ranked = series.withColumn("__at_half", F.when(rank == F.floor(n / 2), F.col(value)))
    return ranked.withColumn(out, F.max("__at_half").over(own)).drop("__at_half")


def pointwise(series: DataFrame, how: str | Callable[[Column], Column]) -> DataFrame:
    f = math.POINTWISE[how] if isinstance(how, str) else how
    return series.withColumn("value", f(F.col("value")))


def function_of_time(spark: SparkSession, how: str | Callable[[Column], Column], params: Params) -> DataFrame:
    """A series without tags that has a function of the time at every step; a name, or any function of the column of times."""
    first = -(params.lookback // params.step)
    k = spark.range(first, params.steps).select(F.col("id").alias("k"))
    ts = F.timestamp_micros(F.lit(params.start) + F.col("k") * params.step)
    return k.select(F.lit(None).cast("string").alias("tags"), "k", ts.alias("ts"), (calendar.of_time(how, ts) if isinstance(how, str) else how(ts).cast("double")).alias("value"))


def union(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All series of all inputs, repeats kept."""
    for other in others:
        first = first.unionByName(other)
    return first


def relabel(series: DataFrame, label: str | None) -> DataFrame:
    """Every series under one label, or under none."""
    return series.withColumn("tags", F.lit(label).cast("string"))


def combine(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Arithmetic between the series of equal tags (null equals null), step by step."""
    right = b.select(F.col("tags").alias("__t"), F.col("k").alias("__k"), F.col("value").alias("__v"))
    both = a.join(right, F.col("tags").eqNullSafe(F.col("__t")) & (F.col("k") == F.col("__k")))
    return both.withColumn("value", math.ARITHMETIC[how](F.col("value"), F.col("__v"))).drop("__t", "__k", "__v")


def series_arrays(series: DataFrame) -> DataFrame:
    """(tags, points): each series as one array in the order of its steps; as long as the grid."""
    return series.groupBy("tags").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda p: p["value"]).alias("points"))


def delta_encode(samples: DataFrame, bits: int | None = None) -> DataFrame:
    """(tags, ts, value, d_ts, d_value, dd_ts): differences and differences of differences along each series, null where there is none before. Raw series are cut into stretches of time."""
    once = previous(samples, ["tags"], "ts", ["ts", "value"], "__b", ["value"], bits)
    first = once.withColumns({"d_ts": F.unix_micros("ts") - F.unix_micros("__b.ts"), "d_value": F.col("value") - F.col("__b.value")}).drop("__b")
    twice = previous(first, ["tags"], "ts", ["d_ts"], "__b", ["value"], bits)
    return twice.withColumn("dd_ts", F.col("d_ts") - F.col("__b.d_ts")).drop("__b")


def delta_decode(encoded: DataFrame, start: DataFrame) -> DataFrame:
    """(tags, n, ts, value) from rows (tags, n, dd_ts, value) numbered from 0 along each series and `start` (tags, ts0, d0).

    The time of row n is ts0 + n d0 plus the sums of the sums of the differences of differences up to n, null
    ones counting as 0: what `delta_encode` took apart. Both sums are made in slices of the numbers.
    """
    rows = encoded.withColumns({"__dd": F.coalesce("dd_ts", F.lit(0)), "__cut": F.floor(F.col("n") / 65536).cast("bigint")})
    once = prefix_sums(rows, ["tags"], ["n"], weight=F.col("__dd"), out="__d", spread=F.col("__cut")).withColumn("__d", F.col("__d") + F.col("__dd"))
    twice = prefix_sums(once, ["tags"], ["n"], weight=F.col("__d"), out="__t", spread=F.col("__cut")).withColumn("__t", F.col("__t") + F.col("__d"))
    first = start.select(F.col("tags").alias("__tags"), F.unix_micros("ts0").alias("__ts0"), F.coalesce("d0", F.lit(0)).alias("__d0"))
    both = twice.join(first, F.col("tags").eqNullSafe(F.col("__tags")))
    return both.select("tags", "n", F.timestamp_micros(F.col("__ts0") + F.col("n") * F.col("__d0") + F.col("__t")).alias("ts"), "value")


def per_second(records: DataFrame, ts: str, start: int, limit: int) -> DataFrame:
    """(second, n): the number of records of every second in [start, limit) microseconds, with the empty ones; the seconds are made by all tasks."""
    grid = records.sparkSession.range(start // MICROS, limit // MICROS).select(F.timestamp_seconds("id").alias("second"))
    held = records.groupBy(F.date_trunc("second", F.col(ts)).alias("second")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(held, "second", "left").fillna(0, ["n"])
