"""Mixing sources to target weights along a curriculum of weights that vary over time.

Training time runs from 0 to 1. A source's weight over it is a schedule of points (at, weight), straight
between them. Its integral gives the share of the source's budget that is due by a time; inverted, that gives
the time at which each document is due, and sorted by it the documents follow the schedule. Without a
schedule of the caller's, weights are w(t) = share + slope (t - 1/2), normalised so that they add up to 1 at any
time and integrate to the target shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.prefix import prefix_sums
from quern.session import materialize

#: How far a source's weight moves over the whole time, relative to its share, at most: from 0.5 to 1.5 of it.
TILT = 1.0
#: A table of targets of up to this many rows may be broadcast; a longer one is joined as Spark chooses.
MOST_SOURCES = 100_000


def canonical_source(source: Column) -> Column:
    """A source's name in one spelling: lower case, words joined by one underscore; null and empty names stay null."""
    name = F.regexp_replace(F.lower(F.trim(source)), r"[\s_\-]+", "_")
    name = F.regexp_replace(name, "^_+|_+$", "")
    return F.when(name != "", name)


def targets(mix: DataFrame) -> DataFrame:
    """(source, share, max_repeats, slope): shares scaled to add up to 1, and the slope of each source's weight.

    Sources are ordered by share; larger ones start heavier and give way to smaller ones, by slopes that add
    up to 0 and never turn a weight negative. Rows with a null source, or without a positive share and
    repeat, don't count; of several rows for one source the largest numbers do. The table has a row for
    each source, so it is collected nowhere and sorted nowhere at large.
    """
    rows = mix.select(canonical_source(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("max_repeats"))
    rows = rows.filter("source is not null and share > 0 and max_repeats > 0").groupBy("source").agg(F.max("share").alias("share"), F.max("max_repeats").alias("max_repeats"))
    every = Window.partitionBy()  # over a row for each source
    both = rows.withColumns({"__all": F.sum("share").over(every), "__squares": F.sum(F.col("share") * F.col("share")).over(every)})
    share = F.col("share") / F.col("__all")
    # slope = -TILT share (share - S), S the sum of squared shares: adds up to 0, and |slope| <= TILT share.
    slope = -F.lit(TILT) * share * (share - F.col("__squares") / (F.col("__all") * F.col("__all")))
    return both.select("source", share.alias("share"), "max_repeats", slope.alias("slope"))


def weight(share: Column, slope: Column, t: Column) -> Column:
    return share + slope * (t - 0.5)


def segments(schedule: DataFrame) -> DataFrame:
    """(source, segments): each source's schedule (source, at, weight) as stretches (t0, t1, w0, w1, before), `before` the integral up to t0, from 0 to 1.

    The first and last weight hold to the ends; of several weights at one time the greatest counts. Rows with a
    null, a negative weight or a time outside of 0 to 1 don't count, nor does a source whose weights are all 0.
    """
    rows = schedule.select(canonical_source(F.col("source")).alias("source"), F.col("at").cast("double").alias("at"), F.col("weight").cast("double").alias("weight"))
    rows = rows.filter("source is not null and at between 0 and 1 and weight >= 0 and weight < double('infinity')").groupBy("source", "at").agg(F.max("weight").alias("weight"))
    points = rows.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("p"))  # a schedule has few points
    ends = F.concat(F.array(F.struct(F.lit(0.0).alias("at"), F.element_at("p", 1)["weight"].alias("weight"))), F.col("p"), F.array(F.struct(F.lit(1.0).alias("at"), F.element_at("p", -1)["weight"].alias("weight"))))
    pairs = F.zip_with(ends, F.slice(ends, F.lit(2), F.size(ends) - 1), lambda a, b: F.struct(a["at"].alias("t0"), b["at"].alias("t1"), a["weight"].alias("w0"), b["weight"].alias("w1")))
    pairs = F.filter(pairs, lambda s: s["t1"] > s["t0"])
    area = lambda s: (s["t1"] - s["t0"]) * (s["w0"] + s["w1"]) / 2
    before = lambda s: F.aggregate(F.filter(pairs, lambda x: x["t1"] <= s["t0"]), F.lit(0.0), lambda acc, x: acc + area(x))
    made = F.transform(pairs, lambda s: F.struct(s["t0"].alias("t0"), s["t1"].alias("t1"), s["w0"].alias("w0"), s["w1"].alias("w1"), before(s).alias("before")))
    whole = F.aggregate(made, F.lit(0.0), lambda acc, x: acc + area(x))
    return points.select("source", made.alias("segments"), whole.alias("__whole")).filter("__whole > 0").drop("__whole")


def linear(targets_: DataFrame) -> DataFrame:
    """The default schedules (source, at, weight) of targets with their slopes."""
    ends = F.explode(F.array(*[F.struct(F.lit(t).alias("at"), weight(F.col("share"), F.col("slope"), F.lit(t)).alias("weight")) for t in (0.0, 1.0)]))
    return targets_.select("source", ends.alias("e")).select("source", "e.at", "e.weight")


def due(segments_: Column, done: Column) -> Column:
    """The time at which the share `done` (0..1) of a source's demand is reached: inverts the integral of its schedule."""
    area = lambda s: (s["t1"] - s["t0"]) * (s["w0"] + s["w1"]) / 2
    last = F.element_at(segments_, -1)
    goal = done * (last["before"] + area(last))
    here = F.coalesce(F.try_element_at(F.filter(segments_, lambda s: (s["before"] + area(s) >= goal) & (area(s) > 0)), F.lit(1)), last)
    rest, width = F.greatest(goal - here["before"], F.lit(0.0)), here["t1"] - here["t0"]
    slope = (here["w1"] - here["w0"]) / width
    # w0 x + slope x^2 / 2 = rest, in the form that is safe for slopes near 0
    root = F.sqrt(F.greatest(here["w0"] * here["w0"] + 2 * slope * rest, F.lit(0.0)))
    x = F.when(here["w0"] + root > 0, 2 * rest / (here["w0"] + root)).otherwise(0.0)
    return F.least(F.greatest(here["t0"] + F.least(x, width), F.lit(0.0)), F.lit(1.0))


def budgets(documents: DataFrame, mix: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, share, max_repeats, slope, docs, tokens, whole, budget): what each source has and is to give.

    `documents` has (source, n_tokens). Without `total_tokens` the mix is as large as the shares allow: the
    least over the sources of tokens x max_repeats / share. With it, a source gives at most its tokens x
    max_repeats, and the shares reached fall short where that is too little. Sources without tokens
    can't give anything and get the budget 0; they don't shrink the mix to nothing.
    """
    have = documents.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    rows = targets(mix).join(have, "source", "left").fillna(0, ["docs", "tokens"])
    most = F.col("tokens") * F.col("max_repeats")
    if total_tokens is None:
        rows = rows.withColumn("whole", F.min(F.when(F.col("tokens") > 0, most / F.col("share"))).over(Window.partitionBy()))
    else:
        rows = rows.withColumn("whole", F.lit(float(total_tokens)))
    demand = F.floor(F.coalesce(F.col("whole"), F.lit(0.0)) * F.col("share") + 1e-6).cast("bigint")
    return rows.withColumn("budget", F.least(demand, most))


def mix(documents: DataFrame, mix_targets: DataFrame, total_tokens: int | None = None, schedule: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, repeat, n_tokens, due): the documents chosen, each `repeat` (from 0) of a document a row of its own.

    `documents` has (doc_id, source, n_tokens), sources in any spelling. A source is gone through in an
    order given by a hash of doc_id, again for every repeat, as long as the middle of a document lies within
    its budget; so its budget is missed by half of one document at most, and no document comes again
    before all of its source have come. `schedule` (source, at, weight) sets when a source comes, see `segments`;
    a source that it leaves out, or the whole mix without it, follows the default. Documents without tokens, with a null id or of a source without a
    target have no row. The running sums of a source are made in slices, whatever its size.
    """
    rows = documents.select("doc_id", canonical_source(F.col("source")).alias("source"), "n_tokens").filter("doc_id is not null and source is not null and n_tokens > 0")
    whole = budgets(rows, mix_targets, total_tokens).select("source", "share", "slope", "max_repeats", "tokens", "budget")  # a row for each source
    times = segments(linear(whole))
    if schedule is not None:
        given = segments(schedule).withColumnRenamed("segments", "given")
        times = times.join(given, "source", "left").select("source", F.coalesce("given", "segments").alias("segments"))
    plan = materialize(whole.join(times, "source").drop("share", "slope"), "plan")
    plan = F.broadcast(plan) if plan.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES else plan
    ordered = prefix_sums(rows, ["source"], ["doc_id", "n_tokens"], weight=F.col("n_tokens"), out="before")
    joined = ordered.join(plan, "source")
    repeats = F.explode(F.sequence(F.lit(0), F.col("max_repeats") - 1)).alias("repeat")
    each = joined.select("doc_id", "source", "n_tokens", "segments", "budget", "tokens", "before", repeats)
    start = F.col("repeat").cast("bigint") * F.col("tokens") + F.col("before")
    chosen = each.withColumn("__start", start).filter(F.col("__start") + F.col("n_tokens") / 2 <= F.col("budget"))
    done = (F.col("__start") + F.col("n_tokens") / 2) / F.col("budget")  # within 0 and 1
    return chosen.select("doc_id", "source", "repeat", "n_tokens", due(F.col("segments"), done).alias("due"))


def positions(mixed: DataFrame) -> DataFrame:
    """The mix with `position` from 0 in the order of (due, source, doc_id, repeat): sorted by range, then numbered slice by slice."""
    held = materialize(mixed.withColumn("__cut", F.floor(F.col("due") * (1 << 20)).cast("bigint")), "mix")
    numbered = prefix_sums(held, [], ["due", "source", "doc_id", "repeat"], out="position", spread=F.col("__cut"))
    return numbered.drop("__cut")


def unused(mixed: DataFrame, documents: DataFrame) -> DataFrame:
    """(source, held, unused): the tokens of each source's documents, and of those that the mix never takes."""
    known = documents.select("doc_id", canonical_source(F.col("source")).alias("source"), "n_tokens").filter("doc_id is not null and source is not null")
    held = known.groupBy("source").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("held"))
    took = mixed.filter("repeat = 0").groupBy("source").agg(F.sum("n_tokens").alias("__took"))
    return held.join(took, "source", "left").select("source", "held", (F.col("held") - F.coalesce("__took", F.lit(0))).alias("unused"))


def shares(mixed: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, tokens, picks, most_repeats, max_repeats): what the mix came to."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("picks"), (F.max("repeat") + 1).alias("most_repeats"))
    rows = targets(mix_targets).join(got, "source", "left").fillna(0, ["tokens", "picks", "most_repeats"])
    rows = rows.withColumn("__total", F.sum("tokens").over(Window.partitionBy()))
    return rows.select("source", F.col("share").alias("target_share"), F.when(F.col("__total") > 0, F.col("tokens") / F.col("__total")).otherwise(0.0).alias("reached_share"), "tokens", "picks", "most_repeats", "max_repeats")
