"""The best N rows of every group, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import materialize

#: Buckets to an octave of the distance from the highest score: each is 1.6 % wide.
OCTAVE = 44
#: The lowest and the highest bucket there can be.
LOWEST, HIGHEST = -(1 << 20), 1 << 20
#: Thresholds of up to this many groups may be broadcast; more are joined by group, where Spark splits hot groups.
BROADCAST_GROUPS = 200_000


def ceiling(rows: DataFrame, score: str) -> float:
    """The highest finite score of all rows; 0 without any."""
    x = F.col(score).cast("double")
    return float(rows.agg(F.max(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x))).first()[0] or 0.0)


def bucket(score: Column, top: float) -> Column:
    """A whole number that never falls as the score rises: the logarithm of its distance below `top`, negated; logarithms never fall either, as Java promises. NaN, which ranks first, is in the highest bucket with infinity."""
    x = score.cast("double")
    below = F.least(F.lit(top) - x, F.lit(1.7e308))
    step = -F.floor(F.log2(below) * OCTAVE)
    return F.when(F.isnan(x) | (x == float("inf")), F.lit(HIGHEST)).when(below <= 0, F.lit(HIGHEST - 1)).when(x == float("-inf"), F.lit(LOWEST)).otherwise(step).cast("int")


def thresholds(rows: DataFrame, by: Sequence[str], score: str, tie: Sequence[str], n: str, top: float) -> DataFrame:
    """(by..., __least): for every group that has rows to drop, the lowest bucket that a row of the best N can be in.

    A bucket counts as many items as bits are set in a 64-bit mask of its rows' hashed tie keys. That is
    at most the number of distinct items, however often rows are repeated, so the buckets from `__least`
    up hold N items or more for certain. One pass, combined task by task; a group has a few thousand
    buckets at most.
    """
    mask = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(*tie), F.lit(64)).cast("int")))
    buckets = rows.groupBy(*by, bucket(F.col(score), top).alias("__b")).agg(F.bit_count(mask).alias("__items"), F.max(n).alias("__want"))
    own = Window.partitionBy(*by)
    above = F.sum("__items").over(own.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sure = buckets.withColumns({"__above": above, "__low": F.min("__b").over(own)}).filter(F.col("__above") >= F.col("__want"))
    return sure.groupBy(*by).agg(F.max("__b").alias("__least"), F.min("__low").alias("__low")).filter("__least > __low").drop("__low")


def top_n(rows: DataFrame, by: Sequence[str], score: str, tie: Sequence[str], n: str, most: int) -> DataFrame:
    """The rows of `rows` that are among the best `n` (a column, constant in a group, `most` at the most) of their group, with `place` from 1.

    Higher scores come first, of equal ones the smaller tie keys. Rows of a group that agree in score and
    tie keys are repeats of one item: they count once and come out once, with the least of their other
    columns. Rows with a null group column, score or `n` never count, nor does a group with an n below 1;
    an empty input has an empty result. Every group loses the rows below its threshold where they are read,
    repeats are combined task by task, and a task passes on its best `most` rows of a group only, so no
    task ever gets a whole large group.
    """
    for c in (*by, score, n):
        rows = rows.filter(F.col(c).isNotNull())
    rows = rows.filter(F.col(n) >= 1)
    top = ceiling(rows, score)
    marks = materialize(thresholds(rows, by, score, tie, n, top), "thresholds")
    marks = F.broadcast(marks) if marks.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else marks
    near = rows.join(marks, list(by), "left")
    near = near.filter(F.col("__least").isNull() | (bucket(F.col(score), top) >= F.col("__least"))).drop("__least")
    keys = [*dict.fromkeys([*by, score, *tie])]
    rest = [c for c in near.columns if c not in keys]
    plain = not any(isinstance(near.schema[c].dataType, (T.MapType, T.VariantType)) for c in rest)
    once = near.groupBy(*keys).agg((F.min if plain else F.any_value)(F.struct(*rest)).alias("__rest")).select(*keys, "__rest.*")
    order = Window.partitionBy(*by).orderBy(F.desc(score), *tie)
    ranked = once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).filter(F.col("place") <= F.col(n))
    return ranked.select(*near.columns, "place")
