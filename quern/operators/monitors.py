"""Alert monitors over successive readings of sensors: stable or firing, with a latch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.prefix import previous

#: A counter that moves this far between two readings is taken for a fault.
JUMP = 1 << 56


def below_threshold(value: Column, threshold: float) -> Column:
    """Fires unless value < threshold (the name is the state wished for); NaN and null fire."""
    return F.coalesce(~(~F.isnan(value) & (value < threshold)), F.lit(True))


def above_threshold(value: Column, threshold: float) -> Column:
    """Fires unless value > threshold; NaN and null fire."""
    return F.coalesce(~(~F.isnan(value) & (value > threshold)), F.lit(True))


def stationary(readings: DataFrame, by: Sequence[str], order: str, counter: str) -> DataFrame:
    """Adds `firing`: whether the counter moved since the reading before; the first reading is held against 0."""
    rows = previous(readings.withColumn("__one", F.lit(True)), by, order, [counter, "__one"], "__b")
    before = F.when(F.col("__b.__one"), F.col(f"__b.{counter}")).otherwise(F.lit(0))
    return rows.withColumn("firing", ~F.col(counter).eqNullSafe(before)).drop("__b", "__one")


def success_rate(readings: DataFrame, by: Sequence[str], order: str, success: str, failure: str, least: float) -> DataFrame:
    """Adds `rate` and `firing`: of what succeeded and failed since the reading before (0 before the first).

    Fires where a counter went back or jumped, where nothing happened, and where the rate is below `least`.
    """
    good, bad = (F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.col(f"__b.{c}"), F.lit(0)) for c in (success, failure))
    rows = previous(readings, by, order, [success, failure], "__b").withColumns({"__good": good, "__bad": bad}).drop("__b")
    total = F.col("__good") + F.col("__bad")
    odd = (F.col("__good") < 0) | (F.col("__bad") < 0) | (F.col("__good") >= JUMP) | (F.col("__bad") >= JUMP) | (total <= 0)
    rate = F.when(~odd, F.col("__good") / total)
    return rows.withColumns({"rate": rate, "firing": F.coalesce(odd | (rate < least), F.lit(True))}).drop("__good", "__bad")


def latch(evaluated: DataFrame, by: Sequence[str], order: str, condition: str, resets: DataFrame | None = None) -> DataFrame:
    """(by..., alert_id, fired_at, first_condition, latest_at, latest_condition): alerts that fired and weren't reset since.

    An alert latches at its first firing reading and keeps that condition, and its latest firing one, until
    a reset (by..., reset_at) at or behind the latest reading that it is to clear. Its id is a hash of its
    group and first reading, so it stays while the alert does. Two combining passes: no group is ordered as a whole.
    """
    firing = evaluated.filter("firing")
    if resets is not None:
        last = resets.groupBy(*by).agg(F.max("reset_at").alias("__reset"))
        firing = firing.join(last, list(by), "left").filter(F.col("__reset").isNull() | (F.col(order) > F.col("__reset")))
    first, latest = (f(F.struct(F.col(order).alias("o"), F.col(condition).alias("c"))) for f in (F.min, F.max))
    out = firing.groupBy(*by).agg(first.alias("__a"), latest.alias("__b"))
    own = F.sha2(F.concat_ws("\u0000", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0001")) for c in by], F.col("__a.o").cast("string")), 256).substr(1, 32)
    return out.select(*by, own.alias("alert_id"), F.col("__a.o").alias("fired_at"), F.col("__a.c").alias("first_condition"), F.col("__b.o").alias("latest_at"), F.col("__b.c").alias("latest_condition"))


def counter_deltas(readings: DataFrame, by: Sequence[str], order: str, counter: str) -> DataFrame:
    """Adds `delta` since the reading before (null at the first) and `regressed` where it is negative."""
    rows = previous(readings, by, order, [counter], "__b").withColumn("delta", F.col(counter) - F.col(f"__b.{counter}")).drop("__b")
    return rows.withColumn("regressed", F.coalesce(F.col("delta") < 0, F.lit(False)))
