"""Ranks, running sums and carried values inside groups of any size, without one task per group."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A slice of a group is to hold about this many bytes of the plan's own estimate of its input.
SLICE_BYTES = 32 << 20
#: Sizes from here on are what the planner puts for ones that it doesn't know.
UNKNOWN = 1 << 62
#: Slices are carried over in chunks of this power of two, so that a window over a group's chunks has 4,096 times fewer rows than slices.
CHUNK_BITS = 12


def estimated_bytes(df: DataFrame) -> int:
    """The size of what df reads, as the planner knows it from file sizes and the like; no job runs. A source of unknown size counts as 8 GB.

    Inputs are summed up: the planner's own estimate of a join is the product of its sides.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s if s < UNKNOWN else 8 << 30 for s in sizes)


def slice_bits(df: DataFrame, least: int = 4, most: int = 24) -> int:
    """The power of two of slices into which df's groups are to be cut; it grows with df."""
    size = estimated_bytes(df)
    return max(least, min(most, math.ceil(math.log2(size / SLICE_BYTES)))) if size > SLICE_BYTES else least


def same_keys(keys: Sequence[str], prefix: str) -> Column:
    """The condition that each key equals the column of the same name behind `prefix`, null equal to null."""
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return on


def carried(totals: DataFrame, by: Sequence[str], slot: str, value: str, out: str, how: str = "sum") -> DataFrame:
    """Adds `out`: the sum (or "max") of `value` over the slots of the group that come before this one; null before the first.

    `totals` has a row for each (by, slot), slots being whole numbers. Slots are carried in chunks of 4,096
    and chunks in a window of their own, so that no task orders all the slots of a group.
    """
    combine = {"sum": F.sum, "max": F.max}[how]
    chunk = "__carry_chunk"
    rows = totals.withColumn(chunk, F.shiftright(F.col(slot).cast("bigint"), CHUNK_BITS))
    inner = Window.partitionBy(*by, chunk).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*by, chunk).agg(combine(value).alias("__carry_own")).withColumn("__carry_top", combine("__carry_own").over(outer))
    keys = [*by, chunk]
    tops = tops.select(*[F.col(c).alias(f"__c_{c}") for c in keys], "__carry_top")
    both = rows.withColumn("__carry_in", combine(value).over(inner)).join(tops, same_keys(keys, "__c_"))
    if how == "sum":
        whole = F.when(F.col("__carry_in").isNotNull() | F.col("__carry_top").isNotNull(), F.coalesce("__carry_in", F.lit(0)) + F.coalesce("__carry_top", F.lit(0)))
    else:
        whole = F.coalesce("__carry_in", "__carry_top")  # a later slot's maximum is the greater one where values rise with the slots
    return both.withColumn(out, whole).drop(chunk, "__carry_in", "__carry_top", *[f"__c_{c}" for c in keys])


def order_slices(df: DataFrame, order: Column, bits: int) -> Column:
    """Which of 2^bits equal stretches of the range of a whole-number order a row lies in; -1 where it is null. The range is read once, for bits above 0."""
    if not bits:
        return F.when(order.isNull(), -1).otherwise(0).cast("bigint")
    low, high = df.agg(F.min(order), F.max(order)).first()
    if low is None:
        return F.lit(-1).cast("bigint")
    width = max(1, -(-(high - low + 1) >> bits))
    return F.coalesce(F.floor((order - F.lit(low)) / F.lit(width)).cast("bigint"), F.lit(-1).cast("bigint"))


def previous(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str], out: str, tie: Sequence[str] = (), bits: int | None = None) -> DataFrame:
    """Adds `out`: a struct of `columns` of the row before in the group's order (order, tie...), null for the first.

    A group is cut into stretches of its order, as many as the planner's estimate of df calls for, and
    the last row of those before is carried over, so a group of any size is no single task. Small inputs
    are one stretch. Null group keys are a group; rows with a null order come first.
    """
    bits = slice_bits(df, 0, 20) if bits is None else bits
    at = F.unix_micros(order) if df.schema[order].dataType.typeName().startswith("timestamp") else F.col(order).cast("bigint")
    mine = F.lag(F.struct(*columns))
    if not bits:
        return df.withColumn(out, mine.over(Window.partitionBy(*by).orderBy(order, *tie)))
    slot = "__stretch"
    rows = df.withColumn(slot, order_slices(df, at, bits))
    last = F.max(F.struct(*dict.fromkeys([order, *tie]), F.struct(*columns).alias("__c"))).alias("__last")
    ends = carried(rows.groupBy(*by, slot).agg(last), by, slot, "__last", "__before", "max")
    keys = [*by, slot]
    ends = ends.select(*[F.col(c).alias(f"__k_{c}") for c in keys], "__before")
    rows = rows.withColumn(out, mine.over(Window.partitionBy(*by, slot).orderBy(order, *tie))).join(ends, same_keys(keys, "__k_"))
    return rows.withColumn(out, F.coalesce(out, "__before.__c")).drop(slot, "__before", *[f"__k_{c}" for c in keys])


def prefix_sums(df: DataFrame, by: Sequence[str], order: Sequence[str], weight: Column | None = None, out: str = "before", bits: int | None = None, spread: Column | None = None, hashed: Sequence[str] = ()) -> DataFrame:
    """Adds to each row the sum of weight (1: its rank from 0) over the rows ahead of it in its group.

    Without `spread` a group is ordered by a 64-bit hash of the order columns (of `hashed`, the first of
    them, where given, so that rows that agree there stay together), then by those. The leading
    `bits` of the hash are the slice, so however many slices there are (they grow with the planner's
    estimate of df), the order and the result are the same. `spread`, whole numbers that never fall as
    the order rises, gives slices of the order itself instead. A slice is summed by one task, and the
    slices' totals are carried over (`carried`). `order` must identify the rows within a group for the same
    result on every run. Null weights count as 0; an empty input gives an empty result.
    """
    w = F.lit(1).cast("bigint") if weight is None else F.coalesce(weight.cast("bigint"), F.lit(0).cast("bigint"))
    slot, at, total, mixed = "__slice", "__weight", "__total", "__hash"
    if spread is None:
        own = F.xxhash64(*[F.col(c) for c in (hashed or order)])
        rows = df.withColumns({mixed: own, slot: F.shiftrightunsigned(own, 64 - (max(1, bits) if bits is not None else slice_bits(df))), at: w})
        along = [mixed, *order]
    else:
        rows = df.withColumns({slot: spread.cast("bigint"), at: w})
        along = list(order)
    inner = Window.partitionBy(*by, slot).orderBy(*along).rowsBetween(Window.unboundedPreceding, -1)
    offsets = carried(rows.groupBy(*by, slot).agg(F.sum(at).alias(total)), by, slot, total, "__ahead_of")
    keys = [*by, slot]
    offsets = offsets.select(*[F.col(c).alias(f"__k_{c}") for c in keys], F.coalesce("__ahead_of", F.lit(0)).alias(total))
    rows = rows.withColumn(out, F.coalesce(F.sum(at).over(inner), F.lit(0)))
    if spread is None and by:
        rows = rows.drop(mixed)
    rows = rows.join(offsets, same_keys(keys, "__k_"))
    return rows.withColumn(out, F.col(out) + F.col(total)).drop(slot, at, total, mixed, *[f"__k_{c}" for c in keys])
