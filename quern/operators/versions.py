"""Versioned key-value records (key columns, ts, value; a null value is a tombstone), newest first within a key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.prefix import carried, order_slices, prefix_sums, previous, same_keys, slice_bits
from quern.plans import retention


def merge(*runs: DataFrame) -> DataFrame:
    """All records of all runs, repeats kept; ordering is the reader's (`ordered`)."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


def ordered(records: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Key ascending, time descending: the order of sorted runs."""
    return records.orderBy(*keys, F.desc(ts))


def bounds(records: DataFrame, key: str, low=None, high=None, low_open: bool = False, high_open: bool = True) -> DataFrame:
    """Records with a key within the bounds; a bound left out is open-ended. The filters reach the scan."""
    if low is not None:
        records = records.filter(F.col(key) > F.lit(low) if low_open else F.col(key) >= F.lit(low))
    if high is not None:
        records = records.filter(F.col(key) < F.lit(high) if high_open else F.col(key) <= F.lit(high))
    return records


def prune(records: DataFrame, keys: Sequence[str], at: int | None = None, ts: str = "ts", value: str = "value", tie: str | None = None) -> DataFrame:
    """The newest version of each key at or before the time `at`; a key whose newest version is a tombstone is gone.

    Versions of several runs are to be merged first, so that a tombstone in one hides values in another.
    Null times don't count; of versions at one time the one with the greater `tie`, else a tombstone, counts.
    Map-side combining leaves a row a key and task, so hot keys don't matter.
    """
    rows = records.filter(F.col(ts).isNotNull())
    if at is not None:
        rows = rows.filter(F.col(ts) <= at)
    rank = [F.col(ts).alias("a"), *([F.col(tie).alias("b")] if tie else []), F.col(value).isNull().alias("c")]
    newest = rows.groupBy(*keys).agg(F.max(F.struct(*rank, F.col(value).alias("v"))).alias("__m"))
    return newest.filter("__m.v is not null").select(*keys, F.col("__m.a").alias(ts), F.col("__m.v").alias(value))


def get(records: DataFrame, keys: Sequence[str], wanted: Sequence, at: int | None = None, **names: str) -> DataFrame:
    """One key's value, or no row."""
    for k, w in zip(keys, wanted, strict=True):
        records = records.filter(F.col(k) == F.lit(w))
    return prune(records, keys, at, **names)


def range_scan(records: DataFrame, keys: Sequence[str], low=None, high=None, at: int | None = None, **names: str) -> DataFrame:
    """A snapshot of the keys within [low, high)."""
    return prune(bounds(records, keys[0], low, high), keys, at, **names)


def page(records: DataFrame, keys: Sequence[str], after=None, limit: int = 100, backward: bool = False, ts: str = "ts") -> DataFrame:
    """The next `limit` records at or behind a key, in order; or backwards, those at or before it."""
    k = F.col(keys[0])
    if after is not None:
        records = records.filter(k <= F.lit(after) if backward else k >= F.lit(after))
    order = [*(F.desc(c) for c in keys), F.asc(ts)] if backward else [*(F.asc(c) for c in keys), F.desc(ts)]
    return records.orderBy(*order).limit(limit)


def write_batch(records: DataFrame, changes: DataFrame, ts: int, keys: Sequence[str], value: str = "value") -> DataFrame:
    """The records with a batch of puts and deletes (null values) on top, all at one time: visible whole or not at all."""
    return records.unionByName(changes.select(*keys, F.lit(ts).cast("bigint").alias("ts"), value))


def _keep(policy, now: int) -> Column:
    if callable(policy):
        return policy(F.col("__cum"), F.col("__vts"), F.lit(now))
    if isinstance(policy, retention.Versions):
        return F.col("__cum") <= policy.number
    if isinstance(policy, retention.Ttl):
        return F.col("__vts") >= now - policy.micros
    parts = [_keep(p, now) for p in policy.of]
    out = parts[0]
    for p in parts[1:]:
        out = (out | p) if isinstance(policy, retention.AnyOf) else (out & p)
    return out


def collect_garbage(records: DataFrame, keys: Sequence[str], policy: str | Callable[[Column, Column, Column], Column], now: int, ts: str = "ts", value: str = "value", bits: int | None = None) -> DataFrame:
    """The versions that a retention policy keeps.

    A version is a value, with the oldest of the tombstones right above it. A value without tombstones
    above costs one, another two; `versions = n` keeps values while their running cost is at most n,
    `ttl_micros = m` those no older than m. Each part of a policy is worked out on the whole history. A
    function of (running cost, time of the value, now) is a policy of the caller's own.
    Tombstones with nothing below them go. Null times don't count; equal versions count once. A key's history
    is cut into stretches of time, so that no task orders the whole of a large one.
    """
    wanted = policy if callable(policy) else retention.parse(policy)
    rows = records.filter(F.col(ts).isNotNull()).select(*keys, ts, value).distinct()
    # Newest first, of one time a tombstone first. A value's tombstone is the row right above it, if that is one.
    rows = rows.withColumns({"__age": -F.col(ts), "__live": F.col(value).isNotNull()})
    bits = slice_bits(records, 0, 20) if bits is None else bits
    near = previous(rows, keys, "__age", [ts, "__live"], "__b", ["__live", value], bits)
    dead = F.coalesce(~F.col("__b.__live"), F.lit(False))
    values = near.filter("__live").withColumns({"__tts": F.when(dead, F.col(f"__b.{ts}")), "__vts": F.col(ts), "__cost": 1 + dead.cast("int")})
    summed = prefix_sums(values, keys, ["__age", value], weight=F.col("__cost"), out="__cum", spread=order_slices(rows, F.col("__age"), bits))
    kept = summed.withColumn("__cum", F.col("__cum") + F.col("__cost")).filter(_keep(wanted, now))
    none = F.lit(None).cast(records.schema[value].dataType)
    both = F.array(F.struct(F.col(ts).alias("t"), F.col(value).alias("v")), F.when(F.col("__tts").isNotNull(), F.struct(F.col("__tts").alias("t"), none.alias("v"))))
    out = kept.select(*keys, F.explode(F.array_compact(both)).alias("__r"))
    return out.select(*keys, F.col("__r.t").alias(ts), F.col("__r.v").alias(value))


def overlapping(files: DataFrame, low, high, first: str = "first_key", last: str = "last_key") -> DataFrame:
    """The files whose key range meets [low, high]: those that a scan has to open."""
    return files.filter((F.col(first) <= F.lit(high)) & (F.col(last) >= F.lit(low)))


def as_of_join(probes: DataFrame, records: DataFrame, keys: Sequence[str], probe_ts: str, ts: str = "ts", value: str = "value", bits: int | None = None) -> DataFrame:
    """Each probe with the value of its keys at its time (null where there is none yet or it was deleted).

    Times are whole numbers. Probes and versions are ordered together within a key and a stretch of time, and a
    probe takes the last version before it, from the stretches before if there is none in its own; so a key
    of any size is no single task. Of versions at one time the greatest value counts. Probes with a null
    key or time stay, with a null value.
    """
    side = records.filter(F.col(ts).isNotNull()).select(*keys, F.col(ts).alias("__at"), F.lit(0).alias("__side"), F.struct(F.col(value).alias("v")).alias("__version"), *[F.lit(None).cast(f.dataType).alias(f"__p_{f.name}") for f in probes.schema if f.name not in keys])
    ask = probes.select(*keys, F.col(probe_ts).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(side.schema["__version"].dataType).alias("__version"), *[F.col(c).alias(f"__p_{c}") for c in probes.columns if c not in keys])
    both = side.unionByName(ask)
    bits = slice_bits(both, 0, 20) if bits is None else bits
    both = both.withColumn("__slot", order_slices(both, F.col("__at"), bits))
    along = Window.partitionBy(*keys, "__slot").orderBy("__at", "__side", "__version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__found", F.last("__version", ignorenulls=True).over(along))
    if bits:
        latest = F.max(F.when(F.col("__side") == 0, F.struct("__at", "__version"))).alias("__latest")
        ends = carried(both.groupBy(*keys, "__slot").agg(latest), keys, "__slot", "__latest", "__before", "max")
        ends = ends.select(*[F.col(c).alias(f"__k_{c}") for c in (*keys, "__slot")], "__before")
        found = found.join(ends, same_keys([*keys, "__slot"], "__k_")).withColumn("__found", F.coalesce("__found", "__before.__version"))
    unknown = F.col("__at").isNull()
    for k in keys:
        unknown = unknown | F.col(k).isNull()
    both = found.filter("__side = 1").withColumn("__found", F.when(~unknown, F.col("__found")))
    return both.select(*keys, *[F.col(f"__p_{c}").alias(c) for c in probes.columns if c not in keys], F.col("__found.v").alias("value"))
