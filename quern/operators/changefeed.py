"""Replaying a feed of inserts, updates and deletes in commit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.prefix import carried, same_keys
from quern.session import materialize

#: The spellings of a delete in a feed, in lower case.
DELETES = ("d", "del", "delete")
#: Sequence numbers are kept as words of 64 bits, and swept in slices of so many words (a power of two).
SLICE_BITS = 12
#: Held transactions of up to this many may be broadcast; more are joined by transaction.
BROADCAST_HELD = 200_000


def is_delete(op: Column, value: Column) -> Column:
    """A change is a delete if its op says so in any case, or if it brings no value."""
    return F.coalesce(F.lower(F.trim(op)).isin(*DELETES), F.lit(False)) | value.isNull()


def _words(numbers: DataFrame, word: Column, bits: Column) -> DataFrame:
    """(w, bits): which of the 64 numbers from 64 w on occur, combined task by task."""
    return numbers.groupBy(word.alias("w")).agg(F.bit_or(bits).alias("bits"))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place.cast("int"))


def _numbers(changes: DataFrame, seq: str, start: int) -> DataFrame:
    return changes.select((F.col(seq).cast("bigint") - start).alias("x")).filter("x >= 0")


def _low_ones(bits: Column) -> Column:
    """How many of the lowest bits are set before the first that isn't."""
    free = F.bitwise_not(bits)
    lowest = F.lit(-(2**63)).cast("bigint")
    return F.when(free == lowest, F.lit(63)).otherwise(F.bit_count(free.bitwiseAND(-F.when(free != lowest, free).otherwise(F.lit(1))) - 1)).cast("int")


def _swept(rows: DataFrame, order: str, end: str) -> DataFrame:
    """Rows with `reach`: the greatest `end` of those with a smaller `order` (a number of words), -1 before the first. Slices' greatest ends are carried over."""
    rows = rows.withColumn("__slice", F.shiftright(F.col(order), SLICE_BITS))
    before = Window.partitionBy("__slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__own", F.max(end).over(before))
    tops = carried(rows.groupBy("__slice").agg(F.max(end).alias("__end")), [], "__slice", "__end", "__ahead", "max")
    tops = tops.select(F.col("__slice").alias("__k"), "__ahead")
    reach = F.greatest(F.coalesce("__own", F.lit(-1)), F.coalesce("__ahead", F.lit(-1)))
    return rows.join(tops, F.col("__slice") == F.col("__k")).withColumn("reach", reach).drop("__slice", "__own", "__k", "__ahead")


def gaps(changes: DataFrame, seq: str, start: int = 1) -> DataFrame:
    """(first, last): the runs of numbers from `start` on that are missing below the greatest that has occurred.

    What a source declares void when it ends a feed. Null numbers and numbers before the start don't count.
    """
    x = F.col("x")
    words = _words(_numbers(changes, seq, start), F.shiftright(x, 6), _bit(x.bitwiseAND(F.lit(63))))
    held = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", F.col("bits"), i).bitwiseAND(F.lit(1)) == 1)
    at = words.withColumn("__at", F.transform(F.when(F.col("bits") == -1, F.array(F.lit(0), F.lit(63))).otherwise(held), lambda i: i + F.col("w") * 64))
    at = at.withColumns({"__last": F.element_at("__at", -1), "__full": F.col("bits") == -1})
    swept = _swept(at, "w", "__last")
    edges = F.concat(F.array("reach"), F.when(F.col("__full"), F.slice("__at", 1, 1)).otherwise(F.col("__at")))
    pairs = F.zip_with(edges, F.slice(edges, F.lit(2), F.size(edges) - 1), lambda a, b: F.struct((a + 1 + start).alias("first"), (b - 1 + start).alias("last")))
    return swept.select(F.explode(F.filter(pairs, lambda p: p["first"] <= p["last"])).alias("g")).select("g.first", "g.last")


def contiguous_watermark(changes: DataFrame, seq: str, start: int = 1, declared: DataFrame | None = None) -> DataFrame:
    """One row (watermark): the largest s such that all of start..s have occurred or are `declared` void; start - 1 if none.

    `declared` has runs (first, last) of numbers that will never come. Null numbers, empty runs and numbers
    before the start don't count. Numbers and the ends of runs are bits of words; runs of whole words stay runs.
    """
    x = F.col("x")
    marks = _numbers(changes, seq, start).select(F.shiftright(x, 6).alias("w"), _bit(x.bitwiseAND(F.lit(63))).alias("bits"))
    runs = None
    if declared is not None:
        a, b = F.greatest(F.col("first").cast("bigint") - start, F.lit(0)), F.col("last").cast("bigint") - start
        void = declared.select(a.alias("a"), b.alias("b")).filter("a <= b").withColumns({"wa": F.shiftright("a", 6), "wb": F.shiftright("b", 6)})
        up = F.call_function("shiftleft", F.lit(-1).cast("bigint"), F.col("a").bitwiseAND(F.lit(63)).cast("int"))
        down = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), (63 - F.col("b").bitwiseAND(F.lit(63))).cast("int"))
        same = F.col("wa") == F.col("wb")
        ends = F.when(same, F.array(F.struct(F.col("wa").alias("w"), up.bitwiseAND(down).alias("bits")))).otherwise(F.array(F.struct(F.col("wa").alias("w"), up.alias("bits")), F.struct(F.col("wb").alias("w"), down.alias("bits"))))
        marks = marks.unionByName(void.select(F.explode(ends).alias("m")).select("m.*"))
        runs = void.filter("wb - wa > 1").select((F.col("wa") + 1).alias("w"), F.lit(-1).cast("bigint").alias("bits"), (F.col("wb") - 1).alias("e"))
    words = _words(marks, F.col("w"), F.col("bits")).withColumn("e", F.when(F.col("bits") == -1, F.col("w")).otherwise(F.col("w") - 1))
    if runs is not None:
        words = words.unionByName(runs).groupBy("w").agg(F.max("e").alias("e"), F.bit_or("bits").alias("bits"))
    swept = _swept(words, "w", "e")
    ahead = F.when(F.col("w") > F.col("reach") + 1, F.struct((F.col("reach") + 1).alias("w"), F.lit(0).alias("t")))
    part = F.when((F.col("e") < F.col("w")) & (F.col("w") == F.col("reach") + 1), F.struct(F.col("w").alias("w"), (-_low_ones(F.col("bits"))).alias("t")))
    hole = F.min(F.coalesce(ahead, part))  # of one word the most numbers
    found = swept.agg(hole.alias("h"), F.max("e").alias("e"))
    at = F.coalesce(F.col("h.w") * 64 - F.col("h.t"), (F.col("e") + 1) * 64, F.lit(0))
    return found.select((at + start - 1).cast("bigint").alias("watermark"))


def held_transactions(changes: DataFrame, txn: Sequence[str], parts: Sequence[str], mark: int | None = None, seq: str | None = None, size: str | None = None) -> DataFrame:
    """(txn..., have): the transactions that aren't complete.

    A transaction's changes are told apart by a 64-bit hash of `parts` (its keys, the position, what is done).
    It is held while it has fewer of them than its greatest `size` says, or one whose first number lies behind
    the watermark `mark`; a change repeated under a later number counts by its first, one without a number
    is never waited for. Null sizes say nothing. Changes, then transactions are combined task by task.
    """
    first = F.min(F.coalesce(F.col(seq).cast("bigint"), F.lit(-(2**62)))) if seq else F.lit(-(2**62))
    want = F.max(size) if size else F.lit(None).cast("bigint")
    once = changes.groupBy(*txn, F.xxhash64(*parts).alias("__part")).agg(first.alias("__first"), want.alias("__want"))
    each = once.groupBy(*txn).agg(F.count(F.lit(1)).alias("have"), F.max("__want").alias("__want"), F.max("__first").alias("__late"))
    late = F.col("__late") > F.lit(mark) if mark is not None else F.lit(False)
    return each.filter(F.coalesce(F.col("have") < F.col("__want"), F.lit(False)) | late).select(*txn, "have")


def without(rows: DataFrame, held: DataFrame, txn: Sequence[str]) -> DataFrame:
    """The rows whose transaction isn't held (null equals null). `held` is to be a written table; it is broadcast if it is short, and nothing is joined if it is empty."""
    n = held.limit(BROADCAST_HELD + 1).count()
    if not n:
        return rows
    held = held.select(*[F.col(c).alias(f"__t_{c}") for c in txn])
    return rows.join(F.broadcast(held) if n <= BROADCAST_HELD else held, same_keys(txn, "__t_"), "left_anti")


def replay(
    changes: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    position: str = "batch_pos",
    op: str = "op",
    value: str = "val",
    txn: Sequence[str] | None = None,
    txn_size: str | None = None,
    seq: str | None = None,
    declared: DataFrame | None = None,
    start: int = 1,
) -> DataFrame:
    """The state of every key that is alive after the feed's committed part: keys, ts, position, value.

    Changes are ordered by (ts, position), the commit order of write batches, whatever order they arrived
    in; repeats therefore change nothing. Where `seq` is given, the committed part ends at the contiguous
    watermark of those numbers: a missing number holds all that lies behind it, unless it is `declared` void
    (runs first, last), as a source does when its feed ends. Where `txn` names the columns of a transaction,
    complete ones alone are applied, see `held_transactions`; `txn_size` names the number of changes that
    each must have. Keys are independent and each is replayed by map-side combining, so a hot key costs one
    row a task. A change with a null key column or null ts never counts, a null position comes first in its
    batch, a change without a number isn't held by the watermark; of different changes at one (ts, position)
    a delete wins, then the greatest value.
    """
    dead = is_delete(F.col(op), F.col(value))
    rows = changes.filter(F.col(ts).isNotNull())
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    mark = contiguous_watermark(changes, seq, start, declared).first()[0] if seq else None  # one number, so that the filter reaches the scan
    if txn:
        done = rows.withColumns({"__done": F.xxhash64(dead, F.when(~dead, F.col(value)))})
        held = materialize(held_transactions(done, txn, [*keys, ts, position, "__done"], mark, seq, txn_size), "held")
        rows = without(rows, held, txn)
    if mark is not None:
        rows = rows.filter(F.col(seq).isNull() | (F.col(seq) <= mark))
    last = F.max(F.struct(F.col(ts).alias("t"), F.coalesce(F.col(position).cast("bigint"), F.lit(-(2**62))).alias("p"), dead.alias("d"), F.col(position).alias("q"), F.when(~dead, F.col(value)).alias("v"))).alias("__last")
    state = rows.groupBy(*keys).agg(last).filter(~F.col("__last.d"))
    return state.select(*keys, F.col("__last.t").alias(ts), F.col("__last.q").alias(position), F.col("__last.v").alias(value))
