"""Has this key been seen before? Elias-Fano sets of key hashes, one a task, probed in order of arrival.

`seen_before` answers one table; `SeenTable` keeps the sets in files, so that each later batch only moves
its own keys and the coded sets."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.eliasfano import EliasFano, Seen
from quern.operators.compaction import commit, committed
from quern.session import hadoop_fs

#: Hash slots that are kept whole by the shuffle; tasks hold one or more of them.
SLOTS = 1 << 14
#: Keys that a task remembers while it reads its input, to answer repeats before the shuffle.
REMEMBERED = 1 << 16
#: Arrivals probed and merged at a time.
BATCH = 1 << 16

_SCHEMA = "arrival_id bigint, hash bigint, settled boolean, slot bigint"


def _heads(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, the least id of each, and for each row the index of its hash."""
    order = np.lexsort((ids, hashes))
    h = hashes[order]
    first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(first) - 1
    return h[first], ids[order][first], which


def _settle_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks rows that repeat a key with a smaller id in the same input, before anything is shuffled.

    What a task remembers is bounded and only saves work: a row that isn't settled here is answered
    after the shuffle. So a key that holds a third of all rows sends about a row a task to its slot.
    """
    known_h, known_id, known_hit = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        hashes = batch.column(1).to_numpy(zero_copy_only=False)
        if not len(ids):
            continue
        head, least, which = _heads(ids, hashes)
        at = np.minimum(np.searchsorted(known_h, head), max(len(known_h) - 1, 0))
        hit = (known_h[at] == head) if len(known_h) else np.zeros(len(head), bool)
        known_hit[at[hit]] = True
        earliest = least.copy()
        earliest[hit] = np.minimum(least[hit], known_id[at[hit]])
        known_id[at[hit]] = earliest[hit]
        settled = ids > earliest[which]
        fresh = ~hit
        if len(known_h) + fresh.sum() > REMEMBERED:
            known_h, known_id = known_h[known_hit][:REMEMBERED], known_id[known_hit][:REMEMBERED]
            known_hit = np.zeros(len(known_h), bool)
        all_h, all_id = np.r_[known_h, head[fresh]], np.r_[known_id, earliest[fresh]]
        all_hit = np.r_[known_hit, np.zeros(fresh.sum(), bool)]
        order = np.argsort(all_h, kind="stable")
        known_h, known_id, known_hit = all_h[order], all_id[order], all_hit[order]
        slot = (np.where(settled, ids * np.int64(-7046029254386353131), hashes).view(np.uint64) >> np.uint64(50)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hashes), pa.array(settled), pa.array(slot)], ["arrival_id", "hash", "settled", "slot"])


class _Prober:
    """Answers arrivals in order of their ids and adds their keys to a growing set."""

    def __init__(self, seen: Seen, bits: int):
        self.seen, self.bits = seen, bits
        self.tied, self.tied_id = np.zeros(0, np.uint64), None

    def __call__(self, ids: np.ndarray, hashes: np.ndarray, settled: np.ndarray) -> np.ndarray:
        got = settled.copy()
        asked = np.flatnonzero(~settled)
        if not len(asked):
            return got
        a, h = ids[asked], hashes[asked].view(np.uint64) >> np.uint64(64 - self.bits)
        head, least, which = _heads(a, h)
        before = self.seen.contains(head)
        self.seen.add(head[~before])
        answer = before[which] | (a > least[which])
        if self.tied_id is not None and len(self.tied):  # rows of one id over the edge of two batches don't precede each other
            answer &= ~((a == self.tied_id) & np.isin(h, self.tied))
        last = a.max()
        here = h[(a == last) & ~answer]
        self.tied = np.r_[self.tied, here] if last == self.tied_id else here
        self.tied_id = last
        got[asked] = answer
        return got


def _answer(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prober = _Prober(Seen(bits), bits)
        for ids, hashes, settled in _grouped(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(prober(ids, hashes, settled))], ["arrival_id", "seen"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of up to BATCH rows, in the order given."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BATCH:
            yield _arrays(held)
            held = []
    if held:
        yield _arrays(held)


def _arrays(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = pa.Table.from_batches(held)
    return t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_numpy().astype(bool)


def seen_before(arrivals: DataFrame, key: str, arrival: str = "arrival_id", warm: DataFrame | None = None, warm_key: str | None = None, bits: int = 64) -> DataFrame:
    """(arrival_id, seen): whether the key of each arrival occurred in `warm` or in an arrival with a smaller id.

    Keys are strings or bytes, compared by a hash of `bits` bits (at most 64, at least 8): nothing seen is
    ever missed, and a new key is wrongly called seen with the chance (keys seen) / 2^bits, see `report`.
    Arrivals with a null key or a null id have no row; empty keys are keys. Rows with the same id don't
    precede each other. Input order and partitioning don't matter. A task holds about 2 + log2(2^64 / n)
    bits for each of its n keys and never the keys themselves, and the shuffle moves 25 bytes a row.
    """
    if not 8 <= bits <= 64:
        raise ValueError("bits must be within 8 and 64")
    rows = arrivals.select(F.col(arrival).cast("bigint").alias("arrival_id"), F.xxhash64(key).alias("hash")).filter(F.col(arrival).isNotNull() & F.col(key).isNotNull())
    if warm is not None:
        first = F.lit(-(2**63)).cast("bigint")
        held = warm.filter(F.col(warm_key or key).isNotNull()).select(first.alias("arrival_id"), F.xxhash64(warm_key or key).alias("hash"))
        rows = rows.unionByName(held)
    marked = rows.mapInArrow(_settle_locally, _SCHEMA)
    ordered = marked.repartition("slot").sortWithinPartitions("arrival_id").select("arrival_id", "hash", "settled")
    answers = ordered.mapInArrow(_answer(bits), "arrival_id bigint, seen boolean")
    return answers.filter(F.col("arrival_id") > -(2**63)) if warm is not None else answers


def report(arrivals: DataFrame, key: str, arrival: str, warm: DataFrame, warm_key: str, bits: int = 64) -> DataFrame:
    """One row: answered, seen, exact_seen, wrong (counted against the keys themselves), wrong_rate, expected_rate.

    `expected_rate` is the chance that the next new key is wrongly called seen: distinct keys / 2^bits.
    Counts hold for arrivals with distinct ids.
    """
    answers = seen_before(arrivals, key, arrival, warm, warm_key, bits)
    told = answers.agg(F.count(F.lit(1)).alias("answered"), F.coalesce(F.sum(F.col("seen").cast("bigint")), F.lit(0)).alias("seen"))
    keys = arrivals.filter(F.col(arrival).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.lit(1).alias("a"))
    keys = keys.unionByName(warm.filter(F.col(warm_key).isNotNull()).select(F.col(warm_key).alias("k"), F.lit(0).alias("a")))
    each = keys.groupBy("k").agg(F.sum("a").alias("a"), F.min("a").alias("fresh"))
    true = each.agg(F.coalesce(F.sum("a") - F.sum("fresh"), F.lit(0)).alias("exact_seen"), F.count(F.lit(1)).alias("distinct_keys"))
    exact_seen, distinct_keys = true.first()  # two numbers
    both = told.withColumns({"exact_seen": F.lit(int(exact_seen)).cast("bigint"), "distinct_keys": F.lit(int(distinct_keys)).cast("bigint")})
    wrong = F.col("seen") - F.col("exact_seen")
    return both.select("answered", "seen", "exact_seen", wrong.alias("wrong"), F.when(F.col("answered") > 0, wrong / F.col("answered")).alias("wrong_rate"), (F.col("distinct_keys") / F.lit(2.0**bits)).alias("expected_rate"))


#: Sets that a `SeenTable` is made of: the leading bits of the hash name one. Ten billion keys are about 600,000 a set, 5 MB coded.
PARTS_BITS = 14
_KEPT = "part int, run int, coded binary"
_ROWS = "arrival_id bigint, seen boolean, part int, run int, coded binary"


def _extend(bits: int):
    """From rows (part, run, coded, arrival_id, hash, settled), a part's coded runs first: its answers, then its runs as they are after them."""

    def finish(part: int, seen: Seen) -> pa.RecordBatch:
        n = len(seen.runs)
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array([part] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([r.to_bytes() for r in seen.runs], pa.binary())], ["arrival_id", "seen", "part", "run", "coded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, prober = None, None
        for batch in batches:
            parts = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1), len(parts)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if parts[lo] != part:
                    if prober is not None:
                        yield finish(part, prober.seen)
                    part, prober = int(parts[lo]), _Prober(Seen(bits), bits)
                own = batch.slice(lo, hi - lo)
                coded = own.column(2).drop_null().to_pylist()
                prober.seen.runs += [EliasFano.of_bytes(c) for c in coded]
                own = own.slice(len(coded))
                if own.num_rows:
                    ids = own.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
                    told = prober(ids, own.column(4).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(own.column(5).to_pylist(), bool))
                    n = own.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(told), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["arrival_id", "seen", "part", "run", "coded"])
        if prober is not None:
            yield finish(part, prober.seen)

    return run


class SeenTable:
    """Keys seen so far, as coded sets in a folder that lasts; batches are answered one after the other.

    A batch's keys go to the sets of their leading hash bits, are answered in order of arrival and merged in.
    The new sets and the answers are written before one commit names them, so a batch that failed changes
    nothing and can be given again. What earlier batches brought moves as coded sets of some 6 bytes a key,
    never as keys. The sets of the version before the last are deleted; answers stay.
    """

    def __init__(self, spark: SparkSession, path: str, bits: int = 64):
        if not PARTS_BITS <= bits <= 64:
            raise ValueError(f"bits must be within {PARTS_BITS} and 64")
        self.spark, self.path, self.bits = spark, path, bits

    def _sets(self) -> tuple[int, dict, DataFrame]:
        number, state = committed(self.spark, f"{self.path}/commits")
        return number, state, self._read(state["sets"], _KEPT) if number else self.spark.createDataFrame([], _KEPT)

    def _read(self, name: str, schema: str) -> DataFrame:
        fs, path_of = hadoop_fs(self.spark, f"{self.path}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if fs.exists(path_of(f"{self.path}/{name}")) else self.spark.createDataFrame([], schema)

    def answer(self, arrivals: DataFrame, key: str, arrival: str = "arrival_id") -> DataFrame:
        """(arrival_id, seen) for a batch, as `seen_before` has them: against all earlier batches and this one's smaller ids. Null keys and ids have no row."""
        number, state, sets = self._sets()
        rows = arrivals.select(F.col(arrival).cast("bigint").alias("arrival_id"), F.xxhash64(key).alias("hash")).filter(F.col(arrival).isNotNull() & F.col(key).isNotNull())
        marked = rows.mapInArrow(_settle_locally, _SCHEMA)
        part = F.shiftrightunsigned(F.when(F.col("settled"), F.xxhash64("arrival_id")).otherwise(F.col("hash")), 64 - PARTS_BITS).cast("int")
        none = lambda kind: F.lit(None).cast(kind)
        asked = marked.select(part.alias("part"), none("int").alias("run"), none("binary").alias("coded"), "arrival_id", "hash", "settled")
        held = sets.select("part", "run", "coded", none("bigint").alias("arrival_id"), none("bigint").alias("hash"), none("boolean").alias("settled"))
        both = held.unionByName(asked).repartition("part").sortWithinPartitions("part", F.col("run").asc_nulls_last(), "arrival_id")
        name = f"v-{uuid.uuid4().hex}"
        both.mapInArrow(_extend(self.bits), _ROWS).withColumn("what", F.when(F.col("part").isNull(), "answers").otherwise("sets")).write.partitionBy("what").parquet(f"{self.path}/{name}")
        commit(self.spark, f"{self.path}/commits/{number + 1:012d}.json", {"sets": f"{name}/what=sets", "before": state.get("sets")})
        if state.get("before"):
            fs, path_of = hadoop_fs(self.spark, self.path)
            fs.delete(path_of(f"{self.path}/{state['before']}"), True)
        return self._read(f"{name}/what=answers", "arrival_id bigint, seen boolean")

    def keys(self) -> int:
        """How many distinct hashes are held; a new key is wrongly called seen with the chance keys / 2^bits."""
        return int(self._sets()[2].agg(F.coalesce(F.sum(F.conv(F.hex(F.substring("coded", 1, 8)), 16, 10).cast("bigint")), F.lit(0))).first()[0])
