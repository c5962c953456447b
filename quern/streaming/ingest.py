"""Streaming: folders that are watched, records counted by the second, monitors and change feeds with state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators import changefeed
from quern.operators.compaction import commit, committed
from quern.operators.monitors import JUMP
from quern.operators.prefix import same_keys
from quern.operators.store import SCHEMA as STORE_SCHEMA
from quern.operators.store import Store
from quern.session import hadoop_fs
from quern.sources import exposition, files


def watch_metrics(spark: SparkSession, path: str, files_at_once: int = 1, done: str | None = None) -> DataFrame:
    """A stream of parsed lines of metric files as they come, oldest first; `done` archives files that were read."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_at_once).option("latestFirst", "false")
    if done:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", done)
    lines = reader.text(path).withColumn("file", F.col("_metadata.file_path"))
    return exposition.parse(lines)


def load_metrics(parsed: DataFrame, path: str, checkpoint: str):
    """Starts appending the samples of parsed lines to a folder, batch by batch; a batch that is done again replaces itself."""

    def store(batch: DataFrame, number: int) -> None:
        exposition.load(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return parsed.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_logs(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """A stream of log records of the JSON lines in a folder, oldest files first; malformed lines have nulls. The checkpoint of the query that reads it remembers which files were read."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_at_once).option("latestFirst", "false").text(path)
    return files.log_lines(lines)


def tail_logs(spark: SparkSession, path: str, out: str, checkpoint: str, files_at_once: int = 100):
    """Starts appending the log records of a folder's files to a table as they come; a batch that is done again replaces itself."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return watch_logs(spark, path, files_at_once).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_runs(spark: SparkSession, path: str, store: str, checkpoint: str, files_at_once: int = 100, rows_per_file: int = 0):
    """Starts ingesting files of records (key, ts, value) into a store as they come: a sorted run a batch, cut into files of at most `rows_per_file`. A batch that is done again is known by its number."""

    def take(batch: DataFrame, number: int) -> None:
        Store(spark, store).ingest(batch, rows_per_file=rows_per_file, token=(checkpoint, number))

    stream = spark.readStream.schema(STORE_SCHEMA).option("maxFilesPerTrigger", files_at_once).option("latestFirst", "false").parquet(path)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def per_second(records: DataFrame, ts: str, late: str = "10 seconds") -> DataFrame:
    """(second, n): records in tumbling seconds; a second closes once the stream is `late` past it. Seconds without records come from `fill`."""
    return records.withWatermark(ts, late).groupBy(F.window(ts, "1 second").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("second"), "n")


def fill(seconds: DataFrame) -> DataFrame:
    """Closed seconds with the empty ones between them, for a batch of them."""
    low, high = seconds.agg(F.min(F.unix_seconds("second")), F.max(F.unix_seconds("second"))).first()
    grid = seconds.sparkSession.range(low or 0, (high or 0) + 1 if low is not None else 0).select(F.timestamp_seconds("id").alias("second"))
    return grid.join(seconds, "second", "left").fillna(0, ["n"])


def first_of_each(records: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Repeats of a record within the lateness are dropped; state older than that goes."""
    return records.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def alerts(readings: DataFrame, monitor: str, threshold: float = 0.0) -> DataFrame:
    """(key, readings, firing, value, fired_at, first_condition, latest_condition) for each key and batch: a monitor and its latch, kept as state.

    `readings` has (key string, at bigint, a double, b double, reset boolean). The monitors are those of
    `operators.monitors`: `stationary` (the counter a), `success_rate` (counters a and b, at least `threshold`),
    `below` and `above` (the gauge a); counters are 0 before the first reading. `firing` says whether it
    fired at any reading of the batch, `value` is the last a (null for NaN). The latch keeps its first firing reading and
    the condition then and at the latest firing one (the rate, else a) until a reset at or behind that. A
    batch of a key is as large as the trigger lets it be, and is ordered by `at` as a whole. Readings with a null
    key, place or counter don't count.
    """
    if monitor not in ("stationary", "success_rate", "below", "above"):
        raise ValueError(f"no monitor: {monitor}")

    def step(keys: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_a, last_b, fired_at, first, latest = state.get if state.exists else (0.0, 0.0, None, None, None)
        last_a, last_b = (float("nan") if x is None else x for x in (last_a, last_b))  # NaN comes back from the state as null
        rows = pd.concat(list(pieces)).sort_values("at", kind="stable")
        at, a, b = (rows[c].to_numpy() for c in ("at", "a", "b"))
        condition = a
        if monitor == "stationary":
            firing = a != np.r_[last_a, a[:-1]]
        elif monitor == "success_rate":
            good, bad = np.diff(a, prepend=last_a), np.diff(b, prepend=last_b)
            odd = (good < 0) | (bad < 0) | (good >= JUMP) | (bad >= JUMP) | (good + bad <= 0)
            condition = np.divide(good, good + bad, out=np.full(len(a), np.nan), where=~odd)
            firing = odd | (condition < threshold)
        else:
            firing = ~(a < threshold if monitor == "below" else a > threshold)
        resets = np.flatnonzero(rows["reset"].to_numpy(bool))
        since = resets[-1] + 1 if len(resets) else 0
        if since:
            fired_at = first = latest = None
        held = np.flatnonzero(firing[since:]) + since
        if len(held):
            if fired_at is None:
                fired_at, first = int(at[held[0]]), float(condition[held[0]])
            latest = float(condition[held[-1]])
        state.update((float(a[-1]), float(b[-1]), fired_at, first, latest))
        yield pd.DataFrame({"key": [keys[0]], "readings": [len(a)], "firing": [bool(firing.any())], "value": [a[-1]], "fired_at": pd.array([fired_at], "Int64"), "first_condition": [first], "latest_condition": [latest]})

    columns = [F.col("at").cast("bigint").alias("at"), F.coalesce(F.col("a").cast("double"), F.lit(float("nan")) if monitor in ("below", "above") else F.lit(None)).alias("a"), F.coalesce(F.col("b").cast("double"), F.lit(0.0)).alias("b"), F.coalesce("reset", F.lit(False)).alias("reset")]
    rows = readings.select(F.col("key").cast("string").alias("key"), *columns).filter("key is not null and at is not null and a is not null")
    out = "key string, readings bigint, firing boolean, value double, fired_at bigint, first_condition double, latest_condition double"
    return rows.groupBy("key").applyInPandasWithState(step, out, "last_a double, last_b double, fired_at bigint, first double, latest double", "update", GroupStateTimeout.NoTimeout)


#: Parts of a streamed state, and runs of one that are merged into one when there are more.
BUCKETS, RUNS = 64, 8


def apply_changes(changes: DataFrame, keys: list[str], path: str, checkpoint: str, txn: list[str] | None = None, seq: str | None = None, **names: str):
    """Starts applying a change feed to a table in files, in commit order.

    With `seq` a batch moves the contiguous watermark of those numbers on; changes behind it, and with `txn`
    those of transactions that aren't complete at it, wait in `pending` until later batches, or `seal`, let
    them through. What is let through is combined and added to the state as a run in each bucket that it
    touches; a bucket of more than RUNS runs is merged. The state keeps deletes, so a change that comes late is
    judged by its place in commit order, not by its arrival; `read_state` shows the keys alive. A batch ends in
    one numbered commit that names its folders, so doing it again changes nothing; folders that no commit of the
    last two names are deleted.
    """

    def merge(batch: DataFrame, number: int) -> None:
        _merge(batch.sparkSession, batch, number, keys, path, txn, seq, names, False)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def seal(spark: SparkSession, path: str, keys: list[str], txn: list[str] | None = None, seq: str | None = None, **names: str) -> None:
    """Ends a feed: numbers that are still missing are declared void, and all that waits is applied."""
    _merge(spark, None, None, keys, path, txn, seq, names, True)


def _merge(spark: SparkSession, batch: DataFrame | None, number: int | None, keys: list[str], path: str, txn: list[str] | None, seq: str | None, names: dict, last: bool) -> None:
    ts, pos, op, value = (names.get(k, d) for k, d in (("ts", "ts"), ("position", "batch_pos"), ("op", "op"), ("value", "val")))
    at, state = committed(spark, f"{path}/commits")
    if number is not None and state.get("batch", -1) >= number:
        return
    wanted = list(dict.fromkeys([*keys, *(txn or []), ts, pos, op, value, *([seq] if seq else [])]))
    rows = batch.select(*wanted) if batch is not None else None
    if state.get("pending"):
        waiting = spark.read.parquet(f"{path}/{state['pending']}").select(*wanted)
        rows = waiting if rows is None else rows.unionByName(waiting)
    if rows is None:
        return
    name = uuid.uuid4().hex
    fs, path_of = hadoop_fs(spark, path)
    listed = lambda folder: [p.getPath().getName() for p in fs.listStatus(path_of(f"{path}/{folder}"))]
    dead = changefeed.is_delete(F.col(op), F.col(value))
    good = F.col(ts).isNotNull()
    for k in keys:
        good = good & F.col(k).isNotNull()
    held, mark, flagged = F.lit(False), state.get("mark", 0), rows
    if seq:
        void = changefeed.gaps(rows, seq, mark + 1) if last else None
        mark = changefeed.contiguous_watermark(rows, seq, mark + 1, void).first()[0]
        held = F.coalesce(F.col(seq) > F.lit(mark), F.lit(False))
    if txn:
        parts = rows.filter(good).withColumn("__done", F.xxhash64(dead, F.when(~dead, F.col(value))))
        open_ = changefeed.held_transactions(parts, txn, [*keys, ts, pos, "__done"], mark if seq else None, seq)
        open_.write.parquet(f"{path}/held-{name}")
        open_ = spark.read.schema(open_.schema).parquet(f"{path}/held-{name}")
        if n := open_.limit(changefeed.BROADCAST_HELD + 1).count():
            open_ = open_.select(*[F.col(c).alias(f"__t_{c}") for c in txn], F.lit(True).alias("__open"))
            flagged = rows.join(F.broadcast(open_) if n <= changefeed.BROADCAST_HELD else open_, same_keys(txn, "__t_"), "left")
            held = held | F.coalesce("__open", F.lit(False))
    waits = None
    if (seq or txn) and not last:
        waits = f"pending-{name}"
        flagged.filter(held).select(*wanted).write.parquet(f"{path}/{waits}")
    order = F.struct(F.col(ts).alias("t"), F.coalesce(F.col(pos).cast("bigint"), F.lit(-(2**62))).alias("p"), dead.alias("d"), F.col(pos).alias("q"), F.when(~dead, F.col(value)).alias("v"))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    newest = lambda c, df: df.groupBy(*keys).agg(F.max(c).alias("__c")).withColumn("__bucket", bucket).repartition("__bucket").write.partitionBy("__bucket")
    newest(order, flagged.filter(~held).filter(good)).parquet(f"{path}/v-{name}")
    buckets = {b: list(runs) for b, runs in state.get("buckets", {}).items()}
    for folder in listed(f"v-{name}"):
        if folder.startswith("__bucket="):
            buckets.setdefault(folder.removeprefix("__bucket="), []).append(f"v-{name}/{folder}")
    long = {b: runs for b, runs in buckets.items() if len(runs) > RUNS}  # at most BUCKETS
    if long:
        newest("__c", spark.read.parquet(*[f"{path}/{r}" for runs in long.values() for r in runs]).select(*keys, "__c")).parquet(f"{path}/m-{name}")
        buckets |= {b: [f"m-{name}/__bucket={b}"] for b in long}
    used = lambda of: {*(r for runs in of.get("buckets", {}).values() for r in runs), *([of["pending"]] if of.get("pending") else [])}
    now = {"batch": number if number is not None else state.get("batch", -1), "mark": mark, "pending": waits, "buckets": buckets}
    commit(spark, f"{path}/commits/{at + 1:012d}.json", now | {"gone": sorted(used(state) - used(now))})
    for folder in (f"held-{name}", *state.get("gone", [])):
        fs.delete(path_of(f"{path}/{folder}"), True)


def read_state(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(keys, ts, batch_pos, val): the keys alive in the newest commit; there must be one."""
    runs = [r for of in committed(spark, f"{path}/commits")[1]["buckets"].values() for r in of]
    if not runs:
        raise ValueError(f"nothing was applied to {path}")
    state = spark.read.parquet(*[f"{path}/{r}" for r in runs]).groupBy(*keys).agg(F.max("__c").alias("__c")).filter("not __c.d")
    return state.select(*keys, F.col("__c.t").alias("ts"), F.col("__c.q").alias("batch_pos"), F.col("__c.v").alias("val"))
