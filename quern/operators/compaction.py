"""Consolidation of many small files: frozen manifest, bin packing, rewrite, verification, atomic commit."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.binpack import Segment, first_fit_decreasing
from quern.operators.prefix import prefix_sums
from quern.session import hadoop_fs, materialize, workspace

TARGET_BYTES = 128 << 20
#: Files below this part of the target, and what is left of the others' bins, are filled in by running sums of their exact sizes.
SMALL = 1024
#: Larger sizes are packed in classes of this many to an octave, rounded up by 1/64 at most.
CLASSES = 64
#: Small files find their bin by the block of their running sum, of so many.
BLOCKS = 4096
#: Bins that are rewritten by one job, a task each.
WAVE = 1 << 16

SEGMENT = T.StructType(
    [
        T.StructField("size_class", T.LongType()),
        T.StructField("first_rank", T.LongType()),
        T.StructField("per_bin", T.LongType()),
        T.StructField("first_bin", T.LongType()),
        T.StructField("bins", T.LongType()),
    ]
)
ROOMS = T.StructType([T.StructField(n, T.LongType()) for n in ("block", "from_bytes", "to_bytes", "step", "start_bin")])


class CompactionMismatch(RuntimeError):
    """What was written isn't what was read; nothing was committed."""


@dataclass(frozen=True)
class Compaction:
    """A committed rewrite: the records kept, the bin of each file, and what was counted."""

    records: DataFrame
    bins: DataFrame
    report: dict


def checksum(*columns: Column | str) -> Column:
    """A row's 64-bit content hash as a decimal, whose sum doesn't depend on order or partitioning."""
    return F.xxhash64(*columns).cast("decimal(20,0)")


def _size_class(size: Column, quantum: int) -> Column:
    """A size in quanta, up to 128 of them exact, above that rounded up to one of 64 classes an octave."""
    units = F.ceil(size / F.lit(quantum)).cast("bigint")
    digits = F.length(F.bin(units - 1))
    step = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(F.lit(0), digits - CLASSES.bit_length()).cast("int"))
    return (F.ceil(units / step) * step).cast("bigint")


def assign_bins(files: DataFrame, target_bytes: int = TARGET_BYTES) -> tuple[DataFrame, int]:
    """(file_id, size_bytes, bin_id, parts) for `files` (file_id, size_bytes), and the number of bins, numbered from 0.

    First-fit decreasing. Files of a 1,024th of the target or more are packed on a histogram of their sizes,
    rounded up by 1/64 at most; the smaller ones, which come last in that order, are poured by their exact
    sizes into the room that is left, bin after bin, and into new bins. No bin exceeds the target, and
    a bin that is followed by another of small files is full up to two 1,024ths. Files larger than the
    target are cut among as many bins of their own as they need (`parts`), behind the others. The driver
    sees only the histogram, some 700 rows. Null or negative sizes count as 0; equal files are ordered by a
    hash of file_id, so the result is the same on every run.
    """
    spark = files.sparkSession
    least = max(1, target_bytes // SMALL)
    quantum = max(1, least // CLASSES)
    capacity = target_bytes // quantum
    size = F.greatest(F.coalesce("size_bytes", F.lit(0)), F.lit(0)).cast("bigint")
    files = files.select("file_id", size.alias("size_bytes"))
    files = files.withColumn("size_class", F.when(F.col("size_bytes") < least, F.lit(0).cast("bigint")).when(F.col("size_bytes") <= target_bytes, F.least(_size_class(F.col("size_bytes"), quantum), F.lit(capacity))))
    counts = {r[0]: r[1:] for r in files.groupBy("size_class").agg(F.count(F.lit(1)), F.sum("size_bytes"), F.sum(F.ceil(F.col("size_bytes") / F.lit(target_bytes)))).collect()}
    middle = {c: n[0] for c, n in counts.items() if c}
    segments, opened = first_fit_decreasing(middle, capacity)
    small_files, small_bytes, _ = counts.get(0, (0, 0, 0))

    table = spark.createDataFrame([tuple(map(int, x)) for x in segments], SEGMENT)  # at most about 2 x 700 rows
    ranked = prefix_sums(files.filter("size_class > 0"), ["size_class"], ["file_id"], out="rank")
    inside = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("per_bin") * F.col("bins"))
    packed = ranked.join(F.broadcast(table), "size_class").filter(inside)
    at = F.col("first_bin") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("per_bin")).cast("bigint")
    packed = packed.select("file_id", "size_bytes", at.alias("bin_id"), F.lit(1).cast("bigint").alias("parts"))

    rooms, opened = _rooms(segments, opened, capacity, quantum, least, small_files, small_bytes)
    block = max(1, small_bytes // BLOCKS)
    spans = [(b, *r) for r in rooms for b in range(r[0] // block, min(r[1] - 1, small_bytes) // block + 1)]  # at most the rooms and BLOCKS
    table = spark.createDataFrame(spans, ROOMS)
    small = prefix_sums(files.filter("size_class = 0"), [], ["file_id"], weight=F.col("size_bytes"), out="before")
    inside = (F.col("before") >= F.col("from_bytes")) & (F.col("before") < F.col("to_bytes"))
    poured = small.withColumn("block", F.floor(F.col("before") / F.lit(block)).cast("bigint")).join(F.broadcast(table), "block").filter(inside)
    at = F.col("start_bin") + F.floor((F.col("before") - F.col("from_bytes")) / F.col("step")).cast("bigint")
    packed = packed.unionByName(poured.select("file_id", "size_bytes", at.alias("bin_id"), F.lit(1).cast("bigint").alias("parts")))

    large = files.filter("size_class is null").withColumn("parts", F.ceil(F.col("size_bytes") / F.lit(target_bytes)).cast("bigint"))
    large = prefix_sums(large, [], ["file_id"], weight=F.col("parts"), out="rank")
    large = large.select("file_id", "size_bytes", (F.col("rank") + opened).alias("bin_id"), "parts")
    return packed.unionByName(large), opened + int(counts[None][2] if None in counts else 0)


def _rooms(segments: list[Segment], opened: int, capacity: int, quantum: int, least: int, files: int, total: int) -> tuple[list[tuple], int]:
    """(from_bytes, to_bytes, step, start_bin) runs of bins with equal room, in order, for `total` bytes of small files; and the bins there are then.

    A file that starts within a bin's step ends less than `least` behind it, so a step is the room less that.
    """
    edges = sorted({s.first_bin for s in segments} | {s.first_bin + s.bins for s in segments})
    change: dict[int, int] = dict.fromkeys(edges, 0)
    for s in segments:
        change[s.first_bin] += s.size * s.per_bin
        change[s.first_bin + s.bins] -= s.size * s.per_bin
    rooms, poured, used = [], 0, 0
    for first, end in zip(edges, edges[1:], strict=False):
        used += change[first]
        step = (capacity - used) * quantum - least + 1
        if step > 0 and files and poured <= total:
            rooms.append((poured, poured + step * (end - first), step, first))
            poured += step * (end - first)
    if files and poured <= total:
        step = capacity * quantum - least + 1
        more = (total - poured) // step + 1
        rooms.append((poured, poured + step * more, step, opened))
        opened += more
    return rooms, opened


def _rewrite(placed: DataFrame, bins: int, order: Sequence[str], out: str) -> None:
    """Writes rows with a bin_id as one sorted file a bin, without folders; more than WAVE bins in that many jobs."""
    spark = placed.sparkSession
    if bins > WAVE:
        staged = workspace(spark, "waves")
        placed.withColumn("__wave", F.floor(F.col("bin_id") / WAVE).cast("int")).write.partitionBy("__wave").parquet(staged)
        again = spark.read.parquet(staged)
    for first in range(0, max(1, bins), WAVE):
        part = again.filter(F.col("__wave") == first // WAVE).drop("__wave") if bins > WAVE else placed
        own = part.repartitionById(max(1, min(WAVE, bins - first)), (F.col("bin_id") - first).cast("int"))
        own.sortWithinPartitions("bin_id", *order).write.mode("append").parquet(out)


def compact(records: DataFrame, manifest: DataFrame, identity: Sequence[str], order: str, target: str | None = None, target_bytes: int = TARGET_BYTES, file: str = "file_id") -> Compaction:
    """Rewrites the records of all files, each distinct record once, into bins of about `target_bytes`.

    A record is identified by the columns `identity` (null equals null, bytes exactly); of copies the one
    with the smallest `order` stays, with the file it was in. The manifest may be wrong or incomplete: a
    file's size is measured as the bytes of the records it keeps, and the frozen file list is that of the
    manifest and the records together; a null `file` is a file of its own. Files that keep nothing are listed
    with size 0. A bin is one file, sorted by `identity`. Before the commit the output is read back and
    compared with the input: the copies of all rows written must add up to the rows read, and the
    order-free content checksum over the rows written, each times its copies, to that over the rows read; a
    mismatch raises and commits nothing. The commit is a small JSON file that can only be made once, and
    readers see only the folder it names, so a lost executor or a second attempt leaves no half result.
    Other columns of `records`, whatever their names, don't count.
    """
    spark = records.sparkSession
    target = target or workspace(spark, "compacted")
    width = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in identity if dict(records.dtypes)[c] in ("string", "binary")), F.lit(8))
    rows = records.select(F.col(order).alias("__order"), F.col(file).alias("file_id"), *identity)
    first = F.min(F.struct("__order", "file_id")).alias("__first")
    kept = rows.groupBy(*identity).agg(first, F.count(F.lit(1)).alias("__copies"))
    kept = materialize(kept.select(*identity, "__copies", "__first.__order", "__first.file_id"), "kept")
    names = manifest.select(F.col(file).alias("file_id")).unionByName(rows.select("file_id")).select("file_id", F.lit(0).cast("bigint").alias("size_bytes"))
    listed = names.unionByName(kept.select("file_id", width.cast("bigint").alias("size_bytes")))
    frozen = f"{target}/frozen"
    listed.groupBy("file_id").agg(F.sum("size_bytes").alias("size_bytes")).write.parquet(frozen)
    bins, opened = assign_bins(spark.read.parquet(frozen), target_bytes)
    bins.write.parquet(f"{target}/bins")
    bins = spark.read.parquet(f"{target}/bins")

    content = checksum(*identity)
    homes = bins.select(F.col("file_id").alias("__file"), "bin_id", "parts")
    placed = kept.join(homes, F.col("file_id").eqNullSafe(F.col("__file")), "left").drop("__file")
    share = F.pmod(F.xxhash64(*identity), F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("bin_id", F.coalesce(F.col("bin_id") + share, F.lit(0))).drop("parts")
    out = f"{target}/data"
    _rewrite(placed, opened, identity, out)

    total = F.coalesce(F.sum(content), F.lit(0)).cast("decimal(38,0)")
    read = rows.agg(F.count(F.lit(1)), total).first()
    again = spark.read.schema(placed.schema).parquet(out)
    copied = F.coalesce(F.sum(content * F.col("__copies")), F.lit(0)).cast("decimal(38,0)")
    wrote = again.agg(F.coalesce(F.sum("__copies"), F.lit(0)), copied, F.count(F.lit(1))).first()
    if (read[0], read[1]) != (wrote[0], wrote[1]):
        raise CompactionMismatch(f"read {read[0]} rows with checksum {read[1]}, wrote {wrote[0]} with {wrote[1]}")
    report = {"rows_read": read[0], "rows_written": wrote[2], "checksum": str(read[1]), "bins": opened}
    commit(spark, f"{target}/COMMITTED", report | {"data": "data"})
    return Compaction(again.select(F.col("__order").alias(order), F.col("file_id").alias(file), *identity, F.col("__copies").alias("copies"), "bin_id"), bins, report)


def compact_folder(spark: SparkSession, source: str, target: str, target_bytes: int = TARGET_BYTES, file_format: str = "parquet", **options: str) -> Compaction:
    """Rewrites a folder of real files, of any format that Spark reads, as parquet files of about `target_bytes` each; every row stays, repeats too.

    The manifest is listed once and frozen: path, size, time of change and rows of each file. Files that come
    later aren't touched. A file that is changed or removed meanwhile leaves fewer rows than the manifest says,
    which raises, like a difference of the content checksum, and commits nothing. A file larger than the
    target is cut among several. Files without rows have nothing to move and aren't listed.
    """
    rows = spark.read.format(file_format).options(**options).load(source)
    columns = rows.columns
    meta = [F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_size").alias("__size"), F.col("_metadata.file_modification_time").alias("__changed")]
    begins = F.col("_metadata.file_block_start").alias("__begins")
    frozen = f"{target}/frozen"
    rows.select(*meta).groupBy("__path", "__size", "__changed").agg(F.count(F.lit(1)).alias("__rows")).write.parquet(frozen)
    listed = spark.read.parquet(frozen)
    bins, opened = assign_bins(listed.select(F.col("__path").alias("file_id"), F.col("__size").alias("size_bytes")), target_bytes)
    bins.write.parquet(f"{target}/bins")
    bins = spark.read.parquet(f"{target}/bins")
    homes = listed.join(bins.withColumnRenamed("file_id", "__path"), "__path").select("__path", "__changed", F.col("bin_id").alias("__bin"), "parts")

    hashable = [c for c, t in rows.dtypes if not t.startswith(("map", "variant"))]
    content = checksum(*hashable) if hashable else F.lit(0).cast("decimal(20,0)")
    total = F.coalesce(F.sum(content), F.lit(0)).cast("decimal(38,0)")
    placed = rows.select(*[F.col(c) for c in columns], *meta, begins).join(homes, ["__path", "__changed"])
    share = F.least(F.col("parts") - 1, F.floor(F.col("__begins") / F.lit(target_bytes)))  # a split's rows stay together, whoever reads it
    out = f"{target}/data"
    _rewrite(placed.select(*columns, (F.col("__bin") + share).alias("bin_id")), opened, (), out)
    said = listed.agg(F.coalesce(F.sum("__rows"), F.lit(0))).first()[0]
    read = rows.select(*[F.col(c) for c in columns], *meta).join(homes.select("__path", "__changed"), ["__path", "__changed"], "left_semi").agg(F.count(F.lit(1)), total).first()
    again = spark.read.parquet(out)
    wrote = again.agg(F.count(F.lit(1)), total).first()
    if not said == read[0] == wrote[0] or read[1] != wrote[1]:
        raise CompactionMismatch(f"listed {said} rows, read {read}, wrote {wrote}")
    report = {"rows_read": read[0], "rows_written": wrote[0], "checksum": str(read[1]), "bins": opened}
    commit(spark, f"{target}/COMMITTED", report | {"data": "data"})
    return Compaction(again, bins, report)


def commit(spark: SparkSession, path: str, content: dict) -> None:
    """Writes a small JSON file that can be made only once: of two writers of one path one fails, and readers see it whole or not at all.

    On local files it is linked to its name, elsewhere it is created without overwriting, which a shared file
    system or object store does for one writer only.
    """
    fs, path_of = hadoop_fs(spark, path)
    text = json.dumps(content, sort_keys=True).encode()
    if str(fs.getUri().getScheme()) == "file":
        final = str(path_of(path).toUri().getPath())
        os.makedirs(os.path.dirname(final), exist_ok=True)
        temporary = f"{final}.{uuid.uuid4().hex}"
        with open(temporary, "wb") as f:
            f.write(text)
        try:
            os.link(temporary, final)
        finally:
            os.remove(temporary)
        return
    try:
        stream = fs.create(path_of(path), False)
    except Py4JJavaError as e:
        raise FileExistsError(f"{path} is committed already") from e
    stream.write(bytearray(text))
    stream.close()


def committed(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """The number and content of the newest of the commits NUMBER.json in a folder; (0, {}) without any. A file that is still empty isn't one yet."""
    fs, path_of = hadoop_fs(spark, folder)
    found = fs.listStatus(path_of(folder)) if fs.exists(path_of(folder)) else []
    numbers = [int(s.getPath().getName()[:-5]) for s in found if s.getPath().getName().endswith(".json") and s.getLen() > 0]
    if not numbers:
        return 0, {}
    return max(numbers), json.loads(spark.read.text(f"{folder}/{max(numbers):012d}.json", wholetext=True).first()[0])
