"""Order-free multiset checksums, Bloom filters and frequency sketches."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.prefix import prefix_sums

#: The modulus of each of the eight columns of a multiset checksum.
PRIMES = (4294967291, 4294967279, 4294967231, 4294967197, 4294967189, 4294967161, 4294967143, 4294967111)
EMPTY = "0" * 64


def multiset_sum(items: DataFrame, item: str, by: Sequence[str] = (), sign: str | None = None, native: bool = False) -> DataFrame:
    """(by..., checksum): 64 hexadecimal digits that depend on the multiset of the items (binary or string) alone.

    Each item's SHA3-256 is eight little-endian 32-bit numbers, added modulo eight primes. Equal multisets
    have equal sums, and sums add and subtract as multisets do; `sign` names a column of 1 and -1 for items
    that come and go. Hashes are made in Arrow batches and summed up in the JVM, task by task first. Null
    items don't count; without items a group has no row, and the whole of nothing has the sum of zeros. With
    `native` the hash is SHA-256, which Spark has itself, so nothing leaves the JVM; such sums aren't
    comparable with the others. Halves of the numbers are summed apart, so that 10^14 items don't overflow.
    """
    names = [*by, *(f"c{i}" for i in range(8))]
    rows = items.filter(F.col(item).isNotNull()).select(*by, F.col(item).cast("binary").alias("__item"), (F.col(sign).cast("bigint") if sign else F.lit(1).cast("bigint")).alias("__sign"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(by)]), *(f"c{i} bigint" for i in range(8))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = b"".join(hashlib.sha3_256(x).digest() for x in batch.column(len(by)).to_pylist())
            cells = np.frombuffer(digests, "<u4").reshape(-1, 8).astype(np.int64) * batch.column(len(by) + 1).to_numpy()[:, None]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], *(pa.array(cells[:, i]) for i in range(8))], names)

    if native:
        hashed = rows.select(*by, "__sign", F.sha2("__item", 256).alias("__h"))
        cells = hashed.select(*by, *[(c * F.col("__sign")).alias(f"c{i}") for i, c in enumerate(_cells(F.col("__h")))])
    else:
        cells = rows.mapInArrow(run, schema)
    residues = [F.pmod(F.col(f"c{i}"), F.lit(p)) for i, p in enumerate(PRIMES)]
    halves = [h for i, r in enumerate(residues) for h in (F.sum(F.shiftright(r, 16)).alias(f"h{i}"), F.sum(r.bitwiseAND(F.lit(0xFFFF))).alias(f"l{i}"))]
    sums = cells.groupBy(*by).agg(*halves)
    whole = [F.coalesce(F.pmod(F.pmod(F.col(f"h{i}"), F.lit(p)) * 65536 + F.col(f"l{i}"), F.lit(p)), F.lit(0)) for i, p in enumerate(PRIMES)]
    return sums.select(*by, digest(whole).alias("checksum"))


def digest(columns: list[Column]) -> Column:
    """The eight numbers as one text, each little-endian."""
    def little(c: Column) -> Column:
        h = F.lpad(F.hex(c), 8, "0")
        return F.lower(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))

    return F.concat(*[little(c) for c in columns])


def _cells(sum_: Column) -> list[Column]:
    parts = []
    for i in range(8):
        b = [F.substring(sum_, 8 * i + 2 * j + 1, 2) for j in (3, 2, 1, 0)]
        parts.append(F.conv(F.concat(*b), 16, 10).cast("bigint"))
    return parts


def add_sums(a: Column, b: Column, sign: int = 1) -> Column:
    """The sum of the union of two multisets, or with sign -1 of their difference."""
    return digest([F.pmod(x + sign * y, F.lit(p)) for x, y, p in zip(_cells(a), _cells(b), PRIMES, strict=True)])


def equal_multisets(a: DataFrame, b: DataFrame) -> DataFrame:
    """(missing, extra): rows of a that b lacks, and of b that a lacks, counted with their repeats."""
    cols = a.columns
    one = a.withColumn("__d", F.lit(1)).unionByName(b.select(*cols).withColumn("__d", F.lit(-1))).groupBy(*cols).agg(F.sum("__d").alias("__d"))
    return one.agg(F.coalesce(F.sum(F.greatest(F.col("__d"), F.lit(0))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.greatest(-F.col("__d"), F.lit(0))), F.lit(0)).alias("extra"))


def bloom_keys(bits_per_key: Column) -> Column:
    """The number of hash functions that suits a filter."""
    return bits_per_key * math.log(2)


def bloom_bits(n: Column, p: Column) -> Column:
    """The bits that n keys need for a false positive rate p."""
    return -n * F.ln(p) / (math.log(2) ** 2)


def bloom_rate(n: Column, m: Column) -> Column:
    """The false positive rate of m bits for n keys; 0 without keys."""
    return F.when(n > 0, F.exp(-(math.log(2) ** 2) * F.try_divide(m, n))).otherwise(0.0)


def bloom_build(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, words): a split-block Bloom filter, eight 32-bit words a block, combined by OR task by task."""
    h = F.xxhash64(key)
    low = F.pmod(h, F.lit(1 << 32))
    block = F.shiftright(F.pmod(F.shiftright(h, 32), F.lit(1 << 32)) * blocks, 32)
    bits = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(low, i).cast("int"))).alias(f"w{i}") for i in range(8)]
    return keys.filter(F.col(key).isNotNull()).groupBy(block.alias("block")).agg(*bits)


#: The odd multipliers of a split-block filter.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)


def _bit(low: Column, i: int) -> Column:
    product = (low.cast("decimal(20,0)") * F.lit(SALTS[i]).cast("decimal(20,0)")) % F.lit(1 << 32).cast("decimal(20,0)")
    return F.shiftright(product.cast("bigint"), 27)


def bloom_probe(probes: DataFrame, key: str, filter_: DataFrame, blocks: int) -> DataFrame:
    """Adds `maybe`: false only where the key isn't in the filter; null keys are never in it."""
    h = F.xxhash64(key)
    low = F.pmod(h, F.lit(1 << 32))
    block = F.shiftright(F.pmod(F.shiftright(h, 32), F.lit(1 << 32)) * blocks, 32)
    joined = probes.withColumn("block", block).join(filter_, "block", "left")
    held = F.col(key).isNotNull() & F.col("w0").isNotNull()
    for i in range(8):
        held = held & (F.call_function("shiftright", F.col(f"w{i}"), _bit(low, i).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return joined.withColumn("maybe", F.coalesce(held, F.lit(False))).drop("block", *(f"w{i}" for i in range(8)))


def frequencies(keys: DataFrame, key: str, order: str | None = None, window: int | None = None, rows: int = 4, width: int = 4096) -> DataFrame:
    """(row, cell, n): a count-min sketch; with `order` and `window` counts halve with every window of that length behind.

    `window` is in units of `order`, counted back from its greatest value. A key's estimate is the least of
    its cells, never less than its own decayed count.
    """
    w = F.lit(1.0)
    if order and window:
        newest = keys.agg(F.max(order)).first()[0] or 0
        w = F.pow(F.lit(0.5), F.floor((F.lit(newest) - F.col(order)) / window).cast("double"))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("row"), F.pmod(F.xxhash64(F.lit(i), key), F.lit(width)).alias("cell")) for i in range(rows)]))
    return keys.filter(F.col(key).isNotNull()).select(w.alias("__w"), cells.alias("c")).groupBy("c.row", "c.cell").agg(F.sum("__w").alias("n"))


def estimate(keys: DataFrame, key: str, sketch: DataFrame, rows: int = 4, width: int = 4096) -> DataFrame:
    """(key, estimate) for distinct keys."""
    own = keys.filter(F.col(key).isNotNull()).select(key).distinct()
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("row"), F.pmod(F.xxhash64(F.lit(i), key), F.lit(width)).alias("cell")) for i in range(rows)]))
    each = own.select(key, cells.alias("c")).select(key, "c.row", "c.cell").join(sketch, ["row", "cell"], "left")
    return each.groupBy(key).agg(F.min(F.coalesce("n", F.lit(0.0))).alias("estimate"))


def conservative(keys: DataFrame, key: str, rows: int = 4, width: int = 4096) -> DataFrame:
    """(row, cell, n): a sketch whose cells are only as large as they must be: the greatest estimate of the keys that fall into them.

    Each key's estimate by the plain sketch bounds what it can have been raised to, so a cell needs no more
    than the greatest of its keys' estimates. Estimates from it are never less than the counts and never more
    than those of the plain sketch.
    """
    plain = estimate(keys, key, frequencies(keys, key, rows=rows, width=width), rows, width)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("row"), F.pmod(F.xxhash64(F.lit(i), key), F.lit(width)).alias("cell")) for i in range(rows)]))
    return plain.select("estimate", cells.alias("c")).groupBy("c.row", "c.cell").agg(F.max("estimate").alias("n"))


def skipping(files: DataFrame, keys: DataFrame, file: str, key: str, blocks: int = 64) -> DataFrame:
    """(file, block, words): a split-block filter for every file of `keys` (file, key); `files` without keys have none and are always skipped."""
    low, block = _block_of(key, blocks)
    bits = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(low, i).cast("int"))).alias(f"w{i}") for i in range(8)]
    made = keys.filter(F.col(key).isNotNull()).groupBy(file, block.alias("block")).agg(*bits)
    return made.join(files.select(file).distinct(), file, "left_semi")


def candidate_files(filters: DataFrame, file: str, wanted, blocks: int = 64) -> DataFrame:
    """(file): the files that may hold the key `wanted`; none that does is missing. The block to look at is known while planning, so the filter reaches the scan."""
    probe = filters.withColumn("__key", F.lit(wanted))
    low, block = _block_of("__key", blocks)
    held = F.lit(True)
    for i in range(8):
        held = held & (F.call_function("shiftright", F.col(f"w{i}"), _bit(low, i).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return probe.filter((F.col("block") == block) & held).select(file).distinct()


def _block_of(key: str, blocks: int) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    return F.pmod(h, F.lit(1 << 32)), F.shiftright(F.pmod(F.shiftright(h, 32), F.lit(1 << 32)) * blocks, 32)


def crc32c(data: Column) -> Column:
    """The Castagnoli checksum of bytes, as a bigint; null stays null. Made in Arrow batches, a table look-up a byte, all rows of a batch side by side."""
    return F.pandas_udf(_crc32c, "bigint")(data.cast("binary"))


def _crc32c(values: pd.Series) -> pd.Series:
    given = [None if v is None else bytes(v) for v in values]
    sizes = np.array([len(v) if v is not None else 0 for v in given])
    crc = np.full(len(given), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-sizes, kind="stable")
    padded = np.frombuffer(b"".join(v or b"" for v in given), np.uint8)
    starts = np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else np.zeros(0, int)
    falling = -sizes[order]
    for at in range(int(sizes.max(initial=0))):
        live = order[: np.searchsorted(falling, -at, side="left")]  # those longer than `at`
        crc[live] = _CRC_TABLE[(crc[live] ^ padded[starts[live] + at]) & 0xFF] ^ (crc[live] >> np.uint32(8))
    out = pd.Series(crc ^ np.uint32(0xFFFFFFFF), dtype="uint32").astype("int64").astype(object)
    out[[v is None for v in given]] = None
    return out


def _crc_table(polynomial: int = 0x82F63B78) -> np.ndarray:
    """Remainders of all bytes for the reflected Castagnoli polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(polynomial), table >> np.uint32(1)).astype(np.uint32)
    return table


_CRC_TABLE = _crc_table()


def should_replace(victim: Column, candidate: Column) -> Column:
    """Whether a cache admits a candidate in place of a victim, by their frequencies."""
    return candidate > victim


def generate(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(id, uniform, normal, exponential, poisson, coin, pick, text, uuid, place): random rows, for fixtures.

    Every value is worked out from the seed and the row's id by hashing alone, so the rows are the same
    however they are partitioned. `poisson` has the mean 3, `place` is the row's place in a shuffle of 0..n-1.
    """
    word = lambda k: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), F.col("id")), 11)
    u = lambda k: word(k).cast("double") / float(1 << 53)
    normal = F.sqrt(-2 * F.ln(1 - u(1))) * F.cos(2 * math.pi * u(2))
    limits = [math.exp(-3) * sum(3**j / math.factorial(j) for j in range(k + 1)) for k in range(24)]
    poisson = F.size(F.filter(F.array(*map(F.lit, limits)), lambda x: x <= u(4)))
    text = F.concat(*[F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.pmod(F.shiftright(word(7), 5 * i), F.lit(26)) + 1).cast("int"), F.lit(1)) for i in range(8)])
    half = F.lower(F.lpad(F.hex(F.xxhash64(F.lit(seed), F.lit(8), F.col("id"))), 16, "0"))
    rest = F.lower(F.lpad(F.hex(F.xxhash64(F.lit(seed), F.lit(9), F.col("id"))), 16, "0"))
    uuid = F.concat_ws("-", F.substring(half, 1, 8), F.substring(half, 9, 4), F.concat(F.lit("4"), F.substring(half, 14, 3)), F.concat(F.lit("8"), F.substring(rest, 2, 3)), F.substring(rest, 5, 12))
    rows = spark.range(n).select("id", u(0).alias("uniform"), normal.alias("normal"), (-F.ln(1 - u(3))).alias("exponential"), poisson.alias("poisson"), (u(5) < 0.5).alias("coin"), F.element_at(F.array(*map(F.lit, "abcde")), (u(6) * 5).cast("int") + 1).alias("pick"), text.alias("text"), uuid.alias("uuid"), F.lit(seed).alias("__seed"))
    return prefix_sums(rows, [], ["__seed", "id"], out="place").drop("__seed")
