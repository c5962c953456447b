"""Substring search over text records, and what occurs most often between delimiters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.prefix import carried, prefix_sums


def offsets(text: Column, needle: str) -> Column:
    """Offsets (from 0) of all matches, overlapping ones too; an empty needle matches at every character. Null text gives null.

    Texts without a match never leave the JVM. The others are searched in Arrow batches, in time that grows
    with their length: Spark's own substring by position starts over at the front each time.
    """
    if not needle:
        return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: i - 1)).when(text.isNotNull(), F.array().cast("array<int>"))

    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _places(t, needle))

    return F.pandas_udf(find, "array<int>")(text)


def _places(text: str, needle: str) -> list[int]:
    out, at = [], text.find(needle)
    while at >= 0:
        out.append(at)
        at = text.find(needle, at + 1)
    return out


def count(text: Column, needle: str) -> Column:
    """Matches of the needle, overlapping ones too; in the JVM and in one pass."""
    if not needle:
        return F.length(text)
    if len(needle) == 1 or not any(needle.startswith(needle[i:]) for i in range(1, len(needle))):
        # A needle that can't overlap itself: as many as are taken out.
        return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")
    return F.size(F.regexp_extract_all(text, F.lit(f"(?s)(?={_quoted(needle)})"), F.lit(0)))


def _quoted(needle: str) -> str:
    """The needle as a regular expression."""
    return "".join(c if c.isalnum() or c.isspace() else "\\" + c for c in needle)


def search(records: DataFrame, needle: str, text: str = "text") -> DataFrame:
    """The records with the needle, one row for each match, with its offset. Null texts don't match."""
    hits = records.filter(F.contains(F.col(text), F.lit(needle))) if needle else records.filter(F.col(text).isNotNull())
    return hits.withColumn("offset", F.explode(offsets(F.col(text), needle))).drop(text)


def starts(records: DataFrame, order: str, text: str = "text") -> DataFrame:
    """Records with `start`, the offset of each in all texts joined by one delimiter, in the order of `order`; null texts are empty."""
    sized = records.withColumn("__len", F.coalesce(F.length(text), F.lit(0)).cast("bigint") + 1)
    return prefix_sums(sized, [], [order], weight=F.col("__len"), out="start", spread=F.floor(F.col(order) / 4096).cast("bigint")).drop("__len")


def lookup(records: DataFrame, global_offsets: DataFrame, order: str, text: str = "text") -> DataFrame:
    """For each row (at) of `global_offsets` the record that holds it and the offset within.

    An as-of lookup: offsets and starts are ordered together in slices of a power of two characters, and
    an offset takes the last start at or before it; a record that covers whole slices is the last start
    of the slices before.
    """
    begin = starts(records, order, text).select(F.col(order).alias("record"), F.col("start").alias("at"), F.lit(0).alias("probe"))
    both = begin.unionByName(global_offsets.select(F.lit(None).cast(begin.schema["record"].dataType).alias("record"), F.col("at").cast("bigint").alias("at"), F.lit(1).alias("probe")))
    both = both.withColumn("__slice", F.shiftright("at", 16))
    pair = F.when(F.col("probe") == 0, F.struct(F.col("at").alias("s"), F.col("record").alias("r")))
    own = F.last(pair, ignorenulls=True).over(Window.partitionBy("__slice").orderBy("at", "probe"))
    ends = both.filter("probe = 0").groupBy("__slice").agg(F.max(F.struct(F.col("at").alias("s"), F.col("record").alias("r"))).alias("__end"))
    used = both.select("__slice").distinct().join(ends, "__slice", "left")
    before = carried(used, [], "__slice", "__end", "__before", "max").select("__slice", "__before")
    found = both.withColumn("__own", own).join(before, "__slice").withColumn("__hit", F.coalesce("__own", "__before")).filter("probe = 1")
    return found.select("at", F.col("__hit.r").alias("record"), (F.col("at") - F.col("__hit.s")).alias("offset"))


def retrieve(records: DataFrame, order: str, wanted: list) -> DataFrame:
    """The records with the given ids; the filter reaches the scan."""
    return records.filter(F.col(order).isin(wanted))


def newline_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text): the lines of text files, numbered from 0 in each file. A file is cut among tasks, whose lines are counted first and numbered then."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__begin"), F.monotonically_increasing_id().alias("__place"), F.col("value").alias("text"))
    numbered = prefix_sums(lines, ["file"], ["__begin", "__place"], out="record", spread=F.shiftright("__begin", 20))
    return numbered.select("file", "record", "text")


def pieces(records: DataFrame, opens: str, closes: str, text: str = "text", inside: str = ".*?") -> DataFrame:
    """One row (piece) for each stretch of a text between an opening and the next closing mark (regular expressions); `inside` is what may stand between."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"{opens}({inside}){closes}"), F.lit(1))
    return records.withColumn("piece", F.explode(found)).drop(text)


def exemplars(found: DataFrame, k: int, piece: str = "piece", min_length: int = 0, suffix: str = "") -> DataFrame:
    """(piece, n): the k most frequent pieces, of equal ones the smaller; at least min_length long, ending in `suffix`."""
    kept = found.filter(F.length(piece) >= min_length)
    if suffix:
        kept = kept.filter(F.endswith(F.col(piece), F.lit(suffix)))
    return kept.groupBy(piece).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), piece).limit(k)


def correlates(found: DataFrame, selected: DataFrame, key: str, k: int, piece: str = "piece") -> DataFrame:
    """(piece, n): the k most frequent pieces of the selected records."""
    return exemplars(found.join(selected.select(key).distinct(), key, "left_semi"), k, piece)


def rank_select(symbols: DataFrame, by: list[str], position: str) -> DataFrame:
    """Adds `rank`: how many of the same symbol come before a position. Row with rank r is what select(symbol, r) finds."""
    return prefix_sums(symbols, by, [position], out="rank", spread=F.floor(F.col(position) / 65536).cast("bigint"))


def next_symbols(records: DataFrame, prefix: str, text: str = "text") -> DataFrame:
    """(symbol, n): what follows the prefix, over all its matches; a match at a text's end has none."""
    held = records.filter(F.contains(F.col(text), F.lit(prefix)))
    after = F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?={_quoted(prefix)}(.))"), F.lit(1))
    return held.select(F.explode(after).alias("symbol")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
