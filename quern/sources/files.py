"""Files of records: plain key-value text, logs as JSON lines, histograms, experiments, sorted runs, generated rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.compaction import checksum, commit, committed
from quern.session import hadoop_fs


def key_value_lines(lines: DataFrame, order: str, line: str = "value") -> DataFrame:
    """(key, value, ts) of lines of two fields apart by blanks; `order` is the time. Other lines have no row."""
    fields = F.split(F.trim(line), r"\s+")
    return lines.filter(F.size(fields) == 2).select(fields[0].cast("binary").alias("key"), fields[1].cast("binary").alias("value"), F.col(order).cast("bigint").alias("ts"))


def log_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, level, timestamp, value) of the JSON lines of files, the value as its JSON text; malformed lines have nulls."""
    return log_lines(spark.read.text(path))


def log_lines(rows: DataFrame) -> DataFrame:
    """Log records of lines (value), of a batch or a stream."""
    get = lambda name, kind: F.get_json_object("value", f"$.{name}").try_cast(kind)
    return rows.select(get("file", "string").alias("file"), get("line", "int").alias("line"), get("level", "bigint").alias("level"), get("timestamp", "bigint").alias("timestamp"), F.get_json_object("value", "$.value").alias("value"))


def emit_log(records: DataFrame, path: str, level: int | None = None) -> None:
    """Appends records (file, line, level, timestamp, value as JSON text) up to a level as JSON lines."""
    rows = records if level is None else records.filter(F.col("level") <= level)
    text = F.concat(F.lit('{"file":'), F.to_json(F.struct(F.col("file").alias("f"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("file").alias("f")))) - 6), F.lit(',"line":'), F.coalesce(F.col("line").cast("string"), F.lit("null")), F.lit(',"level":'), F.coalesce(F.col("level").cast("string"), F.lit("null")), F.lit(',"timestamp":'), F.coalesce(F.col("timestamp").cast("string"), F.lit("null")), F.lit(',"value":'), F.coalesce("value", F.lit("null")), F.lit("}"))
    rows.select(text.alias("value")).write.mode("append").text(path)


def histogram_dump(hist: DataFrame, sig_figs: int) -> Column:
    """The text of a histogram (by aggregation over its rows bucket, n): the figures, then one count a line from bucket 0 on."""
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "n"))))
    dense = F.transform(F.sequence(F.lit(0), F.max("bucket")), lambda b: F.coalesce(F.try_element_at(counts, b), F.lit(0)).cast("string"))
    return F.concat(F.lit(f"{sig_figs}\n"), F.array_join(dense, "\n"), F.lit("\n"))


def histogram_load(texts: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep..., sig_figs, bucket, n): the counts above 0 of dumped histograms; texts with figures outside of 1 to 4 have no row."""
    lines = F.filter(F.split(F.trim(text), r"\r?\n"), lambda x: F.trim(x) != "")
    rows = texts.select(*keep, lines[0].try_cast("int").alias("sig_figs"), F.posexplode(F.slice(lines, F.lit(2), F.greatest(F.lit(0), F.size(lines) - 1))).alias("bucket", "__n"))
    return rows.filter("sig_figs between 1 and 4").select(*keep, "sig_figs", "bucket", F.col("__n").try_cast("bigint").alias("n")).filter("n > 0")


def experiment(name: Column) -> tuple[Column, Column]:
    """(experiment, parameters) of a file name `experiment:param=value:...`: the parameters as a map of texts; null if a part isn't one."""
    base = F.regexp_extract(name, r"([^/]+?)(?:\.[A-Za-z]+)?$", 1)
    parts = F.split(base, ":")
    rest = F.filter(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)), lambda p: p != "")
    fine = F.forall(rest, lambda p: p.rlike("^[^=]+=.*$"))
    return parts[0], F.when(fine, F.map_from_arrays(F.transform(rest, lambda p: F.substring_index(p, "=", 1)), F.transform(rest, lambda p: F.regexp_extract(p, "^[^=]+=(.*)$", 1))))


def parameter_kind(value: Column) -> Column:
    """What a parameter's text is: unit, integer, float, bool or text."""
    return F.when(value == "", "unit").when(value.rlike(r"^\d+$"), "integer").when(value.isin("true", "false"), "bool").when(value.try_cast("double").isNotNull(), "float").otherwise("text")


def write_run(records: DataFrame, path: str, keys: list[str], ts: str = "ts", partitions: int | None = None, rows_per_file: int = 0) -> None:
    """A sorted run: files of disjoint key ranges, in order of key and falling time within; bloom filters let point reads skip files."""
    ranged = records.repartitionByRange(partitions, *keys) if partitions else records.repartitionByRange(*keys)
    out = ranged.sortWithinPartitions(*keys, F.desc(ts)).write
    if rows_per_file:
        out = out.option("maxRecordsPerFile", rows_per_file)
    for k in keys:
        out = out.option(f"parquet.bloom.filter.enabled#{k}", "true")
    out.parquet(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def dump(records: DataFrame, key: str = "key", ts: str = "ts", value: str = "value") -> DataFrame:
    """(value): a line for each record: key, time and value, bytes as hexadecimal digits, `DEL` for a tombstone. Order is the reader's."""
    return records.select(F.concat_ws(" ", F.hex(key), F.coalesce(F.col(ts).cast("string"), F.lit("-")), F.coalesce(F.hex(value), F.lit("DEL"))).alias("value"))


def log_to_run(lines: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """A log of dumped lines, in any order and with torn ones, as a sorted run; lines that aren't whole records are left out."""
    part = F.split("value", " ")
    whole = F.col("value").rlike("^(?:[0-9A-F]{2})* -?[0-9]+ (?:DEL|(?:[0-9A-F]{2})*)$")
    rows = lines.filter(whole).select(F.unhex(part[0]).alias("key"), part[1].cast("bigint").alias("ts"), F.when(part[2] != "DEL", F.unhex(part[2])).alias("value"))
    write_run(rows, path, ["key"], rows_per_file=rows_per_file)


def without_torn_tail(lines: DataFrame, file: str, place: str, whole: Column) -> DataFrame:
    """The lines of log files without a last line that isn't `whole`, as a writer that was stopped leaves it; such lines elsewhere stay, for the reader to see. A combining pass finds the last lines."""
    ends = lines.groupBy(file).agg(F.max(place).alias("__end"))
    ends = ends.select(F.col(file).alias("__file"), "__end")
    both = lines.join(ends, F.col(file).eqNullSafe(F.col("__file")))
    return both.filter((F.col(place) != F.col("__end")) | F.coalesce(whole, F.lit(False))).drop("__file", "__end")


def run_metadata(records: DataFrame, key: str, ts: str = "ts", file: str = "file") -> DataFrame:
    """(file, first_key, last_key, smallest_ts, biggest_ts, n): what a manifest keeps of each file."""
    return records.groupBy(file).agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.min(ts).alias("smallest_ts"), F.max(ts).alias("biggest_ts"), F.count(F.lit(1)).alias("n"))


def manifest_edits(edits: DataFrame, order: str = "edit_id", op: str = "op", item: str = "item") -> DataFrame:
    """(item): the set that a log of edits (add or remove) leaves."""
    last = edits.groupBy(item).agg(F.max_by(op, order).alias("__op"))
    return last.filter("__op = 'add'").select(item)


def rollover(spark: SparkSession, edits: DataFrame, path: str) -> DataFrame:
    """A manifest's log in the folder `path` replaced by one that only adds what is left: readers (`read_manifest`) get the newest.

    The new log is written beside the old ones and then named by a numbered commit, which of two writers
    only one can make. Logs before the last two are deleted.
    """
    number, state = committed(spark, f"{path}/commits")
    name = f"log-{uuid.uuid4().hex}"
    kept = manifest_edits(edits).select(F.lit(0).cast("bigint").alias("edit_id"), F.lit("add").alias("op"), "item")
    kept.write.parquet(f"{path}/{name}")
    count, total = spark.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)), F.coalesce(F.sum(checksum("item")), F.lit(0)).cast("decimal(38,0)")).first()
    commit(spark, f"{path}/commits/{number + 1:012d}.json", {"log": name, "items": count, "checksum": str(total), "before": state.get("log")})
    if state.get("before"):
        fs, path_of = hadoop_fs(spark, path)
        fs.delete(path_of(f"{path}/{state['before']}"), True)
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(edit_id, op, item): the newest log of a manifest; empty before the first rollover."""
    number, state = committed(spark, f"{path}/commits")
    return spark.read.parquet(f"{path}/{state['log']}") if number else spark.createDataFrame([], "edit_id bigint, op string, item string")


def verify_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(fault): what is wrong with the newest log: items added twice or null, edits that aren't additions, other items than were committed. No rows if nothing is."""
    number, state = committed(spark, f"{path}/commits")
    if not number:
        return spark.createDataFrame([], "fault string")
    log = read_manifest(spark, path)
    found = log.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(checksum("item")), F.lit(0)).cast("decimal(38,0)").alias("total"), F.countDistinct("item").alias("distinct"), F.count_if(F.col("op") != "add").alias("other"))
    faults = F.array_compact(F.array(F.when(F.col("distinct") != F.col("n"), "an item is null or added twice"), F.when(F.col("other") > 0, "an edit isn't an addition"), F.when((F.col("n") != state["items"]) | (F.col("total") != F.lit(state["checksum"]).cast("decimal(38,0)")), "the items aren't those committed")))
    return found.select(F.explode(faults).alias("fault"))
