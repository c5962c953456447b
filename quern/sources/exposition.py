"""The text exposition format of metrics: reading it, loading it as samples, writing it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import histogram
from quern.operators.prefix import prefix_sums
from quern.session import materialize

_NAME = r"[a-zA-Z_:][a-zA-Z0-9_:]*"
_LABEL = r'[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*"(?:[^"\\]|\\.)*"'
#: A whole line of any kind that says something: a reading (name, labels, number, stamp), a TYPE line (name, kind) or a HELP line (name, text).
_LINE = rf"^\s*(?:({_NAME})\s*(?:\{{((?:\s*{_LABEL}\s*,?)*)\s*\}})?\s+(\S+)(?:\s+(-?\d+))?|#\s*TYPE\s+({_NAME})\s+(counter|gauge|histogram)|#\s*HELP\s+({_NAME})(?:\s+(.*))?)\s*$"
_MARK = "\u0000"


def _once(df: DataFrame, **made: Column) -> DataFrame:
    """Adds columns that are worked out once a row, however often they are used: a generator is a boundary that the optimizer doesn't copy expressions over."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def parse(lines: DataFrame, line: str = "value") -> DataFrame:
    """Adds to each line its `what` (reading, type, help, comment, blank or malformed) and the parts of it.

    `metric`, `labels` (a map, with escapes undone), `number` (infinities and NaN too) and `stamp_ms` of a
    reading; `metric` and `kind` of a TYPE line, whose kind must be counter, gauge or histogram;
    `metric` and `help` of a HELP line. Null lines are blank. Stays in the JVM, and one expression reads a
    line: it puts the parts apart by a character that no line has (one that has it is malformed).
    """
    own = F.coalesce(F.col(line), F.lit(""))
    taken = F.when(F.contains(own, F.lit(_MARK)), F.lit("")).otherwise(F.regexp_replace(own, _LINE, _MARK.join(["", *(f"${i}" for i in range(1, 9)), ""])))
    rows = _once(lines, __p=F.split(taken, _MARK), __own=own)
    fits = F.size("__p") == 10
    part = lambda i: F.when(fits, F.nullif(F.col("__p")[i], F.lit("")))
    text = F.lower(part(3))
    number = F.when(text.isin("+inf", "inf"), float("inf")).when(text == "-inf", float("-inf")).when(text == "nan", float("nan")).otherwise(text.try_cast("double"))
    found = F.when(part(2).isNull(), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(part(2), F.lit(f"({_LABEL})"), F.lit(1)))
    rows = _once(rows, __name=part(1), __number=number, __found=found, __type=part(5), __kind=part(6), __help=part(7))
    keys = F.transform("__found", lambda x: F.rtrim(F.substring_index(x, "=", 1)))
    raw = lambda x: F.substring(x, F.instr(x, '"') + 1, F.length(x) - F.instr(x, '"') - 1)
    plain = lambda x: F.when(F.contains(x, F.lit("\\")), F.replace(F.replace(F.replace(F.replace(x, F.lit("\\\\"), F.lit("\u0000")), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\u0000"), F.lit("\\"))).otherwise(x)
    rows = _once(rows, __keys=keys, __values=F.transform("__found", lambda x: plain(raw(x))), __unique=F.size(F.array_distinct(keys)) == F.size(keys))
    reading = F.col("__name").isNotNull() & F.col("__number").isNotNull() & F.col("__unique")
    what = F.when(F.trim("__own") == "", "blank").when(F.col("__kind").isNotNull(), "type").when(F.col("__help").isNotNull(), "help").when(F.ltrim("__own").startswith("#"), "comment").when(reading, "reading").otherwise("malformed")
    return rows.withColumns(
        {
            "what": what,
            "metric": F.when(reading, F.col("__name")).otherwise(F.coalesce("__type", "__help")),
            "labels": F.when(reading, F.map_from_arrays(F.when(F.col("__unique"), F.col("__keys")), F.col("__values"))),
            "number": F.when(reading, F.col("__number")),
            "stamp_ms": F.when(reading, part(4).try_cast("bigint")),
            "kind": F.col("__kind"),
            "help": part(8),
        }
    ).drop("__p", "__own", "__name", "__number", "__found", "__type", "__kind", "__help", "__keys", "__values", "__unique")


def escape(value: Column) -> Column:
    """A tag's part with the separators escaped, so that any label fits into a tag set."""
    return F.replace(F.replace(F.replace(value, F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A")), F.lit("="), F.lit("%3D"))


def load(parsed: DataFrame, file: str = "file", order: str | None = None) -> DataFrame:
    """(tags, kind, ts, value): the samples of parsed lines.

    A metric's kind is declared in the same file; readings without a declared kind, or without a time, have
    no sample. The metric is the tag __name__. Of readings of one series at one time the last wins, by
    `order` if given, else the greatest value.
    """
    kinds = parsed.filter("what = 'type'").groupBy(file, "metric").agg(F.max("kind").alias("kind"))
    rows = parsed.filter("what = 'reading' and stamp_ms is not null").drop("kind").join(kinds, [file, "metric"])
    pairs = F.concat(F.array(F.concat(F.lit("__name__="), escape(F.col("metric")))), F.transform(F.map_entries("labels"), lambda e: F.concat(escape(e["key"]), F.lit("="), escape(e["value"]))))
    tags = F.concat(F.lit(":"), F.array_join(F.array_sort(pairs), ":"), F.lit(":"))
    keyed = rows.select(tags.alias("tags"), "kind", F.timestamp_millis("stamp_ms").alias("ts"), F.col("number").alias("value"), F.col(order if order else "number").alias("__o"))
    return keyed.groupBy("tags", "kind", "ts").agg(F.max_by("value", "__o").alias("value"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Samples of files in this format; the lines of one file keep their order."""
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_path")).withColumn("place", F.monotonically_increasing_id())
    return load(parse(lines), order="place")


def sanitize(name: Column) -> Column:
    """A name of allowed characters only."""
    return F.regexp_replace(name, "[^a-zA-Z0-9_:]", "_")


def number_text(x: Column) -> Column:
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "+Inf").when(x == float("-inf"), "-Inf").otherwise(x.cast("string"))


def _labels(labels: Column) -> Column:
    quoted = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), F.replace(F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"')))
    return F.when(F.size(labels) > 0, F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))).otherwise("")


def emit(samples: DataFrame) -> DataFrame:
    """(metric, line): a TYPE line for each metric and kind, and a line for each sample (metric, labels, kind, ts, value)."""
    name = sanitize(F.col("metric"))
    types = samples.select(name.alias("metric"), "kind").distinct().select("metric", F.concat(F.lit("# TYPE "), "metric", F.lit(" "), "kind").alias("line"))
    return types.unionByName(samples.select(name.alias("metric"), F.concat(name, _labels(F.col("labels")), F.lit(" "), number_text(F.col("value")), F.lit(" "), F.unix_millis("ts").cast("string")).alias("line")))


def emit_moments(described: DataFrame) -> DataFrame:
    """(metric, line): five gauges for rows (metric, ts, n, mean, variance, skewness, kurtosis)."""
    parts = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.col(c).cast("double").alias("v")) for s, c in (("count", "n"), ("mean", "mean"), ("variance", "variance"), ("skewness", "skewness"), ("kurtosis", "kurtosis"))]))
    rows = described.select(sanitize(F.col("metric")).alias("metric"), "ts", parts.alias("p"))
    return rows.select("metric", F.concat("metric", F.lit("_"), F.col("p.s"), F.lit(" "), number_text(F.col("p.v")), F.lit(" "), F.unix_millis("ts").cast("string")).alias("line"))


def emit_histogram(hist: DataFrame, by: list[str], sig_figs: int) -> DataFrame:
    """(metric, line): cumulative _bucket lines with their bounds `le`, _sum and _count, for histograms (by..., bucket, n) with by = [metric, ts]."""
    along = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = histogram.boundary_for(F.col("bucket"), sig_figs)
    stamp = F.unix_millis("ts").cast("string")
    buckets = hist.select(*by, b.alias("b"), F.sum("n").over(along).alias("c")).select("metric", F.concat("metric", F.lit('_bucket{le="'), number_text(F.col("b")), F.lit('"} '), F.col("c").cast("string"), F.lit(" "), stamp).alias("line"))
    totals = hist.groupBy(*by).agg(F.sum(b * F.col("n")).alias("s"), F.sum("n").alias("c"))
    lines = F.explode(F.array(F.concat("metric", F.lit('_bucket{le="+Inf"} '), F.col("c").cast("string"), F.lit(" "), stamp), F.concat("metric", F.lit("_sum "), number_text(F.col("s")), F.lit(" "), stamp), F.concat("metric", F.lit("_count "), F.col("c").cast("string"), F.lit(" "), stamp)))
    return buckets.unionByName(totals.select("metric", lines.alias("line")))


def write(lines: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Lines (metric, line) as text files of at most `rows_per_file` lines, each with the TYPE lines of its metrics before their readings.

    A metric's readings are cut into numbered chunks of at most half of that, and chunks that fit go into
    one file. Readings of one series at one time stay together, so that the last still wins in its file;
    only they, or metrics of several kinds, make a file longer. Lines that start with # are
    repeated at the head of every chunk of their metric; metrics without readings have a chunk of those alone.
    """
    if rows_per_file < 2:
        raise ValueError("a file has a TYPE line and a reading at least")
    most = rows_per_file // 2
    held = materialize(lines.filter("line is not null").withColumn("__head", F.col("line").startswith("#")), "lines")
    series = F.regexp_replace("line", r"\s\S+(\s-?\d+)$", "$1")
    readings = prefix_sums(held.filter("not __head").withColumn("__series", series), ["metric"], ["__series", "line"], out="__place", hashed=["__series"])
    first = F.min("__place").over(Window.partitionBy("metric", "__series"))
    cut = materialize(readings.select("metric", "line", "__head", F.floor(first / most).alias("__chunk")), "chunks")
    heads = held.filter("__head").select("metric", "line", "__head").join(cut.select("metric", "__chunk").distinct(), "metric", "left").withColumn("__chunk", F.coalesce("__chunk", F.lit(0).cast("bigint")))
    every = cut.unionByName(heads)
    sizes = every.groupBy("metric", "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    total = sizes.agg(F.sum("__n")).first()[0] or 1
    per = max(1, min(most, total // int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))))  # few lines are still spread over tasks
    placed = prefix_sums(sizes, [], ["metric", "__chunk"], weight=F.col("__n"), out="__at").select("metric", "__chunk", F.floor(F.col("__at") / per).cast("int").alias("__file"))
    numbered = every.join(placed, ["metric", "__chunk"]).repartitionById(-(-total // per), F.col("__file"))
    numbered.sortWithinPartitions("metric", ~F.col("__head"), "line").select("line").write.text(path)


def plain(readings: DataFrame) -> DataFrame:
    """(line): a reading a line, `label time value...`, for rows (label, kind, ts, value, moments, hist): counters and gauges have a value, moments n and four sums, a histogram a line for each boundary and count.

    `value` is a double, `moments` a struct (n, m1..m4), `hist` an array of structs (boundary, n); what a
    kind doesn't use may be null. Times are milliseconds.
    """
    head = F.concat_ws(" ", "label", F.unix_millis("ts").cast("string"))
    one = F.concat_ws(" ", head, number_text(F.col("value")))
    moments = F.concat_ws(" ", head, F.col("moments.n").cast("string"), *[number_text(F.col(f"moments.m{i}")) for i in range(1, 5)])
    buckets = F.transform("hist", lambda h: F.concat(head, F.lit(" {approx="), number_text(h["boundary"]), F.lit("} "), h["n"].cast("string")))
    lines = F.when(F.col("kind") == "moments", F.array(moments)).when(F.col("kind") == "histogram", buckets).otherwise(F.array(one))
    return readings.select(F.explode(lines).alias("line"))
