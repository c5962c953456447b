"""Queries that run a stream over the tables to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.prefix import estimated_bytes
from quern.operators.store import Store
from quern.session import materialize, table, workspace
from quern.sources import exposition, files
from quern.streaming import ingest


def _staged(df: DataFrame, purpose: str, files: int) -> str:
    """A folder of at least so many files to stream from, written by that many tasks or more."""
    path = workspace(df.sparkSession, purpose)
    df.repartition(max(files, estimated_bytes(df) >> 27)).write.parquet(path)
    return path


def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed applied as a stream in several batches, each up to its watermark; at its end the feed declares its gaps void."""
    changes = table(spark, sf_dir, "kv_changes").select("change_id", "keyspace", "kv_key", "ts", "batch_pos", "op", "val")
    path, state = _staged(changes, "feed", 8), workspace(spark, "state")
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 3).parquet(path)
    keys = ["keyspace", "kv_key"]
    ingest.apply_changes(stream, keys, state, workspace(spark, "progress"), txn=["keyspace", "ts"], seq="change_id").awaitTermination()
    ingest.seal(spark, state, keys, txn=["keyspace", "ts"], seq="change_id")
    return ingest.read_state(spark, state, keys).select("keyspace", F.hex("kv_key").alias("key_hex"), "ts", "batch_pos")


def stream_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all events counted by the second, with a watermark, and the gaps filled; the files are one batch, so none comes late."""
    events = table(spark, sf_dir, "events").select("ts")
    path, out = _staged(events, "events", 4), workspace(spark, "seconds")
    stream = ingest.per_second(spark.readStream.schema(events.schema).parquet(path), "ts", "0 seconds")
    # Closed windows only: the last second stays open until later records come.
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", workspace(spark, "progress")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return ingest.fill(spark.read.schema("second timestamp, n bigint").parquet(out)).select(F.unix_micros("second").alias("second_us"), "n")


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as they arrive, each sample_id once within the lateness: the repeats are dropped."""
    rows = table(spark, sf_dir, "samples").filter("arrived_at is not null").select("sample_id", "arrived_at")
    path, out = _staged(rows, "samples", 4), workspace(spark, "first")
    once = ingest.first_of_each(spark.readStream.schema(rows.schema).parquet(path), ["sample_id"], "arrived_at", "400 days")
    once.writeStream.format("parquet").option("path", out).option("checkpointLocation", workspace(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))


def stream_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitors of every user's purchases and errors with their latch, over three batches of readings: what was seen last, whether it fired in the batch, and since when."""
    along = Window.partitionBy("user_id").orderBy("event_id")
    ok, bad = (F.sum((F.col("event_type") == t).cast("bigint")).over(along) for t in ("purchase", "error"))
    events = table(spark, sf_dir, "events")
    third = F.floor(F.col("event_id") * 3 / F.lit((events.agg(F.max("event_id")).first()[0] or 0) + 1)).cast("int")
    reset = (F.col("event_type") == "signup") & (third > 0)
    readings = events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("at"), ok.cast("double").alias("a"), bad.cast("double").alias("b"), reset.alias("reset"), third.alias("third"))
    readings = materialize(readings, "readings")
    path, out, progress = workspace(spark, "arriving"), workspace(spark, "alerts"), workspace(spark, "progress")
    for i in range(3):  # each run takes up the state that the one before left
        readings.filter(F.col("third") == i).drop("third").write.mode("append").parquet(path)
        stream = ingest.alerts(spark.readStream.schema(readings.drop("third").schema).parquet(path), "stationary")
        stream.writeStream.foreachBatch(lambda b, _, i=i: b.write.mode("overwrite").parquet(f"{out}/third={i}")).outputMode("update").option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("third", "key", "readings", "firing", "value", "fired_at", "first_condition", "latest_condition")


def stream_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files tailed as they come, into a table of records."""
    path, out = workspace(spark, "logs"), workspace(spark, "records")
    rows = table(spark, sf_dir, "events").select(F.lit("f").alias("file"), F.col("event_id").cast("int").alias("line"), (F.col("user_id") % 5).alias("level"), F.unix_micros("ts").alias("timestamp"), F.col("props").alias("value"))
    files.emit_log(rows.repartition(6), path)
    ingest.tail_logs(spark, path, out, workspace(spark, "progress"), files_at_once=2).awaitTermination()
    return spark.read.parquet(out).select("line", "level", "timestamp", F.get_json_object("value", "$.k").cast("bigint").alias("k"))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that arrive in a folder are ingested into a store as they come, in pieces of bounded size."""
    rows = table(spark, sf_dir, "kv_versions").filter("ts is not null and keyspace is not null and kv_key is not null")
    key = F.concat(F.encode(F.concat("keyspace", F.lit("/")), "UTF-8"), F.col("kv_key"))
    rows = rows.select(key.alias("key"), "ts", F.col("val").alias("value"))
    path, place = _staged(rows, "incoming", 6), workspace(spark, "store")
    ingest.ingest_runs(spark, path, place, workspace(spark, "progress"), files_at_once=4, rows_per_file=5000).awaitTermination()
    return Store(spark, place).scan().select(F.hex("key").alias("key_hex"), F.hex("value").alias("val_hex"))


def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric files read as they come, a file a batch, into samples."""
    events = table(spark, sf_dir, "events")
    made = events.select(F.col("event_type").alias("metric"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"), F.lit("counter").alias("kind"), "ts", "value")
    path, out = workspace(spark, "metrics"), workspace(spark, "samples")
    exposition.write(exposition.emit(made), path)
    ingest.load_metrics(ingest.watch_metrics(spark, path, files_at_once=4), out, workspace(spark, "progress")).awaitTermination()
    return spark.read.parquet(out).select("tags", F.unix_millis("ts").alias("ms"), "value")


QUERIES = {f.__name__: f for f in (stream_changes, stream_seconds, stream_late, stream_monitor, stream_logs, stream_ingest, stream_metrics)}
_LAST = "SELECT *, row_number() OVER (PARTITION BY keyspace, kv_key ORDER BY ts DESC, coalesce(batch_pos, -2147483648) DESC) AS rn FROM kv_changes WHERE keyspace IS NOT NULL AND kv_key IS NOT NULL AND ts IS NOT NULL"
SQL = {
    "stream_changes": f"SELECT keyspace, hex(kv_key) AS key_hex, ts, batch_pos FROM ({_LAST}) WHERE rn = 1 AND val IS NOT NULL AND NOT coalesce(lower(trim(op)) IN ('d', 'del', 'delete'), false)",
    "stream_seconds": "WITH s AS (SELECT date_trunc('second', ts) AS s, count(*) AS n FROM events GROUP BY 1), c AS (SELECT * FROM s WHERE s < (SELECT max(s) FROM s)), e AS (SELECT epoch_us(min(s)) AS a, epoch_us(max(s)) AS b FROM c), g AS (SELECT unnest(range(a, b + 1, 1000000)) AS u FROM e) SELECT u AS second_us, coalesce(n, 0) AS n FROM g LEFT JOIN c ON epoch_us(c.s) = g.u",
    "stream_late": "SELECT sample_id, CAST(1 AS BIGINT) AS n FROM samples WHERE arrived_at IS NOT NULL GROUP BY 1",
    # A counter fires where it moved; a reset clears what fired up to it, in its batch and before.
    "stream_monitor": """WITH r AS (SELECT user_id, event_id, event_type, CAST(event_id * 3 // ((SELECT max(event_id) FROM events) + 1) AS INTEGER) AS third, CAST(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS DOUBLE) AS a FROM events),
        f AS (SELECT *, a <> lag(a, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS fires, event_type = 'signup' AND third > 0 AS reset FROM r),
        b AS (SELECT user_id, third, count(*) AS readings, bool_or(fires) AS firing, arg_max(a, event_id) AS v FROM f GROUP BY 1, 2),
        z AS (SELECT b.*, (SELECT max(event_id) FROM f WHERE f.user_id = b.user_id AND f.third <= b.third AND f.reset) AS cleared FROM b),
        l AS (SELECT z.user_id, z.third, min(f.event_id) AS fired_at, arg_min(f.a, f.event_id) AS first_condition, arg_max(f.a, f.event_id) AS latest_condition FROM z JOIN f ON f.user_id = z.user_id AND f.third <= z.third AND f.fires AND f.event_id > coalesce(z.cleared, -1) GROUP BY 1, 2)
        SELECT z.third, CAST(z.user_id AS VARCHAR) AS key, readings, firing, v AS "value", fired_at, first_condition, latest_condition FROM z LEFT JOIN l ON l.user_id = z.user_id AND l.third = z.third""",
    "stream_logs": "SELECT CAST(event_id AS INTEGER) AS line, user_id % 5 AS level, epoch_us(ts) AS timestamp, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "stream_ingest": "SELECT hex(encode(keyspace || '/')) || hex(kv_key) AS key_hex, hex(val) AS val_hex FROM (SELECT *, row_number() OVER (PARTITION BY keyspace, kv_key ORDER BY ts DESC, val IS NULL DESC, val DESC) AS rn FROM kv_versions WHERE ts IS NOT NULL AND keyspace IS NOT NULL AND kv_key IS NOT NULL) WHERE rn = 1 AND val IS NOT NULL",
    "stream_metrics": "SELECT ':__name__=' || event_type || ':user=' || user_id || ':' AS tags, epoch_us(ts) // 1000 AS ms, max(value) AS \"value\" FROM events GROUP BY ALL",
}
