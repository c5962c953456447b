"""Queries of problems 2 and 5: consolidating files, applying a change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import changefeed, compaction
from quern.session import materialize, table, workspace

IDENTITY = ["store", "kv_key", "ts", "val"]


#: The size of bins in `p2_fill`, so that even the smallest tables fill several.
SMALL_TARGET = 1 << 14


def _compacted(spark: SparkSession, sf_dir: str, target_bytes: int = compaction.TARGET_BYTES) -> compaction.Compaction:
    return compaction.compact(table(spark, sf_dir, "file_records"), table(spark, sf_dir, "sst_files"), IDENTITY, "rec_id", target_bytes=target_bytes)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compacted(spark, sf_dir).records.select("rec_id")


def p2_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file of the frozen list with the bytes of the records it keeps, and its bin."""
    return _compacted(spark, sf_dir).bins.select("file_id", "size_bytes", "bin_id")


def p2_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packed for bins of 16 kB: the files, their bytes, bins that hold too much, and whether the bins are as few as first-fit decreasing promises."""
    bins = _compacted(spark, sf_dir, SMALL_TARGET).bins
    whole = F.coalesce(F.sum(F.when(F.col("parts") == 1, F.col("size_bytes"))), F.lit(0))
    each = bins.groupBy("bin_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), whole.alias("whole"), F.max(F.col("parts") > 1).alias("cut"))
    few = F.count_if(~F.col("cut")) <= F.ceil(F.sum("whole") / F.lit(SMALL_TARGET)) * 11 / 9 + 1
    return each.agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.count_if(F.col("whole") > SMALL_TARGET).alias("overfull"), few.alias("few"))


def p2_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as real small files in a folder, one for each file_id, consolidated: every row once, and the number of files then."""
    source, target = workspace(spark, "small"), workspace(spark, "folder")
    rows = table(spark, sf_dir, "file_records")
    rows.repartition(16, "file_id").sortWithinPartitions("file_id").write.option("maxRecordsPerFile", 40).parquet(source)
    done = compaction.compact_folder(spark, source, target)
    here = done.records.withColumn("__file", F.col("_metadata.file_path")).groupBy("rec_id", "file_id").agg(F.count(F.lit(1)).alias("n"), F.min("__file").alias("__file"))
    return here.select("rec_id", "file_id", "n", F.lit(done.report["bins"]).cast("bigint").alias("bins"))


def p2_manifest_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest says of each file against what the records say."""
    said = table(spark, sf_dir, "sst_files").groupBy("file_id").agg(F.max("n_records").alias("said_records"), F.countDistinct(F.regexp_replace(F.regexp_replace("out_path", r"(^|/)(\./)+", "$1"), "/+", "/")).alias("paths"))
    held = table(spark, sf_dir, "file_records").groupBy("file_id").agg(F.count(F.lit(1)).alias("held_records"))
    both = said.join(held, "file_id", "full_outer")
    return both.select("file_id", "said_records", F.coalesce("held_records", F.lit(0)).alias("held_records"), F.coalesce("paths", F.lit(0)).alias("paths"))


KEYS, BATCH = ["keyspace", "kv_key"], ["keyspace", "ts"]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table is a feed that has ended: its missing change numbers are declared void, and every batch (keyspace, ts) is assembled and committed."""
    changes = table(spark, sf_dir, "kv_changes")
    void = materialize(changefeed.gaps(changes, "change_id"), "void")
    state = changefeed.replay(changes, KEYS, txn=BATCH, seq="change_id", declared=void)
    return state.select("keyspace", F.hex("kv_key").alias("key_hex"), "ts", "batch_pos")


def p5_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of change numbers that never came."""
    return changefeed.gaps(table(spark, sf_dir, "kv_changes"), "change_id")


def p5_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contiguous watermark of the change numbers that have arrived."""
    return changefeed.contiguous_watermark(table(spark, sf_dir, "kv_changes"), "change_id")


def p5_open_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state as an open feed shows it: only what lies at or before the watermark of change numbers, and no batch in part."""
    state = changefeed.replay(table(spark, sf_dir, "kv_changes"), KEYS, txn=BATCH, seq="change_id")
    return state.select("keyspace", F.hex("kv_key").alias("key_hex"), "ts", "batch_pos", F.hex("val").alias("val_hex"))


def p5_half_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state when only the gaps in the lower half of the numbers are declared void: what lies behind the first gap above waits."""
    changes = table(spark, sf_dir, "kv_changes")
    void = changefeed.gaps(changes, "change_id").filter(F.col("last") <= F.lit((changes.agg(F.max("change_id")).first()[0] or 0) // 2))
    state = changefeed.replay(changes, KEYS, txn=BATCH, seq="change_id", declared=materialize(void, "void"))
    return state.select("keyspace", F.hex("kv_key").alias("key_hex"), "ts", "batch_pos", F.hex("val").alias("val_hex"))


QUERIES = {f.__name__: f for f in (p2_found, p2_bins, p2_fill, p2_folder, p2_manifest_claims, p5_found, p5_gaps, p5_watermark, p5_open_state, p5_half_declared)}

_LAST = """
last AS (SELECT *, row_number() OVER (PARTITION BY keyspace, kv_key ORDER BY ts DESC, coalesce(batch_pos, -2147483648) DESC) AS rn
         FROM {src} WHERE keyspace IS NOT NULL AND kv_key IS NOT NULL AND ts IS NOT NULL)
"""
_LIVE = "rn = 1 AND val IS NOT NULL AND NOT coalesce(lower(trim(op)) IN ('d', 'del', 'delete'), false)"
_SEQ = "n AS (SELECT DISTINCT change_id AS n FROM kv_changes WHERE change_id >= 1), g AS (SELECT lag(n, 1, 0) OVER (ORDER BY n) + 1 AS \"first\", n - 1 AS \"last\" FROM n), gap AS (SELECT * FROM g WHERE \"first\" <= \"last\")"
_MARK = "mark AS (SELECT coalesce((SELECT min(\"first\") - 1 FROM gap{where}), (SELECT max(n) FROM n), 0) AS watermark)"
# A batch is shown when the first number of each of its changes lies at or before the watermark.
_SHOWN = """once AS (SELECT keyspace, ts, kv_key, batch_pos, op, val, min(change_id) AS f FROM (SELECT keyspace, ts, kv_key, batch_pos, CASE WHEN val IS NULL OR coalesce(lower(trim(op)) IN ('d', 'del', 'delete'), false) THEN 'del' ELSE 'set' END AS op,
    CASE WHEN coalesce(lower(trim(op)) IN ('d', 'del', 'delete'), false) THEN NULL ELSE val END AS val, change_id FROM kv_changes WHERE keyspace IS NOT NULL AND kv_key IS NOT NULL AND ts IS NOT NULL) GROUP BY ALL),
    whole AS (SELECT keyspace, ts FROM once GROUP BY 1, 2 HAVING max(f) <= (SELECT watermark FROM mark)),
    shown AS (SELECT c.* FROM kv_changes c SEMI JOIN whole w ON c.keyspace = w.keyspace AND c.ts = w.ts WHERE change_id <= (SELECT watermark FROM mark))"""
_KEPT = "kept AS (SELECT rec_id, file_id, 8 + coalesce(strlen(store), 0) + coalesce(octet_length(kv_key), 0) + coalesce(octet_length(val), 0) AS b FROM (SELECT *, row_number() OVER (PARTITION BY store, kv_key, ts, val ORDER BY rec_id, file_id NULLS FIRST) AS rn FROM file_records) WHERE rn = 1), f AS (SELECT file_id, CAST(sum(b) AS BIGINT) AS size_bytes FROM (SELECT file_id, b FROM kept UNION ALL SELECT file_id, 0 FROM file_records UNION ALL SELECT file_id, 0 FROM sst_files) GROUP BY file_id)"

SQL = {
    "p2_found": "SELECT min(rec_id) AS rec_id FROM file_records GROUP BY store, kv_key, ts, val",
    # All files together fill no bin, so there is one.
    "p2_bins": f"WITH {_KEPT} SELECT file_id, size_bytes, CASE WHEN sum(size_bytes) OVER () < 133000000 THEN CAST(0 AS BIGINT) END AS bin_id FROM f",
    "p2_fill": f"WITH {_KEPT} SELECT count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS overfull, true AS few FROM f",
    "p2_folder": "SELECT rec_id, file_id, count(*) AS n, CAST(1 AS BIGINT) AS bins FROM file_records GROUP BY ALL",
    "p2_manifest_claims": r"""
        WITH said AS (SELECT file_id, max(n_records) AS said_records, count(DISTINCT regexp_replace(regexp_replace(out_path, '(^|/)(\./)+', '\1', 'g'), '/+', '/', 'g')) AS paths FROM sst_files GROUP BY file_id),
             held AS (SELECT file_id, count(*) AS held_records FROM file_records GROUP BY file_id)
        SELECT file_id, said_records, coalesce(held_records, 0) AS held_records, coalesce(paths, 0) AS paths FROM said FULL JOIN held USING (file_id)""",
    "p5_found": f"WITH {_LAST.format(src='kv_changes')} SELECT keyspace, hex(kv_key) AS key_hex, ts, batch_pos FROM last WHERE {_LIVE}",
    "p5_gaps": f"WITH {_SEQ} SELECT * FROM gap",
    "p5_watermark": f"WITH {_SEQ}, {_MARK.format(where='')} SELECT watermark FROM mark",
    "p5_open_state": f"WITH {_SEQ}, {_MARK.format(where='')}, {_SHOWN}, {_LAST.format(src='shown')} SELECT keyspace, hex(kv_key) AS key_hex, ts, batch_pos, hex(val) AS val_hex FROM last WHERE {_LIVE}",
    "p5_half_declared": f"WITH {_SEQ}, {_MARK.format(where=' WHERE last > (SELECT max(n) FROM n) // 2')}, {_SHOWN}, {_LAST.format(src='shown')} SELECT keyspace, hex(kv_key) AS key_hex, ts, batch_pos, hex(val) AS val_hex FROM last WHERE {_LIVE}",
}
