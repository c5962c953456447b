"""Queries over text, logs and versioned records."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import tags, tuples, values
from quern.operators import logs, text, versions
from quern.operators import records as record_sets
from quern.operators.prefix import previous
from quern.session import table, workspace
from quern.sources import files

NEEDLE, TWIN = "the", "ss"
AT = 1_742_000_000_000_000
QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text")


# Text.

_OFFSETS = "SELECT doc_id, p - 1 AS \"offset\" FROM (SELECT doc_id, text, unnest(range(1, length(text) - {n} + 2)) AS p FROM documents WHERE contains(text, '{w}')) WHERE substr(text, p, {n}) = '{w}'"


@_query(_OFFSETS.format(w=NEEDLE, n=len(NEEDLE)))
def txt_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.search(_documents(spark, sf_dir), NEEDLE).select("doc_id", "offset")


@_query(f"SELECT doc_id, count(o.\"offset\") AS n FROM documents LEFT JOIN ({_OFFSETS.format(w=TWIN, n=len(TWIN))}) o USING (doc_id) GROUP BY doc_id")
def txt_count_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", text.count(F.col("text"), TWIN).cast("bigint").alias("n"))


@_query("SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS n FROM documents")
def txt_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", text.count(F.col("text"), NEEDLE).cast("bigint").alias("n"))


@_query("SELECT doc_id, CAST(sum(length(text) + 1) OVER (ORDER BY doc_id) - length(text) - 1 AS BIGINT) AS start FROM documents")
def txt_offset_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.starts(_documents(spark, sf_dir), "doc_id").select("doc_id", "start")


_STARTS = "s AS (SELECT doc_id, sum(length(text) + 1) OVER (ORDER BY doc_id) - length(text) - 1 AS start FROM documents)"


@_query(f"WITH {_STARTS}, g AS (SELECT event_id * 100 AS at FROM events WHERE event_id * 100 <= (SELECT max(start) FROM s)) SELECT CAST(g.at AS BIGINT) AS at, s.doc_id AS record, CAST(g.at - s.start AS BIGINT) AS \"offset\" FROM g ASOF JOIN s ON g.at >= s.start")
def txt_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    last = text.starts(documents, "doc_id").agg(F.max("start")).first()[0] or 0
    asked = table(spark, sf_dir, "events").select((F.col("event_id") * 100).alias("at")).filter(F.col("at") <= last)
    return text.lookup(documents, asked, "doc_id")


@_query("SELECT doc_id, text FROM documents WHERE doc_id IN (3, 5, 8)")
def txt_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.retrieve(_documents(spark, sf_dir), "doc_id", [3, 5, 8]).select("doc_id", "text")


_PIECES = r"SELECT doc_id, source, unnest(regexp_extract_all(text, '\(([^()]*?)\)', 1)) AS piece FROM documents"
_TOP = "SELECT piece, count(*) AS n FROM ({p}) {w} GROUP BY piece ORDER BY n DESC, piece LIMIT {k}"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.pieces(_documents(spark, sf_dir), r"\(", r"\)", inside="[^()]*?")


@_query(_TOP.format(p=_PIECES, w="", k=10))
def txt_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.exemplars(_found(spark, sf_dir), 10)


@_query(_TOP.format(p=_PIECES, w="WHERE length(piece) >= 20", k=10))
def txt_exemplars_min_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.exemplars(_found(spark, sf_dir), 10, min_length=20)


@_query(_TOP.format(p=_PIECES, w="WHERE suffix(piece, '!')", k=10))
def txt_exemplars_from_needle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.exemplars(_found(spark, sf_dir), 10, suffix="!")


@_query(_TOP.format(p=_PIECES, w="WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'plenary_record')", k=10))
def txt_correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = _documents(spark, sf_dir).filter("source = 'plenary_record'")
    return text.correlates(_found(spark, sf_dir), chosen, "doc_id", 10)


@_query("SELECT substr(text, p + 3, 1) AS symbol, count(*) AS n FROM (SELECT text, unnest(range(1, length(text) - 1)) AS p FROM documents WHERE contains(text, 'the')) WHERE substr(text, p, 3) = 'the' AND substr(text, p + 3, 1) <> '' GROUP BY 1")
def txt_next_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.next_symbols(_documents(spark, sf_dir), NEEDLE)


@_query("SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS \"rank\" FROM events")
def txt_rank_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.rank_select(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_type"], "event_id")


# Logs: an event as a record {"type", "user", "props": {"k"}, "big", "tags": [type, user % 5]}.


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"), F.from_json("props", "k bigint").alias("props"), (F.col("value") > 100).alias("big"), F.array(F.to_variant_object(F.struct(F.col("event_type").alias("name"))), F.to_variant_object(F.struct((F.col("user_id") % 5).alias("shard")))).alias("tags")))
    return logs.leaves(table(spark, sf_dir, "events").withColumn("value", value), "value", ["event_id"])


def _matching(query: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.query(_flat(spark, sf_dir), query).select("event_id")


_K = "CAST(json_extract(props, '$.k') AS BIGINT)"
for _name, _text, _where in (
    ("leaf", '{"type": "click"}', "event_type = 'click'"),
    ("bool", '{"big": true}', "value > 100"),
    ("number", '{"props": {"k": 69.0}}', f"{_K} = 69"),
    ("object", '{"type": "view", "user": 7, "props": {"k"}}', f"event_type = 'view' AND user_id = 7 AND {_K} IS NOT NULL"),
    ("array", '{"tags": [{"name": "error"}, {"shard": 3}]}', "event_type = 'error' AND user_id % 5 = 3"),
    ("or", '{"type": "error" or "signup", "props": {"k": 5 or 6}}', f"event_type IN ('error', 'signup') AND {_K} IN (5, 6)"),
    ("any", '{"props"}', f"{_K} IS NOT NULL"),
    ("unknown_path", '{"nothing": 1} or {"user": 12}', "user_id = 12"),
):
    QUERIES[f"log_match_{_name}"] = partial(_matching, _text)
    SQL[f"log_match_{_name}"] = f"SELECT event_id FROM events WHERE {_where}"

_LEAVES = f"""leaf AS (SELECT event_id, unnest([struct_pack(path := '$.type', kind := 'string', v := event_type), struct_pack(path := '$.user', kind := 'number', v := CAST(user_id AS VARCHAR)), struct_pack(path := '$.props.k', kind := 'number', v := CAST({_K} AS VARCHAR)),
    struct_pack(path := '$.big', kind := 'bool', v := CASE WHEN value > 100 THEN 'true' ELSE 'false' END), struct_pack(path := '$.tags[].name', kind := 'string', v := event_type), struct_pack(path := '$.tags[].shard', kind := 'number', v := CAST(user_id % 5 AS VARCHAR))], recursive := true) FROM events)"""


@_query(f"WITH {_LEAVES} SELECT path, kind, v AS \"value\", count(*) AS n FROM leaf WHERE v IS NOT NULL GROUP BY 1, 2, 3 ORDER BY n DESC, path, kind, v LIMIT 10")
def log_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.exemplars(_flat(spark, sf_dir), 10)


@_query(f"WITH {_LEAVES} SELECT path, kind, v AS \"value\", count(*) AS n FROM leaf WHERE v IS NOT NULL AND path <> '$.type' AND event_id IN (SELECT event_id FROM events WHERE event_type = 'purchase') GROUP BY 1, 2, 3 ORDER BY n DESC, path, kind, v LIMIT 10")
def log_correlates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.correlates(_flat(spark, sf_dir), '{"type": "purchase"}', 10, without=["$.type"])


@_query("SELECT event_id FROM events WHERE user_id % 5 <= 2")
def log_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.below_level(table(spark, sf_dir, "events").withColumn("level", F.col("user_id") % 5), 2).select("event_id")


@_query(f"SELECT event_id, {_K} AS k, CASE WHEN {_K} IS NULL THEN 'missing' ELSE 'BIGINT' END AS kind FROM events")
def log_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed path out of a schemaless value."""
    v = F.try_parse_json("props")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.k", "variant"))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.coalesce(kind, F.lit("missing")).alias("kind"))


_MADE = "'{\"a\": ' || CASE WHEN event_id % 4 = 0 THEN '{\"n\": ' || user_id || '}' WHEN event_id % 4 = 1 THEN '{\"n\": \"x\"}' WHEN event_id % 4 = 2 THEN '{}' ELSE '{\"n\": null}' END || ', \"t\": \"' || event_type || '\"}'"


def _made() -> Column:
    """A value of each kind at $.a.n: a number, a text, nothing, null."""
    n = F.col("event_id") % 4
    inner = F.when(n == 0, F.concat(F.lit('{"n": '), F.col("user_id").cast("string"), F.lit("}"))).when(n == 1, F.lit('{"n": "x"}')).when(n == 2, F.lit("{}")).otherwise(F.lit('{"n": null}'))
    return F.concat(F.lit('{"a": '), inner, F.lit(', "t": "'), "event_type", F.lit('"}'))


@_query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN user_id END AS n, CASE event_id % 4 WHEN 0 THEN NULL WHEN 2 THEN 'missing' ELSE 'mismatch' END AS error, event_type AS t, CASE WHEN event_id % 4 = 1 THEN 'x' END AS text, CASE event_id % 4 WHEN 0 THEN 'BIGINT' WHEN 1 THEN 'STRING' WHEN 3 THEN 'VOID' END AS kind FROM events")
def log_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed parts of values by path, with the reason where there is none."""
    v = F.parse_json(_made())
    n = values.extract(v, "$.a.n", "bigint")
    return table(spark, sf_dir, "events").select("event_id", n["value"].alias("n"), n["error"].alias("error"), values.require(v, "$.t", "string").alias("t"), values.extract(v, "$.a.n", "string")["value"].alias("text"), values.kind(v, "$.a.n").alias("kind"))


@_query(f"SELECT event_id, {_MADE} AS shown, {_MADE} AS again FROM events")
def log_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as text, as they came and put together again from their leaves."""
    rows = table(spark, sf_dir, "events").select("event_id", _made().alias("v"))
    flat = logs.leaves(rows, "v", ["event_id", "v"], indexed=True)
    return flat.select("event_id", values.display(F.col("v")).alias("shown"), values.display(values.rebuild(F.col("leaves"))).alias("again"))


# Keys of several elements.


@_query("""WITH o AS (SELECT o_orderkey, '01' || hex(o_orderstatus) || '0000' || translate('01' || '8' || lpad(hex(o_custkey), 15, '0') , '0123456789ABCDEF', 'FEDCBA9876543210') || CASE WHEN o_orderkey % 3 = 0 THEN '00' ELSE '01' || '7' || lpad(hex((1::HUGEINT << 60) - o_orderkey), 15, '0') END AS key_hex, o_orderstatus AS s, o_custkey AS c, CASE WHEN o_orderkey % 3 > 0 THEN -o_orderkey END AS k FROM orders) SELECT * FROM o""")
def key_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a text, a falling number and a number below zero or null, and their elements read again."""
    number = F.when(F.col("o_orderkey") % 3 > 0, -F.col("o_orderkey"))
    key = tuples.encode([(F.col("o_orderstatus"), "string", False), (F.col("o_custkey"), "int", True), (number, "int", False)])
    rows = table(spark, sf_dir, "orders").select("o_orderkey", key.alias("key"))
    s, c, k = tuples.decode(F.col("key"), [("string", False), ("int", True), ("int", False)])
    return rows.select("o_orderkey", F.hex("key").alias("key_hex"), s.alias("s"), c.alias("c"), k.alias("k"))


@_query("SELECT (SELECT count(*) FROM orders) AS n, CAST(0 AS BIGINT) AS disorder, CAST(0 AS BIGINT) AS overlaps")
def key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run written in the order of its keys and falling times: rows that are out of order in their file, and files whose key ranges meet."""
    rows = table(spark, sf_dir, "orders").select(tuples.encode([(F.col("o_custkey"), "int", True)]).alias("key"), F.col("o_custkey").alias("c"), F.unix_micros("o_orderdate").alias("ts"), F.lit(None).cast("binary").alias("value"))
    path = workspace(spark, "run")
    files.write_run(rows, path, ["key"], rows_per_file=4000)
    run = files.read_run(spark, path).select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"))
    held = previous(run, ["file"], "place", ["c", "ts"], "b")
    wrong = (F.col("b.c") < F.col("c")) | ((F.col("b.c") == F.col("c")) & (F.col("b.ts") < F.col("ts")))
    ends = files.run_metadata(run, "c")
    across = previous(ends, [], "first_key", ["last_key"], "b")  # a row for each file
    meets = across.agg(F.count_if(F.col("b.last_key") > F.col("first_key")).alias("overlaps"))
    return held.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(wrong.cast("bigint")), F.lit(0)).alias("disorder")).withColumn("overlaps", F.lit(meets.first()[0]).cast("bigint"))


# Tags.

_TAGSETS = "SELECT o_orderkey, ':priority=' || replace(o_orderpriority, ' ', '') || ':status=' || o_orderstatus || ':' AS tags FROM orders"


@_query(f"SELECT o_orderkey FROM ({_TAGSETS}) WHERE contains(tags, ':status=F:') AND contains(tags, ':priority=1-URGENT:')")
def tag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag containment on canonical tag sets."""
    own = F.concat(F.lit(":status="), "o_orderstatus", F.lit(":priority="), F.replace("o_orderpriority", F.lit(" "), F.lit("")), F.lit(":"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", tags.canonical(own).alias("tags"))
    return rows.filter(tags.covers(F.col("tags"), {"status": "F", "priority": "1-URGENT"})).select("o_orderkey")


@_query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def tag_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by an index of postings."""
    own = F.concat(F.lit(":status="), "o_orderstatus", F.lit(":priority="), "o_orderpriority", F.lit(":"))
    index = record_sets.tag_index(table(spark, sf_dir, "orders").select("o_orderkey", own.alias("tags")), "o_orderkey")
    return record_sets.search_index(index, "o_orderkey", {"status": "F", "priority": "1-URGENT"})


@_query("SELECT sample_id, ':' || array_to_string(list_sort(list_filter(string_split(tags, ':'), lambda t: t <> '')), ':') || ':' AS canonical, split_part(list_filter(string_split(tags, ':'), lambda t: starts_with(t, '__name__='))[1], '=', 2) AS name FROM samples")
def tag_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tags.parse(F.col("tags"))
    return table(spark, sf_dir, "samples").select("sample_id", tags.render(own).alias("canonical"), F.try_element_at(own, F.lit("__name__")).alias("name"))


# Versions.

KEYS = ["keyspace", "kv_key"]


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "kv_versions").select(*KEYS, "ts", F.col("val").alias("value"), "version_id")


def _hex(df: DataFrame) -> DataFrame:
    return df.select("keyspace", F.hex("kv_key").alias("key_hex"), "ts", F.hex("value").alias("val_hex"))


_V = "v AS (SELECT DISTINCT keyspace, kv_key, ts, val, version_id FROM kv_versions WHERE ts IS NOT NULL)"
_PRUNED = "SELECT keyspace, hex(kv_key) AS key_hex, ts, hex(val) AS val_hex FROM (SELECT *, row_number() OVER (PARTITION BY keyspace, kv_key ORDER BY ts DESC, version_id DESC) AS rn FROM {src} WHERE {where}) WHERE rn = 1 AND val IS NOT NULL"


@_query(f"WITH {_V} {_PRUNED.format(src='v', where=f'ts <= {AT}')}")
def kv_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot as of a time."""
    return _hex(versions.prune(_versions(spark, sf_dir), KEYS, AT, tie="version_id"))


@_query(f"WITH {_V} {_PRUNED.format(src='v', where='true')}")
def kv_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping runs merged and pruned once."""
    every = _versions(spark, sf_dir)
    runs = every.filter("version_id % 3 <> 0"), every.filter("version_id % 2 = 0 or version_id % 3 = 0")
    return _hex(versions.prune(versions.merge(*runs), KEYS, tie="version_id"))


_LEDGER = "ledger/0/heartbeat"


@_query(f"WITH {_V} {_PRUNED.format(src='v', where='''kv_key = encode('ledger/0/heartbeat') AND keyspace = 'keep' ''')}")
def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(versions.get(_versions(spark, sf_dir), KEYS, ["keep", bytearray(_LEDGER, "utf-8")], tie="version_id"))


@_query(f"WITH {_V} {_PRUNED.format(src='v', where='''keyspace >= 'blob' AND keyspace < 'echo' ''')}")
def kv_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(versions.range_scan(_versions(spark, sf_dir), KEYS, "blob", "echo", tie="version_id"))


@_query("SELECT version_id FROM (SELECT DISTINCT version_id, keyspace FROM kv_versions) WHERE keyspace > 'blob' AND keyspace <= 'echo'")
def kv_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.bounds(_versions(spark, sf_dir), "keyspace", "blob", "echo", low_open=True, high_open=False).select("version_id").distinct()


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 500 ORDER BY o_orderkey LIMIT 100")
def kv_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a cursor: the next hundred keys from a place on."""
    rows = table(spark, sf_dir, "orders").withColumn("ts", F.lit(0))
    return versions.page(rows, ["o_orderkey"], 500).select("o_orderkey", "o_custkey")


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey <= 500 ORDER BY o_orderkey DESC LIMIT 100")
def kv_page_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("ts", F.lit(0))
    return versions.page(rows, ["o_orderkey"], 500, backward=True).select("o_orderkey", "o_custkey")


@_query(f"WITH {_V}, w AS (SELECT keyspace, kv_key, ts, val, version_id FROM v UNION ALL SELECT keyspace, kv_key, 9000000000000000, CASE WHEN octet_length(kv_key) % 2 = 0 THEN kv_key END, 0 FROM (SELECT DISTINCT keyspace, kv_key FROM v WHERE keyspace = 'cart')) {_PRUNED.format(src='w', where='true')}")
def kv_write_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of puts and deletes on top of the history."""
    rows = _versions(spark, sf_dir).filter("ts is not null")
    batch = rows.filter("keyspace = 'cart'").select(*KEYS).distinct().withColumn("value", F.when(F.octet_length("kv_key") % 2 == 0, F.col("kv_key")))
    written = versions.write_batch(rows.select(*KEYS, "ts", "value", "version_id"), batch.withColumn("version_id", F.lit(0).cast("bigint")), 9_000_000_000_000_000, [*KEYS, "version_id"])
    return _hex(versions.prune(written, KEYS, tie="version_id"))


NOW = 1_743_600_000_000_000
DAY = 86_400_000_000


def _gc(policy: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(versions.collect_garbage(_versions(spark, sf_dir), KEYS, policy, NOW))


_GC = """WITH v AS (SELECT DISTINCT keyspace, kv_key, ts, val FROM kv_versions WHERE ts IS NOT NULL),
a AS (SELECT *, count(val) OVER (PARTITION BY keyspace, kv_key ORDER BY ts DESC, val NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS grp FROM v),
b AS (SELECT *, max(CASE WHEN val IS NOT NULL THEN ts END) OVER g AS vts, min(CASE WHEN val IS NULL THEN ts END) OVER g AS tts FROM a WINDOW g AS (PARTITION BY keyspace, kv_key, grp)),
c AS (SELECT *, sum(CASE WHEN val IS NOT NULL THEN 1 + CASE WHEN tts IS NOT NULL THEN 1 ELSE 0 END ELSE 0 END) OVER (PARTITION BY keyspace, kv_key ORDER BY grp RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM b WHERE vts IS NOT NULL)
SELECT keyspace, hex(kv_key) AS key_hex, ts, hex(val) AS val_hex FROM c WHERE (val IS NOT NULL OR ts = tts) AND ({where})"""
for _name, _text, _where in (
    ("versions", "versions = 2", "cum <= 2"),
    ("ttl", f"ttl_micros = {20 * DAY}", f"vts >= {NOW - 20 * DAY}"),
    ("any", f"any(versions = 1, ttl_micros = {10 * DAY})", f"cum <= 1 OR vts >= {NOW - 10 * DAY}"),
    ("all", f"all(versions = 3, ttl_micros = {20 * DAY},)", f"cum <= 3 AND vts >= {NOW - 20 * DAY}"),
):
    QUERIES[f"kv_gc_{_name}"] = partial(_gc, _text)
    SQL[f"kv_gc_{_name}"] = _GC.format(where=_where)


@_query("SELECT DISTINCT file_id FROM sst_files WHERE first_key <= encode('pier') AND last_key >= encode('kelp')")
def kv_overlapping_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.overlapping(table(spark, sf_dir, "sst_files"), bytearray(b"kelp"), bytearray(b"pier")).select("file_id").distinct()


@_query("""WITH p AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) AS at FROM orders), v AS (SELECT o_custkey, epoch_us(o_orderdate) AS t, max(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
    SELECT p.o_orderkey, p.at, v.k AS "value" FROM p ASOF LEFT JOIN v ON p.o_custkey = v.o_custkey AND p.at >= v.t""")
def kv_as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with its customer's newest finished order at that time."""
    orders = table(spark, sf_dir, "orders").withColumn("at", F.unix_micros("o_orderdate"))
    finished = orders.filter("o_orderstatus = 'F'").groupBy("o_custkey", F.col("at").alias("ts")).agg(F.max("o_orderkey").alias("value"))
    return versions.as_of_join(orders.select("o_custkey", "o_orderkey", "at"), finished, ["o_custkey"], "at").select("o_orderkey", "at", "value")
