"""Queries of the object and stack languages, and of the sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import histogram, values
from quern.operators import statistics, store, text
from quern.operators.prefix import previous
from quern.plans import object_language, stack_language
from quern.session import table, workspace
from quern.sources import exposition, files

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Objects: customers with an account and a map of orders, each joined to its customer's nation.

SCHEMA = """
table Customer (sfixed64 c_custkey = 1) @ 1 {
    string name = 2;
    sfixed32 nation_id = 3;
    object account = 4 { double balance = 1; string segment = 2; };
    map sfixed64 orders = 5 { double total = 1; string status = 2; sfixed32 nation_id = 3; join nation = 4 on Nation(nation_id); };
    join nation = 6 on Nation(nation_id);
}
table Nation (sfixed32 n_nationkey = 1) @ 2 { string nation_name = 2; sfixed32 region = 3; }
"""


def _objects(spark: SparkSession, sf_dir: str) -> tuple[dict, dict[str, DataFrame]]:
    customer, orders, nation = (table(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    root = customer.select("c_custkey", F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation_id"), F.struct(F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")).alias("account"))
    owned = orders.join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").withColumnRenamed("o_custkey", "c_custkey")
    whole = object_language.assemble(root, ["c_custkey"], owned, "orders", "o_orderkey", {"total": F.col("o_totalprice"), "status": F.col("o_orderstatus"), "nation_id": F.col("c_nationkey")})
    nations = nation.select("n_nationkey", F.col("n_name").alias("nation_name"), F.col("n_regionkey").alias("region"))
    return object_language.parse_schema(SCHEMA), {"Customer": whole, "Nation": nations}


@_query("SELECT c_custkey, c_mktsegment AS segment, n_name AS nation_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def obj_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection with a nested object and a declared join."""
    out = object_language.select(*_objects(spark, sf_dir), "Customer { account { segment }, nation { nation_name } }")
    return out.select("c_custkey", "account.segment", "nation.nation_name")


@_query("SELECT c_custkey, c_acctbal AS balance FROM customer WHERE c_custkey = 7")
def obj_select_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return object_language.select(*_objects(spark, sf_dir), "Customer[7] { account { balance } }").select("c_custkey", "account.balance")


@_query("SELECT c_custkey, o_orderkey, o_totalprice AS total, n_name AS nation_name FROM customer JOIN orders ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def obj_select_map_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection that joins from within a map."""
    out = object_language.select(*_objects(spark, sf_dir), "Customer { orders { total, nation { nation_name } } }")
    return out.select("c_custkey", F.explode("orders").alias("o_orderkey", "v")).select("c_custkey", "o_orderkey", "v.total", "v.nation.nation_name")


@_query("SELECT c_custkey, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def obj_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested objects from flat tables, measured."""
    whole = _objects(spark, sf_dir)[1]["Customer"]
    total = F.aggregate(F.map_values("orders"), F.lit(0.0), lambda a, x: a + x["total"])
    return whole.select("c_custkey", F.size("orders").cast("bigint").alias("orders"), (F.round(total, 2) + 0.0).alias("total"))


@_query("SELECT unnest(['(1:Customer:TableID, 1:c_custkey:sfixed64)', '(1:Customer:TableID, 1:c_custkey:sfixed64, 4:account:message)', '(1:Customer:TableID, 1:c_custkey:sfixed64, 5:orders:map<sfixed64>)', '(2:Nation:TableID, 1:n_nationkey:sfixed32)']) AS key")
def obj_describe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = object_language.describe_keys(object_language.parse_schema(SCHEMA))
    return spark.createDataFrame([(k,) for k in keys], "key string")


@_query("SELECT 7 AS tables, true AS again, 'CustomerOrder' AS camel")
def obj_schema_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema written in its own language and read again, and its lines as protobuf: two tables' messages and what they hold."""
    schema = object_language.parse_schema(SCHEMA)
    lines = spark.createDataFrame([(x.strip(),) for x in object_language.protobuf_text(schema).splitlines()], "line string")
    again = object_language.parse_schema(object_language.schema_text(schema)) == schema
    held = lines.agg(F.count_if(F.col("line").startswith("message ") | F.col("line").contains("map<") | F.col("line").contains("Nation nation =")).cast("int").alias("tables"))
    return held.select("tables", F.lit(again).alias("again"), values.camel_case(F.lit("customer_order")).alias("camel"))


@_query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS finished, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F') AS pending, (SELECT max(epoch_us(o_orderdate)) FROM orders WHERE o_custkey = c_custkey) AS latest FROM customer")
def obj_assemble_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of two maps and a breakout field."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    value = {"total": F.col("o_totalprice")}
    maps = {"finished": (orders.filter("o_orderstatus = 'F'"), "o_orderkey", value), "pending": (orders.filter("o_orderstatus <> 'F'"), "o_orderkey", value)}
    whole = object_language.assemble_all(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], maps, {"latest": (orders, F.unix_micros("o_orderdate"))})
    return whole.select("c_custkey", *[F.size(m).cast("bigint").alias(m) for m in ("finished", "pending")], "latest")


# The stack language over line items and vectors.

_ITEM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


@_query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS v FROM lineitem")
def stack_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stack_language.Machine(_ITEM).column("l_extendedprice 1 l_discount - * 1 l_tax + *")
    return _items(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(c, 6).alias("v"))


@_query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN l_quantity * 2 ELSE l_quantity + 100 END + l_quantity AS v FROM lineitem")
def stack_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffles, combinators and a choice."""
    c = stack_language.Machine(_ITEM).column("l_quantity DUP [25 >] KEEP SWAP [2 *] [100 +] IF +")
    return _items(spark, sf_dir).select("l_orderkey", "l_linenumber", c.alias("v"))


@_query("SELECT l_orderkey, l_linenumber, (CAST(l_quantity AS BIGINT) & 7) + (CAST(l_quantity AS BIGINT) << 2) AS v, l_quantity >= 10 AND NOT (l_discount = 0) AS b FROM lineitem")
def stack_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stack_language.Machine(_ITEM)
    return _items(spark, sf_dir).select("l_orderkey", "l_linenumber", m.column("l_quantity [7 &] [2 <<] BI +").alias("v"), m.column("l_quantity 10 >= l_discount 0 = not and").alias("b"))


@_query("SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity + l_partkey % 7 AS a, xor(l_partkey | l_suppkey, l_partkey >> 3) & ~l_suppkey AS b, l_partkey <> l_suppkey OR l_tax < 0.02 OR l_discount = 0 AS c FROM lineitem")
def stack_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operators that the other programs lack."""
    m = stack_language.Machine((*_ITEM, "l_partkey", "l_suppkey"))
    a = m.column("l_extendedprice l_quantity / l_partkey 7 % +")
    b = m.column("l_partkey l_suppkey | l_partkey 3 >> ^ l_suppkey ~ &")
    c = m.column("l_partkey l_suppkey != l_tax 0.02 < || l_discount 0 == or")
    return _items(spark, sf_dir).select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"), c.alias("c"))


#: Programs over q, e and k (quantity, line number and part), each with the SQL of what it leaves.
_PROGRAMS = {
    "over": ("q e OVER - *", "q * (e - q)"), "rot": ("q e k ROT - +", "e + (k - q)"), "unrot": ("q e k -ROT - +", "k + (q - e)"), "nip": ("q e NIP", "e"), "tuck": ("q e TUCK - -", "e - (q - e)"), "twodup": ("q e 2DUP + + -", "q - (e + (q + e))"), "twodrop": ("k q e 2DROP", "k"), "twoswap": ("q e k 1 2SWAP - - -", "k - (1 - (q - e))"), "twoover": ("q e k 1 2OVER - - - - -", "q - (e - (k - (1 - (q - e))))"), "tworot": ("1 2 q e k 3 2ROT - - - - -", "q - (e - (k - (3 - (1 - 2))))"),
    "call": ("q [1 +] CALL", "q + 1"), "dip": ("q e [1 +] DIP -", "(q + 1) - e"), "twodip": ("q e k [1 +] 2DIP - -", "(q + 1) - (e - k)"), "threedip": ("q e k 2 [1 +] 3DIP - - -", "(q + 1) - (e - (k - 2))"), "keep": ("q [1 +] KEEP -", "(q + 1) - q"), "twokeep": ("q e [+] 2KEEP - -", "(q + e) - (q - e)"), "threekeep": ("q e k [+ +] 3KEEP - - -", "(q + (e + k)) - (q - (e - k))"),
    "bi": ("q [1 +] [2 *] BI -", "(q + 1) - q * 2"), "bistar": ("q e [1 +] [2 *] BI* -", "(q + 1) - e * 2"), "biat": ("q e [1 +] BI@ *", "(q + 1) * (e + 1)"), "tri": ("q [1 +] [2 *] [3 -] TRI - -", "(q + 1) - (q * 2 - (q - 3))"), "tristar": ("q e k [1 +] [2 *] [3 -] TRI* - -", "(q + 1) - (e * 2 - (k - 3))"), "triat": ("q e k [1 +] TRI@ - -", "(q + 1) - ((e + 1) - (k + 1))"),
    "compose": ("q [1 +] [2 *] COMPOSE CALL", "(q + 1) * 2"), "curry": ("q e [-] CURRY CALL", "q - e"), "twocurry": ("k q e [- -] 2CURRY CALL", "k - (q - e)"), "threecurry": ("1 k q e [- -] 3CURRY CALL -", "1 - (k - (q - e))"), "when": ("q q 25 > [100 +] WHEN", "CASE WHEN q > 25 THEN q + 100 ELSE q END"), "unless": ("q q 25 > [100 +] UNLESS", "CASE WHEN q > 25 THEN q ELSE q + 100 END"), "native": ("q e twice -", "q - e * 2"),
}


@_query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"CAST({sql} AS DOUBLE) AS {name}" for name, (_, sql) in _PROGRAMS.items()) + " FROM (SELECT l_orderkey, l_linenumber, l_quantity AS q, CAST(l_linenumber AS DOUBLE) AS e, CAST(l_partkey AS DOUBLE) AS k FROM lineitem)")
def stack_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shuffle, combinator and choice, and an operator of the caller's own."""
    m = stack_language.Machine({"q": F.col("l_quantity"), "e": F.col("l_linenumber").cast("double"), "k": F.col("l_partkey").cast("double")}, {"twice": lambda stack: stack.append(stack.pop() * 2)})
    return _items(spark, sf_dir).select("l_orderkey", "l_linenumber", *[m.column(program).cast("double").alias(name) for name, (program, _) in _PROGRAMS.items()])


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x * 100).cast("double")).alias("xs"))


_XS = "SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(x * CAST(100 AS FLOAT)) AS DOUBLE)) AS xs FROM embeddings"


@_query(f"SELECT vec_id, list_sum(list_transform(list_filter(xs, lambda x: x > 0), lambda x: x * x)) AS v, len(list_filter(xs, lambda x: x > 0)) AS n FROM ({_XS}) WHERE len(list_filter(xs, lambda x: x > 0)) > 0")
def stack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FILTER, MAP, FOLD and EACH over arrays."""
    m = stack_language.Machine(["xs"])
    total = m.column("xs [0 >] FILTER [DUP *] MAP 0 [+] FOLD")
    n = m.column("0 xs [0 >] FILTER [DROP 1 +] EACH")
    return _vectors(spark, sf_dir).select("vec_id", total.alias("v"), n.cast("bigint").alias("n")).filter("n > 0")


@_query("SELECT l_orderkey, l_linenumber, round(l_quantity * l_quantity + l_tax * l_tax, 6) AS v FROM lineitem")
def stack_user_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User words with locals."""
    m = stack_language.Machine(_ITEM)
    m.load("[ DUP * ] :square [ >a >b a square b square + ] :norm")
    return _items(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(m.column("l_quantity l_tax norm"), 6).alias("v"))


@_query(f"SELECT vec_id, list_sum(list_transform(xs, lambda x: x * 4)) AS v FROM ({_XS})")
def stack_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps fused by a rewrite rule before compiling."""
    rules = stack_language.Rewriter()
    rules.add_rule("[$*a] MAP [$*b] MAP", "[$*a $*b] MAP")
    program = rules.optimize("xs [2 *] MAP [2 *] MAP 0 [+] FOLD")
    return _vectors(spark, sf_dir).select("vec_id", stack_language.Machine(["xs"]).column(program).alias("v"))


# Sources and sinks.


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("note"), F.concat(F.lit('a "b"\\'), F.col("event_type")))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("ev."), "event_type").alias("metric"), labels.alias("labels"), F.lit("gauge").alias("kind"), "ts", "value")


@_query("SELECT ':__name__=ev_' || event_type || ':note=a \"b\"\\' || event_type || ':user=' || user_id || ':' AS tags, epoch_us(ts) // 1000 AS ms, max(value) AS \"value\" FROM events GROUP BY ALL")
def src_exposition_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples written in the text format and read again."""
    path = workspace(spark, "metrics")
    exposition.write(exposition.emit(_metrics(spark, sf_dir)), path)
    # Two readings of one series within one millisecond are one sample: the greater counts, as lines are written in order of their text.
    lines = spark.read.text(path).withColumn("file", F.lit("all"))
    return exposition.load(exposition.parse(lines)).select("tags", F.unix_millis("ts").alias("ms"), "value")


@_query("SELECT * FROM (VALUES ('reading', 4), ('type', 2), ('help', 1), ('comment', 1), ('blank', 1), ('malformed', 2)) t(what, n)")
def src_exposition_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of line."""
    made = ["# HELP a b c", "# TYPE a counter", "# TYPE h histogram", "# anything", "", 'a{x="1",y="q\\"z"} 3 1700000000000', "a +Inf -5", "a NaN", 'h_bucket{le="+Inf"} 4 1', "a{x=1} 3", "a three"]
    lines = spark.createDataFrame([(x,) for x in made], "value string")
    return exposition.parse(lines).groupBy("what").agg(F.count(F.lit(1)).alias("n"))


def _double_text(x: str) -> str:
    """A double below 10^7 as Java writes it, in SQL."""
    return f"CASE WHEN {x} = trunc({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) || '.0' ELSE CAST({x} AS VARCHAR) END"


_B1 = "CASE WHEN value < 1 THEN 0 ELSE CAST(floor(value / pow(10.0, floor(log10(value))) + 9 * floor(log10(value)) - 1 + 0.5) AS INTEGER) END"
_STAMP = "1706745600000"


@_query(f"""WITH h AS (SELECT event_type AS m, {_B1} AS b, count(*) AS n FROM events WHERE value >= 0 GROUP BY 1, 2), v AS (SELECT m, (b % 9 + 1) * pow(10.0, b // 9) AS x, n, sum(n) OVER (PARTITION BY m ORDER BY b) AS c FROM h)
    SELECT m AS metric, m || '_bucket{{le="' || {_double_text('x')} || '"}} ' || CAST(c AS BIGINT) || ' {_STAMP}' AS line FROM v UNION ALL SELECT m, m || '_bucket{{le="+Inf"}} ' || CAST(sum(n) AS BIGINT) || ' {_STAMP}' FROM v GROUP BY m
    UNION ALL SELECT m, m || '_count ' || CAST(sum(n) AS BIGINT) || ' {_STAMP}' FROM v GROUP BY m UNION ALL SELECT m, m || '_sum of ' || CAST(sum(x * n) AS BIGINT) FROM v GROUP BY m""")
def src_emit_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative bucket lines of histograms."""
    events = table(spark, sf_dir, "events").withColumns({"metric": F.col("event_type"), "ts": F.lit("2024-02-01").cast("timestamp")})
    lines = exposition.emit_histogram(statistics.observe(events, ["metric", "ts"], "value", 1), ["metric", "ts"], 1)
    total = F.regexp_extract("line", r"_sum (\S+) ", 1)  # the text of a large double differs between systems, its value doesn't
    return lines.select("metric", F.when(total != "", F.concat("metric", F.lit("_sum of "), total.try_cast("double").cast("bigint").cast("string"))).otherwise(F.col("line")).alias("line"))


@_query("""WITH m AS (SELECT event_type AS t, value AS v, avg(value) OVER (PARTITION BY event_type) AS mu FROM events), s AS (SELECT t, count(*) AS n, max(mu) AS m1, sum((v - mu) ** 2) AS m2, sum((v - mu) ** 3) AS m3, sum((v - mu) ** 4) AS m4 FROM m GROUP BY t)
    SELECT t || '_' || p AS name, round(x, 4) AS "value" FROM (SELECT t, unnest(['count', 'mean', 'variance', 'skewness', 'kurtosis']) AS p, unnest([n, m1, m2 / (n - 1), sqrt(n) * m3 / m2 ** 1.5, n * m4 / (m2 * m2)]) AS x FROM s)""")
def src_emit_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five gauges for each metric's moments."""
    events = table(spark, sf_dir, "events").withColumns({"metric": F.col("event_type"), "ts": F.lit("2024-02-01").cast("timestamp")})
    lines = exposition.emit_moments(statistics.describe(statistics.moments(events, ["metric", "ts"], "value")))
    read = exposition.parse(lines.select(F.col("line").alias("value")))  # the texts of doubles are read again, to be compared as numbers
    return read.select(F.col("metric").alias("name"), F.round("number", 4).alias("value"))


@_query(f"""WITH h AS (SELECT event_type AS m, {_B1} AS b, count(*) AS n FROM events WHERE value >= 0 GROUP BY 1, 2), v AS (SELECT m, (b % 9 + 1) * pow(10.0, b // 9) AS x, n FROM h)
    SELECT m || ' {_STAMP} {{approx=' || {_double_text('x')} || '}} ' || n AS line FROM v UNION ALL SELECT 'events ' || epoch_us(ts) // 1000 || ' ' || event_id || '.0' FROM events""")
def src_emit_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings a line each: a counter and histograms."""
    events = table(spark, sf_dir, "events")
    hist = statistics.observe(events, ["event_type"], "value", 1)
    boxes = hist.groupBy("event_type").agg(F.collect_list(F.struct(histogram.boundary_for(F.col("bucket"), 1).alias("boundary"), "n")).alias("hist"))
    none = {"value": F.lit(None).cast("double"), "moments": F.lit(None).cast("struct<n:bigint,m1:double,m2:double,m3:double,m4:double>")}
    first = boxes.select(F.col("event_type").alias("label"), F.lit("histogram").alias("kind"), F.lit("2024-02-01").cast("timestamp").alias("ts"), none["value"].alias("value"), none["moments"].alias("moments"), "hist")
    second = events.select(F.lit("events").alias("label"), F.lit("counter").alias("kind"), "ts", F.col("event_id").cast("double").alias("value"), none["moments"].alias("moments"), F.lit(None).cast(first.schema["hist"].dataType).alias("hist"))
    return exposition.plain(first.unionByName(second))


@_query("SELECT DISTINCT hex(kv_key) AS key_hex, ts, hex(val) AS val_hex, CAST(0 AS BIGINT) AS disorder FROM file_records WHERE ts IS NOT NULL AND kv_key IS NOT NULL")
def src_log_to_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records dumped as a log of lines, with torn ones, made into a sorted run and read again."""
    path, run = workspace(spark, "log"), workspace(spark, "run")
    rows = table(spark, sf_dir, "file_records").filter("ts is not null and kv_key is not null").select(F.col("kv_key").alias("key"), "ts", F.col("val").alias("value")).distinct()
    lines = files.dump(rows)
    torn = lines.limit(5).select(F.concat(F.lit("ZZ"), F.substring("value", 1, 3)).alias("value"))
    lines.unionByName(torn).write.text(path)
    files.log_to_run(spark.read.text(path), run, rows_per_file=2000)
    own = files.read_run(spark, run).select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"))
    wrong = previous(own, ["file"], "place", ["key", "ts"], "b").filter("b.key > key or (b.key = key and b.ts < ts)").count()
    return own.select(F.hex("key").alias("key_hex"), "ts", F.hex("value").alias("val_hex"), F.lit(wrong).cast("bigint").alias("disorder"))


@_query("SELECT 'f' || (event_id % 3) AS file, count(*) AS records, min(event_id) AS first_key, max(event_id) AS last_key FROM events GROUP BY 1")
def src_run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a manifest keeps of each file."""
    rows = table(spark, sf_dir, "events").withColumns({"file": F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")), "t": F.unix_micros("ts")})
    return files.run_metadata(rows, "event_id", "t").select("file", F.col("n").alias("records"), "first_key", "last_key")


@_query("SELECT event_id AS n, CAST(user_id AS VARCHAR) AS text FROM events")
def src_newline_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text files as numbered records: each holds its event and is found at its number."""
    path = workspace(spark, "lines")
    events = table(spark, sf_dir, "events").select("event_id", F.concat(F.col("event_id").cast("string"), F.lit(" "), F.col("user_id").cast("string")).alias("value"))
    events.repartitionByRange(3, "event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    part = F.split("text", " ")
    rows = text.newline_records(spark, path).select("file", "record", part[0].cast("bigint").alias("event"), part[1].alias("text"))
    first = rows.groupBy("file").agg(F.min("event").alias("first"))
    return rows.join(first, "file").filter("record = event - first").select(F.col("event").alias("n"), "text")


@_query("SELECT 'f' || (event_id % 4) AS file, count(*) FILTER (WHERE event_id % 4 < 2 OR event_id <> (SELECT max(e.event_id) FROM events e WHERE e.event_id % 4 = events.event_id % 4)) AS lines FROM events GROUP BY 1")
def src_torn_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files whose last line may be torn: two of four are."""
    events = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("f"), (F.col("event_id") % 4).cast("string")).alias("file"), F.col("event_id").alias("place"))
    ends = events.groupBy("file").agg(F.max("place").alias("end")).filter("file in ('f2', 'f3')")
    line = F.when(F.col("place") == F.col("end"), F.lit('{"x": 1')).otherwise(F.lit('{"x": 1}'))
    lines = events.join(ends, "file", "left").select("file", "place", line.alias("value"))
    return files.without_torn_tail(lines, "file", "place", F.try_parse_json("value").isNotNull()).groupBy("file").agg(F.count(F.lit(1)).alias("lines"))


@_query("SELECT 'k' || event_id AS key, 'v' || user_id AS \"value\", event_id AS ts FROM events")
def src_key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain key-value lines."""
    lines = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit(" k"), F.col("event_id").cast("string"), F.lit("\t v"), F.col("user_id").cast("string")).alias("value"))
    return files.key_value_lines(lines, "event_id").select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "ts")


@_query("SELECT 'f' || (event_id % 3) AS file, CAST(event_id AS INTEGER) AS line, user_id % 5 AS level, epoch_us(ts) AS timestamp, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE user_id % 5 <= 2")
def src_log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records emitted up to a level and read again."""
    path = workspace(spark, "logs")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")).alias("file"), F.col("event_id").cast("int").alias("line"), (F.col("user_id") % 5).alias("level"), F.unix_micros("ts").alias("timestamp"), F.col("props").alias("value"))
    files.emit_log(rows, path, 2)
    return files.log_records(spark, path).select("file", "line", "level", "timestamp", F.get_json_object("value", "$.k").cast("bigint").alias("k"))


@_query("SELECT event_type, CAST(2 AS INTEGER) AS sig_figs, bucket, n FROM (SELECT event_type, CASE WHEN value < 1 THEN 0 ELSE CAST(floor(value * 10 / pow(10.0, floor(log10(value))) + 90 * floor(log10(value)) - 10 + 0.5) AS INTEGER) END AS bucket, count(*) AS n FROM events GROUP BY 1, 2)")
def src_histogram_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms dumped as text and loaded again."""
    hist = statistics.observe(table(spark, sf_dir, "events"), ["event_type"], "value", 2)
    texts = hist.groupBy("event_type").agg(files.histogram_dump(hist, 2).alias("text"))
    return files.histogram_load(texts, "text", ["event_type"])


@_query("SELECT 'bench' AS experiment, CAST(user_id AS VARCHAR) AS user, 'integer' AS kind FROM (SELECT DISTINCT user_id FROM events)")
def src_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiments and parameters in file names."""
    names = table(spark, sf_dir, "events").select(F.concat(F.lit("/tmp/x/bench:user="), F.col("user_id").cast("string"), F.lit(":fast=true.hist")).alias("name")).distinct()
    experiment, parameters = files.experiment(F.col("name"))
    return names.select(experiment.alias("experiment"), parameters["user"].alias("user"), files.parameter_kind(parameters["user"]).alias("kind"))


@_query("SELECT 'f' || file_id AS item, CAST(0 AS BIGINT) AS faults FROM sst_files WHERE file_id IS NOT NULL GROUP BY file_id HAVING max(n_records) >= 5")
def src_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a store as edits in two halves: the first rolled over, then that log with the second half, which removes files, rolled over again; verified."""
    listed = table(spark, sf_dir, "sst_files").groupBy("file_id").agg(F.max("n_records").alias("n")).filter("file_id is not null").withColumn("item", F.concat(F.lit("f"), F.col("file_id").cast("string")))
    first = listed.select(F.col("file_id").alias("edit_id"), F.lit("add").alias("op"), "item")
    path = workspace(spark, "manifest")
    log = files.rollover(spark, first, path)
    later = listed.filter("n is null or n < 5").select((F.col("file_id") + 1).alias("edit_id"), F.lit("remove").alias("op"), "item")
    log = files.rollover(spark, log.unionByName(later), path)
    return log.select("item", F.lit(files.verify_manifest(spark, path).count()).cast("bigint").alias("faults"))


# The store.


@_query("SELECT keyspace, hex(kv_key) AS key_hex, hex(val) AS val_hex FROM (SELECT *, row_number() OVER (PARTITION BY keyspace, kv_key ORDER BY ts DESC, val IS NULL DESC, val DESC) AS rn FROM kv_versions WHERE ts IS NOT NULL) WHERE rn = 1 AND val IS NOT NULL")
def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of all keyspaces ingested, compacted with verification, and read: a store's key is the keyspace's length in four hexadecimal digits, the keyspace and the key."""
    space = F.encode("keyspace", "UTF-8")
    key = F.concat(F.encode(F.lpad(F.hex(F.octet_length(space)), 4, "0"), "UTF-8"), space, F.col("kv_key"))
    rows = table(spark, sf_dir, "kv_versions").filter("ts is not null").select(key.alias("key"), "ts", F.col("val").alias("value"), "version_id")
    own = store.Store(spark, workspace(spark, "store"))
    for half in ("version_id % 2 = 0", "version_id % 2 = 1"):
        own.ingest(rows.filter(half).drop("version_id"))
    own.compact()
    n = F.conv(F.decode(F.substring("key", 1, 4), "UTF-8"), 16, 10).cast("int")
    return own.scan().select(F.decode(F.substring("key", F.lit(5), n), "UTF-8").alias("keyspace"), F.hex(F.substring("key", n + 5, F.octet_length("key"))).alias("key_hex"), F.hex("value").alias("val_hex"))


@_query("""SELECT hex(kv_key) AS key_hex, ts, hex(val) AS val_hex, CAST(0 AS BIGINT) AS faults FROM (SELECT *, row_number() OVER (PARTITION BY kv_key ORDER BY ts DESC, val DESC) AS rn FROM (SELECT DISTINCT kv_key, ts, val FROM file_records WHERE val IS NOT NULL AND ts IS NOT NULL AND kv_key IS NOT NULL)) WHERE rn <= 2""")
def store_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compaction by a retention policy (the values of all stores' files, two versions of each key), the old runs removed, and the history verified."""
    rows = table(spark, sf_dir, "file_records").filter("ts is not null and val is not null and kv_key is not null").select(F.col("kv_key").alias("key"), "ts", F.col("val").alias("value"), "file_id")
    own = store.Store(spark, workspace(spark, "store"))
    for half in ("coalesce(file_id, 0) % 2 = 0", "coalesce(file_id, 0) % 2 <> 0"):
        own.ingest(rows.filter(half).drop("file_id"))
    own.compact("versions = 2")
    own.vacuum(keep=1)
    kept = own.records().select(F.hex("key").alias("key_hex"), "ts", F.hex("value").alias("val_hex"))
    return kept.withColumn("faults", F.lit(own.verify().count()).cast("bigint"))


@_query("SELECT count(DISTINCT user_id) FILTER (WHERE user_id % 2 = 1) AS alive, CAST(2 AS BIGINT) AS last_ts FROM events")
def store_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of puts and one of deletes; each is seen whole."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").cast("binary").alias("key"), F.col("user_id").cast("string").cast("binary").alias("value"), "user_id").distinct()
    own = store.Store(spark, workspace(spark, "store"))
    own.write(users.drop("user_id"))
    last = own.write(users.filter("user_id % 2 = 0").select("key", F.lit(None).cast("binary").alias("value")))
    return own.scan().agg(F.count(F.lit(1)).alias("alive"), F.lit(last).cast("bigint").alias("last_ts"))


