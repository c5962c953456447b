"""Queries of the time series operators, over the events as series (__name__: type, user: id)."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import math
from quern.operators import series
from quern.operators.prefix import prefix_sums
from quern.operators.series import MICROS, Params
from quern.plans import series_language
from quern.session import table

HOUR = 3600 * MICROS
START, LIMIT, STEP, BACK = series.micros("2024-01-03T00:00:00Z"), series.micros("2024-01-24T00:00:00Z"), 6 * HOUR, 24 * HOUR
PARAMS = Params(START, LIMIT, STEP)
STEEP = ("exp", "exp2", "exp_m1", "sinh", "cosh", "tan")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    tags = F.concat(F.lit(":__name__="), "event_type", F.lit(":user="), F.col("user_id").cast("string"), F.lit(":"))
    return series.last_write(events.select(tags.alias("tags"), "ts", "value", "event_id"), "event_id")


def _out(df: DataFrame) -> DataFrame:
    return df.select(F.coalesce("tags", F.lit("")).alias("tags"), F.col("k").cast("bigint").alias("k"), (F.round("value", 6) + 0.0).alias("value"))


def language(query: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(series_language.compile_query(query, samples(spark, sf_dir), PARAMS))


def ts_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of resampling of every series."""
    return _out(series.resample(samples(spark, sf_dir), PARAMS)).withColumn("ts_us", F.col("k") * STEP + START)


def ts_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    one = series.resample(series.select(s, "click"), PARAMS)
    return _out(series.union(one, series.resample(series.select(s, "error"), PARAMS), one))


def ts_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All series under one label."""
    return _out(series.relabel(series.resample(samples(spark, sf_dir), PARAMS), ":team=a:"))


def ts_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arithmetic between two collapsed series, division by zero included."""
    s = samples(spark, sf_dir)
    a, b = (series.aggregate(series.resample(series.select(s, n), PARAMS), "maximum") for n in ("click", "view"))
    out = [_out(series.combine(a, b, op)).withColumn("op", F.lit(op)) for op in math.ARITHMETIC]
    return series.union(out[0], *out[1:])


def ts_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.extent(samples(spark, sf_dir)).select(F.unix_micros("start").alias("start_us"), F.unix_micros("limit").alias("limit_us"))


def ts_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.delta_encode(samples(spark, sf_dir)).select("tags", F.unix_micros("ts").alias("ts_us"), "d_ts", "dd_ts", F.round("d_value", 6).alias("d_value"))


def ts_delta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times of every series from its first one and the differences of differences alone."""
    own = prefix_sums(series.delta_encode(samples(spark, sf_dir)).withColumn("us", F.unix_micros("ts")), ["tags"], ["us", "value"], out="n", spread=F.lit(0))
    start = own.groupBy("tags").agg(F.min("ts").alias("ts0"), F.max(F.when(F.col("n") == 1, F.col("d_ts"))).alias("d0"))
    return series.delta_decode(own.select("tags", "n", "dd_ts", "value"), start).select("tags", "n", F.unix_micros("ts").alias("ts_us"), F.round("value", 6).alias("value"))


def ts_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of all three kinds by tags and time: errors are counters, purchases histograms, all others gauges."""
    name = F.regexp_extract("tags", ":__name__=([^:]*):", 1)
    kind = F.when(name == "error", "counter").when(name == "purchase", "histogram").otherwise("gauge")
    own = samples(spark, sf_dir).withColumn("kind", kind)
    got = [series.fetch(own, k, w, START, LIMIT).withColumn("kind", F.lit(k)) for k, w in (("counter", "error"), ("gauge", ":__name__=view:"), ("histogram", "purchase"), ("counter", "view"))]
    return series.union(got[0], *got[1:]).select("kind", "tags", F.unix_micros("ts").alias("ts_us"), F.round("value", 6).alias("value"))


def ts_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of the caller's own: a scalar one, one of a frame, one of a whole series and one across all series."""
    grid = series.resample(series.select(samples(spark, sf_dir), "click"), PARAMS)
    scaled = series.pointwise(grid, lambda v: v * 2 + 1)
    swing = series.rollup(grid, lambda a: F.element_at(a, -1) - F.element_at(a, 1), 4)
    rises = series.uniform(grid, lambda a: F.size(F.filter(F.sequence(F.lit(1), F.size(a) - 1), lambda i: F.element_at(a, i + 1) > F.element_at(a, i))))
    spread = series.aggregate(grid, lambda v: F.max(v) - F.min(v))
    noon = series.function_of_time(spark, lambda t: F.hour(t) * 60 + F.minute(t), PARAMS)
    return series.union(*[_out(x).withColumn("what", F.lit(n)) for n, x in (("noon", noon), ("scaled", scaled), ("swing", swing), ("rises", rises), ("spread", spread))])


def ts_finer_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same window at a third of the step."""
    fine = PARAMS.with_step(STEP // 3)
    return _out(series.aggregate(series.resample(series.select(samples(spark, sf_dir), "error"), fine), "maximum"))


def fn_rfc3339(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written as RFC 3339 with an offset and read again; other texts are null."""
    from quern.functions.calendar import parse_rfc3339

    text = F.when(F.col("event_id") % 5 == 0, "yesterday").otherwise(F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(parse_rfc3339(text)).alias("us"))


def ts_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = series.series_arrays(series.resample(samples(spark, sf_dir), PARAMS))
    return arrays.select("tags", F.array_join(F.transform("points", lambda x: F.round(x * 1000).cast("bigint").cast("string")), ",").alias("points"))


def ts_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every second of the events' extent, empty seconds included."""
    events = table(spark, sf_dir, "events")
    start, limit = series.extent(events).select(F.unix_micros("start"), F.unix_micros("limit")).first()
    if start is None:
        return spark.createDataFrame([], "second_us bigint, n bigint")
    return series.per_second(events.filter("ts is not null"), "ts", start, limit).select(F.unix_micros("second").alias("second_us"), "n")


def ts_rendering_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid for a chart of 100 points, aligned to the limit."""
    grid = Params.rendering(START + 1, LIMIT, 100)
    return _out(series.resample(series.select(samples(spark, sf_dir), "purchase"), grid)).groupBy("tags").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def fn_pointwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pointwise functions over all values, brought to quarters from -6 to 14."""
    x = (F.pmod(F.floor("value"), F.lit(80)) - 25) / F.lit(4.0)
    return table(spark, sf_dir, "events").select("event_id", x.alias("x")).select("event_id", *[(F.round(f(F.col("x")), 6) + 0.0).alias(f"v_{n}") for n, f in math.POINTWISE.items()])


def fn_of_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All functions of time over the events' times."""
    from quern.functions.calendar import OF_TIME, of_time, rfc3339

    return table(spark, sf_dir, "events").select("event_id", *[of_time(n, F.col("ts")).alias(f"t_{n}") for n in OF_TIME], rfc3339(F.col("ts")).alias("rfc3339"))


QUERIES: dict[str, Callable] = {f.__name__: f for f in (ts_resample, ts_union, ts_relabel, ts_arithmetic, ts_extent, ts_delta, ts_delta_round_trip, ts_arrays, ts_seconds, ts_rendering_grid, ts_fetch, ts_closures, ts_finer_step, fn_pointwise, fn_of_time, fn_rfc3339)}

_BASE = """
pts AS (SELECT tags, u, arg_max(v, event_id) AS v FROM (SELECT ':__name__=' || event_type || ':user=' || user_id || ':' AS tags, epoch_us(ts) AS u, value AS v, event_id FROM events) GROUP BY tags, u)
"""


def _grid(name: str, where: str, start: int = START, limit: int = LIMIT, step: int = STEP, shift: int = 0) -> str:
    """Resampled series as CTE `name`: the last value at or before each step, else the first."""
    n = (limit - start) // step
    return f"""
{name}_p AS (SELECT * FROM pts WHERE {where} AND u >= {start} AND u < {limit}),
{name}_s AS (SELECT tags, arg_min(v, u) AS first FROM {name}_p GROUP BY tags),
{name} AS (SELECT g.tags, g.k - {shift} AS k, coalesce(p.v, g.first) AS v FROM
  (SELECT tags, first, k, {start} + k * {step} AS at FROM {name}_s, (SELECT unnest(range({n})) AS k)) g
  ASOF LEFT JOIN {name}_p p ON g.tags = p.tags AND g.at >= p.u)
"""


_MEDIAN = "list_sort(list({v}))[len(list({v})) // 2 + 1]"
_VAR = "coalesce(var_samp({v}), CAST('nan' AS DOUBLE))"
_AGG = {"maximum": "max({v})", "minimum": "min({v})", "mean": "avg({v})", "median": _MEDIAN, "stdvar": _VAR, "stddev": f"sqrt({_VAR})", "sum": "sum({v})", "range": "max({v}) - min({v})"}
_MAD = "list_sort(list_transform({l}, lambda x: abs(x - list_sort({l})[len({l}) // 2 + 1])))[len({l}) // 2 + 1]"

SQL: dict[str, str] = {}
SQL["ts_resample"] = f"WITH {_BASE}, {_grid('g', 'true')} SELECT tags, k, round(v, 6) AS \"value\", k * {STEP} + {START} AS ts_us FROM g"
for how in (*series.ACROSS, "median"):
    name, text = f"ts_aggregate_{how}", f"aggregate({how}, counters(click, view))"
    QUERIES[name] = partial(language, text)
    SQL[name] = f"WITH {_BASE}, {_grid('g', _q)} SELECT '' AS tags, k, round({_AGG[how].format(v='v')}, 6) AS \"value\" FROM g GROUP BY k" if (_q := "(contains(tags, ':__name__=click:') OR contains(tags, ':__name__=view:'))") else ""
for how in series.ROLLUPS:
    name, text = f"ts_rollup_{how}", f"rollup({how}, counters(:__name__=click:), 1d)"
    QUERIES[name] = partial(language, text)
    if how == "changes":
        body = "SELECT tags, k, max(c) OVER (PARTITION BY tags ORDER BY k ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS r FROM (SELECT tags, k, CASE WHEN v IS DISTINCT FROM lag(v) OVER (PARTITION BY tags ORDER BY k) THEN 1.0 ELSE 0.0 END AS c FROM g)"
    elif how.startswith("median"):
        picked = "list_sort(l)[len(l) // 2 + 1]" if how == "median" else _MAD.format(l="l")
        body = f"SELECT tags, k, {picked} AS r FROM (SELECT tags, k, list(v) OVER (PARTITION BY tags ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l FROM g)"
    else:
        over = "OVER (PARTITION BY tags ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
        formula = {"range": f"max(v) {over} - min(v) {over}", "stddev": f"sqrt(coalesce(var_samp(v) {over}, CAST('nan' AS DOUBLE)))", "stdvar": f"coalesce(var_samp(v) {over}, CAST('nan' AS DOUBLE))"}
        body = f"SELECT tags, k, {formula.get(how) or _AGG[how].format(v='v') + ' ' + over} AS r FROM g"
    SQL[name] = f"""WITH {_BASE}, {_grid('g', "contains(tags, ':__name__=click:')", start=START - BACK, shift=BACK // STEP)} SELECT tags, k, round(r, 6) AS "value" FROM ({body}) WHERE k >= 0"""
for how in series.UNIFORMS:
    name, text = f"ts_uniform_{how}", f"uniform({how}, counters(view))"
    QUERIES[name] = partial(language, text)
    if how in ("first", "last"):
        formula = f"arg_{'min' if how == 'first' else 'max'}(v, k)"
    elif how == "median_absolute_deviation":
        formula = _MAD.format(l="list(v)")
    else:
        formula = _AGG[how].format(v="v")
    SQL[name] = f"""WITH {_BASE}, {_grid('g', "contains(tags, ':__name__=view:')")}, w AS (SELECT tags, {formula} AS r FROM g GROUP BY tags) SELECT tags, k, round(r, 6) AS "value" FROM g JOIN w USING (tags)"""

_X = "v"
_TRUNC = "(CASE WHEN v < 0 THEN ceil(v) ELSE floor(v) END)"
POINT_SQL = {
    "abs": "abs(v)", "acos": "CASE WHEN abs(v) <= 1 THEN acos(v) ELSE CAST('nan' AS DOUBLE) END", "acosh": "CASE WHEN v >= 1 THEN acosh(v) ELSE CAST('nan' AS DOUBLE) END", "asin": "CASE WHEN abs(v) <= 1 THEN asin(v) ELSE CAST('nan' AS DOUBLE) END",
    "asinh": "asinh(v)", "atan": "atan(v)", "atanh": "CASE WHEN abs(v) < 1 THEN atanh(v) WHEN v = 1 THEN CAST('inf' AS DOUBLE) WHEN v = -1 THEN CAST('-inf' AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END", "cbrt": "cbrt(v)", "ceil": "ceil(v)", "cos": "cos(v)", "cosh": "cosh(v)",
    "exp": "exp(v)", "exp2": "pow(2, v)", "exp_m1": "exp(v) - 1", "floor": "floor(v)", "fract": f"v - {_TRUNC}", "ln": "CASE WHEN v = 0 THEN CAST('-inf' AS DOUBLE) WHEN v < 0 THEN CAST('nan' AS DOUBLE) ELSE ln(v) END",
    "ln_1p": "CASE WHEN v = -1 THEN CAST('-inf' AS DOUBLE) WHEN v < -1 THEN CAST('nan' AS DOUBLE) ELSE ln(1 + v) END", "log10": "CASE WHEN v = 0 THEN CAST('-inf' AS DOUBLE) WHEN v < 0 THEN CAST('nan' AS DOUBLE) ELSE log10(v) END",
    "log2": "CASE WHEN v = 0 THEN CAST('-inf' AS DOUBLE) WHEN v < 0 THEN CAST('nan' AS DOUBLE) ELSE log2(v) END", "recip": "CASE WHEN v = 0 THEN CAST('inf' AS DOUBLE) ELSE 1 / v END", "round": "round(v)", "sign": "CASE WHEN v > 0 THEN 1.0 WHEN v < 0 THEN -1.0 ELSE 0.0 END",
    "signum": "CASE WHEN v < 0 THEN -1.0 ELSE 1.0 END", "sin": "sin(v)", "sinh": "sinh(v)", "sqrt": "CASE WHEN v >= 0 THEN sqrt(v) ELSE CAST('nan' AS DOUBLE) END", "tan": "tan(v)", "tanh": "tanh(v)", "to_radians": "radians(v)", "trunc": _TRUNC,
}
# The steep functions are applied to a logarithm, so that six places stay within a double's digits.
for how, formula in POINT_SQL.items():
    name = f"ts_point_{how}"
    QUERIES[name] = partial(language, f"{how}(ln_1p(counters(:)))" if how in ("exp", "exp2", "exp_m1", "sinh", "cosh", "tan") else f"{how}(counters(:))")
    inner = "SELECT tags, k, ln(1 + v) AS v FROM g" if how in ("exp", "exp2", "exp_m1", "sinh", "cosh", "tan") else "SELECT * FROM g"
    SQL[name] = f"""WITH {_BASE}, {_grid('g', "true")} SELECT tags, k, round({formula}, 6) + 0.0 AS "value" FROM ({inner})"""
for how, formula in {
    "day": "day(t)", "days_in_month": "day(last_day(t))", "days_in_year": "dayofyear(make_date(year(t), 12, 31))", "hour": "hour(t)", "minute": "minute(t)", "month": "month(t)", "second": "second(t)", "unix_micros": "epoch_us(t)", "weekday": "dayofweek(t) + 1", "year": "year(t)",
}.items():
    QUERIES[f"ts_time_{how}"] = partial(language, f"time({how})")
    SQL[f"ts_time_{how}"] = f"SELECT '' AS tags, k, CAST({formula} AS DOUBLE) AS \"value\" FROM (SELECT k, make_timestamp({START} + k * {STEP}) AS t FROM (SELECT unnest(range({PARAMS.steps})) AS k))"
SQL["fn_of_time"] = (
    "SELECT event_id, CAST(day(ts) AS DOUBLE) AS t_day, CAST(day(last_day(ts)) AS DOUBLE) AS t_days_in_month, CAST(dayofyear(make_date(year(ts), 12, 31)) AS DOUBLE) AS t_days_in_year, CAST(hour(ts) AS DOUBLE) AS t_hour, CAST(minute(ts) AS DOUBLE) AS t_minute, CAST(month(ts) AS DOUBLE) AS t_month, CAST(second(ts) AS DOUBLE) AS t_second, CAST(epoch_us(ts) AS DOUBLE) AS t_unix_micros, CAST(dayofweek(ts) + 1 AS DOUBLE) AS t_weekday, CAST(year(ts) AS DOUBLE) AS t_year, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS rfc3339 FROM events"
)
SQL["fn_pointwise"] = "SELECT event_id, " + ", ".join(f"round({f}, 6) + 0.0 AS v_{n}" for n, f in POINT_SQL.items()) + " FROM (SELECT event_id, (((CAST(floor(value) AS BIGINT) % 80) + 80) % 80 - 25) / CAST(4 AS DOUBLE) AS v FROM events)"
SQL["ts_union"] = f"""WITH {_BASE}, {_grid('a', "contains(tags, ':__name__=click:')")}, {_grid('b', "contains(tags, ':__name__=error:')")} SELECT tags, k, round(v, 6) AS "value" FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM a)"""
SQL["ts_relabel"] = f"""WITH {_BASE}, {_grid('g', "true")} SELECT ':team=a:' AS tags, k, round(v, 6) AS "value" FROM g"""
SQL["ts_arithmetic"] = f"""WITH {_BASE}, {_grid('a', "contains(tags, ':__name__=click:')")}, {_grid('b', "contains(tags, ':__name__=view:')")},
    m AS (SELECT k, x, y FROM (SELECT k, max(v) AS x FROM a GROUP BY k) JOIN (SELECT k, max(v) AS y FROM b GROUP BY k) USING (k))
    SELECT '' AS tags, k, op, round(CASE op WHEN '+' THEN x + y WHEN '-' THEN x - y WHEN '*' THEN x * y ELSE CASE WHEN y <> 0 THEN x / y WHEN x > 0 THEN CAST('inf' AS DOUBLE) WHEN x < 0 THEN CAST('-inf' AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END END, 6) AS "value"
    FROM m, (VALUES ('+'), ('-'), ('*'), ('/')) o(op)"""
SQL["ts_extent"] = "SELECT epoch_us(date_trunc('second', min(ts))) AS start_us, epoch_us(date_trunc('second', max(ts))) + 1000000 AS limit_us FROM events"
SQL["ts_delta"] = f"WITH {_BASE}, d AS (SELECT tags, u, u - lag(u) OVER w AS d_ts, v - lag(v) OVER w AS dv FROM pts WINDOW w AS (PARTITION BY tags ORDER BY u)) SELECT tags, u AS ts_us, d_ts, d_ts - lag(d_ts) OVER (PARTITION BY tags ORDER BY u) AS dd_ts, round(dv, 6) AS d_value FROM d"
SQL["ts_arrays"] = f"WITH {_BASE}, {_grid('g', 'true')} SELECT tags, string_agg(CAST(CAST(round(v * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY k) AS points FROM g GROUP BY tags"
SQL["ts_delta_round_trip"] = f"WITH {_BASE} SELECT tags, row_number() OVER (PARTITION BY tags ORDER BY u, v) - 1 AS n, u AS ts_us, round(v, 6) AS \"value\" FROM pts"
SQL["ts_fetch"] = f"WITH {_BASE} SELECT CASE WHEN contains(tags, '=error:') THEN 'counter' WHEN contains(tags, '=purchase:') THEN 'histogram' ELSE 'gauge' END AS kind, tags, u AS ts_us, round(v, 6) AS \"value\" FROM pts WHERE u >= {START} AND u < {LIMIT} AND (contains(tags, '=error:') OR contains(tags, '=view:') OR contains(tags, '=purchase:'))"
SQL["ts_closures"] = f"""WITH {_BASE}, {_grid('g', "contains(tags, ':__name__=click:')")}, f AS (SELECT *, v - coalesce(first_value(v) OVER w, v) AS swing, v > lag(v) OVER s AS up FROM g WINDOW w AS (PARTITION BY tags ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), s AS (PARTITION BY tags ORDER BY k)),
    r AS (SELECT tags, k, v * 2 + 1 AS x, 'scaled' AS what FROM g UNION ALL SELECT tags, k, swing, 'swing' FROM f UNION ALL SELECT tags, k, CAST(count(*) FILTER (WHERE up) OVER (PARTITION BY tags) AS DOUBLE), 'rises' FROM f UNION ALL SELECT '', k, max(v) - min(v), 'spread' FROM g GROUP BY k UNION ALL SELECT '', k, ({START} + k * {STEP}) // 60000000 % 1440, 'noon' FROM (SELECT unnest(range({PARAMS.steps})) AS k))
    SELECT tags, k, round(x, 6) + 0.0 AS "value", what FROM r"""
SQL["ts_finer_step"] = f"""WITH {_BASE}, {_grid('g', "contains(tags, ':__name__=error:')", step=STEP // 3)} SELECT '' AS tags, k, round(max(v), 6) AS "value" FROM g GROUP BY k"""
SQL["fn_rfc3339"] = "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN epoch_us(ts) END AS us FROM events"
SQL["ts_seconds"] = "WITH h AS (SELECT epoch_us(date_trunc('second', ts)) AS u, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1), g AS (SELECT unnest(range((SELECT min(u) FROM h), (SELECT max(u) FROM h) + 1, 1000000)) AS u) SELECT u AS second_us, coalesce(n, 0) AS n FROM g LEFT JOIN h USING (u)"
_R = Params.rendering(START + 1, LIMIT, 100)
SQL["ts_rendering_grid"] = f"""WITH {_BASE}, {_grid('g', "contains(tags, ':__name__=purchase:')", _R.start, _R.limit, _R.step)} SELECT tags, count(*) AS n, round(sum(round(v, 6)), 4) AS total FROM g GROUP BY tags"""
