"""Mergeable statistics: moments, significant-figure histograms, distribution functions, t-tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import histogram

NAN = float("nan")
MOMENTS = ("n", "m1", "m2", "m3", "m4")


def moments(rows: DataFrame, by: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """(by..., n, m1, m2, m3, m4): the count, the mean and the sums of powers of the deviations from it.

    Without weights one pass: Spark's own central moments are merged task by task, and the shuffle carries a
    few numbers a task and group. With weights the rows, which are then counts of a histogram's buckets, are
    read twice: for the mean, and for the deviations from it. Null values, and weights that are null or not
    positive, don't count; a group of nulls has no row.
    """
    x = F.col(value).cast("double")
    if weight is None:
        n = F.count(x)
        d = n.cast("double")
        m2 = F.coalesce(F.var_pop(x), F.lit(0.0)) * d
        m3 = F.coalesce(F.skewness(x), F.lit(0.0)) * F.sqrt(m2 * m2 * m2 / d)
        m4 = F.when(m2 > 0, (F.coalesce(F.kurtosis(x), F.lit(0.0)) + 3.0) * m2 * m2 / d).otherwise(m2)
        return rows.filter(x.isNotNull()).groupBy(*by).agg(n.alias("n"), F.avg(x).alias("m1"), m2.alias("m2"), m3.alias("m3"), m4.alias("m4")).filter("n > 0")
    w = F.col(weight).cast("bigint")
    own = rows.select(*by, x.alias("__x"), w.alias("__w")).filter("__x is not null and __w > 0")
    mean = own.groupBy(*by).agg((F.sum(F.col("__x") * F.col("__w")) / F.sum("__w")).alias("__mean"))
    if by:
        both = own.join(mean, list(by))
    else:
        centre = mean.first()[0]
        both = own.withColumn("__mean", F.lit(centre).cast("double"))
    d = F.col("__x") - F.col("__mean")
    sums = [F.sum(F.col("__w") * F.pow(d, F.lit(float(p)))).alias(f"m{p}") for p in (2, 3, 4)]
    return both.groupBy(*by).agg(F.sum("__w").alias("n"), F.max("__mean").alias("m1"), *sums)


def describe(m: DataFrame) -> DataFrame:
    """Adds mean, variance (sample), skewness and kurtosis (population, a normal distribution has 3); NaN where undefined."""
    n = F.col("n").cast("double")
    return m.withColumns(
        {
            "mean": F.when(n > 0, F.col("m1")).otherwise(NAN),
            "variance": F.when(n > 1, F.try_divide(F.col("m2"), n - 1)).otherwise(NAN),
            "skewness": F.when(F.col("m2") > 0, F.try_divide(F.sqrt(n) * F.col("m3"), F.pow("m2", F.lit(1.5)))).otherwise(NAN),
            "kurtosis": F.when(F.col("m2") > 0, F.try_divide(n * F.col("m4"), F.col("m2") * F.col("m2"))).otherwise(NAN),
        }
    )


def merge_pair(a: Column, b: Column) -> Column:
    """The moments of two groups together, from structs (n, m1, m2, m3, m4); one of n = 0 leaves the other."""
    na, nb = a["n"].cast("double"), b["n"].cast("double")
    n, d = na + nb, b["m1"] - a["m1"]
    ok = F.when(n > 0, n).otherwise(1.0)
    m1 = a["m1"] + d * nb / ok
    m2 = a["m2"] + b["m2"] + d * d * na * nb / ok
    m3 = a["m3"] + b["m3"] + d * d * d * na * nb * (na - nb) / (ok * ok) + 3.0 * d * (na * b["m2"] - nb * a["m2"]) / ok
    m4 = a["m4"] + b["m4"] + d * d * d * d * na * nb * (na * na - na * nb + nb * nb) / (ok * ok * ok) + 6.0 * d * d * (na * na * b["m2"] + nb * nb * a["m2"]) / (ok * ok) + 4.0 * d * (na * b["m3"] - nb * a["m3"]) / ok
    both = F.struct((a["n"] + b["n"]).alias("n"), m1.alias("m1"), m2.alias("m2"), m3.alias("m3"), m4.alias("m4"))
    return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(both)


def subtract(later: Column, earlier: Column) -> Column:
    """The moments of what came between two cumulative readings; null where the earlier one has more."""
    n = (later["n"] - earlier["n"]).cast("double")
    na = earlier["n"].cast("double")
    whole = later["n"].cast("double")
    some = F.when(n > 0, n).otherwise(1.0)
    m1 = (whole * later["m1"] - na * earlier["m1"]) / some
    d = m1 - earlier["m1"]
    all_ = F.when(whole > 0, whole).otherwise(1.0)
    m2 = later["m2"] - earlier["m2"] - d * d * na * n / all_
    m3 = later["m3"] - earlier["m3"] - d * d * d * na * n * (na - n) / (all_ * all_) - 3.0 * d * (na * m2 - n * earlier["m2"]) / all_
    m4 = later["m4"] - earlier["m4"] - d * d * d * d * na * n * (na * na - na * n + n * n) / (all_ * all_ * all_) - 6.0 * d * d * (na * na * m2 + n * n * earlier["m2"]) / (all_ * all_) - 4.0 * d * (na * m3 - n * earlier["m3"]) / all_
    zero = F.lit(0.0)
    between = F.struct((later["n"] - earlier["n"]).alias("n"), m1.alias("m1"), m2.alias("m2"), m3.alias("m3"), m4.alias("m4"))
    nothing = F.struct((later["n"] - earlier["n"]).alias("n"), zero.alias("m1"), zero.alias("m2"), zero.alias("m3"), zero.alias("m4"))
    return F.when(later["n"] > earlier["n"], between).when(later["n"] == earlier["n"], nothing)


def merge_moments(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """Moments of groups from rows of moments, by sums that add up: power sums about the combined mean."""
    n, m1 = F.col("n").cast("double"), F.col("m1")
    mean = states.filter("n > 0").groupBy(*by).agg((F.sum(n * m1) / F.sum(n)).alias("__mean"))
    both = states.filter("n > 0").join(mean, list(by))
    d = m1 - F.col("__mean")
    return both.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.max("__mean").alias("m1"),
        F.sum(F.col("m2") + n * d * d).alias("m2"),
        F.sum(F.col("m3") + 3 * d * F.col("m2") + n * d * d * d).alias("m3"),
        F.sum(F.col("m4") + 4 * d * F.col("m3") + 6 * d * d * F.col("m2") + n * d * d * d * d).alias("m4"),
    )


def observe(rows: DataFrame, by: Sequence[str], value: str, sig_figs: int, weight: str | None = None, most: int | None = None) -> DataFrame:
    """(by..., bucket, n): a histogram; values that are null or negative don't count, nor do buckets from `most` on."""
    bucket = histogram.bucket_for(F.col(value).cast("double"), sig_figs)
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    out = rows.select(*by, bucket.alias("bucket"), w.alias("__w")).filter("bucket is not null")
    if most is not None:
        out = out.filter(F.col("bucket") < most)
    return out.groupBy(*by, "bucket").agg(F.sum("__w").alias("n"))


def rejected(rows: DataFrame, by: Sequence[str], value: str, sig_figs: int, most: int) -> DataFrame:
    """(by..., negative, beyond): how many values a histogram of `most` buckets doesn't take."""
    bucket = histogram.bucket_for(F.col(value).cast("double"), sig_figs)
    return rows.groupBy(*by).agg(F.count_if(F.col(value) < 0).alias("negative"), F.count_if(bucket >= most).alias("beyond"))


def merge_histograms(*parts: DataFrame) -> DataFrame:
    """Histograms of the same groups and figures added up."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*[c for c in out.columns if c != "n"]).agg(F.sum("n").alias("n"))


def downsample(hist: DataFrame, by: Sequence[str], sig_figs: int, fewer: int) -> DataFrame:
    """A histogram at fewer significant figures."""
    if fewer > sig_figs:
        raise ValueError("a histogram can't gain figures")
    coarse = histogram.bucket_for(histogram.boundary_for(F.col("bucket"), sig_figs), fewer)
    return hist.groupBy(*by, coarse.alias("bucket")).agg(F.sum("n").alias("n"))


def cumulative(hist: DataFrame, by: Sequence[str], sig_figs: int) -> DataFrame:
    """(by..., bucket, boundary, n, running, total, share): the distribution function of a histogram; a group has at most as many rows as buckets."""
    along = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = hist.withColumns({"boundary": histogram.boundary_for(F.col("bucket"), sig_figs), "running": F.sum("n").over(along), "total": F.sum("n").over(Window.partitionBy(*by))})
    return out.withColumn("share", F.try_divide(F.col("running"), F.col("total")))


def summarize(hist: DataFrame, by: Sequence[str], sig_figs: int) -> DataFrame:
    """The moments of a histogram's boundaries, weighted by its counts."""
    return moments(hist.withColumn("__b", histogram.boundary_for(F.col("bucket"), sig_figs)), by, "__b", weight="n")


def lines(hist: DataFrame, fixed: Sequence[str], independent: str, sig_figs: int) -> DataFrame:
    """(fixed..., independent, mean): one line for each setting of the fixed parameters."""
    b = histogram.boundary_for(F.col("bucket"), sig_figs)
    return hist.groupBy(*fixed, independent).agg((F.sum(b * F.col("n")) / F.sum("n")).alias("mean"))


def distribution(hist: DataFrame, by: Sequence[str], sig_figs: int) -> DataFrame:
    """(by..., value, share): the points of each histogram's distribution function, from (0, 0) on; a group without counts has no row."""
    points = cumulative(hist, by, sig_figs).filter("total > 0").select(*by, F.col("boundary").alias("value"), "share")
    first = hist.groupBy(*by).agg(F.sum("n").alias("__n")).filter("__n > 0").select(*by, F.lit(0.0).alias("value"), F.lit(0.0).alias("share"))
    return first.unionByName(points)


def project(rows: DataFrame, names: Sequence[str], keep: Sequence[str] = (), parameters: str = "parameters") -> DataFrame:
    """The rows with only the named parameters (a map of texts), in the order named, as columns behind `keep`; a row that lacks one is an error."""
    got = [F.coalesce(F.try_element_at(parameters, F.lit(n)), F.raise_error(F.lit(f"no parameter {n}")).cast("string")).alias(n) for n in names]
    return rows.select(*keep, *got)


#: Two-sided levels in percent and the critical values of the normal distribution for them.
_T_LEVELS = (80.0, 90.0, 95.0, 98.0, 99.0, 99.5)
_T_NORMAL = (1.2816, 1.6449, 1.9600, 2.3263, 2.5758, 2.8070)


def critical_t(degrees: Column, level: float) -> Column:
    """The two-sided critical value, by the Cornish-Fisher series about the normal one: beyond thirty degrees of freedom, exact to four places up to there; null without any."""
    nearest = min(range(len(_T_LEVELS)), key=lambda i: abs(_T_LEVELS[i] - level))
    if abs(_T_LEVELS[nearest] - level) > 1:
        raise ValueError(f"no such level: {level}")
    z, v = _T_NORMAL[nearest], F.when(degrees > 0, degrees.cast("double"))
    few = {k: round(_student(_T_LEVELS[nearest], k), 4) for k in range(1, 31)}
    series = F.lit(z) + (z**3 + z) / 4 / v + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / (v * v) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / (v * v * v) + (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160 / (v * v * v * v)
    out = F.when(v >= 1000, F.lit(z))
    for k, t in few.items():
        out = out.when(v == k, F.lit(t))
    return out.otherwise(series)


def _student(level: float, degrees: int) -> float:
    """Student's two-sided critical value for few degrees of freedom, by bisection on the closed form of the distribution."""

    def inside(t: float) -> float:
        angle = math.atan(t / math.sqrt(degrees))
        if degrees == 1:
            return 2 * angle / math.pi
        c, total, term = math.cos(angle) ** 2, 0.0, 1.0
        if degrees % 2:
            for k in range(1, (degrees - 1) // 2 + 1):
                total += term
                term *= c * 2 * k / (2 * k + 1)
            return 2 / math.pi * (angle + math.sin(angle) * math.cos(angle) * total)
        for k in range(1, degrees // 2 + 1):
            total += term
            term *= c * (2 * k - 1) / (2 * k)
        return math.sin(angle) * total

    low, high = 0.0, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if inside(middle) < level / 100 else (low, middle)
    return low


def t_test(m: DataFrame, group: str, base, level: float = 95.0) -> DataFrame:
    """(group, n, mean, difference, margin, percent, percent_margin, significant): each group's mean against that of the group `base`, also in percent of that.

    The variance is pooled; the margin is null where either group has no value, or there are no degrees of
    freedom. `m` has a row for each group, from `moments`.
    """
    first = m.filter(F.col(group) == F.lit(base)).select(F.col("n").alias("__n"), F.col("m1").alias("__m1"), F.col("m2").alias("__m2")).first()
    n0, mean0, m20 = first if first else (0, None, None)
    n, d = F.col("n").cast("double"), F.col("m1") - F.lit(mean0).cast("double")
    degrees = n + float(n0) - 2
    pooled = F.when(degrees > 0, F.try_divide(F.col("m2") + F.lit(m20).cast("double"), degrees))
    margin = critical_t(degrees, level) * F.sqrt(pooled * (F.try_divide(F.lit(1.0), n) + F.lit(1.0 / n0 if n0 else None).cast("double")))
    hundredth = F.try_divide(F.lit(100.0), F.abs(F.lit(mean0).cast("double")))
    return m.select(group, "n", F.col("m1").alias("mean"), d.alias("difference"), margin.alias("margin"), (d * hundredth).alias("percent"), (margin * hundredth).alias("percent_margin"), F.coalesce(F.abs(d) > margin, F.lit(False)).alias("significant"))


def sweep(spark: SparkSession, parameters: dict[str, list]) -> DataFrame:
    """Every combination of the parameters' values; a small table by intent, one explode a parameter."""
    out = spark.range(1)
    for name, values in parameters.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.drop("id")


def map_fold(rows: DataFrame, key: Sequence[str], onto: Sequence[str], folds: dict[str, Column]) -> DataFrame:
    """Rows keyed by a tuple reduced onto some of the key's columns by associative, commutative aggregates."""
    if not set(onto) <= set(key):
        raise ValueError("a reduction keeps a subset of the key")
    return rows.groupBy(*onto).agg(*[f.alias(n) for n, f in folds.items()])
