"""Buckets of a fixed number of significant figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket_for(x: Column, sig_figs: int) -> Column:
    """The bucket of a value: 9 x 10^(sig_figs - 1) buckets a decade; values below one, and NaN, share bucket 0. Negative values and null give null."""
    if not 1 <= sig_figs <= 4:
        raise ValueError("1 to 4 significant figures")
    tens, per = 10 ** (sig_figs - 1), 9 * 10 ** (sig_figs - 1)
    decade = F.floor(F.log10(x))
    exact = F.when(F.pow(F.lit(10.0), decade.cast("double")) > x, decade - 1).when(F.pow(F.lit(10.0), (decade + 1).cast("double")) <= x, decade + 1).otherwise(decade)
    own = F.floor(x * tens / F.pow(F.lit(10.0), exact.cast("double")) + per * exact - tens + 0.5)
    return F.when(F.isnan(x), F.lit(0)).when(x < 0, F.lit(None)).when(x < 1, F.lit(0)).otherwise(F.greatest(F.lit(0), own)).cast("int")


def boundary_for(bucket: Column, sig_figs: int) -> Column:
    """The value that stands for a bucket."""
    return boundary(bucket, F.lit(float(sig_figs)))


def boundary(bucket: Column, sig_figs: Column) -> Column:
    """The same for figures that vary by row: (b mod B + B/9) 10^(floor(b/B) - sig_figs + 1) with B = 9 10^(sig_figs - 1). Powers of ten that divide keep decimal values exact."""
    tens = F.pow(F.lit(10.0), sig_figs - 1)
    decade = F.floor(bucket / (tens * 9)).cast("double")
    scale = decade - sig_figs + 1
    digits = bucket - decade * tens * 9 + tens
    return F.when(scale < 0, digits / F.pow(F.lit(10.0), -scale)).otherwise(digits * F.pow(F.lit(10.0), scale))
