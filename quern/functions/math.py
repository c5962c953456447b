"""Pointwise functions with IEEE results: infinities and NaN where Spark would give null or raise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def _whole(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a double as double: from 2^53 on every double is whole, and Spark's bigint would saturate."""
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**53), x).otherwise(f(x).cast("double"))


def ceil(x: Column) -> Column:
    return _whole(x, F.ceil)


def floor(x: Column) -> Column:
    return _whole(x, F.floor)


def trunc(x: Column) -> Column:
    return F.when(x < 0, ceil(x)).otherwise(floor(x))


def round_half_away(x: Column) -> Column:
    return _whole(x, lambda v: F.when(v < 0, -F.floor(-v + 0.5)).otherwise(F.floor(v + 0.5)))


def logarithm(f: Callable[[Column], Column], shift: float = 0.0) -> Callable[[Column], Column]:
    """f with minus infinity at its pole and NaN below it; shift 1 for log1p."""
    return lambda x: F.when(F.isnan(x) | (x + shift < 0), NAN).when(x + shift == 0, -INF).otherwise(f(x))


def recip(x: Column) -> Column:
    return F.when(x == 0, INF).otherwise(F.lit(1.0) / x)


def signum(x: Column) -> Column:
    """1 from zero up, -1 below, NaN for NaN."""
    return F.when(F.isnan(x), NAN).when(x < 0, -1.0).when(x >= 0, 1.0)


def sign(x: Column) -> Column:
    """1, 0 or -1; 0 for NaN."""
    return F.when(F.isnan(x), 0.0).when(x > 0, 1.0).when(x < 0, -1.0).when(x == 0, 0.0)


#: The pointwise functions by their names in the series language. Null gives null everywhere.
POINTWISE: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs,
    "acos": F.acos,
    "acosh": F.acosh,
    "asin": F.asin,
    "asinh": F.asinh,
    "atan": F.atan,
    "atanh": F.atanh,
    "cbrt": F.cbrt,
    "ceil": ceil,
    "cos": F.cos,
    "cosh": F.cosh,
    "exp": F.exp,
    "exp2": lambda x: F.pow(F.lit(2.0), x),
    "exp_m1": F.expm1,
    "floor": floor,
    "fract": lambda x: x - trunc(x),
    "ln": logarithm(F.ln),
    "ln_1p": logarithm(F.log1p, 1.0),
    "log10": logarithm(F.log10),
    "log2": logarithm(F.log2),
    "recip": recip,
    "round": round_half_away,
    "sign": sign,
    "signum": signum,
    "sin": F.sin,
    "sinh": F.sinh,
    "sqrt": F.sqrt,
    "tan": F.tan,
    "tanh": F.tanh,
    "to_radians": F.radians,
    "trunc": trunc,
}


def divide(a: Column, b: Column) -> Column:
    """a / b as doubles divide: infinities and NaN at zero instead of an error."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when((a == 0) | F.isnan(a), NAN).when(a > 0, INF).otherwise(-INF)
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


#: Binary arithmetic on points.
ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide}
