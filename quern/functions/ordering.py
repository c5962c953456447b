"""Order-preserving integers of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a double's fraction.
MANTISSA = 52


def _power(e: Column) -> Column:
    """2^e, exact for integers e in the range of doubles."""
    return F.pow(F.lit(2.0), e)


def order_key(x: Column) -> Column:
    """A bigint that orders as the double x does; -0.0 equals 0.0, infinities are the ends, NaN and null give null."""
    a = F.abs(x)
    guess = F.floor(F.log2(a)).cast("double")
    exponent = F.when(_power(guess) > a, guess - 1).when(_power(guess + 1) <= a, guess + 1).otherwise(guess)
    fraction = a / _power(exponent) - 1
    # Each part is whole and within 53 bits as a double; only their sum as bigints is exact.
    normal = (exponent + 1023).cast("bigint") * F.lit(1 << MANTISSA) + (fraction * F.lit(float(1 << MANTISSA))).cast("bigint")
    bits = (
        F.when(a == 0, F.lit(0).cast("bigint"))
        .when(a == float("inf"), F.lit(2047 << MANTISSA).cast("bigint"))
        .when(a < 2.0**-1022, (a * 2.0**537 * 2.0**537).cast("bigint"))
        .otherwise(normal)
    )
    return F.when(x.isNull() | F.isnan(x), F.lit(None).cast("bigint")).when(x < 0, -bits).otherwise(bits)


def key_value(key: Column) -> Column:
    """The double of an order key."""
    a = F.abs(key)
    exponent = F.shiftright(a, MANTISSA)
    fraction = (a % F.lit(1 << MANTISSA)).cast("double") / float(1 << MANTISSA)
    small = fraction * 2.0**-1022
    value = F.when(exponent == 2047, F.lit(float("inf"))).when(exponent == 0, small).otherwise((fraction + 1) * _power((exponent - 1023).cast("double")))
    return F.when(key < 0, -value).otherwise(value)


def slices(x: Column, bits: int = 4) -> Column:
    """A bigint that never falls as x rises: sign, exponent and the leading `bits` of the fraction. NaN comes last; null stays null."""
    return F.when(F.isnan(x), F.lit(2048 << bits).cast("bigint")).otherwise(F.shiftright(order_key(x), MANTISSA - bits))
