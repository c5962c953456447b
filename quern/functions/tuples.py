"""Keys of several elements as bytes that sort as the elements do, each ascending or descending.

An element is a number of its own kind of order: whole numbers have eight bytes, first byte highest, with
the sign turned; texts and bytes end in two zero bytes, and a zero byte in them is followed by FF. In
descending order all bits are turned. A null has the byte 00 in front and everything else 01, so nulls come first
(last where descending). All of it is text replacement on hexadecimal digits and stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS, TURNED = "0123456789ABCDEF", "FEDCBA9876543210"
#: What an element can be, and the Spark type it comes back as.
KINDS = {"int": "bigint", "string": "string", "bytes": "binary", "timestamp": "timestamp"}


def _whole(x: Column) -> Column:
    """Sixteen digits of a bigint, in the order of the numbers."""
    return F.lpad(F.hex(x.bitwiseXOR(F.lit(-(2**63)).cast("bigint"))), 16, "0")


def _text(digits: Column) -> Column:
    return F.concat(F.regexp_replace(digits, r"\G((?:(?!00)..)*)00", "$100FF"), F.lit("0000"))


def encode(elements: Sequence[tuple[Column, str, bool]]) -> Column:
    """The key of elements (column, kind, descending); kinds are int, string, bytes and timestamp."""
    parts = []
    for value, kind, descending in elements:
        if kind in ("int", "timestamp"):
            digits = _whole(F.unix_micros(value) if kind == "timestamp" else value.cast("bigint"))
        elif kind in ("string", "bytes"):
            digits = _text(F.hex(F.encode(value, "UTF-8") if kind == "string" else value))
        else:
            raise ValueError(f"no kind of element: {kind}")
        own = F.when(value.isNull(), F.lit("00")).otherwise(F.concat(F.lit("01"), digits))
        parts.append(F.translate(own, DIGITS, TURNED) if descending else own)
    return F.unhex(F.concat(*parts))


def decode(key: Column, kinds: Sequence[tuple[str, bool]]) -> list[Column]:
    """The elements of a key, from their (kind, descending); null where the bytes aren't such a key."""
    rest, out = F.hex(key), []
    for kind, descending in kinds:
        plain = F.translate(rest, TURNED, DIGITS) if descending else rest
        if kind in ("int", "timestamp"):
            digits = F.regexp_extract(plain, r"^01([0-9A-F]{16})", 1)
            number = F.conv(F.substring(digits, 1, 1), 16, 10).cast("bigint")
            # The highest digit is taken apart, so that the number fits.
            value = (number - 8) * F.lit(1 << 60) + F.conv(F.substring(digits, 2, 15), 16, 10).cast("bigint")
            own = F.when(digits != "", F.timestamp_micros(value) if kind == "timestamp" else value)
            taken = F.when(digits != "", 18)
        else:
            found = F.regexp_extract(plain, r"^01((?:(?!00)..|00FF)*)0000", 1)
            whole = plain.rlike(r"^01(?:(?!00)..|00FF)*0000")
            data = F.unhex(F.regexp_replace(found, r"\G((?:(?!00)..)*)00FF", "$100"))
            own = F.when(whole, F.decode(data, "UTF-8") if kind == "string" else data)
            taken = F.when(whole, F.length(found) + 6)
        null = plain.startswith("00")
        out.append(F.when(~null, own))
        rest = F.substring(rest, F.when(null, 2).otherwise(taken) + 1, F.length(rest))
    return out
