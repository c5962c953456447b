"""Functions of a step's time, in UTC, as doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

OF_TIME: dict[str, Callable[[Column], Column]] = {
    "day": F.dayofmonth,
    "days_in_month": lambda t: F.dayofmonth(F.last_day(t)),
    "days_in_year": lambda t: F.dayofyear(F.make_date(F.year(t), F.lit(12), F.lit(31))),
    "hour": F.hour,
    "minute": F.minute,
    "month": F.month,
    "second": F.second,
    "unix_micros": F.unix_micros,
    "weekday": F.dayofweek,  # Sunday is 1
    "year": F.year,
}


def of_time(name: str, ts: Column) -> Column:
    return OF_TIME[name](ts).cast("double")


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def parse_rfc3339(text: Column) -> Column:
    """The instant of an RFC 3339 text; null for anything else."""
    return F.try_to_timestamp(text)
