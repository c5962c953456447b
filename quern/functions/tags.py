"""Tag sets: the text `:k=v:k=v:` and maps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def pairs(tags: Column) -> Column:
    return F.array_sort(F.filter(F.split(tags, ":"), lambda t: t != ""))


def canonical(tags: Column) -> Column:
    """The tag set with its pairs in order; null stays null."""
    return F.concat(F.lit(":"), F.array_join(pairs(tags), ":"), F.lit(":"))


def parse(tags: Column) -> Column:
    """The map of a tag set; null for a text that isn't one: a pair without `=` or key, or a key that occurs twice."""
    own = pairs(tags)
    key = lambda t: F.substring_index(t, "=", 1)
    keys = F.transform(own, key)
    fine = F.forall(own, lambda t: t.rlike("^[^=]+=[^=]*$")) & (F.size(F.array_distinct(keys)) == F.size(own))
    return F.when(fine, F.map_from_arrays(keys, F.transform(own, lambda t: F.substring_index(t, "=", -1))))


def render(tags: Column) -> Column:
    """The canonical text of a map."""
    entries = F.array_sort(F.transform(F.map_entries(tags), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return F.concat(F.lit(":"), F.array_join(entries, ":"), F.lit(":"))


def covers(tags: Column, wanted: Mapping[str, str]) -> Column:
    """Whether a canonical tag set holds every wanted pair; an empty want holds everywhere."""
    held = F.lit(True)
    for k, v in wanted.items():
        held = held & F.contains(tags, F.lit(f":{k}={v}:"))
    return held


def parse_wanted(text: str) -> dict[str, str]:
    """The pairs of a tag set that is given in a query."""
    out: dict[str, str] = {}
    for part in filter(None, text.split(":")):
        key, eq, value = part.partition("=")
        if not key or not eq or key in out:
            raise ValueError(f"not a tag set: {text}")
        out[key] = value
    return out
