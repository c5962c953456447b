"""Schemaless values (variants): typed parts with the reason where there is none, their text, and rebuilding them from leaves."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def kind(value: Column, path: str = "$") -> Column:
    """What a part of a value is, as Spark names variants' types; null where it is missing."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def extract(value: Column, path: str, wanted: str) -> Column:
    """A struct (value, error) of the part at a path as the type `wanted`: the error is `missing`, `mismatch` or null.

    A JSON null is a mismatch, as it is there and has no type. A whole number fits a double; a double fits a whole
    number only if it is one.
    """
    part = F.try_variant_get(value, path, "variant")
    got = F.try_variant_get(value, path, wanted)
    if wanted in ("bigint", "int"):
        got = F.when(F.try_variant_get(value, path, "double").eqNullSafe(got.cast("double")), got)
    if wanted == "string":
        got = F.when(F.startswith(F.schema_of_variant(part), F.lit("STRING")), got)
    elif wanted in ("bigint", "int", "double"):
        got = F.when(~F.startswith(F.schema_of_variant(part), F.lit("STRING")) & ~F.startswith(F.schema_of_variant(part), F.lit("BOOLEAN")), got)
    elif wanted == "boolean":
        got = F.when(F.startswith(F.schema_of_variant(part), F.lit("BOOLEAN")), got)
    return F.struct(got.alias("value"), F.when(part.isNull(), "missing").when(got.isNull(), "mismatch").alias("error"))


def require(value: Column, path: str, wanted: str) -> Column:
    """The part at a path as the type `wanted`; a missing part or one of another type raises."""
    both = extract(value, path, wanted)
    return F.when(both["error"].isNull(), both["value"]).otherwise(F.raise_error(F.concat(F.lit(f"{path} as {wanted}: "), both["error"])).cast(wanted))


def display(text: Column) -> Column:
    """The text of a JSON value as people read it: `, ` and `: ` between its parts, control characters escaped. Null where it isn't JSON."""

    def show(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else _shown(t))

    return F.pandas_udf(show, "string")(text)


def _shown(text: str) -> str | None:
    try:
        shown = re.sub(r"\\(.)", lambda m: {"b": "\\u0008", "f": "\\u000c"}.get(m[1], m[0]), json.dumps(json.loads(text), ensure_ascii=False))
        return re.sub("[\x7f-\x9f]", lambda m: f"\\u{ord(m[0]):04x}", shown)
    except ValueError:
        return None


def rebuild(leaves: Column) -> Column:
    """The JSON text of a value from its indexed leaves (`logs.leaves` with `indexed`); null without leaves."""

    def build(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or not len(v) else json.dumps(_built(v), ensure_ascii=False, separators=(",", ":")))

    return F.pandas_udf(build, "string")(leaves)


_STEP = re.compile(r"\.((?:[^.\[\\]|\\.)*)|\[(\d*)\]")


def _built(leaves) -> object:
    root: dict = {}
    for leaf in leaves:
        value = {"bool": lambda t: t == "true", "number": json.loads, "string": lambda t: t, "null": lambda t: None, "object": lambda t: {}, "array": lambda t: []}[leaf["kind"]](leaf["value"])
        at, key = root, "$"
        for m in _STEP.finditer(leaf["path"], 1):
            if m[2] is not None and m[2] == "":
                break  # the mark of an empty array
            at = at.setdefault(key, [] if m[2] is not None else {}) if isinstance(at, dict) else _nth(at, key, [] if m[2] is not None else {})
            key = int(m[2]) if m[2] is not None else re.sub(r"\\(.)", r"\1", m[1])
        if isinstance(at, dict):
            at[key] = value
        else:
            _nth(at, key, value)
    return root["$"]


def _nth(items: list, i: int, made: object) -> object:
    while len(items) <= i:
        items.append(made)
    return items[i]


def camel_case(name: Column) -> Column:
    """An identifier's words, apart by underscores, each with a capital in front and together."""
    words = F.filter(F.split(name, "_"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")
