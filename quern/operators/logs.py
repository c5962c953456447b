"""Structured logs: records of nested JSON values, searched by containment, with exemplars and correlates."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans import log_language

#: Marks of a path that are escaped in the keys of indexed ones.
_MARKS, _ESCAPED = r"[.\[\\]", lambda m: "\\" + m[0]
LEAVES = "array<struct<path:string,kind:string,value:string>>"


def _flat(value, path: str, out: list, indexed: bool = False) -> None:
    if isinstance(value, dict):
        if not value:
            out.append({"path": path, "kind": "object", "value": "{}"})
        for k, v in value.items():
            _flat(v, f"{path}.{re.sub(_MARKS, _ESCAPED, k) if indexed else k}", out, indexed)
    elif isinstance(value, list):
        if not value:
            out.append({"path": path + "[]", "kind": "array", "value": "[]"})
        for i, v in enumerate(value):
            _flat(v, f"{path}[{i if indexed else ''}]", out, indexed)
    elif isinstance(value, bool):
        out.append({"path": path, "kind": "bool", "value": str(value).lower()})
    elif isinstance(value, (int, float)):
        out.append({"path": path, "kind": "number", "value": repr(value)})
    elif isinstance(value, str):
        out.append({"path": path, "kind": "string", "value": value})
    else:
        out.append({"path": path, "kind": "null", "value": None})


def leaves(records: DataFrame, json_column: str, keep: list[str], indexed: bool = False) -> DataFrame:
    """The columns `keep` and `leaves`: all leaves of a JSON text of any depth, as (path, kind, value).

    A null or malformed text has no leaves. With `indexed` a path names the places in arrays and escapes marks in
    keys, so that `values.rebuild` can put the value together again. Values are parsed in Arrow batches; only the kept columns and
    the text reach Python.
    """
    rows = records.select(*keep, F.col(json_column).alias("__json"))
    schema = rows.drop("__json").withColumn("leaves", F.lit(None).cast(LEAVES)).schema
    kind = pa.list_(pa.struct([("path", pa.string()), ("kind", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text in batch.column(len(keep)).to_pylist():
                out: list = []
                try:
                    _flat(json.loads(text), "$", out, indexed) if text is not None else None
                except ValueError:
                    out = []
                made.append(out)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(made, kind)], [*keep, "leaves"])

    return rows.mapInArrow(run, schema)


def struct_leaves(columns: dict[str, Column]) -> Column:
    """Leaves of records whose fields are plain columns: strings, numbers and booleans; nulls have none. Stays in the JVM."""
    made = []
    for name, c in columns.items():
        made.append(F.struct(F.lit(f"$.{name}").alias("path"), F.when(F.typeof(c) == "string", "string").when(F.typeof(c) == "boolean", "bool").otherwise("number").alias("kind"), c.cast("string").alias("value")))
    return F.filter(F.array(*made), lambda p: p["value"].isNotNull())


def query(flat: DataFrame, text: str) -> DataFrame:
    """The records that hold the query."""
    return flat.filter(log_language.matches(F.col("leaves"), log_language.parse(text)))


def exemplars(flat: DataFrame, k: int, without: list[str] | None = None) -> DataFrame:
    """(path, kind, value, n): the k commonest leaves over all records, of equal ones the smaller; paths in `without` don't compete."""
    each = flat.select(F.explode("leaves").alias("p")).select("p.path", "p.kind", "p.value").filter("value is not null")
    if without:
        each = each.filter(~F.col("path").isin(without))
    return each.groupBy("path", "kind", "value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "path", "kind", "value").limit(k)


def correlates(flat: DataFrame, text: str, k: int, without: list[str] | None = None) -> DataFrame:
    """(path, kind, value, n): the k commonest leaves of the records that hold the query."""
    return exemplars(query(flat, text), k, without)


def below_level(records: DataFrame, level: int) -> DataFrame:
    """What an emitter with this level filter lets through: records of at most that level; a null level never passes."""
    return records.filter(F.col("level") <= level)
