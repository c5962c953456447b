"""Nested objects: a schema of tables, its compatibility and keys, and selections that compile to Spark.

    table Ship (fixed64 imo = 1) @ 7 {
        string flag = 2;
        breakout double draught = 3;
        object engine = 4 { string maker = 1; int32 kilowatts = 2; };
        map fixed32 calls = 5 { timestamp_micros arrived = 1; join port = 2 on Port(calls); };
    }

    Ship[9074729] { flag, engine { kilowatts }, calls { arrived, port { town } } }
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The types of values, and the Spark type of each.
TYPES: dict[str, T.DataType] = {
    "unit": T.NullType(), "int32": T.IntegerType(), "int64": T.LongType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "sint32": T.IntegerType(), "sint64": T.LongType(), "fixed32": T.LongType(), "fixed64": T.DecimalType(20, 0), "sfixed32": T.IntegerType(), "sfixed64": T.LongType(),
    "timestamp_micros": T.TimestampType(), "float": T.FloatType(), "double": T.DoubleType(), "bool": T.BooleanType(), "bytes": T.BinaryType(), "bytes16": T.BinaryType(), "bytes32": T.BinaryType(), "bytes64": T.BinaryType(), "string": T.StringType(), "message": T.StructType([]),
}
KEY_TYPES = ("unit", "fixed32", "fixed64", "sfixed32", "sfixed64", "string")
#: Types that may stand for each other in a key.
_ALIKE = ({"int32", "sfixed32", "sint32"}, {"int64", "sfixed64", "sint64"}, {"uint32", "fixed32"}, {"uint64", "fixed64"})


class SchemaError(ValueError):
    """The text isn't a schema or a selection, or doesn't fit it."""


@dataclass(frozen=True)
class Field:
    name: str
    number: int
    type: str
    breakout: bool = False


@dataclass(frozen=True)
class Object:
    name: str
    number: int
    fields: tuple


@dataclass(frozen=True)
class Map:
    name: str
    number: int
    key_type: str
    fields: tuple


@dataclass(frozen=True)
class Join:
    name: str
    number: int
    table: str
    keys: tuple[str, ...]


@dataclass(frozen=True)
class Table:
    name: str
    number: int
    keys: tuple[Field, ...]
    fields: tuple


@dataclass(frozen=True)
class Selection:
    """A name, what its key must equal, and what to take of it; `of` is None for all."""

    name: str
    equals: object = None
    of: tuple | None = None


class _Tokens:
    def __init__(self, text: str):
        self.tokens = re.findall(r'"(?:[^"\\]|\\.)*"|[A-Za-z_]\w*|-?\d+|\S', text) + [""]
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at]

    def take(self, wanted: str | None = None) -> str:
        got = self.peek()
        if (wanted is not None and got != wanted) or not got:
            raise SchemaError(f"expected {wanted or 'more'}, found {got or 'the end'}")
        self.at += 1
        return got

    def name(self) -> str:
        got = self.take()
        if not re.fullmatch(r"[A-Za-z_]\w*", got):
            raise SchemaError(f"expected a name, found {got}")
        return got

    def number(self) -> int:
        got = self.take()
        if not got.isdigit() or int(got) == 0:
            raise SchemaError(f"expected a positive number, found {got}")
        return int(got)


def parse_schema(text: str) -> dict[str, Table]:
    t = _Tokens(re.sub(r"//[^\n]*", "", text))
    tables: dict[str, Table] = {}

    def fields() -> tuple:
        out = []
        t.take("{")
        while t.peek() != "}":
            word = t.take()
            if word in ("object", "map"):
                key_type = _key_type(t.take()) if word == "map" else ""
                name = t.name()
                t.take("=")
                number = t.number()
                inner = fields()
                out.append(Map(name, number, key_type, inner) if word == "map" else Object(name, number, inner))
            elif word == "join":
                name = t.name()
                t.take("=")
                number = t.number()
                t.take("on")
                table = t.name()
                t.take("(")
                keys = [t.name()]
                while t.peek() == ",":
                    t.take()
                    keys.append(t.name())
                t.take(")")
                out.append(Join(name, number, table, tuple(keys)))
            else:
                breakout = word == "breakout"
                kind = t.take() if breakout else word
                if kind not in TYPES:
                    raise SchemaError(f"no type: {kind}")
                name = t.name()
                t.take("=")
                out.append(Field(name, t.number(), kind, breakout))
            t.take(";")
        t.take("}")
        _unique(out)
        return tuple(out)

    while t.peek():
        t.take("table")
        name = t.name()
        t.take("(")
        keys = []
        while True:
            kind = _key_type(t.take())
            key = t.name()
            t.take("=")
            keys.append(Field(key, t.number(), kind))
            if t.peek() != ",":
                break
            t.take()
        t.take(")")
        t.take("@")
        number = t.number()
        own = Table(name, number, tuple(keys), fields())
        if t.peek() == ";":
            t.take()
        _unique([*own.keys, *own.fields])
        if name in tables or number in (x.number for x in tables.values()):
            raise SchemaError(f"table {name} or its number occurs twice")
        tables[name] = own
    for table in tables.values():
        _check_joins(table.fields, tables, {k.name: k.type for k in table.keys})
    return tables


def _key_type(word: str) -> str:
    if word not in KEY_TYPES:
        raise SchemaError(f"no type of keys: {word}")
    return word


def _unique(fields: list) -> None:
    if len({f.name for f in fields}) < len(fields) or len({f.number for f in fields}) < len(fields):
        raise SchemaError("a name or number occurs twice")


def _check_joins(fields: tuple, tables: Mapping[str, Table], scope: dict[str, str]) -> None:
    scope = scope | {f.name: f.type for f in fields if isinstance(f, Field)}
    for f in fields:
        if isinstance(f, Join):
            if f.table not in tables:
                raise SchemaError(f"join {f.name} on unknown table {f.table}")
            keys = tables[f.table].keys
            if len(keys) != len(f.keys) or any(k not in scope or not alike(scope[k], want.type) for k, want in zip(f.keys, keys, strict=False)):
                raise SchemaError(f"the keys of join {f.name} don't fit {f.table}")
        elif isinstance(f, Object):
            _check_joins(f.fields, tables, scope)
        elif isinstance(f, Map):
            _check_joins(f.fields, tables, scope | {f.name: f.key_type})


def alike(a: str, b: str) -> bool:
    return a == b or any(a in group and b in group for group in _ALIKE)


def describe_keys(schema: Mapping[str, Table]) -> list[str]:
    """Every key that a table's data is kept under, as the path of numbers, names and types to it."""
    out = []

    def walk(fields: tuple, prefix: str) -> None:
        for f in fields:
            if isinstance(f, Field) and f.breakout:
                out.append(f"{prefix}, {f.number}:{f.name}:{_wire(f.type)})")
            elif isinstance(f, (Object, Map)):
                own = f"{prefix}, {f.number}:{f.name}:{f'map<{_wire(f.key_type)}>' if isinstance(f, Map) else 'message'}"
                out.append(own + ")")
                walk(f.fields, own)

    for t in schema.values():
        prefix = f"({t.number}:{camel_case(t.name)}:TableID" + "".join(f", {k.number}:{k.name}:{_wire(k.type)}" for k in t.keys)
        out.append(prefix + ")")
        walk(t.fields, prefix)
    return out


def _wire(kind: str) -> str:
    """A type as protobuf names it."""
    return "sfixed64" if kind == "timestamp_micros" else kind


def camel_case(name: str) -> str:
    """The words of a name, apart by underscores, each with a capital in front and together."""
    return "".join(w[0].upper() + w[1:] for w in name.split("_") if w)


def schema_text(schema: Mapping[str, Table]) -> str:
    """The schema in its own language, which `parse_schema` reads back as the same."""

    def lines(fields: tuple, depth: int) -> list[str]:
        pad, out = "    " * depth, []
        for f in fields:
            if isinstance(f, Field):
                out.append(f"{pad}{'breakout ' if f.breakout else ''}{f.type} {f.name} = {f.number};")
            elif isinstance(f, Join):
                out.append(f"{pad}join {f.name} = {f.number} on {f.table}({', '.join(f.keys)});")
            else:
                word = f"map {f.key_type}" if isinstance(f, Map) else "object"
                out += [f"{pad}{word} {f.name} = {f.number} {{", *lines(f.fields, depth + 1), f"{pad}}};"]
        return out

    tables = []
    for t in schema.values():
        keys = ", ".join(f"{k.type} {k.name} = {k.number}" for k in t.keys)
        tables.append("\n".join([f"table {t.name} ({keys}) @ {t.number} {{", *lines(t.fields, 1), "}"]))
    return "\n\n".join(tables) + "\n"


def protobuf_text(schema: Mapping[str, Table]) -> str:
    """The schema as protobuf messages: one for each table, nested ones for objects and for the values of maps; joins are optional messages of the table they look up."""

    def body(fields: tuple, depth: int) -> list[str]:
        pad, out = "    " * depth, []
        for f in fields:
            if isinstance(f, Field):
                out.append(f"{pad}optional {_wire(f.type)} {f.name} = {f.number};")
            elif isinstance(f, Join):
                out.append(f"{pad}optional {camel_case(f.table)} {f.name} = {f.number};")
            else:
                message = camel_case(f.name) + ("Value" if isinstance(f, Map) else "")
                out += [f"{pad}message {message} {{", *body(f.fields, depth + 1), f"{pad}}}"]
                out.append(f"{pad}map<{_wire(f.key_type)}, {message}> {f.name} = {f.number};" if isinstance(f, Map) else f"{pad}optional {message} {f.name} = {f.number};")
        return out

    messages = ["\n".join([f"message {camel_case(t.name)} {{", *body((*t.keys, *t.fields), 1), "}"]) for t in schema.values()]
    return "\n\n".join(['syntax = "proto2";', *messages]) + "\n"


def entry_of(schema: Mapping[str, Table], numbers: tuple[int, ...]) -> tuple[str, ...] | None:
    """The names along a key of numbers (table, its keys, then fields), or None if the schema has no such key: what a stored key belongs to."""
    table = next((t for t in schema.values() if numbers and t.number == numbers[0]), None)
    if table is None or tuple(numbers[1 : 1 + len(table.keys)]) != tuple(k.number for k in table.keys):
        return None
    names, fields = [table.name, *(k.name for k in table.keys)], table.fields
    rest = numbers[1 + len(table.keys) :]
    for i, n in enumerate(rest):
        f = next((f for f in fields if f.number == n), None)
        if f is None or isinstance(f, Join) or (isinstance(f, Field) and not (f.breakout and i == len(rest) - 1)):
            return None
        names.append(f.name)
        fields = f.fields if isinstance(f, (Object, Map)) else ()
    return tuple(names)


def compatible(old: Mapping[str, Table], new: Mapping[str, Table]) -> list[str]:
    """What keeps data of the old schema from being read by the new one; empty if nothing does. Fields may come and go; a number can't change its kind."""
    trouble = []

    def same(a: tuple, b: tuple, where: str) -> None:
        by = {f.number: f for f in b}
        for f in a:
            g = by.get(f.number)
            if g is None:
                continue
            here = f"{where}.{f.number}"
            if type(f) is not type(g):
                trouble.append(f"{here}: {type(f).__name__.lower()} became {type(g).__name__.lower()}")
            elif isinstance(f, Field) and not alike(f.type, g.type):
                trouble.append(f"{here}: {f.type} became {g.type}")
            elif isinstance(f, Map) and not alike(f.key_type, g.key_type):
                trouble.append(f"{here}: keys of {f.key_type} became {g.key_type}")
            if isinstance(f, (Object, Map)) and type(f) is type(g):
                same(f.fields, g.fields, here)

    by = {t.number: t for t in new.values()}
    for t in old.values():
        if u := by.get(t.number):
            if len(t.keys) != len(u.keys) or any(not alike(a.type, b.type) for a, b in zip(t.keys, u.keys, strict=False)):
                trouble.append(f"{t.number}: its keys changed")
            same(t.fields, u.fields, str(t.number))
    return trouble


def spark_type(fields: tuple, schema: Mapping[str, Table] | None = None) -> T.StructType:
    """The Spark type of fields; joins have none of their own."""
    out = []
    for f in fields:
        if isinstance(f, Field):
            out.append(T.StructField(f.name, TYPES[f.type]))
        elif isinstance(f, Object):
            out.append(T.StructField(f.name, spark_type(f.fields)))
        elif isinstance(f, Map):
            out.append(T.StructField(f.name, T.MapType(TYPES[f.key_type], spark_type(f.fields))))
    return T.StructType(out)


def parse_selection(text: str) -> Selection:
    t = _Tokens(text)

    def one() -> Selection:
        name, equals, of = t.name(), None, None
        if t.peek() == "[":
            t.take()
            word = t.take()
            equals = json.loads(word)
            t.take("]")
        if t.peek() == "{":
            t.take()
            parts = []
            while t.peek() != "}":
                parts.append(one())
                if t.peek() == ",":
                    t.take()
            t.take("}")
            of = tuple(parts)
        elif equals is not None:
            raise SchemaError("a key's selection says what to take")
        return Selection(name, equals, of)

    out = one()
    if t.peek():
        raise SchemaError(f"unexpected {t.peek()}")
    return out


def select(schema: Mapping[str, Table], tables: Mapping[str, DataFrame], query: str | Selection) -> DataFrame:
    """The rows of a selection: key columns and what it takes, nested as asked for.

    `tables` have their keys and fields as columns: objects as structs, maps as maps of structs. A key in
    brackets filters the root's first key or takes one entry of a map; such filters reach the scan. Joins
    look their table up from the left: a row without a partner has null. A join within a map opens the
    map's entries into rows and folds them back, by the root's keys.
    """
    asked = parse_selection(query) if isinstance(query, str) else query
    table = schema.get(asked.name)
    if table is None:
        raise SchemaError(f"no table: {asked.name}")
    rows = tables[asked.name]
    keys = [k.name for k in table.keys]
    if asked.equals is not None:
        rows = rows.filter(F.col(keys[0]) == F.lit(asked.equals))
    outputs: dict[str, Column] = {}
    by_name = {f.name: f for f in (*table.keys, *table.fields)}
    for part in asked.of or tuple(Selection(f.name) for f in table.fields if not isinstance(f, Join)):
        field = by_name.get(part.name)
        if field is None:
            raise SchemaError(f"{asked.name} has no {part.name}")
        if isinstance(field, Join):
            rows = _join(schema, tables, rows, field, part, {k: F.col(k) for k in field.keys})
            outputs[part.name] = F.col(f"__j_{part.name}")
        elif isinstance(field, Map) and _joins_in(field, part):
            rows = _join_in_map(schema, tables, rows, keys, field, part)
            outputs[part.name] = F.col(f"__m_{part.name}")
        else:
            outputs[part.name] = _project(field, part, F.col(part.name))
    return rows.select(*[F.col(k) for k in keys if k not in outputs], *[c.alias(n) for n, c in outputs.items()])


def _part_of(fields: tuple, parts: tuple | None) -> list[tuple]:
    by = {f.name: f for f in fields}
    chosen = parts if parts is not None else tuple(Selection(f.name) for f in fields if not isinstance(f, Join))
    for p in chosen:
        if p.name not in by:
            raise SchemaError(f"no field: {p.name}")
    return [(by[p.name], p) for p in chosen]


def _project(field, part: Selection, value: Column) -> Column:
    if isinstance(field, Field):
        if part.of is not None:
            raise SchemaError(f"{field.name} has no parts")
        return value
    inner = lambda v: F.struct(*[_project(f, p, v[f.name]).alias(f.name) for f, p in _part_of(field.fields, part.of)])
    if isinstance(field, Object):
        return F.when(value.isNotNull(), inner(value))
    if part.equals is not None:
        entry = F.try_element_at(value, F.lit(part.equals).cast(TYPES[field.key_type]))
        return F.when(entry.isNotNull(), inner(entry))
    return F.transform_values(value, lambda _, v: inner(v))


def _joins_in(field: Map, part: Selection) -> bool:
    return any(isinstance(f, Join) for f, _ in _part_of(field.fields, part.of))


def _target(schema, tables, join: Join, part: Selection) -> DataFrame:
    """The joined table as (__k0, ..., __v)."""
    other = schema[join.table]
    inner = select(schema, tables, Selection(join.table, None, part.of))
    values = [p.name for p in part.of] if part.of else [f.name for f in other.fields if not isinstance(f, Join)]
    own = [k.name for k in other.keys]
    return inner.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(own)], F.struct(*values).alias("__v"))


def _join(schema, tables, rows: DataFrame, join: Join, part: Selection, scope: dict[str, Column]) -> DataFrame:
    target = _target(schema, tables, join, part)
    on = F.lit(True)
    for i, k in enumerate(join.keys):
        on = on & (scope[k] == F.col(f"__k{i}"))
    return rows.join(target, on, "left").drop(*[f"__k{i}" for i in range(len(join.keys))]).withColumnRenamed("__v", f"__j_{part.name}")


def _join_in_map(schema, tables, rows: DataFrame, keys: list[str], field: Map, part: Selection) -> DataFrame:
    entries = rows.select(*keys, F.explode(F.col(field.name)).alias("__key", "__entry"))
    if part.equals is not None:
        entries = entries.filter(F.col("__key") == F.lit(part.equals).cast(TYPES[field.key_type]))
    made = {}
    for f, p in _part_of(field.fields, part.of):
        if isinstance(f, Join):
            scope = {k: F.col("__key") if k == field.name else F.col("__entry")[k] if k not in keys else F.col(k) for k in f.keys}
            entries = _join(schema, tables, entries, f, p, scope)
            made[f.name] = F.col(f"__j_{f.name}")
        else:
            made[f.name] = _project(f, p, F.col("__entry")[f.name])
    one = F.struct(*[c.alias(n) for n, c in made.items()])
    folded = entries.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("__key").alias("k"), one.alias("v")))).alias(f"__m_{field.name}"))
    if part.equals is not None:
        folded = folded.withColumn(f"__m_{field.name}", F.map_values(f"__m_{field.name}")[0])
    return rows.join(folded, keys, "left")


def assemble(parent: DataFrame, keys: list[str], child: DataFrame, name: str, map_key: str, values: dict[str, Column]) -> DataFrame:
    """The parent with a map column `name` of its children's structs, by `map_key`; an object without children has an empty map.

    What belongs to one object is one row by definition, so its children gather in one place.
    """
    entry = F.struct(F.col(map_key).alias("k"), F.struct(*[c.alias(n) for n, c in values.items()]).alias("v"))
    maps = child.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias(name))
    out = parent.join(maps, keys, "left")
    return out.withColumn(name, F.coalesce(F.col(name), F.map_from_arrays(F.array().cast(T.ArrayType(maps.schema[name].dataType.keyType)), F.array().cast(T.ArrayType(maps.schema[name].dataType.valueType)))))


def assemble_all(parent: DataFrame, keys: list[str], maps: Mapping[str, tuple[DataFrame, str, Mapping[str, Column]]], breakouts: Mapping[str, tuple[DataFrame, Column]] | None = None) -> DataFrame:
    """The parent with several maps, (children, their key, their values) by name, and with breakout fields, (rows, value) by name, that are kept apart from their object.

    Of several rows of a breakout field the greatest value counts; an object without any has null. What
    belongs to an object outside of the parent is left out, as it has no place.
    """
    out = parent
    for name, (child, map_key, values) in maps.items():
        out = assemble(out, keys, child, name, map_key, dict(values))
    for name, (rows, value) in (breakouts or {}).items():
        out = out.join(rows.groupBy(*keys).agg(F.max(value).alias(name)), keys, "left")
    return out
