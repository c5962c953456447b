"""The log query language: what a record must contain, as JSON-like text with `or`.

    {"user": {"name": "bo", "age"}, "tags": ["a", true]} or 5
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class QueryError(ValueError):
    """The text isn't a query."""


@dataclass(frozen=True)
class Leaf:
    value: bool | int | float | str


@dataclass(frozen=True)
class Any:
    """Anything there."""


@dataclass(frozen=True)
class Array:
    """An array; each query holds for some element."""

    of: tuple


@dataclass(frozen=True)
class Object:
    """An object; each key's query holds."""

    of: tuple[tuple[str, object], ...]


@dataclass(frozen=True)
class Or:
    of: tuple


_TOKEN = re.compile(r'\s*(?:(?P<str>"(?:[^"\\]|\\.)*")|(?P<num>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>true|false|or)\b|(?P<mark>[\[\]{}:,]))')


def parse(text: str):
    tokens, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"can't read at {at}: {text[at : at + 20]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    i = 0

    def ahead(*token: str) -> bool:
        return tokens[i] == token

    def take(kind: str, value: str | None = None) -> str:
        nonlocal i
        k, v = tokens[i]
        if k != kind or (value is not None and v != value):
            raise QueryError(f"expected {value or kind}, found {v or 'the end'}")
        i += 1
        return v

    def one():
        nonlocal i
        kind, value = tokens[i]
        i += 1
        if kind == "str":
            return Leaf(json.loads(value))
        if kind == "num":
            return Leaf(float(value) if re.search(r"[.eE]", value) else int(value))
        if kind == "word" and value != "or":
            return Leaf(value == "true")
        if (kind, value) == ("mark", "["):
            items = []
            while not ahead("mark", "]"):
                items.append(either())
                if not ahead("mark", "]"):
                    take("mark", ",")
            i += 1
            return Array(tuple(items))
        if (kind, value) == ("mark", "{"):
            entries = []
            while not ahead("mark", "}"):
                key = json.loads(take("str"))
                if ahead("mark", ":"):
                    i += 1
                    entries.append((key, either()))
                else:
                    entries.append((key, Any()))
                if not ahead("mark", "}"):
                    take("mark", ",")
            i += 1
            return Object(tuple(entries))
        raise QueryError(f"unexpected {value or 'end'}")

    def either():
        nonlocal i
        options = [one()]
        while ahead("word", "or"):
            i += 1
            options.append(one())
        return options[0] if len(options) == 1 else Or(tuple(options))

    root = either()
    take("end")
    return root


def conjunctions(query) -> list[list[tuple[str, object]]]:
    """The disjunctive normal form: alternatives of (path, leaf or Any); a path has `.key` and `[]` steps. For explaining a query."""

    def normal(q, path: str) -> list[list[tuple[str, object]]]:
        if isinstance(q, Or):
            return [c for o in q.of for c in normal(o, path)]
        if isinstance(q, (Array, Object)):
            parts = [normal(x, path + "[]") for x in q.of] if isinstance(q, Array) else [normal(x, f"{path}.{k}") for k, x in q.of]
            if not parts:
                return [[(path + ("[]" if isinstance(q, Array) else ""), Any())]]
            out = [[]]
            for p in parts:
                out = [a + b for a in out for b in p]
            return out
        return [[(path, q)]]

    return normal(query, "$")


def matches(paths: Column, query) -> Column:
    """Whether a record holds the query, given its flattened leaves: an array of (path, kind, value), as `logs.leaves` makes it.

    Numbers are equal by value whatever their kind; strings and booleans only by kind. What is asked of
    an array's elements may be met by different elements. An unknown path makes the result false.
    """

    def leaf(path: str, wanted) -> Column:
        if isinstance(wanted, Any):
            under = lambda p: (p["path"] == path) | p["path"].startswith(path + ".") | p["path"].startswith(path + "[")
            return F.exists(paths, under)
        v = wanted.value
        if isinstance(v, bool):
            return F.exists(paths, lambda p: (p["path"] == path) & (p["kind"] == "bool") & (p["value"] == str(v).lower()))
        if isinstance(v, str):
            return F.exists(paths, lambda p: (p["path"] == path) & (p["kind"] == "string") & (p["value"] == v))
        return F.exists(paths, lambda p: (p["path"] == path) & (p["kind"] == "number") & (p["value"].try_cast("double") == float(v)))

    out = F.lit(False)
    for alternative in conjunctions(query):
        both = F.lit(True)
        for path, wanted in alternative:
            both = both & leaf(path, wanted)
        out = out | both
    return F.coalesce(out, F.lit(False))
