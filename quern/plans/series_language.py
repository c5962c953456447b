"""The series language: counters, aggregate, rollup, uniform, time and pointwise functions, nested freely.

    aggregate(maximum, rollup(mean, counters(requests, :host=a:), 5m))
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import calendar, math
from quern.operators import series
from quern.operators.series import Params

_TOKEN = re.compile(r"\s*(?:(?P<tags>:[^,()\s]*=[^,()\s]*:)|(?P<dur>[+-]?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?[smhd](?![\w.:-]))|(?P<name>[A-Za-z_.:-][\w.:-]*)|(?P<mark>[(),]))")
_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


class QueryError(ValueError):
    """The text isn't a query."""


@dataclass(frozen=True)
class Select:
    names: tuple[str, ...]
    kind: str = "counter"


@dataclass(frozen=True)
class Call:
    """`what` is aggregate, rollup, uniform or pointwise; `how` the function; `lookback` in microseconds for a rollup."""

    what: str
    how: str
    of: Select | Call | OfTime
    lookback: int = 0


@dataclass(frozen=True)
class OfTime:
    how: str


_HOW = {"aggregate": {*series.ACROSS, "median"}, "rollup": set(series.ROLLUPS), "uniform": set(series.UNIFORMS)}
#: Selectors; the last two are additions, for data whose samples tell their kind.
_KINDS = {"counters": "counter", "gauges": "gauge", "histograms": "histogram"}


def parse(text: str) -> Select | Call | OfTime:
    tokens, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"can't read at {at}: {text[at : at + 20]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    i = 0

    def take(kind: str, value: str | None = None) -> str:
        nonlocal i
        k, v = tokens[i]
        if k != kind or (value is not None and v != value):
            raise QueryError(f"expected {value or kind}, found {v or 'the end'}")
        i += 1
        return v

    def expression() -> Select | Call | OfTime:
        nonlocal i
        word = take("name")
        take("mark", "(")
        if word in _KINDS:
            names = []
            while True:
                kind, value = tokens[i]
                if kind not in ("name", "tags"):
                    raise QueryError(f"expected a name or tags, found {value or 'the end'}")
                i += 1
                names.append(value)
                if tokens[i] != ("mark", ","):
                    break
                i += 1
            out = Select(tuple(names), _KINDS[word])
        elif word == "time":
            how = take("name")
            if how not in calendar.OF_TIME:
                raise QueryError(f"no function of time: {how}")
            out = OfTime(how)
        elif word in _HOW:
            how = take("name")
            if how not in _HOW[word]:
                raise QueryError(f"{word} has no {how}")
            take("mark", ",")
            inner = expression()
            back = 0
            if word == "rollup":
                take("mark", ",")
                duration = take("dur")
                back = round(float(duration[:-1]) * _UNITS[duration[-1]] * series.MICROS)
            out = Call(word, how, inner, back)
        elif word in math.POINTWISE:
            out = Call("pointwise", word, expression())
        else:
            raise QueryError(f"no function: {word}")
        take("mark", ")")
        return out

    root = expression()
    take("end")
    return root


def compile_query(query: str | Select | Call | OfTime, samples: DataFrame, params: Params) -> DataFrame:
    """The plan of a query over samples (tags, ts, value and, for selection by kind, kind)."""
    node = parse(query) if isinstance(query, str) else query
    if isinstance(node, OfTime):
        return series.function_of_time(samples.sparkSession, node.how, params)
    if isinstance(node, Select):
        own = samples.filter(F.col("kind") == node.kind) if "kind" in samples.columns else samples
        return series.union(*[series.resample(series.select(own, name), params) for name in node.names])
    if node.what == "rollup":
        wide = params.back(node.lookback)
        return series.rollup(compile_query(node.of, samples, wide), node.how, node.lookback // params.step)
    inner = compile_query(node.of, samples, params)
    if node.what == "aggregate":
        return series.aggregate(inner, node.how)
    if node.what == "uniform":
        return series.uniform(inner, node.how)
    return series.pointwise(inner, node.how)
