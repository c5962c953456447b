"""Packing documents into containers of a fixed number of tokens.

The documents' sizes are counted in a histogram, which is all the driver sees: one count for each size
up to the capacity. Shallow combinations of sizes that fill a container to within a small window are
enumerated, their numbers of repeats are solved by non-negative least squares against the histogram and
rounded down to what the histogram holds, and what is left is packed greedily, first fit decreasing.
The plan is a table of segments (size, ranks, bins); each document finds its container by its rank
among the documents of its size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.binpack import Segment, first_fit_decreasing
from quern.operators.prefix import prefix_sums
from quern.session import materialize

#: A combination counts as filling a container that it leaves at most capacity / WINDOW tokens of.
WINDOW = 512
#: Combinations enumerated for each size, of two sizes with repeats and of three.
PAIRS, TRIPLES = 8, 16
ITERATIONS = 300
#: Plans of up to this many segments may be broadcast (about 10 MB).
MOST_SEGMENTS = 200_000

_PLAN = T.StructType([T.StructField(n, T.LongType()) for n in ("pack_id", "size", "first_rank", "per_bin", "first_bin", "bins")])


def combinations(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, int], ...]]:
    """Combinations ((size, times), ...) of at most three distinct sizes, in number proportional to the sizes that occur.

    For each size: the mirror size that completes it, alone or repeated, then two sizes to which a third
    completes it. Only sizes that occur often enough are used, commoner ones first.
    """
    slack = capacity // WINDOW
    support = np.flatnonzero(counts)
    support = support[support > 0]
    if not len(support):
        return []
    weight = counts[support]
    top = support[np.argsort(-weight, kind="stable")][:64]  # commonest partners
    found: dict[tuple[tuple[int, int], ...], None] = {}

    def completes(rest: int) -> int:
        """The commonest size within the window that fills `rest`."""
        lo, hi = max(1, rest - slack), rest
        if hi < 1:
            return 0
        here = counts[lo : hi + 1]
        return int(lo + here.argmax()) if here.max() > 0 else 0

    for a in map(int, support[::-1]):
        made = 0
        for times in dict.fromkeys((1, 2, 3, capacity // a, max(1, capacity // (2 * a)))):
            if times * a > capacity or times > counts[a]:
                continue
            rest = capacity - times * a
            if rest <= slack:
                found[((a, times),)] = None
                continue
            for parts in (1, 2, 4, 8, 16):
                b = completes(rest // parts) if rest % parts <= slack else 0
                if b and b != a and parts <= counts[b] and 0 <= rest - parts * b <= slack:
                    found[tuple(sorted(((a, times), (b, parts))))] = None
                    made += 1
            if made >= PAIRS:
                break
        made = 0
        for b in map(int, top):
            if b == a or made >= TRIPLES:
                continue
            for times in (1, 2, 4):
                c = completes(capacity - a - times * b)
                if c and c not in (a, b) and times <= counts[b]:
                    found[tuple(sorted(((a, 1), (b, times), (c, 1))))] = None
                    made += 1
    return list(found)


def solve(columns: list[tuple[tuple[int, int], ...]], counts: np.ndarray) -> np.ndarray:
    """Non-negative x with the least squares of (sum of x times its combination) - counts, scaled by 1 / sqrt(count), by accelerated projected gradients."""
    sizes = np.array([s for c in columns for s, _ in c])
    times = np.array([t for c in columns for _, t in c], float)
    col = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    scale = 1 / np.sqrt(np.maximum(counts, 1.0))
    rows, n = len(counts), len(columns)
    value = times * scale[sizes]
    norm = np.sqrt(np.bincount(col, value * value, n))  # columns of length one converge alike
    value = value / norm[col]
    goal = counts * scale
    forward = lambda x: np.bincount(sizes, value * x[col], rows)
    back = lambda r: np.bincount(col, value * r[sizes], n)
    v = np.ones(n)
    for _ in range(20):  # the largest eigenvalue, for the step
        v = back(forward(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(back(forward(v))))
    x, y, t = np.zeros(n), np.zeros(n), 1.0
    for _ in range(ITERATIONS):
        new = np.maximum(0, y - step * back(forward(y) - goal))
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / following * (new - x), new, following
    return x / norm


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Segment], int, int]:
    """(segments, containers, containers filled by combinations) for items of sizes 1..capacity."""
    have = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        have[s] = n
    left, used = have.copy(), np.zeros_like(have)
    segments: list[Segment] = []
    opened = 0
    columns = combinations(have.astype(float), capacity)
    if columns:
        x = solve(columns, have.astype(float))
        for k in np.argsort(-x, kind="stable"):
            repeats = min([int(x[k] + 0.5), *(int(left[s]) // t for s, t in columns[k])])
            if repeats < 1:
                continue
            for s, t in columns[k]:
                segments.append(Segment(s, int(used[s]), t, opened, repeats))
                used[s] += t * repeats
                left[s] -= t * repeats
            opened += repeats
    solved = opened
    rest = {int(s): int(left[s]) for s in np.flatnonzero(left)}
    more, extra = first_fit_decreasing(rest, capacity, opened, {s: int(used[s]) for s in rest})
    return segments + more, opened + extra, solved


def capacities(packs: DataFrame) -> dict[int, int]:
    """The packs of a table of a few rows; those without an id or a positive capacity don't count."""
    return {r["pack_id"]: int(r["capacity_tokens"]) for r in packs.filter("pack_id is not null and capacity_tokens > 0").orderBy("capacity_tokens").collect()}


def pieces(sizes: DataFrame, limits: dict[int, int]) -> DataFrame:
    """(pack_id, doc_id, piece, first_token, n_tokens): whole documents, and those above a capacity cut at its multiples.

    Documents without tokens have no row.
    """
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("pack_id"), F.lit(c).cast("bigint").alias("capacity")) for p, c in limits.items()]))
    rows = sizes.filter("n_tokens > 0").select("doc_id", "n_tokens", each.alias("__p")).select("doc_id", "n_tokens", "__p.*")
    last = F.floor((F.col("n_tokens") - 1) / F.col("capacity")).cast("int")
    cut = rows.select("pack_id", "capacity", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    first = F.col("piece").cast("bigint") * F.col("capacity")
    return cut.select("pack_id", "doc_id", "piece", first.alias("first_token"), F.least(F.col("capacity"), F.col("n_tokens") - first).alias("n_tokens"))


def pack(sizes: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_id, bin_id, doc_id, piece, first_token, n_tokens): every document (doc_id, n_tokens) in one container of each pack.

    Only documents larger than the capacity are cut. Documents of one size are ordered by a hash of
    (doc_id, piece), so the result is the same on every run; rows with one doc_id are packed each, in an
    order among themselves that doesn't matter as they are alike. The driver gets one count for each pack
    and size, at most the sum of the capacities; the plan that is broadcast has as many segments as a few
    times that. Full pieces need no plan: each is a container, like any item of the capacity's size.
    """
    spark = sizes.sparkSession
    limits = capacities(packs)
    if not limits:
        return spark.createDataFrame([], "pack_id int, bin_id bigint, doc_id bigint, piece int, first_token bigint, n_tokens bigint")
    cut = materialize(pieces(sizes, limits), "pieces")
    histogram = cut.groupBy("pack_id", "n_tokens").count().collect()
    segments = []
    for pack_id, capacity in limits.items():
        counts = {r["n_tokens"]: r["count"] for r in histogram if r["pack_id"] == pack_id}
        segments += [(pack_id, *map(int, s)) for s in plan(counts, capacity)[0]]
    table = spark.createDataFrame(pd.DataFrame(segments, columns=_PLAN.names) if segments else [], _PLAN)
    ranked = prefix_sums(cut, ["pack_id", "n_tokens"], ["doc_id", "piece"], out="rank")
    inside = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("per_bin") * F.col("bins"))
    keyed = table.withColumnsRenamed({"pack_id": "__pack", "size": "__size"})
    keyed = F.broadcast(keyed) if len(segments) <= MOST_SEGMENTS else keyed
    placed = ranked.join(keyed, (F.col("pack_id") == F.col("__pack")) & (F.col("n_tokens") == F.col("__size")) & inside)
    at = F.col("first_bin") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("per_bin")).cast("bigint")
    return placed.select("pack_id", at.alias("bin_id"), "doc_id", "piece", "first_token", "n_tokens")


def fill_report(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_id, capacity_tokens, bins, least_bins, tokens, fullest, fill): `fill` is the share of the containers' room that is used."""
    bins = packed.groupBy("pack_id", "bin_id").agg(F.sum("n_tokens").alias("t"))
    each = bins.groupBy("pack_id").agg(F.count(F.lit(1)).alias("bins"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    both = each.join(packs.groupBy("pack_id").agg(F.max("capacity_tokens").cast("bigint").alias("capacity_tokens")), "pack_id")
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens")).cast("bigint")
    return both.select("pack_id", "capacity_tokens", "bins", least.alias("least_bins"), "tokens", "fullest", (F.col("tokens") / (F.col("bins") * F.col("capacity_tokens"))).alias("fill"))
