"""Sets of record ids, and postings of tags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import tags


def meeting_all(rows: DataFrame, key: str, conditions: Sequence[Column]) -> DataFrame:
    """(key): the keys for which each condition holds in some row, in one combining pass; a condition that is null doesn't hold, null keys have no row.

    Without conditions every key meets them.
    """
    met = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(F.coalesce(c, F.lit(False))).alias(f"__m{i}") for i, c in enumerate([F.lit(True), *conditions])])
    for i in range(len(conditions) + 1):
        met = met.filter(f"__m{i}")
    return met.select(key)


def intersect_ids(*sets: DataFrame) -> DataFrame:
    """Ids (one column of the same name) that are in every set, once; null is an id like any other."""
    out = sets[0]
    for s in sets[1:]:
        out = out.intersect(s)
    return out.distinct()


def union_ids(*sets: DataFrame) -> DataFrame:
    """Ids that are in any set, once."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.distinct()


def tag_index(rows: DataFrame, record: str, tag_set: str = "tags") -> DataFrame:
    """(posting, record): a row for each pair of each record's tag set; texts that aren't tag sets have none."""
    pairs = F.when(tags.parse(F.col(tag_set)).isNotNull(), tags.pairs(F.col(tag_set)))
    return rows.select(F.explode(pairs).alias("posting"), record).distinct()


def search_index(index: DataFrame, record: str, wanted: Mapping[str, str]) -> DataFrame:
    """(record): records that have all the wanted pairs, by their postings; written with `posting` in front, only those postings are read. At least one pair must be wanted."""
    if not wanted:
        raise ValueError("no tags are wanted")
    asked = [f"{k}={v}" for k, v in wanted.items()]
    hits = index.filter(F.col("posting").isin(asked))
    return hits.groupBy(record).agg(F.count_distinct("posting").alias("__n")).filter(F.col("__n") == len(asked)).select(record)
