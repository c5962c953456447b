"""A versioned key-value table in files: atomic batches, ingest of sorted runs, snapshots, compaction that is verified.

A table is a folder of runs and a folder of numbered commits, each a small JSON file that lists the live
runs. Readers take the newest commit, so a write is seen whole or not at all, and two writers of one
number can't both win.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import versions
from quern.operators.compaction import CompactionMismatch, checksum, commit, committed
from quern.session import hadoop_fs
from quern.sources.files import write_run

SCHEMA = "key binary, ts bigint, value binary"
#: Limits of a key and a value in bytes.
MOST_KEY, MOST_VALUE = 1 << 14, 1 << 15


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def head(self) -> tuple[int, dict]:
        number, state = committed(self.spark, f"{self.path}/commits")
        return number, state or {"runs": [], "ts": 0}

    def _commit(self, number: int, state: dict) -> None:
        commit(self.spark, f"{self.path}/commits/{number:012d}.json", state)

    def _add(self, rows: DataFrame, number: int, state: dict, ts: int, rows_per_file: int = 0, tokens: dict | None = None) -> None:
        long = rows.filter((F.octet_length("key") > MOST_KEY) | (F.octet_length("value") > MOST_VALUE) | F.col("key").isNull())
        if not long.isEmpty():
            raise ValueError("a key is null or a key or value is too long")
        name = f"runs/{uuid.uuid4().hex}"
        write_run(rows.select("key", "ts", "value"), f"{self.path}/{name}", ["key"], rows_per_file=rows_per_file)
        self._commit(number + 1, {"runs": [*state["runs"], name], "ts": max(ts, state["ts"]), "added": [name], "tokens": tokens or state.get("tokens", {})})

    def write(self, changes: DataFrame) -> int:
        """A batch of (key, value), null values delete; all get one time, the next one, which is returned. Of several changes of a key the greatest value wins."""
        number, state = self.head()
        ts = state["ts"] + 1
        one = changes.groupBy("key").agg(F.max("value").alias("value"))
        self._add(one.withColumn("ts", F.lit(ts).cast("bigint")), number, state, ts)
        return ts

    def ingest(self, run: DataFrame, rows_per_file: int = 0, token: tuple[str, int] | None = None) -> None:
        """Adds records (key, ts, value) with times of their own, in files of at most `rows_per_file` if given.

        A `token` (source, number) is kept with the commit; one that isn't above its source's last adds nothing.
        """
        number, state = self.head()
        tokens = state.get("tokens", {})
        if token and tokens.get(token[0], -1) >= token[1]:
            return
        self._add(run, number, state, run.agg(F.max("ts")).first()[0] or 0, rows_per_file, tokens | ({token[0]: token[1]} if token else {}))

    def records(self) -> DataFrame:
        runs = self.head()[1]["runs"]
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{r}" for r in runs]) if runs else self.spark.createDataFrame([], SCHEMA)

    def get(self, key: bytes, at: int | None = None) -> bytes | None:
        row = versions.get(self.records(), ["key"], [bytearray(key)], at).first()
        return bytes(row["value"]) if row else None

    def scan(self, low: bytes | None = None, high: bytes | None = None, at: int | None = None) -> DataFrame:
        ends = (bytearray(x) if x is not None else None for x in (low, high))
        return versions.range_scan(self.records(), ["key"], *ends, at=at)

    def compact(self, policy: str | None = None, now: int = 0) -> dict:
        """One run in place of all, with the versions that the policy keeps (all, each once, without one).

        Before the commit the checksum of the inputs must be that of what was written and what was dropped. The
        commit keeps these sums for `verify`. Readers of the version before may still be at work: `vacuum`
        removes the runs that no commit from a number on names.
        """
        number, state = self.head()
        records = self.records()
        distinct = records.groupBy("key", "ts", "value").agg(F.count(F.lit(1)).alias("copies"))
        kept = versions.collect_garbage(records, ["key"], policy, now) if policy else distinct.select("key", "ts", "value")
        name = f"runs/{uuid.uuid4().hex}"
        write_run(kept, f"{self.path}/{name}", ["key"])
        content, total = checksum("key", "ts", "value"), lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)")
        again = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{name}")
        same = F.col("key").eqNullSafe(F.col("k")) & F.col("ts").eqNullSafe(F.col("t")) & F.col("value").eqNullSafe(F.col("v"))
        dropped = distinct.join(again.select(F.col("key").alias("k"), F.col("ts").alias("t"), F.col("value").alias("v")), same, "left_anti")
        read, wrote, gone = (df.agg(total(content), F.count(F.lit(1))).first() for df in (distinct, again, dropped))
        if read[0] != wrote[0] + gone[0] or read[1] != wrote[1] + gone[1]:
            raise CompactionMismatch(f"read {read}, wrote {wrote}, dropped {gone}")
        sums = {"read": str(read[0]), "wrote": str(wrote[0]), "dropped": str(gone[0])}
        self._commit(number + 1, {"runs": [name], "ts": state["ts"], "compacted": state["runs"], "added": [name], "sums": sums, "tokens": state.get("tokens", {})})
        return {"read": read[1], "kept": wrote[1], "dropped": gone[1]}

    def commits(self) -> list[dict]:
        """All commits in order, each with its number; small files that the driver reads."""
        number = self.head()[0]
        made = self.spark.read.text(f"{self.path}/commits/*.json", wholetext=True).select(F.col("_metadata.file_name").alias("f"), "value") if number else None
        return sorted(({"number": int(r["f"][:-5]), **json.loads(r["value"])} for r in made.collect()), key=lambda c: c["number"]) if number else []

    def verify(self) -> DataFrame:
        """(number, fault): what is wrong in the history of commits; no rows if nothing is.

        Numbers must follow each other, a commit must have the runs of the one before, less those it
        compacted and with those it added, a compaction's sums must add up, and a live
        run that a compaction made must still have the sum that was written.
        """
        faults, before, expected = [], {"number": 0, "runs": [], "ts": 0}, {}
        for c in self.commits():
            gone = c.get("compacted", [])
            if c["number"] != before["number"] + 1:
                faults.append((c["number"], "a number is missing before it"))
            if sorted(c["runs"]) != sorted([*(r for r in before["runs"] if r not in gone), *c["added"]]) or set(gone) - set(before["runs"]):
                faults.append((c["number"], "its runs aren't those before it with its changes"))
            if c["ts"] < before["ts"]:
                faults.append((c["number"], "its time goes back"))
            if "sums" in c:
                if int(c["sums"]["read"]) != int(c["sums"]["wrote"]) + int(c["sums"]["dropped"]):
                    faults.append((c["number"], "what it read isn't what it wrote and dropped"))
                expected[c["added"][0]] = int(c["sums"]["wrote"])
            before = c
        for run in [r for r in before["runs"] if r in expected]:
            held = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{run}").agg(F.coalesce(F.sum(checksum("key", "ts", "value")), F.lit(0)).cast("decimal(38,0)")).first()[0]
            if int(held) != expected[run]:
                faults.append((before["number"], f"{run} isn't what was written"))
        return self.spark.createDataFrame(faults, "number bigint, fault string")

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes the folders of runs that none of the last `keep` commits names; their names."""
        fs, path_of = hadoop_fs(self.spark, self.path)
        live = {r for c in self.commits()[-max(1, keep) :] for r in c["runs"]}
        folder = path_of(f"{self.path}/runs")
        found = [f"runs/{s.getPath().getName()}" for s in fs.listStatus(folder)] if fs.exists(folder) else []
        dead = sorted(set(found) - live)
        for run in dead:
            fs.delete(path_of(f"{self.path}/{run}"), True)
        return dead
