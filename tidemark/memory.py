"""Agent memory: records with branches that can be tried, compared, merged or discarded.

Main is a change log; a branch is a log of its own under branches/<name> and the main
snapshot it forked from. Reads of a branch are main at the fork, without the touched ids,
and the branch's own live rows.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ids import stable_id
from tidemark.operators import branches, knn
from tidemark.operators.versions import DELETE, UPSERT
from tidemark.sources.store import ChangeLog, Files

MAIN = "main"


class Memory:
    def __init__(self, spark: SparkSession, root: str, dimensions: int | None = None, metric: str = "cosine", strategy: str = branches.LAST_WRITER):
        self.spark, self.root, self.strategy = spark, root.rstrip("/"), strategy
        self.main, self.files = ChangeLog(spark, f"{self.root}/main", dimensions, metric), Files(spark, root)

    def snapshot(self) -> int:
        return self.main.clock()

    def branch(self, name: str, snapshot: int | None = None) -> Branch:
        """Opens a branch at a snapshot of main (now, if none is given)."""
        clock = self.snapshot()
        base = clock if snapshot is None else snapshot
        if name == MAIN or self.files.exists(f"branches/{name}/_branch.json"):
            raise ValueError(f"a branch named {name} exists")
        if not 0 <= base <= clock:
            raise ValueError(f"snapshot {base} is not between 0 and the clock {clock}")
        self.files.write(f"branches/{name}/_branch.json", json.dumps({"base": base}))
        return Branch(self, name)

    def open(self, name: str) -> Branch:
        """The branch if it is open, else a new one: reattaching is harmless."""
        return Branch(self, name) if self.files.exists(f"branches/{name}/_branch.json") else self.branch(name)

    def branches(self) -> dict[str, int]:
        names = [n for n in self.files.names("branches") if self.files.exists(f"branches/{n}/_branch.json")]
        return {n: json.loads(self.files.read(f"branches/{n}/_branch.json"))["base"] for n in names}

    def rows(self, snapshot: int | None = None) -> DataFrame:
        return self.main.live(snapshot).select("id", "name", "vector", F.col("metadata").alias("payload"))

    def add(self, id: str | int, vector: Sequence[float], payload: Mapping[str, Any] | None = None) -> int:
        return self.main.append(_upsert(self.spark, [(id, vector, payload)], 0)).ts

    def add_many(self, rows: Sequence[tuple[str | int, Sequence[float], Mapping[str, Any] | None]]) -> int:
        """(id, vector, payload) rows in one commit."""
        return self.main.append(_upsert(self.spark, list(rows), 0)).ts

    def delete(self, id: str | int) -> int:
        if self.rows().where(F.col("id") == stable_id(id)).isEmpty():
            raise KeyError(id)
        return self.main.append(_delete(self.spark, id, 0)).ts

    def search(self, vector: Sequence[float], k: int = 10, snapshot: int | None = None) -> DataFrame:
        return knn.exact(self.rows(snapshot), vector, k, self.main.metric)

    def purge(self, horizon: int) -> int:
        """Reclaims history before the horizon, which no open branch may still need."""
        needed = min(self.branches().values(), default=horizon)
        if horizon > needed + 1:
            raise ValueError(f"an open branch needs snapshot {needed}")
        return self.main.vacuum(horizon)


class Branch:
    """One branch. As a context it is discarded at the end unless keep() was called."""

    def __init__(self, memory: Memory, name: str):
        self.memory, self.name, self._keep = memory, name, False
        self.base: int = json.loads(memory.files.read(f"branches/{name}/_branch.json"))["base"]
        self.log = ChangeLog(memory.spark, f"{memory.root}/branches/{name}", memory.main.dimensions, memory.main.metric)

    def __enter__(self) -> Branch:
        return self

    def __exit__(self, *_: object) -> None:
        if not self._keep and self.name in self.memory.branches():
            self.discard()

    def keep(self) -> None:
        self._keep = True

    def delta(self) -> DataFrame:
        """The branch's changes; their commit is their order."""
        return self.log.changes().select("id", (F.col("ts") * 1_000_000 + F.col("seq")).alias("seq"), "op", "name", "vector", F.col("metadata").alias("payload"))

    def add(self, id: str | int, vector: Sequence[float], payload: Mapping[str, Any] | None = None) -> int:
        return self.log.append(_upsert(self.memory.spark, [(id, vector, payload)], 0)).ts

    def add_many(self, rows: Sequence[tuple[str | int, Sequence[float], Mapping[str, Any] | None]]) -> int:
        return self.log.append(_upsert(self.memory.spark, list(rows), 0)).ts

    def delete(self, id: str | int) -> int:
        if self.rows().where(F.col("id") == stable_id(id)).isEmpty():
            raise KeyError(id)
        return self.log.append(_delete(self.memory.spark, id, 0)).ts

    def rows(self) -> DataFrame:
        return branches.overlay(self.memory.rows(self.base), self.delta())

    def search(self, vector: Sequence[float], k: int = 10) -> DataFrame:
        return knn.exact(self.rows(), vector, k, self.log.metric)

    def as_of_fork(self, vector: Sequence[float], k: int = 10) -> DataFrame:
        return self.memory.search(vector, k, self.base)

    def diff(self) -> DataFrame:
        return branches.diff(self.delta())

    def conflicts(self) -> DataFrame:
        return branches.conflicts(self.memory.main.changes(), self.delta(), self.base)

    def merge(self, strategy: str | None = None) -> int:
        """One commit to main of the net changes; returns how many. The branch ends."""
        main = self.memory.main.changes().select("id", "ts", "seq", "op")
        rows = branches.promoted(main, self.delta(), self.base, 0, strategy or self.memory.strategy)
        shaped = rows.select("op", "id", "name", "vector", F.col("payload").alias("metadata"))
        done = 0 if shaped.isEmpty() else sum((c := self.memory.main.append(shaped)) and (c.upserts, c.deletes))
        self.memory.files.delete(f"branches/{self.name}")
        return done

    def discard(self) -> int:
        self.memory.files.delete(f"branches/{self.name}")
        return 0


def _upsert(spark: SparkSession, rows: list[tuple], seq: int) -> DataFrame:
    made = [(seq, UPSERT, stable_id(i), json.dumps(i), [float(x) for x in v], json.dumps(dict(p or {}))) for i, v, p in rows]
    return spark.createDataFrame(made, "seq bigint, op string, id bigint, name string, vector array<float>, metadata string")


def _delete(spark: SparkSession, id: str | int, seq: int) -> DataFrame:
    return spark.createDataFrame([(seq, DELETE, stable_id(id), json.dumps(id))], "seq bigint, op string, id bigint, name string")
