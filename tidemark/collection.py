"""Collections: named records with vectors, metadata and documents, readable at any snapshot."""

from __future__ import annotations

import asyncio
import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.embeddings import as_embedder
from tidemark.functions.filters import json_field, where
from tidemark.functions.ids import stable_id
from tidemark.operators import knn
from tidemark.operators.versions import DELETE, UPSERT, value_as_of
from tidemark.sources.store import META, ChangeLog, Files

_NAME = re.compile(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$")
_ROW = "seq bigint, op string, id bigint, name string, vector array<float>, metadata string, document string"


@dataclass
class Record:
    id: str | int
    metadata: dict = field(default_factory=dict)
    document: str | None = None
    distance: float | None = None


class Collection:
    """A change log with names, metadata and documents. Metadata-only updates tick the clock
    too, so a snapshot taken before does not see them."""

    def __init__(self, spark: SparkSession, path: str, dimensions: int | None = None, metric: str = "cosine", embedding: Any = None, overfetch: int = 8):
        self.spark, self.log, self.overfetch = spark, ChangeLog(spark, path, dimensions, metric), max(1, overfetch)
        self.embedder = as_embedder(embedding) if embedding is not None else None

    # --- state

    def snapshot(self) -> int:
        return self.log.clock()

    def rows(self, snapshot: int | None = None) -> DataFrame:
        """id, name, vector, metadata, document of the live records: a vector's own version,
        and the metadata and document in force then."""
        t = self.snapshot() if snapshot is None else snapshot
        live = self.log.live(t).select("id", "name", "vector", F.col("ts").alias("_ts"))
        history = self.log.changes().where(F.col("op") != DELETE).select("id", F.col("ts").alias("stamp"), "seq", "metadata", "document")
        return live.join(value_as_of(history, t, ["metadata", "document"]), "id", "left")

    def count(self, snapshot: int | None = None) -> int:
        return self.log.live(self.snapshot() if snapshot is None else snapshot).count()

    __len__ = count

    def __contains__(self, id: str | int) -> bool:
        return not self.log.live().where(F.col("id") == stable_id(id)).isEmpty()

    # --- writes

    def _known(self, keys: list[int]) -> dict[int, tuple]:
        wanted = self.spark.createDataFrame([(k,) for k in keys], "id bigint")
        return {r.id: (r.vector, r.metadata, r.document) for r in self.rows().join(wanted, "id", "left_semi").collect()}

    def add(self, ids: Sequence, embeddings: Sequence | None = None, documents: Sequence | None = None, metadatas: Sequence | None = None) -> int:
        """Inserts or replaces; omitted metadata and documents are carried forward. One commit."""
        ids = list(ids)
        keys = [stable_id(i) for i in ids]
        if len(set(keys)) != len(keys):
            raise ValueError("an id is given twice")
        if embeddings is None:
            if documents is None or self.embedder is None:
                raise ValueError("embeddings are needed, or documents and an embedding")
            embeddings = self.embedder.documents(list(documents))
        for what in (embeddings, documents, metadatas):
            if what is not None and len(what) != len(ids):
                raise ValueError("ids and values differ in number")
        for m in metadatas or ():
            if m is not None and not isinstance(m, Mapping):
                raise TypeError("metadata is a mapping")
        if not ids:
            return self.snapshot()
        known = self._known(keys) if documents is None or metadatas is None or None in documents or None in metadatas else {}
        rows = []
        for n, (i, k) in enumerate(zip(ids, keys, strict=True)):
            _, old_m, old_d = known.get(k, (None, None, None))
            m = json.dumps(metadatas[n]) if metadatas is not None and metadatas[n] is not None else old_m
            d = documents[n] if documents is not None and documents[n] is not None else old_d
            rows.append((n, UPSERT, k, json.dumps(i), [float(x) for x in embeddings[n]], m, d))
        return self.log.append(self.spark.createDataFrame(rows, _ROW)).ts

    upsert = add

    def append(self, rows: DataFrame, batch_id: int | None = None) -> int:
        """One commit of a whole DataFrame: op, id, vector and, where there are, name, seq, label, metadata, document."""
        return self.log.append(rows, batch_id=batch_id).ts

    def update(self, ids: Sequence, embeddings: Sequence | None = None, documents: Sequence | None = None, metadatas: Sequence | None = None) -> int:
        """Changes known records: metadata keys are merged, what is omitted stays."""
        keys = [stable_id(i) for i in ids]
        known = self._known(keys)
        if missing := [i for i, k in zip(ids, keys, strict=True) if k not in known]:
            raise KeyError(missing[0])
        rows = []
        for n, (i, k) in enumerate(zip(ids, keys, strict=True)):
            _, old_m, old_d = known[k]
            m = json.dumps((json.loads(old_m) if old_m else {}) | dict(metadatas[n])) if metadatas is not None and metadatas[n] is not None else old_m
            d = documents[n] if documents is not None and documents[n] is not None else old_d
            v = [float(x) for x in embeddings[n]] if embeddings is not None else None
            rows.append((n, UPSERT if v else META, k, json.dumps(i), v, m, d))
        return self.log.append(self.spark.createDataFrame(rows, _ROW)).ts

    def delete(self, ids: Sequence | None = None, where_: Mapping | None = None) -> int:
        """Deletes live records by id, by filter, or by both; returns how many."""
        if ids is None and not where_:
            raise ValueError("ids or a filter are needed")
        rows = self.rows().where(where(where_, json_field("metadata")))
        if ids is not None:
            wanted = self.spark.createDataFrame([(stable_id(i),) for i in ids], "id bigint")
            rows = rows.join(wanted, "id", "left_semi")
        gone = rows.select(F.lit(DELETE).alias("op"), "id", "name")
        if gone.isEmpty():
            return 0
        return self.log.append(gone).deletes

    # --- reads

    def query(self, vector: Sequence[float] | None = None, k: int = 10, where_: Mapping | None = None, snapshot: int | None = None, text: str | None = None, exact: bool = True) -> list[Record]:
        """The k nearest records; with a filter the nearest of those that match, or with
        exact=False the matches among the k * overfetch nearest."""
        if isinstance(vector, str):
            vector, text = None, vector
        if vector is None:
            if text is None or self.embedder is None:
                raise ValueError("a vector is needed, or a text and an embedding")
            vector = self.embedder.query(text)
        if len(vector) != self.log.dimensions:
            raise ValueError(f"the query has {len(vector)} dimensions, not {self.log.dimensions}")
        rows, keep = self.rows(snapshot), where(where_, json_field("metadata"))
        found = knn.exact(rows, vector, k, self.log.metric, keep) if exact or not where_ else knn.over_fetched(rows, vector, k, keep, self.log.metric, self.overfetch)
        return [self._record(r, r.distance) for r in found.orderBy("distance", "id").collect()]

    def query_many(self, queries: DataFrame, k: int = 10, where_: Mapping | None = None, snapshot: int | None = None) -> DataFrame:
        """qid, id, distance, rank for queries(qid, vector)."""
        return knn.batch(self.rows(snapshot).where(where(where_, json_field("metadata"))), queries, k, self.log.metric)

    def get(self, ids: Sequence | None = None, where_: Mapping | None = None, limit: int | None = None, snapshot: int | None = None) -> list[Record]:
        """Records by id and filter, first written first."""
        rows = self.rows(snapshot).where(where(where_, json_field("metadata")))
        if ids is not None:
            rows = rows.join(self.spark.createDataFrame([(stable_id(i),) for i in ids], "id bigint"), "id", "left_semi")
        rows = rows.orderBy("_ts", "id")
        return [self._record(r) for r in (rows if limit is None else rows.limit(limit)).collect()]

    def peek(self, limit: int = 10) -> list[Record]:
        return self.get(limit=limit)

    def _record(self, r, distance: float | None = None) -> Record:
        return Record(json.loads(r.name) if r.name else r.id, json.loads(r.metadata) if r.metadata else {}, r.document, distance)

    def vacuum(self, keep_snapshot: int | None = None, budget: int = 0) -> int:
        return self.log.vacuum(self.snapshot() if keep_snapshot is None else keep_snapshot, budget)


class AsyncCollection:
    """The same calls as coroutines, each in a thread."""

    def __init__(self, collection: Collection):
        self._inner = collection

    def __getattr__(self, name: str):
        call = getattr(self._inner, name)

        async def run(*args, **kwargs):
            return await asyncio.to_thread(call, *args, **kwargs)

        return run


class Client:
    """A folder of collections."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def _path(self, name: str) -> str:
        if not _NAME.match(name):
            raise ValueError(f"{name!r} is no collection name")
        return f"{self.root}/{name}"

    def create(self, name: str, dimensions: int, metric: str = "cosine", exist_ok: bool = False, **options: Any) -> Collection:
        path = self._path(name)
        if self.files.exists(f"{name}/_config.json") and not exist_ok:
            raise ValueError(f"{name} exists")
        return Collection(self.spark, path, dimensions, metric, **options)

    def get(self, name: str, **options: Any) -> Collection:
        path = self._path(name)
        if not self.files.exists(f"{name}/_config.json"):
            raise KeyError(name)
        return Collection(self.spark, path, **options)

    def get_or_create(self, name: str, dimensions: int, metric: str = "cosine", **options: Any) -> Collection:
        return self.create(name, dimensions, metric, exist_ok=True, **options)

    def list(self) -> list[str]:
        return [n for n in self.files.names("") if self.files.exists(f"{n}/_config.json")]

    def delete(self, name: str) -> None:
        self._path(name)
        if not self.files.exists(f"{name}/_config.json"):
            raise KeyError(name)
        self.files.delete(name)

    def reset(self) -> None:
        for name in self.list():
            self.delete(name)
