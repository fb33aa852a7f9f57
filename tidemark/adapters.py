"""Texts over an agent memory, in the shape that chains and agents expect of a vector store.

Nothing is imported from those libraries: any embedding that embeddings.as_embedder takes
will do, and their wrappers can call these methods.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from tidemark.embeddings import as_embedder
from tidemark.functions.ids import stable_id
from tidemark.memory import Branch, Memory


@dataclass
class Found:
    id: str
    text: str
    metadata: dict = field(default_factory=dict)
    distance: float = 0.0

    @property
    def similarity(self) -> float:
        return 1 - self.distance


class TextStore:
    def __init__(self, memory: Memory, embedding: Any):
        self.memory, self.embedder = memory, as_embedder(embedding)

    def add_texts(self, texts: Iterable[str], metadatas: Sequence[Mapping] | None = None, ids: Sequence[str] | None = None, branch: Branch | None = None) -> list[str]:
        """Writes texts to main or a branch in one commit; ids default to one made of the text."""
        texts = list(texts)
        for what in (metadatas, ids):
            if what is not None and len(what) != len(texts):
                raise ValueError("texts and values differ in number")
        if not texts:
            return []
        named = list(ids) if ids else [f"doc-{stable_id(t):x}" for t in texts]
        payloads = [dict(m or {}) | {"text": t} for m, t in zip(metadatas or [{}] * len(texts), texts, strict=True)]
        (branch or self.memory).add_many(list(zip(named, self.embedder.documents(texts), payloads, strict=True)))
        return named

    def delete(self, ids: Iterable[str], branch: Branch | None = None) -> int:
        """How many of the ids were there."""
        gone = 0
        for i in ids:
            try:
                (branch or self.memory).delete(i)
            except KeyError:
                continue
            gone += 1
        return gone

    def similarity_search(self, query: str, k: int = 4, branch: Branch | None = None, as_of: int | None = None) -> list[Found]:
        vector = self.embedder.query(query)
        if branch is None:
            return _found(self.memory.search(vector, k, as_of))
        if as_of is not None:
            raise ValueError("a branch is read as it is; as_of is for main")
        return _found(branch.search(vector, k))

    def thread(self, thread_id: str) -> Branch:
        """The branch of a conversation, opened on first use and found again later."""
        return self.memory.open(f"thread-{stable_id(thread_id):x}")


def _found(rows: DataFrame) -> list[Found]:
    out = []
    for r in rows.orderBy("distance", "id").collect():
        payload = json.loads(r.payload) if r.payload else {}
        out.append(Found(json.loads(r.name) if r.name else str(r.id), payload.pop("text", ""), payload, r.distance))
    return out
