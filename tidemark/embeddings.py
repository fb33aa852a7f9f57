"""Embedding adapters: anything that turns texts into vectors, on the driver or as a column."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder:
    def __init__(self, documents: Callable[[list[str]], Sequence], query: Callable[[str], Sequence] | None = None):
        self._documents, self._query = documents, query

    def documents(self, texts: list[str]) -> list[list[float]]:
        return [[float(x) for x in v] for v in self._documents(texts)]

    def query(self, text: str) -> list[float]:
        return [float(x) for x in (self._query(text) if self._query else self._documents([text])[0])]


def as_embedder(model: Any) -> Embedder:
    """A callable over a list of texts, or an object with embed_documents and embed_query, or
    with get_text_embedding_batch and get_query_embedding, or with encode."""
    if isinstance(model, Embedder):
        return model
    for documents, query in (("embed_documents", "embed_query"), ("get_text_embedding_batch", "get_query_embedding"), ("encode", None)):
        if hasattr(model, documents):
            return Embedder(getattr(model, documents), getattr(model, query, None) if query else None)
    if callable(model):
        return Embedder(model)
    raise TypeError("not an embedding: no known method, not callable")


def embed_column(model: Any, text: str | Column) -> Column:
    """The vectors of a text column, in Arrow batches; null texts have null vectors."""
    own = as_embedder(model)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            some = texts[texts.notna()]
            made = pd.Series(own.documents(some.tolist()) if len(some) else [], index=some.index, dtype=object)
            yield made.reindex(texts.index).map(lambda v: v if isinstance(v, list) else None)

    return run(F.col(text) if isinstance(text, str) else text)
