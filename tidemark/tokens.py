"""Documents as sets of token vectors, versioned: each document is written in one commit."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ids import stable_id
from tidemark.operators import multivector
from tidemark.operators.versions import DELETE, UPSERT
from tidemark.sources.store import ChangeLog

_ROW = "op string, id bigint, vector array<float>, label bigint"


class TokenIndex:
    """A change log of unit token vectors; a row's label is its document."""

    def __init__(self, spark: SparkSession, path: str, dimensions: int | None = None):
        self.spark, self.log = spark, ChangeLog(spark, path, dimensions)

    def tokens(self, snapshot: int | None = None) -> DataFrame:
        return self.log.live(snapshot).select(F.col("label").alias("doc_id"), F.col("id").alias("tok"), "vector")

    def add(self, doc_id: int, vectors: Sequence[Sequence[float]]) -> int:
        """Inserts or replaces a document: its tokens and the deletes of surplus old ones are one commit."""
        x = np.asarray(vectors, dtype=np.float64)
        if x.ndim != 2 or x.shape[1] != self.log.dimensions or not len(x):
            raise ValueError(f"a document is one or more vectors of {self.log.dimensions} dimensions")
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
        fresh = {stable_id(f"{doc_id}/{n}"): row.tolist() for n, row in enumerate(x)}
        surplus = [r.tok for r in self.tokens().where(F.col("doc_id") == doc_id).select("tok").collect() if r.tok not in fresh]
        rows = [(UPSERT, i, v, doc_id) for i, v in fresh.items()] + [(DELETE, i, None, doc_id) for i in surplus]
        return self.log.append(self.spark.createDataFrame(rows, _ROW)).ts

    def append(self, tokens: DataFrame) -> int:
        """tokens(doc_id, tok, vector) of new documents, in one commit."""
        key = F.xxhash64("doc_id", "tok")
        return self.log.append(tokens.select(F.lit(UPSERT).alias("op"), key.alias("id"), "vector", F.col("doc_id").alias("label"))).ts

    def delete(self, doc_id: int) -> int:
        """Deletes all tokens of a document in one commit; returns how many there were."""
        gone = self.tokens().where(F.col("doc_id") == doc_id).select(F.lit(DELETE).alias("op"), F.col("tok").alias("id"), F.col("doc_id").alias("label"))
        if gone.isEmpty():
            raise KeyError(doc_id)
        return self.log.append(gone).deletes

    def search(self, query: Sequence[Sequence[float]], k: int = 10, snapshot: int | None = None, encoder: multivector.Encoder | None = None, shortlist: int | None = None) -> DataFrame:
        """doc_id and score of the k best: shortlisted by tokens, or by encodings with an encoder."""
        rows = self.tokens(snapshot)
        if encoder is None:
            return multivector.token_search(rows, query, k, shortlist)
        return multivector.encoded_search(rows, query, k, encoder, shortlist)
