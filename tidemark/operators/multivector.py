"""Late interaction: documents that are sets of token vectors, ranked by Chamfer similarity.

tokens(doc_id, tok, vector) hold unit vectors. A query is a few token vectors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.vectors import rounded
from tidemark.operators.knn import batch


def _best_products(tokens: DataFrame, query: Sequence[Sequence[float]]) -> DataFrame:
    """doc_id, q, s: the best product of each query token within each Arrow batch of a document."""
    q = np.array(query, dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not len(q):
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, q.shape[1]).astype(np.float64)
            docs, at = np.unique(b.column(0).to_numpy(), return_inverse=True)
            best = np.full((len(docs), len(q)), -np.inf)
            np.maximum.at(best, at, x @ q.T)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(docs, len(q))), pa.array(np.tile(np.arange(len(q), dtype=np.int32), len(docs))), pa.array(best.ravel())], names=["doc_id", "q", "s"])

    return tokens.select(F.col("doc_id").cast("bigint"), "vector").mapInArrow(run, T.StructType.fromDDL("doc_id bigint, q int, s double"))


def chamfer(tokens: DataFrame, query: Sequence[Sequence[float]]) -> DataFrame:
    """doc_id and score, the sum over query tokens of the best product; an empty query scores nothing."""
    best = _best_products(tokens, query).groupBy("doc_id", "q").agg(F.max("s").alias("s"))
    return best.groupBy("doc_id").agg(rounded(F.sum("s")).alias("score"))


def top_documents(tokens: DataFrame, query: Sequence[Sequence[float]], k: int) -> DataFrame:
    return chamfer(tokens, query).orderBy(F.desc("score"), "doc_id").limit(k)


def token_search(tokens: DataFrame, query: Sequence[Sequence[float]], k: int, shortlist: int | None = None) -> DataFrame:
    """The owners of each query token's nearest shortlist // |query| tokens, ranked by Chamfer."""
    if not query:
        return top_documents(tokens, query, k)
    spark, wanted = tokens.sparkSession, max(10 * k, 50) if shortlist is None else shortlist
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(query)], "qid bigint, vector array<double>")
    keyed = tokens.withColumn("id", F.xxhash64("doc_id", "tok"))
    near = batch(keyed, queries, max(1, wanted // len(query)))
    owners = keyed.join(near.select("id").distinct(), "id", "left_semi").select("doc_id").distinct()
    return top_documents(tokens.join(owners, "doc_id", "left_semi"), query, k)


class Encoder:
    """Fixed-dimensional encodings: hyperplanes cut the space into 2**bits buckets, `repeats`
    times; a query sums its tokens per bucket, a document averages them and fills an empty
    bucket from the occupied one with the nearest code. Deterministic by seed."""

    def __init__(self, dimensions: int, bits: int = 4, repeats: int = 8, seed: int = 7):
        self.planes = np.random.default_rng(seed).standard_normal((repeats, bits, dimensions))
        self.bits, self.repeats, self.width = bits, repeats, repeats * (1 << bits) * dimensions

    def buckets(self, tokens: np.ndarray) -> np.ndarray:
        """repeats x tokens codes."""
        side = np.einsum("rbd,td->rtb", self.planes, tokens) >= 0
        return side @ (1 << np.arange(self.bits))

    def encode(self, tokens: np.ndarray, document: bool) -> np.ndarray:
        codes, size = self.buckets(tokens), 1 << self.bits
        out = np.zeros((self.repeats, size, tokens.shape[1]))
        for r in range(self.repeats):
            np.add.at(out[r], codes[r], tokens)
            if document and len(tokens):
                counts = np.bincount(codes[r], minlength=size)
                full = np.flatnonzero(counts)
                out[r, full] /= counts[full][:, None]
                empty = np.flatnonzero(counts == 0)
                gaps = np.bitwise_count((empty[:, None] ^ full[None, :]).astype(np.uint64))
                out[r, empty] = out[r, full[gaps.argmin(1)]]
        return out.ravel()


def encode_documents(tokens: DataFrame, encoder: Encoder) -> DataFrame:
    """id (of the document) and vector."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x = np.array(table.column("vector").to_pylist(), dtype=np.float64)
        return pa.table({"id": pa.array([key[0].as_py()], pa.int64()), "vector": pa.array([encoder.encode(x, True)], pa.list_(pa.float64()))})

    return tokens.select(F.col("doc_id").cast("bigint").alias("doc_id"), "vector").groupBy("doc_id").applyInArrow(run, "id bigint, vector array<double>")


def encoded_search(tokens: DataFrame, query: Sequence[Sequence[float]], k: int, encoder: Encoder, shortlist: int | None = None) -> DataFrame:
    """The documents whose encodings have the largest product with the query's, ranked by Chamfer."""
    wanted = max(10 * k, 50) if shortlist is None else shortlist
    q = encoder.encode(np.array(query, dtype=np.float64), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(q))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x @ q)], names=["doc_id", "s"])

    near = encode_documents(tokens, encoder).mapInArrow(run, "doc_id bigint, s double").orderBy(F.desc("s"), "doc_id").limit(wanted)
    return top_documents(tokens.join(near.select("doc_id"), "doc_id", "left_semi"), query, k)
