"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each counted once however often it occurs: its words, their first
four and six bytes, adjacent word pairs and pairs one word apart, hashed to 2**BITS
places. FTRL-proximal gives each coordinate its own rate and keeps its weight at zero
until its evidence passes L1, so the fitted weights are a short list: that list, never
more than the 2**BITS places there are, is what gets broadcast. Whole texts are scored.

Fitting reads a bounded sample: at most `sample_per_class` labelled texts of either
class, those with the smallest hash of their id; the intercept is then corrected for
the classes' shares in all labels.

Defined cases: null, empty or wordless texts have only the intercept; labels that are
null are ignored and repeated label rows are examples each; without examples of both
classes every score is the share of the class there is (0 without labels); every
document row gives one row, null and repeated ids too; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fold, load, utf8
from tidemark.llm.decontaminate import words_of

BITS = 22
SAMPLE_PER_CLASS = 4096
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 1.0
THRESHOLD = 0.7
KNOWN_WORDS = 400_000


class _Words(dict):
    """Rows of hashes (word, first four bytes, first six) by word; starts anew when full."""

    def __init__(self) -> None:
        super().__init__()
        self.table = np.zeros((3, 1024), dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n == self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
        h = xxhash.xxh64_intdigest
        self.table[:, n] = h(word, 1), h(word[:4], 2), h(word[:6], 3)
        self[word] = n
        return n


def features(words: list[bytes], known: _Words) -> np.ndarray:
    """Places of a text's features; repeats included."""
    if len(known) > KNOWN_WORDS:
        known.clear()
    rows = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
    w, four, six = known.table[:, rows]
    odd = np.uint64(0x9E3779B97F4A7C15)
    pairs, skips = (w[:-1] * odd) ^ w[1:], (w[:-2] * odd + odd) ^ w[2:]
    every = np.concatenate([w, four, six, pairs, skips]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (every >> np.uint64(64 - BITS)).astype(np.int32)


def fit(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and weights that are not zero, and the intercept."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    for _ in range(epochs):
        for places, y in examples:
            zi, ni = z[places], n[places]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + root) / ALPHA + L2))
            bias = -zb / ((BETA + math.sqrt(nb)) / ALPHA)
            g = _sigmoid(float(w.sum()) + bias) - y
            z[places] = zi + g - (np.sqrt(ni + g * g) - root) / ALPHA * w
            n[places] = ni + g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / ALPHA * bias
            nb += g * g
    some = np.flatnonzero(np.abs(z) > L1)
    return some, (np.sign(z[some]) * L1 - z[some]) / ((BETA + np.sqrt(n[some])) / ALPHA + L2), -zb / ((BETA + math.sqrt(nb)) / ALPHA)


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


class Model:
    def __init__(self, places: np.ndarray, weights: np.ndarray, intercept: float):
        self.places, self.weights, self.intercept = places.astype(np.int32), weights.astype(np.float32), intercept

    def scorer(self):
        dense, known = np.zeros(1 << BITS, dtype=np.float32), _Words()
        dense[self.places] = self.weights

        def score(text: bytes) -> float:
            words, total = words_of(text), self.intercept
            for lo in range(0, len(words), 1 << 16):  # long texts piece by piece, joined below
                f = features(words[max(0, lo - 2) : lo + (1 << 16)], known)
                part = f[dense[f] != 0]
                found = part if lo == 0 else np.concatenate([found, part])
            if words:
                total += float(dense[np.unique(found)].sum(dtype=np.float64))
            return _sigmoid(total)

        return score


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fits on docs(doc_id, text) and labels(doc_id, <label>)."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    shares = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(shares.values())
    if len(shares) < 2:
        p = shares.get(1, 0) / total if total else 0.0
        return Model(np.zeros(0), np.zeros(0), 50.0 if p else -50.0)
    order = F.xxhash64("doc_id", F.lit(label))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(order, "doc_id").limit(sample_per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), "y", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Words()
        for b in batches:
            made = [np.unique(features(words_of(t), seen)) for t in utf8(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.list_(pa.int32()))], names=["h", "y", "f"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for b in batches:
            y, f = b.column(1).to_pylist(), b.column(2)
            found += [(f[i].values.to_numpy(zero_copy_only=False), y[i]) for i in range(b.num_rows)]
        places, weights, intercept = fit(found) if found else (np.zeros(0, np.int64), np.zeros(0), 0.0)
        ones = sum(y for _, y in found)
        row = [places.astype(np.int32)], [weights], [intercept], [ones], [len(found) - ones]
        kinds = pa.list_(pa.int32()), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["places", "weights", "intercept", "ones", "zeros"])

    sample = rows.mapInArrow(extract, "h bigint, y int, f array<int>").orderBy("h", "y").limit(2 * sample_per_class)
    fitted = [r for r in sample.mapInArrow(learn, "places array<int>, weights array<double>, intercept double, ones bigint, zeros bigint").collect() if r.ones + r.zeros]
    if not fitted:
        return Model(np.zeros(0), np.zeros(0), math.log(shares[1] / shares[0]))
    best = fitted[0]
    shift = math.log(shares[1] / shares[0]) - math.log(max(best.ones, 1) / max(best.zeros, 1))
    return Model(np.array(best.places), np.array(best.weights), best.intercept + shift)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held.value.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of(t) for t in utf8(b.column(1))], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())]))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = train(docs, labels.where(~fold("doc_id", 3, 1)))
    scored = score(docs, model)
    return scored.select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
