"""Quality by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled texts of quality 1; the unlabelled set is the web text
itself, whatever its labels. A text is described by shares that junk distorts (capitals,
symbols, digits, repeated neighbours, distinct words for its length, ...), each cut into
fixed bins. The additive model on these bins minimises

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))

with logistic losses, so its output is the log odds of being positive. The class prior
is estimated from the same two samples, without negative labels: it is the least ratio,
over score thresholds, of the unlabelled share above to the positive share above (the
mixture-proportion bound), after a first fit at one half.

Fitting reads at most `sample` rows of either kind, those with the smallest hash of
their id. Only their bins (some tens of numbers a row) reach the driver.

Defined cases: null and empty texts are texts without words; without positives or
without texts every score is 0.5; null labels are ignored; every document row gives one
row, null and repeated ids too; other columns pass `keep` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fold, giving, load, utf8

SAMPLE = 8192
THRESHOLD = 0.7
STEPS, RATE, DECAY = 600, 0.05, 1e-3

_CUTS = [
    np.array([0.02, 0.2, 0.4]),  # capitals beyond one a word, among bytes
    np.array([0.02, 0.05, 0.1, 0.2]),  # symbols among bytes
    np.array([0.1, 0.3]),  # digits among bytes
    np.array([0.08, 0.3]),  # words equal to the one before
    np.array([2.0, 10.0, 30.0]),  # bytes a word
    np.array([0.25, 0.6]),  # lines met before in the text
    np.array([0.2, 0.5]),  # one-byte words
    np.arange(1.0, 18.0),  # distinct words for the length: see describe
]
_SIZES = [len(c) + 1 for c in _CUTS]
_OFFSETS = np.cumsum([0, *_SIZES])
DIMENSIONS = int(_OFFSETS[-1])
_UPPER, _DIGIT, _SYMBOL = (np.isin(np.arange(256), list(s)) for s in (range(65, 91), range(48, 58), b"!#$%&*+/<=>?@\\^_`{|}~[]"))


def describe(text: bytes) -> list[int]:
    """The bin of each description of a text."""
    raw = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    words, n = text.split(), max(1, len(text))
    m = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct = len(set(words)) / m
    length = min(2, int(np.log2(m) / 5))  # below 32, below 1024, more
    values = [
        max(0, raw[_UPPER].sum() - m) / n,
        raw[_SYMBOL].sum() / n,
        raw[_DIGIT].sum() / n,
        sum(map(eq, words, words[1:])) / m,
        sum(map(len, words)) / m,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(len(w) == 1 for w in words) / m,
        6 * length + min(5, int(distinct * 10)),
    ]
    return [int(o + np.searchsorted(c, v, side="right" if i == 7 else "left")) for i, (o, c, v) in enumerate(zip(_OFFSETS, _CUTS, values, strict=False))]


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> np.ndarray:
    """Weights (the last is the intercept) of least non-negative PU risk. Rows are bins."""
    w, m, v = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def gradient(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
        g = np.bincount(rows.ravel(), np.repeat(by, rows.shape[1]), minlength=DIMENSIONS + 1)[: DIMENSIONS + 1]
        g[-1] = by.sum()
        return g / len(rows)

    for step in range(1, steps + 1):
        fp, fu = (w[x].sum(1) + w[-1] for x in (positive, unlabelled))
        pp, pu = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        g_neg = gradient(unlabelled, pu) - prior * gradient(positive, pp)
        g = (gradient(positive, pp - 1) * prior + g_neg if negative >= 0 else -g_neg) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least_share: float = 0.5) -> float:
    """The least ratio of shares above a threshold, with a margin for the samples' size."""
    cuts = np.unique(positive)
    p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    margin = np.sqrt(0.25 / len(unlabelled)) / 2
    some = p >= least_share
    return float(np.clip(((u[some] + margin) / p[some]).min(), 0.01, 0.99))


def train(docs: DataFrame, positives: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """docs(doc_id, text) are the unlabelled texts, positives(doc_id) the trusted ids among them."""

    def picked(ids: DataFrame, salt: str) -> DataFrame:
        return ids.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(sample).distinct()

    def bins(ids: DataFrame) -> np.ndarray:
        rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([describe(t) for t in utf8(b.column(1))], pa.list_(pa.int32()))], names=["h", "bins"])

        return np.array([r.bins for r in rows.mapInArrow(giving(run), "h bigint, bins array<int>").orderBy("h").limit(sample).collect()], dtype=np.int64)

    positive, unlabelled = bins(picked(positives, "p")), bins(picked(docs, "u"))
    if not len(positive) or not len(unlabelled):
        return None
    first = minimise(positive, unlabelled, 0.5)
    prior = estimate_prior(first[positive].sum(1), first[unlabelled].sum(1))
    return minimise(positive, unlabelled, prior)


def _scores(texts: list[bytes], weights: np.ndarray | None) -> np.ndarray:
    if weights is None or not texts:
        return np.full(len(texts), 0.5)
    f = weights[np.array([describe(t) for t in texts])].sum(1) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(f, -35, 35)))


def score(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """doc_id and score (0 to 1) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(utf8(b.column(1)), weights), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(giving(run), T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())]))


def keep(docs: DataFrame, weights: np.ndarray | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score `threshold` or more (all without a model)."""
    if weights is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_scores(utf8(b.column(b.schema.get_field_index("text"))), weights) >= threshold))

    return docs.mapInArrow(giving(run), docs.schema)


def model_for(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """Fits on the rows outside the held-out fold (crc32 of the id mod 4 is 2)."""
    positives = labels.where((F.col("quality") == 1) & ~fold("doc_id", 4, 2))
    return train(docs.where(~fold("doc_id", 4, 2)), positives, sample)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    weights = model_for(docs, load(spark, sf_dir, "labels"))
    scored = score(docs, weights)
    return scored.select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
