import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, toxicity
from tidemark.llm.common import fold, load
from tidemark.llm.quality import op6_quality
from tidemark.llm.toxicity import op1_toxicity

DOCS = "doc_id bigint, text string, score string, h bigint"


def test_fold_is_crc32_of_the_id_as_text(spark):
    rows = spark.range(200).select("id", fold("id", 3, 1).alias("f")).collect()
    assert all(r.f == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)
    assert spark.sql("SELECT CAST(NULL AS BIGINT) AS id").select(fold("id", 3, 1)).first()[0] is False


@pytest.fixture(scope="module")
def case(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(600):
        text, bad, junk = [r.choice(words) for _ in range(r.randint(5, 80))], i % 4 == 0, i % 6 == 0
        if bad:
            text[r.randrange(len(text))] = r.choice(["idiot", "Scum", "loser"]) + r.choice(["", "!", "."])
        text = " ".join(text)
        docs.append((i, " ".join(w.upper() + "!!" for w in text.split()) if junk else text, "clash", 1))
        labels.append((i, int(not junk), int(bad)))
    extra = [(9001, None, None, None), (9002, "", None, None), (None, "w1 idiot", "x", 1), (9003, "w1 " * 50000 + "scum", "x", 1), (0, docs[0][1], "x", 1)]
    frame = spark.createDataFrame(docs + extra, DOCS)
    known = spark.createDataFrame(labels + [(9001, None, None), (9002, 1, 0), (None, 1, 1), (1, 1, 0)], "doc_id bigint, quality int, toxic int")
    return frame, known


def test_toxicity_held_out(spark, case):
    docs, labels = case
    model = toxicity.train(docs, labels.where(~fold("doc_id", 3, 1)))
    assert len(model.places) < 1 << 16
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = np.mean([(by[i] >= 0.7) == (i % 4 == 0) for i in held])
    assert right > 0.95
    assert by[9003] >= 0.7 > by[9001] == by[9002]


def test_toxicity_without_examples(spark, case):
    docs, labels = case
    ones = labels.where("toxic = 1")
    for known, most in ((labels.limit(0), 0.01), (labels.where("toxic = 0"), 0.01)):
        assert all(r.score <= most for r in toxicity.score(docs, toxicity.train(docs, known)).collect())
    assert all(r.score > 0.99 for r in toxicity.score(docs, toxicity.train(docs, ones)).collect())
    model = toxicity.train(docs.limit(0), labels)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_long_texts_are_scored_like_short_ones():
    model = toxicity.Model(np.arange(1 << toxicity.BITS), np.random.default_rng(0).normal(size=1 << toxicity.BITS) * 1e-4, 0.0)
    score, known = model.scorer(), toxicity._Words()
    text = " ".join(f"w{i % 977}" for i in range(200_000)).encode()
    dense = np.zeros(1 << toxicity.BITS, dtype=np.float32)
    dense[model.places] = model.weights
    whole = float(dense[np.unique(toxicity.features(toxicity.words_of(text), known))].sum(dtype=np.float64))
    assert score(text) == pytest.approx(1 / (1 + np.exp(-whole)), abs=1e-9)


def test_quality_held_out_and_keep(spark, case):
    docs, labels = case
    weights = quality.model_for(docs, labels)
    by = {r.doc_id: r.score for r in quality.score(docs, weights).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(by[i] >= 0.7) == (i % 6 != 0) for i in held]) > 0.97
    kept = quality.keep(docs, weights)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.score >= 0.7 for r in quality.score(docs, weights).collect())


def test_quality_without_examples(spark, case):
    docs, labels = case
    assert quality.model_for(docs, labels.limit(0)) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.keep(docs, None).count() == docs.count()
    assert quality.score(docs.limit(0), None).count() == 0


def test_prior_estimate():
    rng = np.random.default_rng(5)
    for prior in (0.3, 0.6, 0.9):
        positive = rng.normal(2, 1, 4000)
        unlabelled = np.where(rng.random(4000) < prior, rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000))
        assert quality.estimate_prior(positive, unlabelled) == pytest.approx(prior, abs=0.06)


@pytest.mark.parametrize(("query", "modulus", "remainder"), [(op1_toxicity, 3, 1), (op6_quality, 4, 2)])
def test_queries_return_every_document(spark, sf, query, modulus, remainder):
    rows, docs = query(spark, sf), load(spark, sf, "documents")
    assert rows.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    both = rows.join(docs, "doc_id")
    assert both.count() == docs.count() == rows.count()
    assert rows.where((F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % modulus == remainder)) | (F.col("predicted") != (F.col("score") >= 0.7).cast("int"))).count() == 0
