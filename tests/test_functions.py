import numpy as np
import pytest

from tidemark.embeddings import as_embedder, embed_column
from tidemark.functions import vectors as V
from tidemark.functions.filters import json_field, label_match, where
from tidemark.functions.ids import stable_id, stable_ids

RECORDS = [
    ("a", '{"lang": "en", "year": 2021, "score": 0.9, "tags": ["x", "y"], "ok": true}'),
    ("b", '{"lang": "fr", "year": 2022, "score": 0.7, "tags": ["y"]}'),
    ("c", '{"lang": "en", "year": 2023, "score": 0.5}'),
    ("d", '{"lang": "de", "year": 2024, "ok": false}'),
    ("e", '{"description": "multiversion concurrency"}'),
    ("f", None),
    ("g", "not json"),
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(RECORDS, "id string, metadata string")


@pytest.mark.parametrize(
    ("condition", "want"),
    [
        ({}, "abcdefg"),
        (None, "abcdefg"),
        ({"lang": "en"}, "ac"),
        ({"lang": {"$ne": "en"}}, "bdefg"),
        ({"lang": None}, "efg"),
        ({"year": {"$gt": 2021, "$lte": 2023}}, "bc"),
        ({"year": {"$gte": 2023}}, "cd"),
        ({"score": {"$lt": 0.7}}, "c"),
        ({"lang": {"$in": ["fr", "de"]}}, "bd"),
        ({"lang": {"$nin": ["fr", "de"]}}, "acefg"),
        ({"lang": {"$in": [None, "fr"]}}, "befg"),
        ({"lang": {"$in": []}}, ""),
        ({"tags": {"$contains": "x"}}, "a"),
        ({"description": {"$contains": "concurrency"}}, "e"),
        ({"lang": {"$regex": "^[ef]"}}, "abc"),
        ({"ok": True}, "a"),
        ({"ok": {"$ne": True}}, "bcdefg"),
        ({"$and": []}, "abcdefg"),
        ({"$or": []}, ""),
        ({"$or": [{"lang": "fr"}, {"$and": [{"lang": "en"}, {"year": {"$gt": 2022}}]}]}, "bc"),
        ({"lang": "en", "year": {"$eq": 2021}}, "a"),
        ({"lang": {"$gt": 5}}, ""),
    ],
)
def test_where(records, condition, want):
    rows = records.where(where(condition, json_field("metadata"))).collect()
    assert "".join(sorted(r.id for r in rows)) == want


@pytest.mark.parametrize("condition", [{"a": {"$near": 1}}, {"$not": []}, {"$and": {"a": 1}}, {"a": {"$in": "text"}}])
def test_unknown_operators_are_refused(spark, condition):
    with pytest.raises(ValueError):
        where(condition)


def test_label_match(spark):
    rows = spark.createDataFrame([(i,) for i in range(16)] + [(-(1 << 63),)], "label bigint")
    got = {r.label for r in rows.where(label_match("label", require_all=1, require_any=6, exclude=8)).collect()}
    assert got == {x for x in range(16) if x & 1 and x & 6 and not x & 8}
    assert rows.where(label_match("label", require_all=-(1 << 63))).count() == 1


def test_vectors(spark):
    a, b = np.random.default_rng(0).standard_normal((2, 8))
    row = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>").select(
        V.dot("a", "b").alias("dot"), V.l2_distance("a", "b").alias("l2"), V.cosine_distance("a", "b").alias("cos"), V.normalise("a").alias("unit"), V.sketch8(V.normalise("a")).alias("s")
    ).first()
    assert row.dot == pytest.approx(a @ b) and row.l2 == pytest.approx(np.linalg.norm(a - b))
    assert row.cos == pytest.approx(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert row.unit == pytest.approx((a / np.linalg.norm(a)).tolist())
    assert max(map(abs, row.s)) <= 127
    with pytest.raises(ValueError):
        V.units(np.zeros((1, 3)))
    with pytest.raises(ValueError):
        V.distance("a", "b", "manhattan")
    with pytest.raises(Exception, match="zero"):
        spark.createDataFrame([([0.0, 0.0],)], "a array<double>").select(V.normalise("a")).collect()


def test_centroids(spark):
    x = np.random.default_rng(1).standard_normal((20, 4))
    frame = spark.createDataFrame([(i % 3, v.tolist()) for i, v in enumerate(x)], "g int, v array<double>")
    for r in V.centroids(frame, "g", "v").collect():
        assert r.centroid == pytest.approx(x[r.g :: 3].mean(0).tolist())
    for r in V.centroids(frame, "g", "v", "cosine").collect():
        assert np.linalg.norm(r.centroid) == pytest.approx(1)


@pytest.mark.parametrize(
    ("value", "want"),
    [("a", 2340832890917691671), ("doc-1", 3132883647696894624), ("user-preference-42", 4816184505566365106), ("hello world", 4882774824043272360), ("", 8238016292129134938), ("unicode-café-🎉", 4281077293084237012), (7, 7), (-1, -1)],
)
def test_stable_id(value, want):
    assert stable_id(value) == want


def test_stable_ids_column(spark):
    with pytest.raises(TypeError):
        stable_id(True)
    rows = spark.createDataFrame([("a",), (None,)], "n string").select(stable_ids("n").alias("i")).collect()
    assert [r.i for r in rows] == [2340832890917691671, None]


def test_embedders(spark):
    class Both:
        def embed_documents(self, texts):
            return [[len(t), 1] for t in texts]

        def embed_query(self, text):
            return [0, len(text)]

    assert as_embedder(Both()).query("abc") == [0.0, 3.0]
    assert as_embedder(lambda texts: [[len(t)] for t in texts]).query("abcd") == [4.0]
    with pytest.raises(TypeError):
        as_embedder(5)
    rows = spark.createDataFrame([("ab",), (None,)], "t string").select(embed_column(lambda ts: [[float(len(t))] for t in ts], "t").alias("v")).collect()
    assert [r.v for r in rows] == [[2.0], None]


def test_estimate_memory():
    e = V.estimate_memory(128, 1000)
    assert e["vector_bytes"] == 512_000 and e["total_bytes"] > e["vector_bytes"]
    with pytest.raises(ValueError):
        V.estimate_memory(0, 1)
