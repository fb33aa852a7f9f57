import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tidemark.functions.filters import where
from tidemark.operators import branches, evaluate, knn, multivector


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(21)
    return rng.standard_normal((600, 8)).astype(np.float32)


@pytest.fixture(scope="module")
def corpus(spark, data):
    return spark.createDataFrame([(i - 300, v.tolist(), i % 5) for i, v in enumerate(data)], "id bigint, vector array<float>, label int").repartition(3).cache()


def truth(data, q, k, metric):
    x = data.astype(np.float64)
    d = np.linalg.norm(x - q, axis=1) if metric == "l2" else 1 - x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)
    return sorted((round(float(v), 6), i - 300) for i, v in enumerate(d))[:k]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("k", [0, 1, 10, 1000])
def test_exact(corpus, data, metric, k):
    got = [(r.distance, r.id) for r in knn.exact(corpus, data[3], k, metric).collect()]
    assert [i for _, i in got] == [i for _, i in truth(data, data[3].astype(float), k, metric)]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_batch_in_blocks(spark, corpus, data, metric):
    queries = spark.createDataFrame([(i, data[i].tolist()) for i in range(0, 600, 20)], "qid bigint, vector array<float>")
    for block in (7, 1000):
        got = {}
        for r in knn.batch(corpus, queries, 7, metric, block).collect():
            got.setdefault(r.qid, []).append((r.rank, r.id))
        assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: [i for _, i in truth(data, data[q].astype(float), 7, metric)] for q in range(0, 600, 20)}
    assert knn.batch(corpus, queries.limit(0), 7, metric).count() == 0
    assert knn.batch(corpus.limit(0), queries, 7, metric).count() == 0


class OneTask:
    """A corpus whose mapInArrow hands out the function that a task runs."""

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def one_task(spark, queries, k, metric, batches):
    """What a task gives, a batch a time, and the most MB that it allocated."""
    run = knn._one_pass(OneTask(spark), list(range(len(queries))), queries, k, metric)
    tracemalloc.start()
    sizes, rows = [], []
    for b in run(iter(batches)):
        sizes.append(b.num_rows)
        rows.append(np.column_stack([b.column(i).to_numpy() for i in range(3)]))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return np.concatenate(rows), sizes, peak - sum(r.nbytes for r in rows) / 1e6


def arrow(ids, vectors):
    flat = pa.array(vectors.ravel())
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, vectors.shape[1]), pa.int32()), flat)], names=["id", "vector"])


@pytest.mark.parametrize("k", [80, 10])
def test_a_task_is_bounded_whatever_the_rows(spark, k):
    rng = np.random.default_rng(5)
    queries = rng.standard_normal((3000, 8)).astype(np.float32).tolist()
    batches = [arrow(np.arange(lo, lo + 10_000), rng.standard_normal((10_000, 8)).astype(np.float32)) for lo in range(0, 40_000, 10_000)]
    rows, sizes, peak = one_task(spark, queries, k, "cosine", batches)
    assert len(rows) == 3000 * k and peak < 60


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_a_task_gives_its_rows_in_small_batches(spark, metric):
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((2000, 8)).astype(np.float32)
    rows, sizes, _ = one_task(spark, vectors.tolist(), 10, metric, [arrow(np.arange(2000), vectors)])
    assert len(rows) == 20_000 and max(sizes) <= 2560


def test_blocks_of_queries_are_smaller_for_a_large_k(spark, monkeypatch):
    vectors = np.random.default_rng(9).standard_normal((40, 4)).tolist()
    rows = spark.createDataFrame(list(enumerate(vectors)), "id bigint, vector array<double>")
    asked, one_pass = [], knn._one_pass
    monkeypatch.setattr(knn, "_one_pass", lambda c, qids, *rest: (asked.append(len(qids)), one_pass(c, qids, *rest))[1])
    k = 1 << 18  # 40 queries of it are five times the neighbours that a task keeps
    assert knn.batch(rows, rows.withColumnRenamed("id", "qid"), k).count() == 1600
    assert sum(asked) == 40 and len(asked) == 5


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_a_task_finds_the_nearest_among_ties(spark, metric):
    rng = np.random.default_rng(6)
    vectors = rng.integers(-2, 3, (9000, 3)).astype(np.float32) + np.float32(0.25)
    vectors[rng.random(9000) < 0.3] = vectors[0]
    ids = rng.permutation(9000) - 4000
    queries = vectors[:300].astype(np.float64)
    rows, _, _ = one_task(spark, queries.tolist(), 40, metric, [arrow(ids[lo : lo + 4000], vectors[lo : lo + 4000]) for lo in range(0, 9000, 4000)])
    x, q = vectors.astype(np.float64), queries
    d = np.linalg.norm(x[None] - q[:, None], axis=2) if metric == "l2" else 1 - (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)
    d = np.round(d, 6)
    want = [(i, int(ids[j])) for i in range(300) for j in np.lexsort((ids, d[i]))[:40]]
    assert [(int(a), int(b)) for a, b, _ in rows] == want


def test_ties_go_by_id(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in (5, 3, 9, 1)], "id bigint, vector array<float>")
    assert [r.id for r in knn.exact(rows, [1.0, 0.0], 2).collect()] == [1, 3]
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "qid bigint, vector array<float>")
    assert [r.id for r in knn.batch(rows, queries, 2).orderBy("rank").collect()] == [1, 3]


@pytest.mark.parametrize("share", [0.5, 0.1, 0.01])
def test_filters_fill_k(corpus, data, share):
    keep = {i - 300 for i in range(int(600 * share))}
    rows = knn.exact(corpus, data[0], 5, "l2", where({"id": {"$lt": min(keep) + len(keep)}})).collect()
    assert len(rows) == min(5, len(keep)) and {r.id for r in rows} <= keep


def test_pages(spark, corpus, data):
    own = knn.build_pages(corpus, 40)
    placed = knn.assign(corpus, own).cache()
    stats = knn.page_stats(placed, own).cache()
    assert placed.count() == 600 and stats.agg({"live": "sum"}).first()[0] == 600
    q = data[7].tolist()
    want = [i for _, i in truth(data, data[7].astype(float), 10, "l2")]
    assert [r.id for r in knn.bounded(placed, stats, q, 10, 2).collect()] == want
    found = {r.id for r in knn.routed(placed, own, q, 10, 6, "l2").collect()}
    assert len(found & set(want)) >= 7
    with pytest.raises(ValueError):
        knn.build_pages(corpus, 4)


def test_chamfer(spark, data):
    unit = data[:120] / np.linalg.norm(data[:120], axis=1, keepdims=True)
    tokens = spark.createDataFrame([(i // 12, i % 12, v.tolist()) for i, v in enumerate(unit)], "doc_id bigint, tok int, vector array<float>")
    query = unit[24:27].astype(np.float64)
    want = {d: sum(max(float(q @ t) for t in unit[d * 12 : d * 12 + 12].astype(np.float64)) for q in query) for d in range(10)}
    got = {r.doc_id: r.score for r in multivector.chamfer(tokens, query.tolist()).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    best = max(want, key=want.get)
    assert multivector.top_documents(tokens, query.tolist(), 3).first().doc_id == best
    assert multivector.token_search(tokens, query.tolist(), 3, 30).first().doc_id == best
    encoder = multivector.Encoder(8, 3, 6)
    assert multivector.encoded_search(tokens, query.tolist(), 3, encoder, 5).first().doc_id == best
    assert (multivector.Encoder(8, 3, 6).encode(unit[:4], True) == encoder.encode(unit[:4], True)).all()


def test_summaries(spark):
    recalls = spark.createDataFrame([(i, i / 10) for i in range(11)], "qid int, recall double")
    row = evaluate.quality(recalls).first()
    assert (row.mean, row.p50, row.perfect) == (0.5, 0.5, round(1 / 11, 6)) and row.p05 == pytest.approx(np.percentile(np.arange(11) / 10, 5))
    samples = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    row = evaluate.confidence(samples, "v").first()
    assert (row.n, row.mean) == (4, 2.5) and row.half_width == pytest.approx(3.182 * np.std([1, 2, 3, 4], ddof=1) / 2, abs=1e-5)
    assert evaluate.confidence(samples.limit(1), "v").first().half_width is None
    assert evaluate.gate({"recall": 0.9, "qps": 100, "gone": 1}, {"recall": 0.8, "qps": 99}, {"recall": 0.05, "qps": 0.1, "gone": 1}) == {"recall": "fail", "qps": "pass", "gone": "abstain"}


@pytest.mark.parametrize("options", [{}, {"slices": 5}, {"kinds": ("replace",)}, {"kinds": ("delete", "update", "insert"), "slices": 2}])
def test_trace_keeps_the_live_rows(spark, options):
    made = lambda: [tuple(r) for r in evaluate.replace_trace(spark, 300, 100, 10, 3, **options).orderBy("seq").collect()]
    rows, live, sizes = made(), set(), {}
    for _, ts, op, i, _ in rows:
        if op == "upsert":
            live.add(i)
        else:
            assert i in live
            live.discard(i)
        sizes[ts] = len(live)
    assert len(live) == 100 and max(sizes.values()) <= 110 and min(sizes.values()) >= 90
    assert rows == made()
    for bad in ((100, 100, 10, 1), (300, 100, 0, 1)):
        with pytest.raises(ValueError):
            evaluate.replace_trace(spark, *bad)
    with pytest.raises(ValueError):
        evaluate.replace_trace(spark, 300, 100, 10, 1, kinds=("insert",))


def test_tree_search(spark):
    nodes = spark.createDataFrame([("r", None, 0, 0.0), ("a", "r", 1, 1.0), ("b", "r", 1, 0.0), ("aa", "a", 3, 0.0), ("ab", "a", 0, 0.0)], "node string, parent string, visits bigint, value double")
    sums = branches.backpropagated(nodes)
    assert {r.node: (r.visits, r.value) for r in sums.collect()} == {"r": (5, 1.0), "a": (4, 1.0), "b": (1, 0.0), "aa": (3, 0.0), "ab": (0, 0.0)}
    assert {r.parent: r.node for r in branches.selected(sums).collect()} == {"r": "b", "a": "ab"}
    assert branches.selected(sums, 0.0).where("parent = 'r'").first().node == "a"
