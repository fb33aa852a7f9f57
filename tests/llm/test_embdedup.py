import numpy as np
import pytest

from tidemark.llm.embdedup import build, near_vectors, op4_embeddings, unit

ROWS = "vec_id bigint, embedding array<float>, h string, root bigint, copies int"


def brute(rows, threshold=0.9):
    n, ids = len(rows), [r[0] for r in rows]
    ok = [i is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, *_ in rows]
    links, least = [0] * n, list(ids)
    pairs = []
    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]) and float(unit(np.array([rows[a][1]]))[0] @ unit(np.array([rows[b][1]]))[0]) >= threshold:
                links[a] += 1
                links[b] += 1
                pairs.append((a, b))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return [(i, k, c, i is not None and i == c) for i, k, c in zip(ids, links, least, strict=True)]


@pytest.fixture(scope="module")
def case():
    rng, rows = np.random.default_rng(3), []
    for _ in range(80):
        x = rng.standard_normal(16)
        x /= np.linalg.norm(x)
        rows.append(x)
        for _ in range(rng.integers(0, 5)):
            g = rng.standard_normal(16)
            g -= g @ x * x
            c = rng.uniform(0.93, 1)
            rows.append(c * x + np.sqrt(1 - c * c) * g / np.linalg.norm(g))
    rows += [rows[0]] * 40 + [rows[1] * 3]
    rows = [(int(i), np.array(v, dtype=np.float32).tolist(), "clash", 1, 2) for i, v in zip(rng.permutation(len(rows)) * 3, rows, strict=True)]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0, 3.0], [1.0, 2.0, 3.1], [5.0], [6.0]]
    rows += [(10_000 + i, v, None, None, None) for i, v in enumerate(odd)]
    return rows + [(None, rows[0][1], "x", 1, 1), (rows[5][0], rows[5][1], "x", 1, 1)]


def test_links_and_components(spark, case):
    got = near_vectors(spark.createDataFrame(case, ROWS)).collect()
    want = brute(case)
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in got]
    recall = sum(g[1] for g in got) / sum(w[1] for w in want)
    assert len(got) == len(want) and 0.97 <= recall <= 1
    most = {}
    for i, n, *_ in want:
        most[i] = max(most.get(i, 0), n)
    assert all(n <= most[i] for i, n, *_ in got)
    assert np.mean([a == b for a, b in zip(sorted(got, key=str), sorted(want, key=str), strict=True)]) > 0.95
    plain = {i for i, *_ in case[-12:-2]}
    assert [g for g in sorted(got, key=str) if g[0] in plain and g[0] < 10_006] == [w for w in sorted(want, key=str) if w[0] in plain and w[0] < 10_006]


def test_recall_at_the_threshold(spark):
    """Half of the near pairs lie just above the threshold; recall is measured against brute force."""
    rng = np.random.default_rng(4)
    x = unit(rng.standard_normal((800, 64)))
    g = rng.standard_normal(x.shape)
    g = unit(g - (g * x).sum(1, keepdims=True) * x)
    c = np.where(np.arange(800) % 2, 0.905, 0.97)[:, None]
    rows = np.concatenate([x, c * x + np.sqrt(1 - c * c) * g])
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(rows.astype(np.float32).tolist())], "vec_id bigint, embedding array<float>")
    found = sum(r.n_links for r in near_vectors(frame).collect())
    u = unit(rows.astype(np.float32))
    assert found / ((u @ u.T >= 0.9).sum() - len(u)) >= 0.9


def test_visits_are_in_order_and_half():
    x = unit(np.random.default_rng(5).standard_normal((3000, 16)))
    index = build(x, 3000)
    d1, d2 = index.distances(x[:200])
    width = len(index.second)
    for r, (own, visits) in enumerate(index.visits(d1, d2)):
        total = d1[r][:, None] + d2[r]
        want = {i * width + j for i, j in np.argwhere(total <= total.min() + index.margin).tolist() if i * width + j >= own}
        assert {int(i * width + j) for i, js in visits for j in js} == want


def test_empty_and_query(spark, sf):
    assert near_vectors(spark.createDataFrame([], ROWS)).count() == 0
    assert near_vectors(spark.createDataFrame([(1, None, "x", 1, 1)], ROWS)).first() == (1, 0, 1, True)
    assert op4_embeddings(spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
