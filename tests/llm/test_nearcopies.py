import random

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import nearcopies
from tidemark.llm.common import load
from tidemark.llm.nearcopies import near_copies


def brute(texts):
    """Component of each text: 5-word shingles, Jaccard 0.8 or more, by all pairs."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def case():
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    common = " ".join(r.choice(words) for _ in range(40))
    texts = [None, "", " \n", "one two", "ONE two", "one two three"]
    for i in range(40):
        text = [r.choice(words) for _ in range(r.choice([8, 60, 200]))]
        for _ in range(r.randint(1, 8)):
            texts.append(" ".join(text) + (f" {common}" if i % 3 == 0 else ""))
            for _ in range(r.randint(1, 3)):
                text[r.randrange(len(text))] = r.choice(words)
    return [(i, t) for i, t in enumerate(texts)]


def test_common_counts_are_those_of_each_pair():
    r = np.random.default_rng(3)
    left, right = ([np.unique(r.integers(0, 900, 60, dtype=np.uint64)) for _ in range(k)] for k in (30, 20))
    want = np.array([[len(set(x.tolist()) & set(y.tolist())) for y in right] for x in left])
    every = np.ones(want.shape, bool)
    assert (nearcopies.common_counts(left, right, every) == want).all()
    few = r.random(want.shape) < 0.1
    assert (nearcopies.common_counts(left, right, few)[few] == want[few]).all()


@pytest.mark.parametrize(("block", "hot"), [(nearcopies.BLOCK_ROWS, nearcopies.HOT), (4, 1000), (8, 6)])
def test_components_are_those_of_all_pairs(spark, case, block, hot, monkeypatch):
    monkeypatch.setattr(nearcopies, "SET_ROWS", min(block, nearcopies.SET_ROWS))
    monkeypatch.setattr(nearcopies, "BLOCK_ROWS", block)
    monkeypatch.setattr(nearcopies, "HOT", hot)
    want = brute([t for _, t in case])
    root = {r.doc_id: r.root for r in near_copies(spark.createDataFrame(case, "doc_id bigint, text string")).collect()}
    groups = {}
    for d, t in root.items():
        groups.setdefault(t, []).append(d)
    assert sorted(map(sorted, groups.values())) == sorted([i for i, k in enumerate(want) if k == c] for c in set(want))
    assert len(groups) < len(case)


def test_fingerprints_are_majorities_and_bits_follow_similarity():
    r = random.Random(2)
    one = nearcopies.shingles(" ".join(f"w{r.randrange(9999)}" for _ in range(304)).encode())
    other = nearcopies.shingles(" ".join(f"v{r.randrange(9999)}" for _ in range(36)).encode())
    two = np.sort(np.concatenate([one[:-33], other[:30]]))
    f = nearcopies.fingerprints([one, np.empty(0, np.uint64), two])
    assert not f[1].any()
    for bit in (0, 17, 63):
        assert bool(f[0, 0] >> np.uint64(bit) & np.uint64(1)) == (2 * int((one >> np.uint64(bit) & np.uint64(1)).sum()) > len(one))
    assert 0 < np.bitwise_count(f[0] ^ f[2]).sum() <= nearcopies.MAX_BITS
    assert np.bitwise_count(f[0] ^ nearcopies.fingerprints([other])[0]).sum() > nearcopies.MAX_BITS


def test_empty_table_gives_no_rows(spark):
    assert near_copies(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_stage_drops_copies_that_three_bits_miss(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents").where("doc_id in (2, 56, 3)")
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()) == [2, 3]
