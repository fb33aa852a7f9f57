import random
import re

import numpy as np
import pytest
import xxhash

from tidemark.llm.simhash import fingerprints, keep_one, near_duplicates, stars, trie_links

DOCS = "doc_id bigint, text string, fp string, root bigint"


def slow(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall("[^\x20\x09-\x0d]+", lower)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if h and sum(x >> b & 1 for x in h) * 2 > len(h))


def roots(points):
    parent = list(range(len(points)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


def test_fingerprints():
    r = random.Random(1)
    texts = ["", " \t\n", "One", "one TWO", "É b c\x1cd e f", "a b c"] + [" ".join(r.choice(["aa", "Bb", "c"]) for _ in range(n)) for n in (3, 4, 50, 20000)]
    assert [int(x) for x in fingerprints([t.encode() for t in texts])] == [slow(t) for t in texts]


@pytest.mark.parametrize("n", [1, 2, 60, 700])
def test_trie_links_are_all_links(n):
    rng = np.random.default_rng(n)
    p = rng.integers(0, 2**63, max(1, n // 8), dtype=np.uint64)[rng.integers(0, max(1, n // 8), n)]
    for _ in range(2):
        p = p ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    p = np.unique(p)
    found = {(int(a), int(b)) for i, j in trie_links(p, leaf=4) for a, b in zip(i, j, strict=True)}
    assert found == {(i, j) for i in range(len(p)) for j in range(i + 1, len(p)) if (int(p[i]) ^ int(p[j])).bit_count() <= 3}
    member, centre = stars(p)
    own = dict(zip(member.tolist(), centre.tolist(), strict=True))
    assert [own.get(int(x), int(x)) for x in p] == [int(p[k]) for k in roots([int(x) for x in p])]


@pytest.fixture(scope="module")
def case():
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(60):
        text = [r.choice(vocabulary) for _ in range(120)]
        docs.append((i * 3, " ".join(text), "clash", 1))
        for k in range(r.randint(0, 6)):
            text[r.randrange(120)] = r.choice(vocabulary)
            docs.append((1000 - i * 7 - k, " ".join(text), None, None))
    return docs + [(0, docs[0][1], "x", 1), (5000, "", "x", 1), (4999, None, "x", 1), (None, " ", "x", 1), (None, "alone", "x", 1)]


@pytest.mark.parametrize("group_rows", [512, 2])
def test_components(spark, case, group_rows):
    points = [slow(t) for _, t, *_ in case]
    of = roots(points)
    least = {k: min((d for (d, *_), c in zip(case, of, strict=True) if c == k and d is not None), default=None) for k in set(of)}
    want = sorted(((d, p, least[k]) for (d, *_), p, k in zip(case, points, of, strict=True)), key=str)
    found = near_duplicates(spark.createDataFrame(case, DOCS), group_rows=group_rows).collect()
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in found), key=str) == want


def test_keep_one(spark, case):
    frame = spark.createDataFrame(case, DOCS)
    kept = keep_one(frame)
    assert kept.columns == frame.columns
    of = roots([slow(t) for _, t, *_ in case])
    least = [min((d for (d, *_), c in zip(case, of, strict=True) if c == k and d is not None), default=None) for k in set(of)]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(least, key=str)
    clash = frame.withColumnsRenamed({"fp": "_keep_id", "root": "_text_hash"})
    assert keep_one(clash).columns == clash.columns


def test_empty(spark):
    nothing = spark.createDataFrame([], DOCS)
    assert near_duplicates(nothing).count() == 0
    assert keep_one(nothing).count() == 0
