import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm.common import load
from tidemark.llm.packing import best_fit, default_tokenizer, op9_packing, pack, plan, reduce_by_dominance, sequences, tokenizer_of

DOCS = "doc_id bigint, text string, piece string, length bigint"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def best_by_search(items, capacity):
    best = len(items)

    def go(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(items):
            best = len(room)
            return
        for k in {r: k for k, r in enumerate(room) if r >= items[i]}.values():
            room[k] -= items[i]
            go(i + 1, room)
            room[k] += items[i]
        go(i + 1, [*room, capacity - items[i]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best


def test_dominance_never_costs_a_sequence():
    r = random.Random(6)
    for _ in range(200):
        capacity = r.randint(6, 20)
        items = [r.randint(1, capacity) for _ in range(r.randint(1, 8))]
        fixed, left = reduce_by_dominance(dict(Counter(items)), capacity)
        rest = [x for x, n in left.items() for _ in range(n)]
        used = sum(n for _, n in fixed) + (best_by_search(rest, capacity) if rest else 0)
        assert used == best_by_search(items, capacity), (capacity, items)
        assert Counter(items) == Counter(rest) + Counter({x: 0 for x in items}) + sum((Counter({x: q * n for x, q in inside}) for inside, n in fixed), Counter())


@pytest.mark.parametrize("mean", [3.0, 5.5, 7.5])
def test_plan_is_whole_and_near_the_bound(mean):
    lengths = np.clip(np.random.default_rng(7).lognormal(mean, 1, 20000).astype(int), 1, 4096)
    counts = dict(Counter(lengths.tolist()))
    fill, seen = Counter(), Counter()
    for length, a, b, sequence, _, q in plan(counts).tolist():
        seen[length] += b - a
        for k in range((b - a) // q):
            fill[sequence + k] += q * length
    assert seen == Counter(counts)
    assert max(fill.values()) <= 4096
    assert len(fill) <= -(-sum(lengths) // 4096) * 1.005 + 1


def test_best_fit_alone():
    assert sum(n for _, n in best_fit({6: 2, 4: 2, 3: 3}, 10)) == 3


def test_chunk_cache_gives_the_tokenizer_s_ids(tokenizer):
    texts = ["It's a TEST... ok, 'S. x,y. ÉCOLE. Σίσυφος ΟΔΟΣ. é, a.́ <|endoftext|> a.b", "", "don't. 5. 5.5, ５.　x y.  ", "A\tB\x0bC\x1cD. E,\r\nf", "a" * 5000, "we'll, they'd. I'm 'm 've."]
    coded = tokenizer_of(open(default_tokenizer(), encoding="utf-8").read()).ids([t.encode() for t in texts])
    assert [np.frombuffer(c, "<u4").tolist() for c in coded] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.fixture(scope="module")
def case():
    r = random.Random(8)
    words = ["the", "Cat,", "café.", "x1", "sat"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 3, 50, 3000, 5000]))), "clash", 1) for i in range(40)]
    return docs + [(3, docs[3][1], "x", 1), (None, "no id", "x", 1), (100, None, "x", 1), (101, "one " * 30000, None, None)] + [(200 + i, "same text", "x", 1) for i in range(300)]


def check_placement(rows, docs, tokenizer):
    want = Counter()
    for doc, text, *_ in docs:
        ids = ids_of(tokenizer, text)
        for k, at in enumerate(range(0, len(ids), 4096)):
            own = np.array(ids[at : at + 4096], "<u4")
            want[doc, k, at, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in by.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 4096
    return len(by)


def test_pack(spark, case, tokenizer):
    rows = pack(spark.createDataFrame(case, DOCS)).collect()
    used = check_placement(rows, case, tokenizer)
    assert used <= -(-sum(r.length for r in rows) // 4096) + 2
    kept = sequences(spark.createDataFrame(case, DOCS)).collect()
    assert len(kept) == used and sum(len(r.ids) for r in kept) == sum(r.length for r in rows) and all(len(r.ids) <= 4096 for r in kept)
    assert Counter(x for r in kept for x in r.ids)[1] >= len(case)


def test_empty(spark):
    assert pack(spark.createDataFrame([], DOCS)).count() == 0


def test_query(spark, sf, tokenizer):
    docs = [(r.doc_id, r.text) for r in load(spark, sf, "documents").collect()]
    check_placement(op9_packing(spark, sf).collect(), docs, tokenizer)
