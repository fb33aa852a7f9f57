import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lm
from tidemark.llm.common import fold, load
from tidemark.llm.lm import draw_tables, op10_lm, perplexity, score_texts, stirling

DOCS = "doc_id bigint, text string, n string, score string"


def tokens_of(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [*re.findall("[^\x20\x09-\x0d]+", lower), None]


def check(rows, docs):
    """Everything but score against counts by hand; docs: (doc_id, text)."""
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(w for d, t in docs if not held(d) for w in tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, t in docs:
        w = tokens_of(t)
        want.append((str(d), held(d), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)


@pytest.fixture(scope="module")
def case():
    r = random.Random(10)
    words = [f"W{i}" for i in range(300)]
    docs = [(i, " ".join(words[min(299, int(r.expovariate(0.02)))] for _ in range(r.randint(0, 60))), "clash", "x") for i in range(120)]
    return docs + [(500, None, None, None), (501, " \t", "x", "x"), (None, "W1 w2", "x", "x"), (3, docs[3][1], "x", "x"), (502, "w1 é\x1cx w2 " * 20_000, "x", "x")]


WAYS = [(lm.TOP, lm.DENSE), (lm.TOP, 8), (40, 8), (1, 1)]


@pytest.mark.parametrize("top,dense", WAYS)
def test_counts_are_exact_and_the_model_beats_the_base(spark, case, top, dense):
    rows = score_texts(spark.createDataFrame(case, DOCS), fold("doc_id", 7, 2), top, dense)
    got = rows.collect()
    check(got, [(d, t) for d, t, *_ in case])
    assert all(r.score < 0 for r in got)
    for r in perplexity(rows).collect():
        assert r.perplexity < r.base_perplexity


def first_seating(docs):
    """Scores of every text by hand when each pair and each word has one table."""
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    pairs = Counter()
    for d, t in docs:
        if not held(d):
            w = tokens_of(t)
            pairs.update(zip(["start", *w], w))
    customers, tables, own = Counter(), Counter(), Counter()
    for (u, w), c in pairs.items():
        customers[u] += c
        tables[u] += 1
        own[w] += 1
    v, n = len(own), sum(own.values())

    def p(u, w):
        fresh = (lm.THETA0 + lm.D0 * v) / (v + 1)
        parent = (own[w] - lm.D0 * (own[w] > 0) + fresh) / (lm.THETA0 + n)
        c = pairs[u, w]
        return (c - lm.D1 * (c > 0) + (lm.THETA1 + lm.D1 * tables[u]) * parent) / (lm.THETA1 + customers[u])

    for u in [*list(customers)[:20], "never seen"]:
        assert sum(p(u, w) for w in own) + p(u, "unknown") == pytest.approx(1.0)
    return [(str(d), sum(math.log10(p(u, w)) for u, w in zip(["start", *tokens_of(t)], tokens_of(t)))) for d, t in docs]


@pytest.mark.parametrize("top,dense", WAYS)
def test_first_seating_is_the_one_by_hand(spark, case, top, dense):
    rows = score_texts(spark.createDataFrame(case, DOCS), fold("doc_id", 7, 2), top, dense, 0).collect()
    want = sorted(first_seating([(d, t) for d, t, *_ in case]))
    for a, b in zip(sorted((str(r.doc_id), r.score) for r in rows), want, strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], rel=1e-5)


def test_all_ways_agree(spark, case):
    docs = spark.createDataFrame(case, DOCS)
    whole = {(r.doc_id, r.n_tokens): r.score for r in score_texts(docs, fold("doc_id", 7, 2)).collect()}
    for top, dense in WAYS[1:3]:
        dealt = {(r.doc_id, r.n_tokens): r.score for r in score_texts(docs, fold("doc_id", 7, 2), top, dense).collect()}
        # draws differ by way, so the scores of the shortest texts differ by more than those of all
        assert all(dealt[k] == pytest.approx(v, rel=0.1) for k, v in whole.items())
        assert sum(dealt.values()) == pytest.approx(sum(whole.values()), rel=0.02)


def test_pairs_of_two_rare_words_are_resampled():
    rng = np.random.default_rng(4)
    rare = np.array([int(lm.BIG) + i for i in range(12)], dtype=np.uint64)
    w, u = (x.ravel() for x in np.meshgrid(rare, rare, indexing="ij"))
    c = rng.integers(0, 100, len(w))
    pairs, before, state = lm.Pairs(w, u, c, 0, 1), None, None
    for run in range(2):
        before, added = state, np.zeros((1, 2 * lm.CODES + 2))
        lm.sums(pairs, before, 1, run, added)
        state = lm.State(int(c.sum()), 12, np.zeros(lm.CODES), added, before)
    seen = [t for t, _, _ in lm.seatings(pairs, state, lm.SAMPLES, 2)]
    for t in seen:
        assert (t <= c).all() and (t[c > 0] >= 1).all() and t[c > 50].mean() > 1.2
    assert any((t != seen[0]).any() for t in seen)


def test_scores_of_rare_pairs_are_as_those_of_top_pairs(spark):
    """Few words in many buckets: where one word is a top word most pairs are of two rare ones."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(i, " ".join(r.choices(words, range(1, 13), k=40)), None, None) for i in range(150)], DOCS)
    whole, dealt = ({x.doc_id: x.score for x in score_texts(docs, fold("doc_id", 7, 2), *way).collect()} for way in (WAYS[0], WAYS[3]))
    assert sum(dealt.values()) == pytest.approx(sum(whole.values()), rel=0.003)
    assert all(dealt[k] == pytest.approx(v, rel=0.03) for k, v in whole.items())


def test_buckets_tell_each_other_their_tables():
    """Pairs of rare words over buckets: every context's probabilities add up to one."""
    buckets, samples = 3, 2
    rng = np.random.default_rng(3)
    rare = np.array([int(lm.BIG) + (i << 31) + i for i in range(9)], dtype=np.uint64)
    words, contexts = np.append(np.arange(2, dtype=np.uint64), rare), np.append(np.array([0, lm.START], dtype=np.uint64), rare[:-1])
    w, u = (x.ravel() for x in np.meshgrid(words, contexts, indexing="ij"))
    c = rng.integers(0, 200, len(w))
    c[w == rare[-1]] = 0  # the unknown word
    home = lm._homes(w, u, lm._mixed(w, u), buckets).astype(int)
    both = (w >= lm.BIG) & (u >= lm.BIG)
    parts = []
    for b in range(buckets):
        at = np.flatnonzero((home == b) | both & (lm._bucket(u, buckets) == b))
        parts.append(lm.Pairs(w[at], u[at], c[at], b, buckets))
    customers = np.zeros(lm.CODES)
    np.add.at(customers, u[u < lm.BIG].astype(int), c[u < lm.BIG])

    def run(before, n, seed, mail):
        added, sent = np.zeros((n, 2 * lm.CODES + 2)), []
        for b, p in enumerate(parts):
            sent += lm.letters(p, *lm.sums(p, before, n, seed + b, added, mail[b]), b, buckets)
        return lm.State(int(c.sum()), 10, customers, added, before), sent

    def to(b, kind, sent):
        return [blob for x, k, blob in sent if (x, k) == (b, kind)]

    before, mail, told = None, [None] * buckets, None
    for r in range(3):
        state, sent = run(before, samples if r == 2 else 1, 10 * r, mail)
        if r == 2:
            told = [lm.Mail(p, samples, to(b, 1, sent)) for b, p in enumerate(parts)]
            break
        answered = [x for b in range(buckets) for own in to(b, 0, sent) for x in lm.answers(b, own, to(b, 1, sent))]
        before, mail = state, [lm.Mail(p, 1, to(b, 1, answered), to(b, 0, answered)) for b, p in enumerate(parts)]
    assert any(m.added.any() for m in told) and any(m.tables.any() for m in mail)
    total, tables, over_of = Counter(), {}, {}
    asked = []
    for b, p in enumerate(parts):
        logs, seats, parents, over = lm.log_probabilities(p, before, state, 20 + b, mail[b], told[b])
        for i in np.flatnonzero(~p.both):
            total[int(p.u[i])] += 10 ** logs[i]
        for i, x in enumerate(p.contexts):
            tables[int(x)] = [t[i] for t in seats]
        asked += [(int(p.u[j]), int(p.c[j]), [x[i] for x in parents], [x[i] for x in over]) for i, j in enumerate(np.flatnonzero(p.asked))]
    for x, n, parents, over in asked:
        seen = int(c[u == np.uint64(x)].sum())
        assert max(over) > 0 or n < 20
        for s in range(samples):
            total[x] += (n - lm.D1 * (min(n, 1) + over[s]) + (lm.THETA1 + lm.D1 * tables[x][s]) * parents[s]) / (lm.THETA1 + seen) / samples
    assert len(total) == len(contexts) and len(asked) == both.sum()
    for x in total.values():
        assert x == pytest.approx(1.0, abs=1e-6)


def test_stirling_numbers_count_seatings():
    s = stirling(0.5, 6)

    def seatings(c, t):
        """Sum over partitions of c customers into t tables of the product of (1 - d)(2 - d)..."""
        if c == 0:
            return float(t == 0)
        total = 0.0
        for size in range(1, c + 1):
            weight = math.prod(k - 0.5 for k in range(1, size))
            total += math.comb(c - 1, size - 1) * weight * seatings(c - size, t - 1) if t else 0
        return total

    for c in range(1, 6):
        for t in range(1, c + 1):
            assert math.exp(s[c, t]) == pytest.approx(seatings(c, t))


def test_draws_follow_their_conditional():
    rng = np.random.default_rng(1)
    c, a = np.full(40_000, 5), np.full(40_000, 2.0)
    drawn = np.bincount(draw_tables(c, a, lm.D1, rng), minlength=6)[1:] / 40_000
    p = np.exp(stirling(lm.D1, 5)[5, 1:] + np.arange(1, 6) * math.log(2.0))
    assert drawn == pytest.approx(p / p.sum(), abs=0.01)
    many = draw_tables(np.array([0, 1, 1000, 1_000_000]), np.full(4, 5.0), lm.D1, rng)
    assert many[0] == 0 and many[1] == 1 and 1 <= many[2] <= 1000 and many[2] < many[3] <= 1_000_000


def test_probabilities_after_sweeps_sum_to_one():
    """One bucket of rare words after top words and one after the start of a text."""
    rng = np.random.default_rng(2)
    rare = np.array([int(lm.BIG) + i for i in range(25)], dtype=np.uint64)
    w, u = (x.ravel() for x in np.meshgrid(rare, np.array([0, 1, lm.START], dtype=np.uint64), indexing="ij"))
    c = rng.integers(1, 8, len(w))
    c[w == rare[-1]] = 0  # the unknown word
    pairs = lm.Pairs(w, u, c, 0, 1)
    customers = np.zeros(lm.CODES)
    np.add.at(customers, u.astype(int), c)
    before, state = None, None
    for run, samples in enumerate((1, 1, lm.SAMPLES)):
        before, added = state, np.zeros((samples, 2 * lm.CODES + 2))
        lm.sums(pairs, before, samples, run, added)
        state = lm.State(int(c.sum()), 24, customers, added, before)
    p = 10 ** lm.log_probabilities(pairs, before, state, 2)[0]
    for x in np.unique(u):
        assert p[u == x].sum() == pytest.approx(1.0, abs=1e-9)


def test_empty_and_query(spark, sf):
    nothing = spark.createDataFrame([], DOCS)
    assert score_texts(nothing, F.lit(False)).count() == 0
    untrained = score_texts(spark.createDataFrame([(1, "a b", None, None)], DOCS), F.lit(True)).first()
    assert untrained.train_tokens == 0 and untrained.n_known == 0 and untrained.n_tokens == 3 and untrained.base_score == 0.0
    check(op10_lm(spark, sf).collect(), [(r.doc_id, r.text) for r in load(spark, sf, "documents").collect()])
