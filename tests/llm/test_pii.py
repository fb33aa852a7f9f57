import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tidemark.llm.common import load
from tidemark.llm.pii import KINDS, LABELS, Field, Mentions, base_spans, digest, find, fit, op8_pii, redact, redacted, spans_of, train

DOCS = "doc_id bigint, text string, spans string, n_chars bigint"


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        out += [(2, *m.span())] * (16 <= len(d) <= 19 and luhn(d))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@pytest.mark.parametrize("alphabet", ["a@.1-", "12.", "0123456789 -", "+1() .-5", 'a1@.+- ("é%', "٣1.+@"])
def test_base_rules(alphabet):
    r = random.Random(5)
    for _ in range(3000):
        t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
        assert base_spans(t) == brute(t), t


def test_long_texts_take_linear_time():
    field = fit([], [], [], [])
    for t in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 50_000, "+1" + " " * 200_000, "1 " * 100_000, "a.b@" * 50_000 + "c.d", "joe1@x.org " * 10_000):
        assert len(list(spans_of([t.encode()], field))) == 1


TEXT = "call +1 (499) 555-6503 now, or (499) 555-6503, or 499-555-6503. joe12@x.example.com or joe12@x; 4432507379035540. 1.2.3.4"


@pytest.fixture(scope="module")
def case():
    r = random.Random(6)
    parts = ["word", "a.b@c.org", "+44 20 7946 0958", "10.0.0.1", "999.1.1.1", "4432507379035540", "4432507379035541", "token = 1eb9c654e721b4", "é"]
    docs = [(i, " ".join(r.choice(parts) for _ in range(r.randint(0, 30))), "clash", 1) for i in range(50)]
    return docs + [(100, None, "x", None), (101, "", "x", 0), (None, TEXT, "x", 1), (102, TEXT, "x", 1), (102, TEXT, "x", 1), (103, "w " * 60_000 + "a@b.org", "x", 1)]


def test_likes_of_a_base_span_are_added(spark, case):
    docs = spark.createDataFrame(case, DOCS)
    field = train(docs)
    assert isinstance(field, Field)
    (_, base, every), = spans_of([TEXT.encode()], field)
    assert set(base) == set(brute(TEXT)) and set(base) <= set(every)
    assert {TEXT[a:b] for k, a, b in set(every) - set(base) if k == 3} == {"499) 555-6503", "499-555-6503"}
    assert "joe12@x" in {TEXT[a:b] for k, a, b in set(every) - set(base) if k == 0}
    (_, _, alone), = spans_of([b"499-555-6503 and 4432507379035541 and 999.1.1.1 alone"], field)
    assert alone == []


def test_marginals_are_those_of_all_labellings_on_a_tree():
    r = np.random.default_rng(4)
    field = Field(r.normal(size=(12, LABELS)), np.exp(r.normal(size=(LABELS, LABELS))), np.exp(r.normal(size=(LABELS, LABELS))))
    m = Mentions()
    m.doc, m.span, m.label, m.shape = [0] * 4, [(0, 1)] * 4, [2, LABELS - 1, LABELS - 1, LABELS - 1], [[0, 2], [0, 3, 7], [0, 4], [0, 5, 9]]
    m.chain, m.skip = [(0, 1), (1, 2)], [(1, 3)]
    p = np.zeros((4, LABELS))
    for y in itertools.product([2], range(LABELS), range(LABELS), range(LABELS)):
        weight = np.prod([np.exp(field.unary[m.shape[i], y[i]].sum()) for i in (1, 2, 3)])
        weight *= np.prod([field.chain[y[a], y[b]] for a, b in m.chain]) * field.skip[y[1], y[3]]
        p[range(4), y] += weight
    assert np.allclose(field.marginals(m), p / p.sum(1, keepdims=True), atol=0.02)


def test_planted_repeats_are_found_and_decoys_are_left(spark):
    r = random.Random(8)
    docs, truth, decoys = [], {}, {}
    for k in range(60):
        number = f"{r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"
        decoy = str(r.randrange(10**15, 10**16))
        while luhn(decoy):
            decoy = str(int(decoy) + 1)
        text = f"call +1 ({number} now " + " ".join("w" for _ in range(r.randint(1, 9))) + f" or ({number} and not {decoy}"
        docs.append((k, text, "x", 1))
        truth[k], decoys[k] = text.rindex(number), text.index(decoy)
    frame = spark.createDataFrame(docs, DOCS)
    rows = find(frame, train(frame)).collect()
    added = {(x.doc_id, s.start) for x in rows for s in x.spans} - {(x.doc_id, s.start) for x in rows for s in x.base}
    right = {(k, at) for k, at in truth.items()}
    assert len(added & right) >= 0.9 * len(right)
    assert len(added & right) >= 0.9 * len(added)
    assert not added & set(decoys.items())


def test_digest(spark, case):
    docs = spark.createDataFrame(case, DOCS)
    rows = digest(docs, train(docs)).collect()
    assert len(rows) == len(case)
    texts = {d: t or "" for d, t, *_ in case}
    for r in rows:
        want = brute(texts[r.doc_id])
        text = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))
    assert find(docs, train(docs)).count() == len(case)


def test_redact(spark, case):
    docs = spark.createDataFrame(case, DOCS)
    rows = redact(docs, train(docs))
    assert rows.columns == docs.columns
    for r in rows.collect():
        assert r.text is None or (brute(r.text) == [] and (r.n_chars == len(r.text)))
    assert redacted("x 1.2.3.4 y", [(1, 2, 9)]) == "x [IP] y"
    assert redacted("abcdef", [(0, 0, 3), (3, 2, 5)]) == "[EMAIL]f"


def test_empty_and_query(spark, sf):
    nothing = spark.createDataFrame([], DOCS)
    assert digest(nothing, train(nothing)).count() == 0
    assert redact(nothing, train(nothing)).count() == 0
    texts = {r.doc_id: r.text for r in load(spark, sf, "documents").collect()}
    rows = op8_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    assert all(r.n_email + r.n_ip + r.n_card + r.n_phone == len(brute(texts[r.doc_id])) for r in rows)
