import hashlib
import random
import re

import pytest

from tidemark.llm.decontaminate import decontaminate, digest, find_windows

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id bigint, text string, items string, n_chars bigint", "item_id bigint, text string"


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, t in items:
        w = words(t)
        n = min(8, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            if item is not None:
                windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, t, *_ in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def case():
    r = random.Random(3)
    vocabulary = ["a", "B", "c", "é", "d9", "日本"]
    say = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", ".", "-x"]) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([3, 1, 0, 8, 9, 20, 30])] + [(10, None), (None, "a b c"), (5, "again the same id")]
    docs = [(i, say(r.randint(0, 60)), "clash", 7) for i in range(40)]
    docs += [(100, f"start {items[6][1]} x {items[5][1]} end", None, None), (101, None, "x", 1), (102, "", "x", 1), (None, items[6][1], "x", 1), (100, items[6][1], "x", 1), (103, "z " * 30000 + items[6][1], "x", 1)]
    return docs, items


@pytest.mark.parametrize("limit", [16 << 20, 200])
def test_digest_is_that_of_brute_force(spark, case, limit):
    docs, items = case
    found = digest(find_windows(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), max_pass_bytes=limit))
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items)


@pytest.mark.parametrize("limit", [16 << 20, 200])
def test_removal(spark, case, limit):
    docs, items = case
    items = [i for i in items if len(words(i[1])) > 8]
    frame, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    clean = [d for d, b in zip(docs, (brute([d], items)[0] for d in docs), strict=True) if not b[5]]
    kept = decontaminate(frame, bench, remove="documents", max_pass_bytes=limit)
    assert kept.columns == frame.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(clean, key=str)
    for mode, most in (("spans", len(docs)), ("both", len(clean))):
        cut = decontaminate(frame, bench, remove=mode, max_pass_bytes=limit).collect()
        assert len(cut) == most
        assert all(b[2] == 0 for b in brute([(r.doc_id, r.text) for r in cut], items))
        assert all(r.n_chars == len(r.text) for r in cut if r.doc_id == 103)
    with pytest.raises(ValueError):
        decontaminate(frame, bench, remove="lines")


def test_empty_tables(spark, case):
    docs, items = case
    nothing, frame = spark.createDataFrame([], ITEMS), spark.createDataFrame(docs, DOCS)
    assert all(r.n_items == 0 and not r.contaminated for r in digest(find_windows(frame, nothing)).collect())
    assert digest(find_windows(frame.limit(0), spark.createDataFrame(items, ITEMS))).count() == 0
    assert decontaminate(frame, nothing).count() == len(docs)


def test_cuts_of_several_passes_reach_a_fixpoint(spark):
    one, two = ([f"{c}{k}" for k in range(16)] for c in "pq")
    items = [(1, " ".join(one)), (2, " ".join(two))]
    text = " ".join([*one[:4], *two[:10], *one[4:12], "end"])  # cutting item 2 joins a window of item 1 and so on
    text = " ".join([*two[:3], *text.split(), "x", *one[:2], *two[2:12], *one[2:9]])
    docs = [(k, text, "x", 1) for k in range(3)]
    frame, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for limit in (16 << 20, 10):
        rows = decontaminate(frame, bench, remove="spans", max_pass_bytes=limit).collect()
        assert len(rows) == 3 and all(b[2] == 0 for b in brute([(r.doc_id, r.text) for r in rows], items))
