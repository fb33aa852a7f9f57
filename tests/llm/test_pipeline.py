"""run() against the stages by hand on the smallest tables."""

import re
from collections import Counter

import corpus_pipeline
from tidemark.llm import quality
from tidemark.llm.common import load
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_nearcopies import brute as copies
from tests.llm.test_packing import check_placement
from tests.llm.test_pii import brute as personal


def test_stages(spark, sf):
    docs = load(spark, sf, "documents")
    frame, results = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = results[name] = stage(spark, frame, sf).cache()
        assert frame.columns == docs.columns
    weights = quality.model_for(docs, load(spark, sf, "labels"))
    accepted = {r.doc_id for r in quality.score(docs, weights).collect() if r.score >= quality.THRESHOLD}
    assert {r.doc_id for r in results["quality"].collect()} == accepted
    before = sorted(results["quality"].select("doc_id", "text").collect())
    roots = copies([r.text for r in before])
    assert sorted(r.doc_id for r in results["dedup"].collect()) == sorted({before[k].doc_id for k in roots})
    items = [(r.item_id, r.text) for r in load(spark, sf, "benchmark").collect()]
    before, after = (results[n].collect() for n in ("dedup", "decontaminate"))
    dirty = {b[0] for b in leaks([(r.doc_id, r.text) for r in before], items) if b[5]}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - dirty
    assert all(b[2] == 0 for b in leaks([(r.doc_id, r.text) for r in after], items))
    clean = results["pii"].collect()
    assert Counter(r.doc_id for r in clean) == Counter(r.doc_id for r in after)
    assert all(personal(r.text) == [] and r.n_chars == len(r.text) for r in clean if r.doc_id not in {x.doc_id for x in after if x.text == r.text})
    assert all(not re.search(r"[A-Za-z0-9]@[A-Za-z0-9]+\.[a-z]", r.text) for r in clean)
    from tokenizers import Tokenizer

    from tidemark.llm.packing import default_tokenizer

    rows = corpus_pipeline.run(spark, sf).collect()
    check_placement(rows, [(r.doc_id, r.text) for r in clean], Tokenizer.from_file(default_tokenizer()))
