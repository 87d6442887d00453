"""The corpus pipeline, stage by stage, against the operators and plain checks."""

import re

import corpus_pipeline
from lumigrid.llm import common, jaccard, pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, sf, small):
    docs, before = small, small.count()
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.table(stage(spark, docs, sf), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == small.columns
        seen[name] = (docs, out)
        docs = out
    kept = {r.doc_id for r in quality.judge(small).filter("kept").collect()}
    assert {r.doc_id for r in seen["quality_rules"][1].collect()} == kept and len(kept) < before
    came, left = seen["near_duplicates"]
    alone = {r.doc_id for r in jaccard.classes(came, 5, 80).filter("component_id = doc_id").collect()}
    assert {r.doc_id for r in left.collect()} == alone
    came, left = seen["personal_data"]
    assert left.count() == came.count() and pii.scan(left).filter("n_email + n_ip + n_card + n_phone > 0").count() == 0
    came, left = seen["source_mixing"]
    words = lambda t: sum(len(WORD.findall(r.text or "")) for r in t.collect())
    assert abs(words(left) - 1.5 * words(came)) < 0.02 * words(came) + 500
    pieces = seen["best_fit_packing"][1].collect()
    assert len([p for p in pieces if p.piece == 0]) == seen["best_fit_packing"][0].count()


def test_stages_take_odd_and_empty_tables(spark, sf, odd, empty):
    for docs in (odd, empty):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.table(stage(spark, docs, sf), "odd")
            assert docs.columns == columns
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).count()
