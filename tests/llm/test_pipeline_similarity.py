"""The near-duplicate stage links from a similarity of 0.8; op9 from 0.85."""

import corpus_pipeline
from epispan.llm import neardup
from epispan.llm.common import prepared


def near_copies():
    """Pairs (2k, 2k + 1) of 104 words, 100 shingles, of which the last ``changed`` words differ: 100 - c of 100 + c shared."""
    rows = []
    for k, changed in enumerate((8, 9, 10, 11, 11, 12, 13)):
        words = [f"p{k}w{j}" for j in range(104)]
        copy = words[: 104 - changed] + [f"q{k}w{j}" for j in range(changed)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    return rows


def similarities(rows):
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    return [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]


def test_stage_drops_copies_from_four_fifths_on(spark):
    rows = near_copies()
    alike = similarities(rows)
    assert any(0.8 <= x < 0.85 for x in alike) and min(alike) < 0.8 and max(alike) >= 0.85
    docs = prepared(spark).createDataFrame(rows, "doc_id bigint, text string")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near-duplicates"](spark, docs, "").collect()}
    assert kept == {2 * k for k in range(len(alike))} | {2 * k + 1 for k, x in enumerate(alike) if x < 0.8}
    own = {r.doc_id for r in neardup.near_duplicates(docs).where("doc_id = component_id").collect()}
    assert own == {2 * k for k in range(len(alike))} | {2 * k + 1 for k, x in enumerate(alike) if x < 0.85}
