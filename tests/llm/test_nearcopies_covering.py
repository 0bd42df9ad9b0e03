"""The near-copy stage searches by the covering masks of op10 over all fingerprints; what these link needs no other search."""

import random

import corpus_pipeline
from test_nearcopies import brute, edited
from test_operators import documents
from vigilake.llm import covering, nearcopies


def test_stage_goes_through_the_covering_search(spark, monkeypatch):
    rng = random.Random(8)
    texts = []
    for _ in range(6):
        base = " ".join(f"w{rng.randrange(500)}" for _ in range(1200))
        texts += [base, base.upper(), *(edited(base, 0.001, rng) for _ in range(6))]
    near = {covering.fingerprint(t, nearcopies.SHINGLE) for t in texts}
    assert any(0 < (a ^ b).bit_count() <= covering.RADIUS for a in near for b in near)
    searched, tried = [], []
    monkeypatch.setattr(covering, "links", lambda fps, *a, real=covering.links, **k: (
        searched.extend(r["fp"] for r in fps.collect()), real(fps, *a, **k))[1])
    monkeypatch.setattr(nearcopies, "_apart", lambda *a, real=nearcopies._apart: tried.append(real(*a)) or tried[-1])
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    got = corpus_pipeline.near_copy_stage(spark, documents(spark, rows), "").collect()
    assert sorted(r["doc_id"] for r in got) == brute(rows) == list(range(0, 48, 8))
    assert sorted(searched) == sorted(covering._signed(f) for f in near)
    assert tried[0].count() < len(near)


def test_common_shingles_are_learned_from_a_share_of_all_texts(spark):
    rows = [(i, f"one passage that all the texts hold and then {i} {i + 1} {i + 2}", "en", "a") for i in range(600)]
    found, often = nearcopies.common_shingles(documents(spark, rows), sample=5)
    assert len(found) and often.max() > 20  # 5 texts of 600 show no more than some 5
