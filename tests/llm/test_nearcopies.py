"""The near-copy stage against brute force over all pairs."""

import random

import numpy as np

import corpus_pipeline
from test_operators import documents, roots
from vigilake.llm import nearcopies


def brute(rows):
    """Ids kept: the smallest of each group that pairs of similar five-word shingle sets connect."""
    sets = []
    for _, text, *_ in rows:
        words = text.lower().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))})
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)
             if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    groups = {}
    for row, root in zip(rows, roots(len(rows), pairs)):
        groups.setdefault(root, []).append(row[0])
    return sorted(min(ids) for ids in groups.values())


def edited(text, share, rng):
    words = text.split()
    for at in rng.sample(range(len(words)), round(share * len(words))):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


def test_stage_keeps_what_brute_force_keeps(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(30):
        base = " ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice((6, 20, 60, 150, 400))))
        texts += [base] + [edited(base, share, rng) for share in (0, 0.005, 0.01, 0.02, 0.022, 0.025, 0.03, 0.1)]
    page = " ".join(f"p{i}" for i in range(120))  # one large group, and texts that share half of it only
    texts += [edited(page, 0.01, rng) for _ in range(80)]
    texts += [" ".join(page.split()[:60]) + " " + " ".join(f"q{rng.random()}" for _ in range(60)) for _ in range(20)]
    rng.shuffle(texts)
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    docs = documents(spark, rows)
    want = brute(rows)
    got = corpus_pipeline.near_copy_stage(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in got) == want
    small = nearcopies.one_of_each(docs, block=8)
    assert sorted(r["doc_id"] for r in small.collect()) == want


def test_chains_unlike_their_first_member_and_many_blocks(spark, monkeypatch):
    """Copies edited so far that most pairs stay just under the similarity: found in rounds, confirmed in small blocks."""
    rng = random.Random(5)
    page = " ".join(f"p{i}" for i in range(200))
    texts = [edited(page, share, rng) for share in (0.01, 0.012, 0.016, 0.02, 0.024) for _ in range(24)]
    for _ in range(12):  # each the next link of one chain whose ends share little
        page = edited(page, 0.015, rng)
        texts.append(page)
    rng.shuffle(texts)
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    want = brute(rows)
    assert 1 < len(want) < len(rows) // 2
    monkeypatch.setattr(nearcopies, "HELD", 1000)
    monkeypatch.setattr(nearcopies, "WORTH", 1000)
    got = nearcopies.one_of_each(documents(spark, rows), block=16).collect()
    assert sorted(r["doc_id"] for r in got) == want


def test_marks_never_differ_more_than_the_sets():
    rng = np.random.default_rng(3)
    alike = nearcopies._alike(0.8)
    for _ in range(300):
        base = rng.integers(-2**63, 2**63, rng.integers(1, 600))
        kept = base[rng.random(len(base)) < rng.choice((0.5, 0.8, 0.9, 0.97, 1.0))]
        other = np.concatenate((kept, rng.integers(-2**63, 2**63, rng.integers(0, 60))))
        one, two = np.unique(base), np.unique(other)
        if not len(two):
            continue
        met = len(np.intersect1d(one, two))
        if met >= 0.8 * (len(one) + len(two) - met):
            assert alike(nearcopies.marks(one), nearcopies.marks(two))
    far = [np.unique(rng.integers(-2**63, 2**63, 400)) for _ in range(2)]
    assert not alike(nearcopies.marks(far[0]), nearcopies.marks(far[1]))
    assert len(nearcopies.marks(np.zeros(0, np.int64))) == 5
