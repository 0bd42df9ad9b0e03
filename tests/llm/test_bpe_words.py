"""Words that texts go on to use are encoded once, however many others pass by; pair tests equal whole merges."""

import random

from vigilake.llm import bpe, queries


def model():
    with open(queries.vocabulary("word_bpe_49k.json"), encoding="utf-8") as file:
        return bpe.TextBpe(file.read())


def test_words_in_use_are_not_forgotten(monkeypatch):
    monkeypatch.setattr(bpe, "WORD_BYTES", 60_000)
    coder, rng, asked = model(), random.Random(1), []
    real = coder.words.encode
    monkeypatch.setattr(coder.words, "encode", lambda word: asked.append(word) or real(word))
    for _ in range(60):
        rare = " ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(20))
        coder.found(f"often {rare} été")
    assert asked.count("often") == 1 and len(asked) == 2 + 60 * 20
    assert coder.size <= 60_000


def test_pair_tests_equal_whole_merges():
    words, rng = model().words, random.Random(2)
    names = rng.sample(sorted(n for n in words.tokens if words.merged(n) == [n] and not n.endswith(bpe._END)), 400)
    ends = rng.sample(sorted(n for n in words.tokens if words.merged(n) == [n] and len(n) > 1), 400)
    fits = [words.compatible(a, b, k) for k, (a, b) in enumerate(zip(names, ends))]
    assert fits == [words.merged(a + b) == [a, b] for a, b in zip(names, ends)]
    assert True in fits and False in fits
