"""Passages of many short words, too few bytes for whole chunks."""

import random

import pytest

from test_operators import documents, prose
from vigilake.llm import chunks


def short_words(n, most, rng):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, most))) for _ in range(n))


@pytest.mark.parametrize("most, words", [(1, 50), (2, 51), (2, 60), (4, 51)])
def test_dense_passage_is_cut(spark, most, words):
    rng = random.Random(17)
    rows, passages = [], {}
    for i in range(0, 200, 2):
        p = passages[i + 1] = short_words(words, most, rng)
        rows += [(i, f"{prose(30, rng)} {p} {prose(30, rng)}", "en", "a"), (i + 1, f"{prose(20, rng)} {p} {prose(40, rng)}", "en", "a")]
    old = {r[0]: r[1] for r in rows}
    got = {r["doc_id"]: r for r in chunks.without_repeats(documents(spark, rows)).collect()}
    for i, p in passages.items():
        assert p not in got[i]["text"] and p in got[i - 1]["text"]
        assert got[i - 1]["text"] == old[i - 1]


def test_under_fifty_words_stays(spark):
    rng = random.Random(18)
    p = short_words(49, 2, rng)
    rows = [(i, f"{prose(30, rng)} start{i} {p} end{i} {prose(30, rng)}", "en", "a") for i in (1, 2)]
    assert [r["text"] for r in chunks.without_repeats(documents(spark, rows)).orderBy("doc_id").collect()] == [r[1] for r in rows]


def test_own_passage_keeps_the_first_copy(spark):
    p = short_words(60, 1, random.Random(19))
    got = chunks.without_repeats(documents(spark, [(1, f"{p} between {p} after", "en", "a")]))
    one = got.first()["text"]
    assert one.count(p) == 1 and one.startswith(p + " between") and one.endswith("after")
