"""Keyword matching as Catalyst expressions.

Substring tests are the default; ``match="word"`` asks for whole words.
Lower-case the text once, in a column of its own, before calling these: the
lexicons are lower-case already.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    Catalyst copies the text of an aliased expression into every filter it pushes
    down, so a costly column (a lower-cased text, a keyword scan, a regex) used by
    a later filter would run again there. Passing the columns through a
    one-element generator gives them a value that filters refer to."""
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def _test(text: Column, word: str, match: str) -> Column:
    if match == "substring":
        return text.contains(word)
    if match == "word":
        return text.rlike(r"\b" + re.escape(word) + r"\b")
    raise ValueError(f"match must be 'substring' or 'word', not {match!r}")


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def has_any(text: Column, words: Sequence[str], match: str = "substring") -> Column:
    return any_of(_test(text, w, match) for w in words)


def count_hits(text: Column, words: Sequence[str], match: str = "substring") -> Column:
    return sum((_test(text, w, match).cast("int") for w in words), F.lit(0))


def weighted_hits(text: Column, weighted: Iterable[tuple[str, float]]) -> Column:
    return sum(
        (F.when(text.contains(w), F.lit(float(v))).otherwise(F.lit(0.0)) for w, v in weighted),
        F.lit(0.0),
    )


def hit_words(text: Column, words: Sequence[str]) -> Column:
    """Array of the words found, in list order, repeats kept."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def first_label(text: Column, lexicon: Mapping[str, Sequence[str]], default,
                match: str = "substring") -> Column:
    """Label of the first lexicon entry with a match; entry order is priority."""
    out = None
    for label, words in lexicon.items():
        test = has_any(text, words, match)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(default))


def first_word(text: Column, words: Sequence[str], default=None) -> Column:
    """First word of the list that the text holds, in list order."""
    found = F.try_element_at(hit_words(text, words), F.lit(1))
    return F.coalesce(found, F.lit(default).cast("string"))


def steps(value: Column, cuts: Sequence[tuple[float, object]], otherwise, op: str = "ge") -> Column:
    """CASE ladder: first cut that ``value`` reaches decides."""
    test = {
        "ge": lambda c: value >= F.lit(c), "gt": lambda c: value > F.lit(c),
        "lt": lambda c: value < F.lit(c),
    }[op]
    out = None
    for cut, label in cuts:
        out = F.when(test(cut), F.lit(label)) if out is None else out.when(test(cut), F.lit(label))
    return out.otherwise(F.lit(otherwise))


def lookup(value: Column, table: Mapping[str, object], default) -> Column:
    out = None
    for key, result in table.items():
        out = F.when(value == key, F.lit(result)) if out is None else out.when(value == key, F.lit(result))
    return out.otherwise(F.lit(default))


def round_half_up(value: Column) -> Column:
    """Nearest integer with .5 going up, also below zero."""
    return F.floor(value + F.lit(0.5)).cast("bigint")
