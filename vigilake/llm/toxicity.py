"""Toxicity by a counterfactually regularised classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import ship, without
from vigilake.session import cut

#: Labelled rows that training reads at most, taken in order of a hash of their id.
TRAINING_ROWS = 16_000
#: Words that training weighs at most: those whose counts differ most from chance; fewest rows of a word.
TRAINING_WORDS, LEAST_ROWS = 4096, 8
THRESHOLD = 0.3
NEUTRAL = "people"
#: Terms that may stand for one another without changing what a sentence does.
IDENTITY = {
    "religion": ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist"),
    "origin": ("american", "african", "asian", "european", "arab", "mexican", "indian", "immigrant", "refugee"),
    "colour": ("black", "white", "brown"),
    "gender": ("man", "woman", "men", "women", "transgender", "nonbinary"),
    "orientation": ("gay", "lesbian", "bisexual", "straight", "queer"),
    "ability": ("disabled", "deaf", "blind", "autistic"),
}
_GROUP = {t: g for g, terms in IDENTITY.items() for t in terms}
_words = re.compile(r"\w+").findall


def words_of(text: str | None) -> set[str]:
    """Distinct lower-cased words, and the first four letters of longer ones as stems (with a hyphen).

    Identity terms have no stem: a swap of the word is a swap of all that it adds.
    """
    words = set(_words((text or "").lower()))
    return words | {w[:4] + "-" for w in words if len(w) > 4 and w not in _GROUP and w != NEUTRAL}


def swaps(words: set[str]) -> list[tuple[str, str]]:
    """(term, replacement) pairs: each identity term against the others of its group, and a neutral word."""
    return [(t, r) for t in sorted(words & _GROUP.keys()) for r in (*IDENTITY[_GROUP[t]], NEUTRAL) if r != t]


@dataclass
class Classifier:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fit(cls, texts: list[set[str]], labels: list[int], fair=10.0, rounds=300, sparse=None) -> Classifier:
        """Logistic loss + ``sparse`` * L1 + ``fair`` * mean squared change of the score under a swap.

        Accelerated proximal gradient steps over presence of words, each divided by
        its standard deviation, so that a rare word can speak as clearly as a common
        one; ``sparse`` defaults to what chance reaches over all words. The swap term
        counts each (sentence, swap) once; it pulls the weights of a group's terms
        and of the neutral word together, so mentioning a group changes no score.
        """
        if not texts or not 0 < sum(labels) < len(labels):
            return cls(float(np.log((sum(labels) + 0.5) / (len(labels) - sum(labels) + 0.5))) if texts else -3.0)
        column = {w: i for i, w in enumerate(sorted(set().union(*texts)))}
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        col = np.fromiter((column[w] for t in texts for w in t), np.int64, len(row))
        n, m = len(texts), len(column) + 1
        part = np.append(np.bincount(col, minlength=m - 1)[:m - 1] / n, 0.5)
        scale = 1 / np.sqrt(np.maximum(part * (1 - part), 0.5 / n))
        scale[-1] = 1.0  # the last column is the bias
        row, col = np.concatenate((row, np.arange(n))), np.concatenate((col, np.full(n, m - 1)))
        pairs = Counter((t, r) for x in texts for t, r in swaps(x))
        old = np.array([column[t] for t, _ in pairs], int)
        new = np.array([column.get(r, -1) for _, r in pairs], int)
        share = np.array(list(pairs.values()), float) / max(1, sum(pairs.values()))
        y = np.array(labels, float)
        if sparse is None:
            sparse = np.sqrt(y.mean() * (1 - y.mean()) * 2 * np.log(m) / n)

        def change(w):
            return w[old] - np.where(new >= 0, w[new], 0.0)

        def spread(d):
            known = new >= 0
            return np.bincount(old, d, m) - np.bincount(new[known], d[known], m)

        def gradient(w):
            w = w * scale
            p = 1 / (1 + np.exp(-np.bincount(row, w[col], n)))
            return scale * (np.bincount(col, (p - y)[row], m) / n + spread(2 * fair * share * change(w)))

        v = np.random.default_rng(1).normal(size=m)
        for _ in range(30):  # the steepest curvature sets the step
            u = v / np.linalg.norm(v) * scale
            v = scale * (0.25 * np.bincount(col, np.bincount(row, u[col], n)[row], m) / n
                         + spread(2 * fair * share * change(u)))
        step = 0.9 / np.linalg.norm(v)
        w, ahead, t = np.zeros(m), np.zeros(m), 1.0
        for _ in range(rounds):
            moved = ahead - step * gradient(ahead)
            kept = np.sign(moved) * np.maximum(np.abs(moved) - step * sparse, 0)
            kept[-1] = moved[-1]
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead = kept + (t - 1) / after * (kept - w)
            w, t = kept, after
        w *= scale
        return cls(float(w[-1]), {x: float(w[i]) for x, i in column.items() if abs(w[i]) > 1e-9})

    def score(self, text: str | None) -> float:
        z = self.bias + sum(map(self.weights.__getitem__, words_of(text) & self.weights.keys()))
        return float(1 / (1 + np.exp(-min(50.0, max(-50.0, z)))))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, words: int = TRAINING_WORDS) -> Classifier:
    """Fit on at most ``rows`` labelled documents outside the held-out fold.

    They are the first in order of a hash of their id. Their distinct words are
    counted by label in Spark; the ``words`` whose counts in toxic documents differ
    most from chance, and all identity terms, are features. An id with several
    labels is toxic if one says so. Rows without id, label or document teach
    nothing; without both classes the score is the share of toxic labels.
    """
    ship(docs.sparkSession)
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))

    @F.pandas_udf("array<string>")
    def distinct_words(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: sorted(words_of(t)))

    sampled = cut(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
                  .select("doc_id", "toxic", distinct_words(F.coalesce("text", F.lit(""))).alias("words")))
    one = sampled.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.count("*").alias("copies"))
    n, toxic = one.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < n:
        return Classifier.fit([set()] * n, [int(i < toxic) for i in range(n)])
    terms = [*_GROUP, NEUTRAL]
    part = F.col("n") / n
    chosen = (sampled.select("toxic", F.explode("words").alias("word")).groupBy("word")
              .agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
              .filter(F.col("word").isin(terms) | (F.col("n") >= LEAST_ROWS))
              .orderBy(F.desc(F.col("word").isin(terms)),
                       F.desc(F.abs(F.col("k") - F.col("n") * toxic / n) / F.sqrt(F.col("n") * F.greatest(1 - part, F.lit(1 / n)))),
                       "word")
              .limit(words).select("word"))
    held = (sampled.select("doc_id", F.explode("words").alias("word")).join(F.broadcast(chosen), "word")
            .groupBy("doc_id").agg(F.collect_set("word").alias("words")))
    taught = one.join(held, "doc_id", "left").orderBy("doc_id").select("toxic", "words").collect()
    return Classifier.fit([set(r["words"] or ()) for r in taught], [r["toxic"] for r in taught])


def add_scores(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) of each whole text; null and empty texts get the score of no word."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for batch in texts:
            yield batch.map(model.score, na_action=None).astype("float64")

    return without(docs, "score").withColumn("score", scored(F.coalesce(text, F.lit(""))))


def document_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = add_scores(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
