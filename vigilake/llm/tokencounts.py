"""Token counts from the pieces of distinct pre-tokens, without any ids."""

from __future__ import annotations

import json
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigilake.llm.common import ship
from vigilake.session import fresh_path

#: A pre-token in at least this share of all (document, pre-token) rows is looked up in a table
#: that every task holds: 2^21 entries of 12 bytes at most. All others are joined.
COMMON = 2**21
#: Distinct pre-tokens that a worker holds before it hands them on, and pre-tokens it looks up at once.
HELD, AT_ONCE = 100_000, 200_000
#: White space, letters and numbers below U+02B0 (U+0130 aside, which lower case takes beyond)
#: and dashes and quotes. The library and Python agree on texts of these; others the library divides itself.
_SPACES, _LETTERS, _NUMBERS = r"\t-\r \x85\xa0\u2028\u2029", "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u02af", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_UNUSUAL = re.compile("[^\x00-\u012f\u0131-\u02af\u2010-\u2027]")


class PreTokens:
    """The pre-tokens of whole texts as the vocabulary file asks: normal form, lower case, its pattern."""

    def __init__(self, vocabulary: str):
        plan = json.loads(vocabulary)
        names = [t["content"] for t in plan["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.pieces = re.compile(
            f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
        plan["pre_tokenizer"] = plan["pre_tokenizer"]["pretokenizers"][0]
        library = Tokenizer.from_str(json.dumps(plan))
        self.normalized, self.divided = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens in order, and how many strings of special tokens stand between them."""
        parts = self.special.split(text) if self.special else [text]
        found: list[str] = []
        for part in parts:
            if _UNUSUAL.search(part):
                found += [piece for piece, _ in self.divided(self.normalized(part))]
            else:
                found += self.pieces.findall(part.lower())
        return found, len(parts) - 1


def _piece_counter(vocabulary: str) -> Tokenizer:
    """The library's own model over ready pre-tokens: nothing is normalised or divided again."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    plan = json.loads(vocabulary)
    plan |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {
        "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}
    return Tokenizer.from_str(json.dumps(plan))


def _distinct(shared):
    """(word, docs): in how many documents each pre-token stands, summed over what a worker holds at a time."""
    def run(batches):
        pre, held = PreTokens(shared.value), Counter()

        def handed():
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())],
                                             names=["word", "docs"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                held.update(set(pre.split(text.as_py() or "")[0]))
                if len(held) >= HELD:
                    yield handed()
        yield handed()

    return run


def _measured(shared):
    def run(batches):
        model = _piece_counter(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 10_000):
                part = batch.slice(start, 10_000)
                pieces = [len(e) for e in model.encode_batch(part.column("word").to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pieces, pa.int64())],
                                                 names=["word", "docs", "pieces"])

    return run


def _summed(shared, common):
    """Per document one row with the sum over common pre-tokens; beside it a row per other pre-token."""
    def run(batches):
        pre, (keys, pieces) = PreTokens(shared.value), common.value
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            start, words, times, of = 0, [], [], []
            known, n = [], batch.num_rows
            ids = batch.column("_row").to_numpy()
            for i, text in enumerate(batch.column("_text")):
                found, special = pre.split(text.as_py() or "")
                tally = Counter(found)
                words += tally.keys()
                times += tally.values()
                of += [i - start] * len(tally)
                known.append(special)
                if len(words) < AT_ONCE and i < n - 1:
                    continue
                hashes = np.array([digest(w.encode("utf-8", "surrogatepass"), 42) for w in words], np.uint64)
                place = np.searchsorted(keys, hashes)
                place[place == len(keys)] = 0
                hit = keys[place] == hashes if len(keys) else np.zeros(len(words), bool)
                counts, doc = np.array(times, np.int64), np.array(of, np.int64)
                sums = np.array(known, np.int64)
                if len(keys):
                    np.add.at(sums, doc[hit], counts[hit] * pieces[place[hit]])
                rest = np.flatnonzero(~hit)
                rows = ids[start:i + 1]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([rows, rows[doc[rest]]])),
                    pa.concat_arrays([batch.column("_id").slice(start, i + 1 - start),
                                      pa.nulls(len(rest), batch.column("_id").type)]),
                    pa.concat_arrays([batch.column("n_bytes").slice(start, i + 1 - start), pa.nulls(len(rest), pa.int64())]),
                    pa.array([f" {r}" for r in rows] + [words[k] for k in rest], pa.string()),
                    pa.array(np.concatenate([sums, counts[rest]]))], names=["_row", "_id", "n_bytes", "word", "times"])
                start, words, times, of, known = i + 1, [], [], [], []

    return run


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens``: tokens of each whole text under the vocabulary file ``path``.

    Pieces are counted once per distinct pre-token of all texts, by the library's model.
    Each document then needs only how often it holds each pre-token: those common in the
    corpus (at least one in ``COMMON`` of all rows, so at most that many) are looked up in a
    broadcast table of 64-bit hashes, the others meet their counts in a join. A hash is in
    the table only if no other pre-token of the corpus has it, so the look-up is exact. No
    pre-token left to the join has more than that share of rows, so no key of it is hot.

    ``path`` is a file of the tokenizers library on the driver, with this pattern: word ends,
    no post-processing. Strings of special tokens inside texts count as one token each. Null
    text has 0 bytes and 0 tokens, as has an empty one; repeated rows and rows without a key
    each stay a row; other columns aren't read.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    if not path.endswith(".json"):
        raise ValueError(f"{path}: not a vocabulary file of the tokenizers library")
    with open(path, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())
    words = (docs.select(F.col(text).alias("text")).mapInArrow(_distinct(shared), "word string, docs long")
             .groupBy("word").agg(F.sum("docs").alias("docs"))
             .mapInArrow(_measured(shared), "word string, docs long, pieces long"))
    folder = fresh_path(spark, "pieces")
    words.write.parquet(folder)
    words = spark.read.schema(words.schema).parquet(folder)
    least = (words.agg(F.sum("docs")).first()[0] or 0) / COMMON
    common = (words.groupBy(F.xxhash64("word").alias("hash"))
              .agg(F.count("*").alias("n"), F.max("docs").alias("docs"), F.max("pieces").alias("pieces"))
              .filter((F.col("n") == 1) & (F.col("docs") >= least)).select("hash", F.col("pieces").cast("int"))).toArrow()
    keys = common.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    table = spark.sparkContext.broadcast((keys[order], common.column("pieces").to_numpy()[order]))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_id"), F.col(text).alias("_text"),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    tallied = rows.mapInArrow(_summed(shared, table), f"_row long, _id {docs.schema[key].dataType.simpleString()}, "
                                                      "n_bytes long, word string, times long")
    each = tallied.join(words.select("word", "pieces"), "word", "left")
    return each.groupBy("_row").agg(
        F.max("_id").alias(key), F.max("n_bytes").alias("n_bytes"),
        F.sum(F.col("times") * F.coalesce("pieces", F.lit(1))).alias("n_tokens")).drop("_row")


def documents_counted(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    return token_counts(docs, path).withColumn("over_limit", F.col("n_tokens") > limit)
