"""Alignment of the tokens of two tokenizers by the bytes they cover."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from vigilake.llm.common import ship
from vigilake.session import fresh_path

#: An id pair in at least this share of all (document, pair) rows is looked up in a table that
#: every task holds: 2^21 entries of 8 bytes at most. All others are joined.
COMMON = 2**21
#: Stretches of text whose distinct ones a worker holds together, distinct ones that it aligns at once,
#: and id pairs of documents that it hands on at once.
TOGETHER, STRETCHES, AT_ONCE = 2_000_000, 10_000, 500_000
#: Fixed value: the character that stands for a space in sentencepiece's pieces.
_SPACE = "▁"


_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")


def byte_values() -> dict[str, int]:
    """The byte that each printable character stands for: itself, else by its place from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {chr(b) if b in plain else chr(next(spare)): b for b in range(256)}


def stretches(text: str) -> list[str]:
    """``text`` (its first character a space) in parts whose tokens don't depend on each other.

    Neither tokenizer has a token that reaches over the place before a space which follows
    no white space: in both vocabularies spaces only lead.
    """
    parts = _BEFORE_SPACE.split(text)
    if len(parts) > 1 and not parts[-1].strip(" "):  # spaces alone are no text of their own
        tail = parts.pop()
        parts[-1] += tail
    return parts


@dataclass
class Aligned:
    """What alignment makes of stretches: a number for each, and its linked pairs in a row of one array."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    first_link: np.ndarray
    pairs: np.ndarray
    groups: list[bytes]


class Pair:
    """Two tokenizers, and what they make of stretches of text."""

    def __init__(self, vocabulary: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(vocabulary)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=model)
        values = byte_values()
        vocab = json.loads(vocabulary)["model"]["vocab"]
        if max(vocab.values()) >= 1 << 16 or self.b.get_piece_size() > 1 << 15:
            raise ValueError("ids of A need 16 bits, of B 15")
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(values[c] for c in token)
        self.b_bytes = [self._piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, t)), np.int64) for t in (self.a_bytes, self.b_bytes))
        # an id with what follows it: in a group, at its end, at the end of a stretch
        self.names = [f"{i}{c}".encode() for i in range(len(self.a_bytes)) for c in ",|"]
        self.names += [f"{i}{c}".encode() for i in range(len(self.b_bytes)) for c in ",;\n"]

    @staticmethod
    def _piece_bytes(piece: str) -> bytes:
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(_SPACE, " ").encode()

    def tokens(self, texts: list[str], first_letter: np.ndarray):
        """Ids, tokens per text, and spans (letters of all texts in a row for A, bytes of each for B).

        Texts begin with a space, so that A may have them in a row as long as none ends in white space.
        """
        runs, start = [], 0
        for k, text in enumerate(texts):
            if text[-1].isspace():
                runs.append((start, k + 1))
                start = k + 1
        if start < len(texts):
            runs.append((start, len(texts)))
        coded = self.a.encode_batch(["".join(texts[i:j]) for i, j in runs], add_special_tokens=False)
        flat = chain.from_iterable
        ids = [c.ids for c in coded]
        a_ids = np.fromiter(flat(ids), np.int64)
        spans = np.fromiter(flat(flat(c.offsets for c in coded)), np.int64, 2 * len(a_ids)).reshape(-1, 2)
        spans += np.repeat(first_letter[[i for i, _ in runs]], list(map(len, ids)))[:, None]
        n_a = np.bincount(np.searchsorted(first_letter, spans[:, 0], "right") - 1, minlength=len(texts))
        # B adds the first space itself
        coded = self.b.encode([t[1:] for t in texts], return_type="offset_mapping", return_bytes=True, num_threads=1)
        ids = [c["ids"] for c in coded]
        b_ids = np.fromiter(flat(ids), np.int64)
        b = b_ids, np.array(list(map(len, ids)), np.int64), np.fromiter(
            flat(flat([c["offsets"] for c in coded])), np.int64, 2 * len(b_ids)).reshape(-1, 2)
        return (a_ids, n_a, spans), b

    @staticmethod
    def ends(spans: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Byte ends of consecutive tokens of ``sizes`` bytes. A span is a coarse cut: it holds where it is as
        long as its token and the next span starts at its end. Tokens that share a character, and
        bytes that stand for one, are cut by the decoded bytes so far."""
        refined = np.cumsum(sizes)
        start, end = spans.T
        whole = (end - start == sizes) & (end == refined)
        whole[:-1] &= end[:-1] == start[1:]
        return np.where(whole, end, refined)

    def aligned(self, texts: list[str]) -> tuple[Aligned, np.ndarray]:
        """The alignment of each stretch, and whether both tokenizers give back its bytes (if not: no tokens)."""
        first_letter = np.cumsum([0] + [len(t) for t in texts[:-1]])
        a, b = self.tokens(texts, first_letter)
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        good = np.ones(len(texts), bool)
        whole = b"".join(data)
        for table, (ids, counts, _) in ((self.a_bytes, a), (self.b_bytes, b)):
            if b"".join(map(table.__getitem__, ids.tolist())) != whole:
                last = np.cumsum(counts)
                for k, text in enumerate(data):
                    good[k] &= b"".join([table[i] for i in ids[last[k] - counts[k]:last[k]]]) == text
        if not good.all():
            found, _ = self.aligned([t for t, ok in zip(texts, good) if ok]) if good.any() else (None, None)
            return self._spread(found, good), good
        sizes = np.array(list(map(len, data)), np.int64)
        starts = np.cumsum(sizes) - sizes
        letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.concatenate([[0], np.cumsum(1 + (letters > 0x7F) + (letters > 0x7FF) + (letters > 0xFFFF), dtype=np.int64)])
        (a_ids, n_a, a_spans), (b_ids, n_b, b_spans) = a, b
        a_ends = self.ends(place[a_spans], self.a_sizes[a_ids])
        b_spans = b_spans + 1 + np.repeat(starts, n_b)[:, None]
        b_spans[np.cumsum(n_b) - n_b, 0] -= 1
        b_ends = self.ends(b_spans, self.b_sizes[b_ids])
        return self._grouped(a_ids, n_a, a_ends, b_ids, n_b, b_ends), good

    def all_aligned(self, texts: list[str], at_once: int = STRETCHES) -> tuple[Aligned, np.ndarray]:
        """``aligned``, some stretches at a time: the libraries' own results are large."""
        parts = [self.aligned(texts[i:i + at_once]) for i in range(0, len(texts), at_once)]
        joined = {f: np.concatenate([getattr(p, f) for p, _ in parts]) for f in ("n_a", "n_b", "n_groups", "n_links", "pairs")}
        return (Aligned(first_link=np.cumsum(joined["n_links"]) - joined["n_links"],
                        groups=list(chain.from_iterable(p.groups for p, _ in parts)), **joined),
                np.concatenate([good for _, good in parts]))

    def _grouped(self, a_ids, n_a, a_ends, b_ids, n_b, b_ends) -> Aligned:
        """Tokens end together where a group ends; every end of either begins a link of the next two."""
        at = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
        at = at[np.diff(at, prepend=-1) > 0]
        a_at, b_at = np.searchsorted(a_ends, at), np.searchsorted(b_ends, at)
        common = (a_ends[a_at] == at) & (b_ends[b_at] == at)
        a_stretch, b_stretch = (np.repeat(np.arange(len(n)), n) for n in (n_a, n_b))
        # position of each token among all: those of A of a group, then those of B
        a_upto, b_upto = a_at[common] + 1, b_at[common] + 1
        a_group = np.searchsorted(a_upto, np.arange(len(a_ids)), "right")
        b_group = np.searchsorted(b_upto, np.arange(len(b_ids)), "right")
        codes = np.empty(len(a_ids) + len(b_ids), np.int64)
        last = np.zeros(len(a_ids), np.int64)
        last[a_upto - 1] = 1
        codes[np.arange(len(a_ids)) + np.concatenate([[0], b_upto])[a_group]] = a_ids * 2 + last
        last = np.zeros(len(b_ids), np.int64)
        last[b_upto - 1] = 1
        last[np.cumsum(n_b) - 1] = 2
        codes[np.arange(len(b_ids)) + a_upto[b_group]] = 2 * len(self.a_bytes) + b_ids * 3 + last
        groups = b"".join(map(self.names.__getitem__, codes.tolist())).split(b"\n")[:-1]
        links = np.bincount(a_stretch[a_at], minlength=len(n_a))
        return Aligned(n_a, n_b, np.bincount(a_stretch[a_upto - 1], minlength=len(n_a)), links, np.cumsum(links) - links,
                       (a_ids[a_at] << 15 | b_ids[b_at]).astype(np.int32), groups)

    @staticmethod
    def _spread(found: Aligned | None, good: np.ndarray) -> Aligned:
        """``found`` of the good stretches as one of all, zeros for the others."""
        def put(values):
            out = np.zeros(len(good), np.int64)
            if found is not None:
                out[good] = values
            return out

        names = iter(found.groups if found else ())
        parts = [put(getattr(found, f, None)) for f in ("n_a", "n_b", "n_groups", "n_links", "first_link")]
        return Aligned(*parts, found.pairs if found else np.zeros(0, np.int32), [next(names) if ok else b"" for ok in good])


def gathered(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places ``first[k] .. first[k] + counts[k] - 1`` of all k in a row."""
    return np.arange(counts.sum()) + np.repeat(first - np.cumsum(counts) + counts, counts)


class Document:
    """Sums over the stretches of one text as they come."""

    def __init__(self):
        self.numbers, self.digest, self.parts, self.whole = np.zeros(4, np.int64), hashlib.sha256(), 0, True
        self.pairs, self.times = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def add(self, found: Aligned, good: np.ndarray, which: np.ndarray):
        self.whole = self.whole and bool(good[which].all())
        if not self.whole:
            return
        names = b";".join([found.groups[k] for k in which.tolist()])
        self.digest.update(b";" + names if self.parts else names)
        self.parts += 1
        self.numbers += [int(n[which].sum()) for n in (found.n_a, found.n_b, found.n_groups, found.n_links)]
        pairs = np.sort(found.pairs[gathered(found.first_link[which], found.n_links[which])])
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        pairs, times = pairs[first], np.diff(first, append=len(pairs))
        if len(self.pairs):  # an earlier part of the text
            pairs, times = np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times])
            order = np.argsort(pairs)
            pairs = pairs[order]
            first = np.flatnonzero(np.diff(pairs, prepend=-1))
            pairs, times = pairs[first], np.add.reduceat(times[order], first)
        self.pairs, self.times = pairs, times

    def row(self):
        """``n_a, n_b, n_groups, n_links, hash, pairs, times``."""
        if not self.whole or not self.parts:
            return 0, 0, 0, 0, "", np.zeros(0, np.int32), np.zeros(0, np.int32)
        return *self.numbers.tolist(), self.digest.hexdigest(), self.pairs, self.times.astype(np.int32)


def document_rows(pair: Pair, texts, together: int = TOGETHER):
    """A row of ``Document`` for each text, in order. The distinct ones of some ``together``
    stretches of text are aligned at a time; a longer text comes in several such parts."""
    open_docs: list[Document] = []
    known: defaultdict[str, int] = defaultdict(count().__next__)
    waiting, held = [], 0

    def settle():
        if known:
            found, good = pair.all_aligned(list(known))
            for doc, which in waiting:
                doc.add(found, good, which)
        known.clear()
        known.default_factory = count().__next__
        waiting.clear()
        rows = [d.row() for d in open_docs]
        open_docs.clear()
        return rows

    for text in texts:
        doc = Document()
        parts = stretches(" " + text) if text else []
        at = 0
        while at < len(parts):
            here = parts[at:at + together - held]
            waiting.append((doc, np.fromiter(map(known.__getitem__, here), np.int64, len(here))))
            held, at = held + len(here), at + len(here)
            if held >= together:  # the text goes on after these
                yield from settle()
                held = 0
        open_docs.append(doc)
    yield from settle()


def _aligner(vocabulary, model):
    def run(batches):
        pair = Pair(vocabulary.value, model.value)
        for batch in batches:
            start, rows, n = 0, [], 0
            found = document_rows(pair, (t.as_py() or "" for t in batch.column("_text")))
            for i, row in enumerate(found):
                rows.append(row)
                n += len(row[5])
                if n < AT_ONCE and i < batch.num_rows - 1:
                    continue
                ends = pa.array(np.cumsum([0] + [len(r[5]) for r in rows]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[k] for r in rows]))) for k in (5, 6)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row").slice(start, i + 1 - start), batch.column("_id").slice(start, i + 1 - start),
                     *[pa.array([r[k] for r in rows], pa.int64()) for k in range(4)],
                     pa.array([r[4] for r in rows], pa.string()), *lists],
                    names=["_row", "_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                start, rows, n = i + 1, [], 0

    return run


def _weighed(common, best):
    """Per document what common pairs add; beside it a row per other pair, ``pair`` null for the former."""
    def run(batches):
        (keys, counts), top = common.value, best.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            ends = pairs.offsets.to_numpy()
            ids, weight = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            row = np.repeat(batch.column("_row").to_numpy(), np.diff(ends))
            place = np.searchsorted(keys, ids)
            place[place == len(keys)] = 0
            hit = keys[place] == ids if len(keys) else np.zeros(len(ids), bool)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(ends))[hit]
            sums, firsts = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            if len(keys):
                count = counts[place[hit]]
                np.add.at(sums, doc, weight[hit] * count)
                np.add.at(firsts, doc, np.where(count == top[ids[hit] >> 15], weight[hit], 0))
            rest = np.flatnonzero(~hit)
            n, m = batch.num_rows, len(rest)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([batch.column("_row"), pa.array(row[rest])]),
                pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(ids[rest])]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(weight[rest])]),
                pa.concat_arrays([pa.array(firsts), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([pa.array(sums), pa.nulls(m, pa.int64())])],
                names=["_row", "pair", "times", "n_best", "count_sum"])

    return run


def linked_tokens(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text",
                  folder: str | None = None) -> DataFrame:
    """Per text its tokens of both tokenizers, cut into groups, and its linked id pairs.

    Columns: ``_row`` (a number of the row), ``_id`` (its ``key``), ``n_a, n_b, n_groups,
    n_links, groups_sha256``, and ``pairs`` (id of A times 2^15 plus id of B, ascending)
    with ``times``. Offsets that the libraries give are cuts of text between characters;
    where tokens share a character, or are bytes, their decoded bytes refine them. Texts
    are divided where neither tokenizer has a token across, so that a stretch which occurs
    again near by is aligned once. Written to ``folder`` (a new one in the shared place)
    and read back, since tokens cost far more than reading.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    with open(a_path, encoding="utf-8") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())
    with open(b_path, "rb") as file:
        model = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_id"), F.col(text).alias("_text"))
    schema = (f"_row long, _id {docs.schema[key].dataType.simpleString()}, n_a long, n_b long, n_groups long, "
              "n_links long, groups_sha256 string, pairs array<int>, times array<int>")
    folder = folder or fresh_path(spark, "links")
    rows.mapInArrow(_aligner(vocabulary, model), schema).write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def pair_counts(linked: DataFrame) -> DataFrame:
    """``pair, docs``: how many documents hold each id pair linked."""
    return linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))


def aligned_tokens(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each text.

    A pair's count is the number of documents that hold it linked. ``n_best`` are the links
    whose count is the highest of their A id, ``count_sum`` is the sum over all links. Pairs
    common in the corpus (at least one in ``COMMON`` of all rows, so at most that many) and
    the best count per A id (as many as A has tokens) are looked up in broadcast tables; other
    pairs meet their counts in a join, in which no key has more than that share of rows.

    Null and empty texts, and texts that a tokenizer does not give back byte by byte, have
    zeros and an empty hash. Repeated rows and rows without a key each stay a row and count
    as documents. Other columns aren't read.
    """
    spark = docs.sparkSession
    linked = linked_tokens(docs, a_path, b_path, key, text)
    folder = fresh_path(spark, "pair-counts")
    pair_counts(linked).write.parquet(folder)
    counts = spark.read.schema("pair int, docs long").parquet(folder)
    best = counts.groupBy(F.shiftright("pair", 15).alias("a")).agg(F.max("docs").alias("best"))
    least = (counts.agg(F.sum("docs")).first()[0] or 0) / COMMON
    common = counts.filter(F.col("docs") >= least).toArrow()
    order = np.argsort(common.column("pair").to_numpy())
    table = tuple(common.column(c).to_numpy()[order] for c in ("pair", "docs"))
    top = np.zeros(1 << 16, np.int64)
    tops = best.toArrow()
    top[tops.column("a").to_numpy()] = tops.column("best").to_numpy()
    context = spark.sparkContext
    weighed = linked.select("_row", "pairs", "times").mapInArrow(
        _weighed(context.broadcast(table), context.broadcast(top)),
        "_row long, pair int, times long, n_best long, count_sum long")
    rest = weighed.filter("pair IS NOT NULL").join(counts, "pair").join(
        F.broadcast(best), F.shiftright("pair", 15) == F.col("a")).select(
        "_row", F.when(F.col("docs") == F.col("best"), F.col("times")).otherwise(0).alias("n_best"),
        (F.col("times") * F.col("docs")).alias("count_sum"))
    known = weighed.filter("pair IS NULL").select("_row", "n_best", "count_sum")
    sums = known.unionByName(rest).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return linked.drop("pairs", "times").join(sums, "_row").select(
        F.col("_id").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
