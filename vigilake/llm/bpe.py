"""BPE encoding by dynamic programming over prefixes, and decoding."""

from __future__ import annotations

import json
import unicodedata
from array import array
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import ship, without

_END = "\ue000"  # stands for the suffix that marks a word's end
#: The Unicode characters with the property White_Space.
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes of words that a task remembers, token pairs (some 100 bytes each) that a worker remembers, and ids or
#: documents that a task hands over at once.
WORD_BYTES, PAIRS, IDS_OUT, DOCS_OUT = 60_000_000, 300_000, 500_000, 512


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself, else the next from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Exact ids of single words from a vocabulary file's vocabulary and merges."""

    def __init__(self, vocabulary: str):
        model = json.loads(vocabulary)
        bpe = model["model"]
        suffix = bpe["end_of_word_suffix"]
        self.names = {i: t for t, i in bpe["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.names |= {i: t for t, i in self.specials.items()}
        inner = lambda t: t[: -len(suffix)] + _END if t.endswith(suffix) and t != suffix else t
        merges = [m if isinstance(m, list) else m.split(" ") for m in bpe["merges"]]
        self.ranks = {(inner(a), inner(b)): r for r, (a, b) in enumerate(merges)}
        self.tokens = {inner(t): i for t, i in bpe["vocab"].items()}
        self.letters = dict(enumerate(byte_letters()))
        self.fits: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.tokens.items():
            if self.merged(token) == [token]:  # else no merge order ever yields it
                self.automaton.add_word(token, (len(token), i, token))
        self.automaton.make_automaton()

    def merged(self, word: str, mid: int = 0) -> list[str]:
        """Merge the pair of lowest rank, leftmost first, until none is left or one spans the place ``mid``."""
        parts, rank_of = list(word), self.ranks.get
        if len(parts) > 1 and parts[-1] == _END:
            parts[-2:] = [parts[-2] + _END]
        found = [rank_of(p, 1 << 30) for p in zip(parts, parts[1:])]
        while found:
            rank = min(found)
            if rank == 1 << 30:
                break
            at = found.index(rank)
            if at == mid - 1:
                break
            if at < mid:
                mid -= 1
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = rank_of((parts[at - 1], parts[at]), 1 << 30)
            if at < len(found):
                found[at] = rank_of((parts[at], parts[at + 1]), 1 << 30)
        return parts

    def compatible(self, left: str, right: str, pair: int) -> bool:
        """Whether encoding both together gives these two tokens again; kept under the number of the pair."""
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        parts = self.merged(left + right, len(left))
        known = self.fits[pair] = parts == [left, right] and (left, right) not in self.ranks
        return known

    def encode(self, word: str) -> list[int]:
        """Ids of one word in byte letters.

        ``last[i]`` is the last token of the encoding of the first i letters. It is
        unique: the token that ends there and is compatible with the last token of
        what precedes it. The automaton yields all tokens that end at a place.
        """
        n, fits = len(word), self.fits
        last: list[tuple[int, int, str] | None] = [None] * (n + 2)
        for end, token in self.automaton.iter(word + _END):
            end += 1
            if last[end] is None and end != n:
                size, i, name = token
                if end > size:
                    before = last[end - size]
                    if before is None:
                        continue
                    pair = before[1] << 32 | i
                    known = fits.get(pair)
                    if known is None:
                        known = self.compatible(before[2], name, pair)
                    if not known:
                        continue
                last[end] = token
        ids, at = [], n + 1
        while at:
            size, i, _ = last[at]
            ids.append(i)
            at -= size
        return ids[::-1]


def pack(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class TextBpe(dict):
    """Words to (packed ids, decoded word); missing words are encoded. At half of ``WORD_BYTES`` the words become
    the older half, those of the former older half that were not met again are forgotten."""

    def __init__(self, vocabulary: str):
        super().__init__()
        self.size = 0
        self.older: dict[str, tuple] = {}
        self.words = WordBpe(vocabulary)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.words.specials)) + ")")
        self.pieces = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + _SPACES + r"\p{L}\p{N}]+")

    def __missing__(self, word):
        found = self.older.get(word)
        if found is None:
            plain = word
            if not (word.isascii() and word.isalnum()):  # else its bytes stand for themselves
                plain = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.words.letters)
            ids = self.words.encode(plain)
            found = pack(ids), " ".join([self.words.names[i] for i in ids])
        if len(word) < 64:
            self.size += 350 + 3 * len(word) + 2 * len(found[0])  # as Python keeps a word, its ids and its decoded form
            if self.size > WORD_BYTES // 2:
                self.older = dict(self)
                self.clear()
                self.size = 0
            self[word] = found
        return found

    def forget(self):
        self.clear()
        self.older = {}
        self.size = 0

    def found(self, text: str) -> list[tuple]:
        out = []
        for k, part in enumerate(self.special.split(text) if "<|" in text else (text,)):
            if k % 2:
                out.append((pack([self.words.specials[part]]), part))
            else:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                out.extend(map(self.__getitem__, self.pieces.findall(part.lower())))
        return out


_models: dict[int, TextBpe] = {}


def _model(shared) -> TextBpe:
    vocabulary = shared.value
    key = hash(vocabulary)
    if key not in _models:
        _models.clear()
        _models[key] = TextBpe(vocabulary)
    return _models[key]


def _coder(shared, names):
    ids_of, word_of = itemgetter(0), itemgetter(1)

    def run(batches):
        model = _model(shared)
        try:
            yield from coded(model, batches)
        finally:  # the worker lives on, and may serve other work; its pairs serve the next task
            model.forget()
            pa.default_memory_pool().release_unused()

    def coded(model, batches):
        for batch in batches:
            flat, ends, decoded, start, total = [], [0], [], 0, 0
            n = batch.num_rows
            for row, text in enumerate(batch.column("_text")):
                found = model.found(text.as_py() or "")
                packed = b"".join(map(ids_of, found))
                total += len(packed) // 4
                flat.append(packed)
                ends.append(total)
                decoded.append(" ".join(map(word_of, found)))
                if total > IDS_OUT or len(decoded) >= DOCS_OUT or row == n - 1:
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(flat), np.int32)))
                    rest = [batch.column(c).slice(start, row + 1 - start) for c in names]
                    yield pa.RecordBatch.from_arrays([*rest, ids, pa.array(decoded, pa.string())],
                                                     names=[*names, "ids", "decoded"])
                    flat, ends, decoded, start, total = [], [0], [], row + 1, 0

    return run


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (array of int) and ``decoded`` (the ids turned back to text) for each whole text.

    ``path`` is a vocabulary file on the driver (1.7 MB; its text is broadcast). Its
    normal form is taken: NFC, lower case letter by letter, pieces by its pattern,
    strings of special tokens as those tokens. Decoding joins tokens with spaces, as
    a file without a decoder asks. Null text has no ids and decodes to an empty
    string, like an empty one. Texts and words of any length are encoded whole;
    the work per word is linear in its length. Input columns ``ids`` and ``decoded``
    are replaced, others pass through; repeated rows stay.
    """
    ship(docs.sparkSession)
    with open(path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    plain = without(docs, "ids", "decoded", "_text")
    names = [c for c in plain.columns if c != text]
    fields = "".join(f"`{c}` {plain.schema[c].dataType.simpleString()}, " for c in names)
    return plain.select(*[F.col(f"`{c}`") for c in names], F.col(text).alias("_text")).mapInArrow(
        _coder(shared, names), f"{fields}ids array<int>, decoded string")


def joined_ids(ids: str = "ids") -> Column:
    return F.array_join(F.col(ids).cast("array<string>"), " ")


def encoded_documents(docs: DataFrame, path: str) -> DataFrame:
    coded = encode(docs.select("doc_id", "text"), path)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(joined_ids(), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
