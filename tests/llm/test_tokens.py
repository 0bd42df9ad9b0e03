"""Token counts and token alignment against the libraries on whole texts."""

import hashlib
import random
from collections import Counter

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from vigilake.llm import alignment, queries, tokencounts

WORD, BYTE, PIECE = (queries.vocabulary(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, word string, pair int, n_bytes string, _row string"
RNG = random.Random(8)
LETTERS = [chr(c) for c in [*range(0x20, 0x250), *range(0x300, 0x310), 0x3a3, 0x3c2, 0x2028, 0x85, 0x3000, 0xfeff, 0x1F600,
                            0x4e00, 0xac00, 0x0660, 0x2581, 0x20ac, 0x10400, 0x212b, 0x1e9e, 0x058c]]
PARTS = ["the", " ", "  ", "\n", "ing", "'s", "12", "<|endoftext|>", "<|startoftext|>", "<s>", "<0x0A>", "\t", " x", "Straße", "日本"]
TEXTS = ["".join(RNG.choice(PARTS) if RNG.random() < 0.7 else RNG.choice(LETTERS) for _ in range(RNG.randint(0, 30))) for _ in range(300)]
TEXTS += ["", None, " ", "   ", "\n", "a\x00b", "x" * 5000, "one two " * 8000, "a ", " a", "a  b   c", "a▁b", "two words", "two words"]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id here"), (None, None), (3, "the same id")]


def made(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "w", 1, "n", "r") for i, t in rows], SCHEMA).repartition(3)


def test_pre_tokens_are_the_library_s():
    library = Tokenizer.from_file(WORD)
    pre = tokencounts.PreTokens(open(WORD).read())
    model = tokencounts._piece_counter(open(WORD).read())
    texts = [t or "" for t in TEXTS] + ["".join(chr(c) for c in (RNG.randint(1, 0x2FFFF) for _ in range(12)) if not 0xD800 <= c < 0xE000)
                                       for _ in range(2000)]
    for text, coded in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        words, special = pre.split(text)
        assert special + sum(len(model.encode(w, add_special_tokens=False)) for w in words) == len(coded), repr(text)


@pytest.mark.parametrize("common", [2**21, 3])
def test_counts(spark, monkeypatch, common):
    """With few common pre-tokens nearly all meet their counts in the join."""
    monkeypatch.setattr(tokencounts, "COMMON", common)
    library = Tokenizer.from_file(WORD)
    got = tokencounts.documents_counted(made(spark), WORD, 100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = Counter()
    for i, t in ROWS:
        n = len(library.encode(t or "", add_special_tokens=False))
        want[i, len((t or "").encode()), n, n > 100] += 1
    assert Counter(map(tuple, got.collect())) == want
    assert tokencounts.documents_counted(made(spark, []), WORD).collect() == []


def aligned(texts):
    """By the bytes of all tokens of whole texts."""
    a, b = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    values = alignment.byte_values()
    found = []
    for text in texts:
        full = (" " + (text or "")).encode()
        a_ids = a.encode(full.decode(), add_special_tokens=False).ids
        b_ids = b.encode(text or "")
        a_bytes = [bytes(values[c] for c in a.id_to_token(i)) for i in a_ids]
        b_bytes = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
                   for p in map(b.id_to_piece, b_ids)]
        if not text or b"".join(a_bytes) != full or b"".join(b_bytes) != full:
            found.append((0, 0, 0, "", Counter()))
            continue
        spans = []
        for tokens in (a_bytes, b_bytes):
            ends = [0]
            for t in tokens:
                ends.append(ends[-1] + len(t))
            spans.append(ends)
        common = sorted(set(spans[0]) & set(spans[1]))
        groups = []
        for lo, hi in zip(common, common[1:]):
            groups.append("|".join(",".join(str(i) for i, s, e in zip(ids, ends, ends[1:]) if lo <= s and e <= hi)
                                   for ids, ends in ((a_ids, spans[0]), (b_ids, spans[1])))
                          if len(text) < 400 else "")
        links, k = Counter(), 0
        for i, s, e in zip(a_ids, spans[0], spans[0][1:]):
            while spans[1][k + 1] <= s:
                k += 1
            m = k
            while m < len(b_ids) and spans[1][m] < e:
                links[i, b_ids[m]] += 1
                m += 1
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if len(text) < 400 else None
        found.append((len(a_ids), len(b_ids), len(groups), sha, links))
    return found


@pytest.mark.parametrize("common", [2**21, 5])
def test_alignment(spark, monkeypatch, common):
    monkeypatch.setattr(alignment, "COMMON", common)
    got = alignment.aligned_tokens(made(spark), BYTE, PIECE)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = aligned([t for _, t in ROWS])
    docs = Counter(p for *_, links in found for p in links)
    best = {}
    for (a, _), n in docs.items():
        best[a] = max(n, best.get(a, 0))
    want = Counter()
    for (i, _), (n_a, n_b, n_groups, sha, links) in zip(ROWS, found):
        want[i, n_a, n_b, n_groups, sum(links.values()), sum(n for p, n in links.items() if docs[p] == best[p[0]]),
             sum(n * docs[p] for p, n in links.items()), sha] += 1
    rows = Counter(tuple(r[:7]) + ((r[7] if (r[0] is None or len(TEXTS[r[0]] or "") < 400) else None),) for r in got.collect())
    assert rows == want
    assert alignment.aligned_tokens(made(spark, []), BYTE, PIECE).collect() == []


def test_long_text_in_parts():
    pair = alignment.Pair(open(BYTE).read(), open(PIECE, "rb").read())
    texts = [t or "" for t in TEXTS]
    whole = [(*r[:5], r[5].tolist(), r[6].tolist()) for r in alignment.document_rows(pair, texts)]
    for together in (1, 40, 3000):
        assert [(*r[:5], r[5].tolist(), r[6].tolist()) for r in alignment.document_rows(pair, texts, together)] == whole
