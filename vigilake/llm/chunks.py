"""Substring deduplication by content-defined chunks."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import LAST_ID, ship, without

#: One place in 16 may end a chunk, unless another does within the 7 bytes before it: 25 bytes on average.
MASK_BITS = 4
SHORTEST, LONGEST = 8, 128
#: Bytes that a run of repeated chunks must cover, and bytes of it that one earlier document must hold.
LEAST_RUN, LEAST_SHARED = 96, 64
#: Words that a repeated passage holds. A cut depends on this many bytes before it.
LEAST_WORDS, LOOK_BACK = 50, 23
#: Passages of LEAST_WORDS words in this many bytes or fewer are compared whole: too short to hold
#: enough whole chunks for sure (2 of 4,000 lost at 256 bytes by chunks alone, none from 272 on).
DENSE = 272
#: Stands for the text itself where it repeats its own passage.
OWN = -1 << 63
_SPACE = frozenset(b" \t\n\x0b\x0c\r")
_IS_SPACE = np.array([b in _SPACE for b in range(256)])


def gear_table(seed: int = 8) -> np.ndarray:
    """A random 32-bit value for each byte, from a seeded generator."""
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


def divided(rolling: np.ndarray, start: int, end: int) -> list[int]:
    """Ends between ``start`` and ``end``: where the hash is smallest, then so in each part still too long."""
    ends, todo = [], [(start, end)]
    while todo:
        a, b = todo.pop()
        gap = rolling[a + SHORTEST - 1:b - SHORTEST]
        last = a
        for inner in (np.flatnonzero(gap == gap.min()) + a + SHORTEST).tolist():
            if inner - last >= SHORTEST:
                ends.append(inner)
                if inner - last > LONGEST:
                    todo.append((last, inner))
                last = inner
        if b - last > LONGEST:
            todo.append((last, b))
    return sorted(ends)


def cuts(data: bytes, gear: np.ndarray, mask_bits: int = MASK_BITS) -> list[int]:
    """Ends of the chunks of ``data``, the last one its length.

    The gear hash at a byte is the sum of the values of the last 16 bytes, the older
    the further shifted left; doubling the window four times gives it for all bytes
    at once. A place qualifies where the bits that all 16 reach are zero, and ends
    a chunk if no other qualifies just before it. So ends depend on the 23 bytes
    before them alone, and an insertion moves only the chunks around it. Over 128
    bytes without an end are divided where their smallest hash stands, and again
    until no part is longer; in periodic text that is one phase of the period,
    whatever its surroundings.
    """
    if not data:
        return []
    rolling = gear[np.frombuffer(data, np.uint8)]
    width = 1
    while width < 16:
        longer = rolling.copy()
        if len(rolling) > width:
            longer[width:] += rolling[:-width] << np.uint32(width)
        rolling, width = longer, 2 * width
    mask = np.uint32(((1 << mask_bits) - 1) << 15)
    places = np.flatnonzero(rolling & mask == 0) + 1
    places = places[np.diff(places, prepend=-SHORTEST) >= SHORTEST] if len(places) else places
    ends, last = [], 0
    for end in (*places.tolist(), len(data)):
        if end - last > LONGEST:
            ends.extend(divided(rolling, last, end))
        if end > last:
            ends.append(end)
            last = end
    return ends


def digests(data: bytes, ends: list[int]) -> list[int]:
    """Signed 64-bit digests of the chunks."""
    out, last, digest = [], 0, xxhash.xxh3_64_intdigest
    for end in ends:
        out.append(digest(data[last:end]))
        last = end
    return np.array(out, np.uint64).view(np.int64).tolist()


def dense_passages(data: bytes, words: int = LEAST_WORDS, most: int = DENSE) -> tuple[list[int], list[int], list[int]]:
    """Digests, starts and ends of all passages of ``words`` whole words in ``most`` bytes or fewer."""
    space = _IS_SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    if len(starts) < words:
        return [], [], []
    starts, ends = starts[: len(starts) - words + 1], ends[words - 1:]
    short = ends - starts <= most
    starts, ends = starts[short].tolist(), ends[short].tolist()
    digest = xxhash.xxh3_64_intdigest
    found = np.array([digest(data[a:b]) for a, b in zip(starts, ends)], np.uint64).view(np.int64).tolist()
    return found, starts, ends


def dense_runs(found: list[int], starts: list[int], ends: list[int], earlier: dict[int, int]) -> list[tuple[int, int]]:
    """Byte ranges that repeated dense passages cover: those of ``earlier``, or that end before here in the same text."""
    covered, own = [], {}
    for d, a, b in zip(found, starts, ends):
        if d in earlier or own.setdefault(d, b) <= a:
            covered.append((a, b))
    return covered


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def runs(ends: list[int], owners: list[int | None], least: int, shared: int) -> list[tuple[int, int]]:
    """Byte ranges of ``least`` bytes or more that consecutive repeated chunks cover, ``shared`` of
    them in a row from one document: short chunks also meet by chance, but not in one place."""
    found, start, last, same, best, before = [], 0, 0, 0, 0, None
    for end, owner in zip((*ends, None), (*owners, None)):
        if owner is None:
            if last - start >= least and best >= shared:
                found.append((start, last))
            start, same, best = end, 0, 0
        else:
            same = (same if owner == before else 0) + end - last
            best = max(best, same)
        last, before = end, owner
    return found


def room(data: bytes, ends: list[int], start: int, end: int) -> int:
    """Most words that a repeated passage can hold whose repeated chunks cover ``start`` to ``end``.

    It may begin and stop inside the chunks beside the run, and begin further ahead by what
    the first cut inside it depends on.
    """
    before, after = bisect_left(ends, start), bisect_right(ends, end)
    low = ends[before - 1] if start and before else 0
    high = ends[after] if after < len(ends) else len(data)
    return len(data[max(0, low - LOOK_BACK if start else 0):high].split())


def snapped(data: bytes, start: int, end: int) -> tuple[int, int]:
    """The range shrunk to whole words, or to whole characters where it holds no white space."""
    a, b = start, end
    if a > 0:
        while a < end and data[a] not in _SPACE and data[a - 1] not in _SPACE:
            a += 1
    if b < len(data):
        while b > start and data[b] not in _SPACE and data[b - 1] not in _SPACE:
            b -= 1
    if a >= b:
        a, b = start, end
        while a < len(data) and data[a] & 0xC0 == 0x80:
            a += 1
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
    return a, max(a, b)


def _chunked(mask_bits: int, words: int):
    def emit(batches):
        gear = gear_table()
        for batch in batches:
            keys, found = [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                own = set(digests(data, cuts(data, gear, mask_bits)))
                own.update(dense_passages(data, words)[0])
                found.extend(own)
                keys.extend([key] * len(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int64()), pa.array(keys, pa.int64())], names=["digest", "key"])

    return emit


def _cleaner(mask_bits: int, least: int, shared: int, words: int, names: list[str]):
    def clean(batches):
        gear = gear_table()
        for batch in batches:
            texts, spans = [], []
            for text, seen in zip(batch.column("_text"), batch.column("_seen")):
                text = text.as_py()
                data = (text or "").encode("utf-8", "surrogatepass")
                ends = cuts(data, gear, mask_bits)
                earlier = {x["digest"]: x["owner"] for x in seen.as_py() or ()}
                dense = dense_runs(*dense_passages(data, words), earlier)
                owners = []
                for d in digests(data, ends):
                    owners.append(earlier.get(d))
                    earlier.setdefault(d, OWN)
                found = [r for r in runs(ends, owners, least, shared) if room(data, ends, *r) >= words]
                gone = merged([s for s in (snapped(data, *r) for r in found) if s[0] < s[1]] + dense)
                if gone:
                    kept, last = [], 0
                    for a, b in gone:
                        kept.append(data[last:a])
                        last = b
                    kept.append(data[last:])
                    text = b"".join(kept).decode("utf-8", "surrogatepass")
                texts.append(text)
                spans.append([{"start": a, "end": b} for a, b in gone])
            rest = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(texts, pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=[*names, "text", "cut_spans"])

    return clean


def without_repeats(docs: DataFrame, mask_bits: int = MASK_BITS, least: int = LEAST_RUN,
                    shared: int = LEAST_SHARED, words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with passages cut out that occur earlier; adds ``cut_spans``.

    Texts are split at content-defined places; a chunk is repeated if its digest
    occurs in a document of smaller id or earlier in the same text. Runs of repeated
    chunks over ``least`` bytes or more, with ``shared`` bytes in a row from one
    document, are removed, shrunk to whole words, so the document of the smallest id
    keeps its copy. A run is left alone if even with the chunks beside it, which the
    passage may reach into, it has no room for ``words`` words. ``cut_spans`` has
    the byte ranges in the old text. A passage of 50 words is some 290 bytes, eleven
    chunks on average; one of short words has few whole chunks or none, so passages of
    ``words`` words in up to ``DENSE`` bytes are also compared as wholes, each by the
    digest of its bytes, and cut whatever their chunks say. Of a text's own, the first
    copy that does not overlap stays.

    Null text stays null, an empty one empty. Null ids come last and count as one
    document, as do rows with one id: they are not cut against each other. Other
    columns pass through; an input column ``cut_spans`` is replaced.

    Digests have 64 bits; a false match would have to hit a whole run. They are
    grouped with map-side combine, so a chunk that a third of all documents share is
    one row per task. The digests that a document must give up are gathered per
    document; texts move once, to meet them, and are split again there.
    """
    ship(docs.sparkSession)
    key = F.coalesce("doc_id", F.lit(LAST_ID))
    occurs = docs.select(key.alias("key"), "text").mapInArrow(_chunked(mask_bits, words), "digest long, key long")
    owners = occurs.groupBy("digest").agg(F.min("key").alias("owner"), F.max("key").alias("last")).filter("owner < last")
    seen = (occurs.join(owners.select("digest", "owner"), "digest").filter("key <> owner")
            .groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("digest", "owner")).alias("_seen")))
    plain = without(docs, "cut_spans", "_key", "_seen", "_text")
    rest = [c for c in plain.columns if c != "text"]
    joined = (plain.select(*[F.col(f"`{c}`") for c in rest], F.col("text").alias("_text"), key.alias("_key"))
              .join(seen, "_key", "left").drop("_key"))
    fields = ", ".join(f"`{c}` {plain.schema[c].dataType.simpleString()}" for c in rest)
    cleaned = joined.mapInArrow(
        _cleaner(mask_bits, least, shared, words, rest),
        f"{fields}, text string, cut_spans array<struct<start: bigint, `end`: bigint>>")
    return cleaned.select(*[F.col(f"`{c}`") for c in plain.columns], "cut_spans")


def cut_documents(docs: DataFrame) -> DataFrame:
    """Documents with the passages cut, their new length and how much went."""
    found = without_repeats(docs.select("doc_id", "text"))
    gone = F.aggregate("cut_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "text", F.char_length("text").cast("long").alias("n_chars"),
                        F.size("cut_spans").alias("n_cuts"), gone.alias("cut_bytes"), "cut_spans")
