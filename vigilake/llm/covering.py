"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.llm.common import components, ship, without
from vigilake.session import cut

SHINGLE = 3
SEED = 42
RADIUS = 3
BITS = 64
#: Fingerprints of one bucket that one comparison holds from either side.
BLOCK = 1024
#: Texts whose further values a worker holds at once.
TEXTS = 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a whole text: a bit is 1 if set in over half of the shingle hashes.

    A-Z are lower-cased; words are runs without ASCII white space; shingles count
    as often as they occur. Too few words: the whole sequence is one shingle. No
    word, or null: 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in
                       zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1:] - 1).tolist())], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at:at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(texts, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprints of some texts as signed longs."""
    return np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64)


def add_fingerprint(docs: DataFrame, text: str = "text", shingle: int = SHINGLE,
                    also: Callable[[list[str | None]], list[pa.Array]] | None = None,
                    fields: list[T.StructField] = ()) -> DataFrame:
    """Add ``fp``: the 64 bits as a signed long.

    ``also`` makes further columns, ``fields``, of up to ``TEXTS`` texts at once. They come from the same
    pass: two Python functions would hold two workers a task, and Spark keeps all that ever were. Input
    columns with the added names are replaced.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(fingerprints(batch, shingle))

    if also is None:
        return docs.withColumn("fp", simhash(text))
    fields = [T.StructField("fp", T.LongType()), *fields]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for start in range(0, len(batch), TEXTS):
                texts = batch[start:start + TEXTS].to_pylist()
                yield pa.StructArray.from_arrays([pa.array(fingerprints(texts, shingle)), *also(texts)],
                                                 names=[f.name for f in fields])

    found = F.arrow_udf(run, T.StructType(fields))
    plain = without(docs, *[f.name for f in fields])
    return plain.withColumn("_found", found(text)).select(*[F.col(f"`{c}`") for c in plain.columns], "_found.*")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The 2^(radius+1) - 1 masks of a covering family (Pagh 2016).

    Bit i gets a nonzero vector of radius+1 bits, in turn; the mask of a nonzero
    vector v keeps the bits whose vector has odd overlap with v. At most ``radius``
    differing bits span less than the whole space, so some v is orthogonal to all
    of them: its mask drops every differing bit, and the pair collides there.
    """
    top = 1 << (radius + 1)
    vectors = [i % (top - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if bin(vectors[i] & v).count("1") % 2) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (differing bits <= radius) inside runs of equal ``group`` as few edges: each
    linked fingerprint with the first one that it reaches in its run."""
    label = np.arange(len(fp))
    step = 1
    while step < len(fp):
        same = group[step:] == group[:-step]
        if not same.any():
            break
        left = np.flatnonzero(same)
        left = left[np.bitwise_count(fp[left] ^ fp[left + step]) <= radius]
        while True:  # hang the larger root under the smaller until both ends agree
            one, two = label[left], label[left + step]
            if (one == two).all():
                break
            np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
            while (deeper := label[label] != label).any():
                label[deeper] = label[label[deeper]]
        step += 1
    far = np.flatnonzero(label != np.arange(len(fp)))
    return far, label[far]


def _linker(radius: int):
    def linked(batches):
        """Rows sorted by bucket; a bucket may run over batches, so its rows wait for its end."""
        keys = ("mask", "key", "low", "high")
        held = None
        for batch in batches:
            table = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "fp")}
            if held is not None:
                table = {c: np.concatenate((held[c], table[c])) for c in table}
            n = len(table["fp"])
            if not n:
                continue
            new = np.zeros(n, bool)
            for c in keys:
                new[1:] |= table[c][1:] != table[c][:-1]
            last = int(np.flatnonzero(new)[-1]) if new.any() else 0
            held = {c: v[last:] for c, v in table.items()}
            if last:
                yield from stars(np.cumsum(new[:last]), table["fp"][:last])
        if held is not None:
            yield from stars(np.zeros(len(held["fp"]), np.int64), held["fp"])

    def stars(group, fp):
        far, near = _stars(group, fp.view(np.uint64), radius)
        yield pa.RecordBatch.from_arrays([pa.array(fp[far]), pa.array(fp[near])], names=["a", "b"])

    return linked


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges ``a, b`` that connect all fingerprints (distinct longs in ``fp``) within ``radius`` bits.

    Fingerprints meet in the buckets of all masks, so no pair is missed. A bucket is
    cut into blocks of about ``block`` by a hash, and blocks are compared two by two in
    separate groups, each of bounded size. Pairs stay inside a comparison; what
    leaves it is at most one edge per fingerprint, enough to keep every link's
    ends in one component.
    """
    masks = [_signed(m) for m in covering_masks(radius)]
    spread = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias(
        "mask", "key"))
    crowded = (spread.groupBy("mask", "key").count().filter("count > 1")
               .withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).drop("count"))
    members = spread.join(crowded, ["mask", "key"]).withColumn(
        "own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    paired = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "mask", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    keys = ["mask", "key", "low", "high"]
    return (paired.repartition(*keys).sortWithinPartitions(*keys, "fp")
            .mapInArrow(_linker(radius), "a long, b long"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, fp, root, component_id`` for every row of ``docs``.

    Rows with fingerprints at ``radius`` or fewer differing bits are linked;
    ``component_id`` is the smallest id reachable. Rows with equal fingerprints are
    one class, so copies cost one row in the search. Null and empty texts have
    fingerprint 0 and are linked like others. A null id takes part but is never the
    smallest; a component of null ids only has a null component_id. No rows: none.
    """
    rows = cut(add_fingerprint(docs.select("doc_id", "text")).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), "fp"))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(classes.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(rooted.select("fp", "root").join(smallest, "root"), "fp")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each component, columns as given: that of the smallest id (nulls
    last), then of the smallest text hash; of rows equal in both, any one."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    kept = near_duplicates(docs, **options).groupBy("root").agg(F.min(order).alias("first")).select(
        F.coalesce("first.doc_id", F.lit(0)).alias("_id"), F.col("first.none").alias("_none"),
        F.col("first.text_hash").alias("_hash")).distinct()
    rows = without(docs, "_id", "_none", "_hash").select(
        "*", F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"),
        F.xxhash64("text").alias("_hash"))
    keys = ["_id", "_none", "_hash"]
    return rows.join(kept, keys, "left_semi").dropDuplicates(keys).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_document_components(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
