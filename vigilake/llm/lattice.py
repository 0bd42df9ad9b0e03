"""Near-duplicate vectors by E8 lattice hashing."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.functions.match import once
from vigilake.llm.common import components, ship
from vigilake.session import cut

THRESHOLD = 0.95
TABLES, BLOCKS, PROBES, SCALE = 6, 3, 16, 2.2
#: Neighbouring cells considered in one block before blocks are combined.
NEAREST = 9


def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minuses."""
    whole = np.zeros((112, 8))
    for row, ((i, j), (a, b)) in zip(whole, product(combinations(range(8), 2), product((1, -1), repeat=2))):
        row[i], row[j] = a, b
    halves = [s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.concatenate([whole, np.array(halves)])


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest whole vectors with an even sum."""
    near = np.rint(x)
    off = x - near
    odd = near.sum(axis=1) % 2 != 0
    worst = np.abs(off).argmax(axis=1)
    rows = np.flatnonzero(odd)
    near[rows, worst[rows]] += np.where(off[rows, worst[rows]] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the better of the even lattice and its shift by a half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


class Hasher:
    """Home cell and nearest neighbouring cells of unit vectors, in every table."""

    def __init__(self, size: int, tables=TABLES, blocks=BLOCKS, probes=PROBES, scale=SCALE, seed=4):
        rng = np.random.default_rng([seed, size])
        self.project = rng.normal(size=(tables, blocks, size, 8)) / scale
        self.start = rng.uniform(0, 2, (tables, blocks, 8))
        self.mix = rng.integers(1, 1 << 63, (tables, blocks, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(0, 1 << 63, tables, dtype=np.uint64)
        self.probes = probes
        self.shortest = shortest_vectors()

    def _mixed(self, points: np.ndarray, mix: np.ndarray) -> np.ndarray:
        twice = np.rint(2 * points).astype(np.int64).view(np.uint64)
        return (twice * mix).sum(axis=-1, dtype=np.uint64)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, tables, probes) cells, the home cell first, then by distance over all blocks."""
        tables, blocks = self.project.shape[:2]
        out = np.zeros((len(unit), tables, self.probes), np.uint64)
        for t in range(tables):
            cost, key = np.zeros((len(unit), 1)), np.full((len(unit), 1), self.salt[t])
            for b in range(blocks):
                x = unit @ self.project[t, b] + self.start[t, b]
                home = decode(x)
                away = 2 - 2 * (x - home) @ self.shortest.T
                near = np.argpartition(away, NEAREST, axis=1)[:, :NEAREST]
                steps = self._mixed(self.shortest, self.mix[t, b])
                own = np.concatenate([np.zeros((len(unit), 1)), np.take_along_axis(away, near, axis=1)], axis=1)
                at = self._mixed(home, self.mix[t, b])[:, None]
                cells = np.concatenate([at, at + steps[near]], axis=1)
                cost = (cost[:, :, None] + own[:, None, :]).reshape(len(unit), -1)
                key = (key[:, :, None] + cells[:, None, :]).reshape(len(unit), -1)
                best = np.argsort(cost, axis=1, kind="stable")[:, :max(self.probes, NEAREST)]
                cost, key = np.take_along_axis(cost, best, axis=1), np.take_along_axis(key, best, axis=1)
            out[:, t] = key[:, :self.probes]
        return out


def _cells(options: dict):
    def emit(batches):
        hashers: dict[int, Hasher] = {}
        for batch in batches:
            for part in range(0, batch.num_rows, 1024):
                rows = batch.slice(part, 1024)
                ids = rows.column("vec_id").to_numpy(zero_copy_only=False)
                vectors = rows.column("embedding").to_pylist()
                sizes = np.array([len(v) for v in vectors])
                for size in np.unique(sizes):
                    if size not in hashers:
                        hashers[size] = Hasher(int(size), **options)
                    own = np.flatnonzero(sizes == size)
                    v = np.array([vectors[i] for i in own], np.float64)
                    v /= np.abs(v).max(axis=1, keepdims=True)
                    cells = hashers[size].keys(v / np.linalg.norm(v, axis=1, keepdims=True))
                    n, tables, probes = cells.shape
                    yield pa.RecordBatch.from_arrays([
                        pa.array(cells.reshape(-1).view(np.int64)), pa.array(np.repeat(ids[own], tables * probes)),
                        pa.array(np.tile(np.arange(probes) == 0, n * tables))], names=["cell", "vec_id", "home"])

    return emit


def usable(vector: str = "embedding"):
    """Neither null nor zero, and every component finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def similar_pairs(vectors: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Pairs ``a < b`` of ids whose cosine, in double precision, is ``threshold`` or more.

    ``vectors``: distinct usable ``vec_id, embedding``. Unit vectors are projected at
    random to blocks of eight dimensions and decoded to E8 points, in several
    tables; a vector lies in its home cell and probes the neighbouring cells next in
    distance. Only ids meet in cells. Candidates found in several tables are made
    distinct before vectors are fetched and the cosine is taken. Vectors of different
    lengths never meet. A crowd of different vectors that all link costs a row for
    each of its links: those are the result.
    """
    ship(vectors.sparkSession)
    placed = vectors.mapInArrow(_cells(options), "cell long, vec_id long, home boolean")
    homes = placed.filter("home").select("cell", F.col("vec_id").alias("a"))
    probes = placed.select("cell", F.col("vec_id").alias("b"))
    met = (homes.join(probes, "cell").filter("a <> b")
           .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # by a power of two near the largest component: exact, and no square leaves the range of doubles
    most = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    scaled = once(vectors.select("vec_id", "embedding"), _by=F.pow(F.lit(2.0), F.floor(F.log2(most)))).select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") / F.col("_by")).alias("embedding"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    known = scaled.select("vec_id", "embedding", norm.alias("norm"))
    left = known.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va"), F.col("norm").alias("na"))
    right = known.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb"), F.col("norm").alias("nb"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y),
                      F.lit(0.0), lambda s, x: s + x)
    return (met.join(left, "a").join(right, "b")
            .filter(F.size("va") == F.size("vb")).filter(dot / (F.col("na") * F.col("nb")) >= threshold)
            .select("a", "b"))


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``embeddings``.

    Equal vectors are one class, searched once and linked to one another. Null, zero
    and non-finite vectors link with nothing, nor do rows without id (component null,
    not kept). Rows sharing an id are one node. No rows: no rows.
    """
    rows = embeddings.select("vec_id", "embedding", usable().alias("ok"), F.xxhash64("embedding").alias("h"))
    good = rows.filter(F.col("ok") & F.col("vec_id").isNotNull())
    classes = cut(good.groupBy("h", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("members")))
    pairs = cut(similar_pairs(classes.select(F.col("rep").alias("vec_id"), "embedding"), threshold, **options))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.select(F.col("rep").alias("b"), "members")
    linked = both.join(sizes, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("members").alias("others"))
    roots = components(pairs).select(F.col("node").alias("rep"), "root")
    known = (classes.join(linked, "rep", "left").join(roots, "rep", "left")
             .select("h", F.col("embedding").alias("v"), F.coalesce("root", "rep").alias("root"),
                     (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("links")))
    alone = rows.filter(~(F.col("ok") & F.col("vec_id").isNotNull()) | F.col("ok").isNull())
    found = good.join(known, "h").filter(F.col("embedding") == F.col("v")).select("vec_id", "links", "root")
    return found.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("root"))
                             ).select("vec_id", F.col("links").alias("n_links"), F.col("root").alias("component_id"),
                                      F.coalesce(F.col("vec_id") == F.col("root"), F.lit(False)).alias("kept"))
