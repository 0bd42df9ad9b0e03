"""String similarity and candidate pairs.

``ratio`` is the only Python in the library's batch path: an Arrow batch UDF
with the standard library's sequence matcher's result, applied to pairs that survive
the native bounds. ``metric="levenshtein"`` is a fully native alternative.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BLOCK_TASK = 500
LEAST_SALTS = 8


def matcher():
    """A function with the result of ``SequenceMatcher(None, p, q).ratio()``. It is local, so it
    ships to executors that do not have this package.

    A second string under 200 characters knows no popular ones in ``SequenceMatcher``: its
    longest block is the earliest of the first string that the second holds, so a
    substring search finds it, and what is left of it and right of it goes on alike."""
    def blocks(p: str, q: str) -> float:
        if len(q) >= 200:
            return SequenceMatcher(None, p, q).ratio()
        matched, parts = 0, [(p, q)]
        while parts:
            x, y = parts.pop()
            at = start = size = 0
            while y and start + size < len(x):
                if x[start:start + size + 1] in y:
                    at, size = start, size + 1
                else:
                    start += 1
            if size:
                there = y.index(x[at:at + size])
                matched += size
                parts += [(x[:at], y[:there]), (x[at + size:], y[there + size:])]
        total = len(p) + len(q)
        return 2.0 * matched / total if total else 1.0

    return blocks


def ratio(a: Column, b: Column) -> Column:
    """Matching-block ratio of two strings; the argument order matters."""
    blocks = matcher()

    def batch(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([blocks(p, q) for p, q in zip(x, y)], dtype="float64")

    return F.pandas_udf(batch, T.DoubleType())(a, b)


def scorer(metric: str):
    """A function of two strings with the result of ``similarity``. It is local, so it ships to
    executors that do not have this package."""
    if metric == "ratio":
        return matcher()
    if metric != "levenshtein":
        raise ValueError(f"unknown metric {metric!r}")

    def edits(p: str, q: str) -> float:
        """Edit distance by columns of bits (Myers 1999, Hyyro 2003), as a share of the longer string."""
        longest = max(len(p), len(q))
        if not p or not q:
            return 0.0 if longest else 1.0
        places, every, top = {}, (1 << len(p)) - 1, 1 << (len(p) - 1)
        for i, c in enumerate(p):
            places[c] = places.get(c, 0) | 1 << i
        up, down, distance = every, 0, len(p)
        for c in q:
            equal = places.get(c, 0)
            flat = equal | down
            cross = (((equal & up) + up) ^ up) | equal
            more, less = down | ~(cross | up), up & cross
            if more & top:
                distance += 1
            elif less & top:
                distance -= 1
            more, less = (more << 1 | 1) & every, less << 1 & every
            up, down = less | ~(flat | more) & every, more & flat
        return 1.0 - distance / longest

    return edits


def similarity(a: Column, b: Column, metric: str = "ratio") -> Column:
    if metric == "ratio":
        return ratio(a, b)
    if metric == "levenshtein":
        longest = F.greatest(F.length(a), F.length(b))
        return F.when(longest == 0, F.lit(1.0)).otherwise(
            F.lit(1.0) - F.levenshtein(a, b).cast("double") / longest)
    raise ValueError(f"unknown metric {metric!r}")


# Letters in groups; counts per group bound the characters two texts can share.
_LETTER_GROUPS = ["e", "a", "i", "o", "t", "n", "s", "r", "ldu", "cmp", "hbgv", " "]


def letter_counts(text: Column) -> Column:
    sizes = [F.length(text) - F.length(F.translate(text, g, "")) for g in _LETTER_GROUPS]
    return F.struct(*[s.alias(f"g{i}") for i, s in enumerate(sizes)],
                    (F.length(text) - sum(sizes, F.lit(0))).alias("rest"), F.length(text).alias("n"))


def could_reach(a: str, b: str, a_counts: str, b_counts: str, floor: Column) -> Column:
    """True unless the native bounds prove both metrics stay below ``floor``:
    shared letters bound the matched characters, and the edit distance is at
    most (1 - floor) x (total length) for any pair that reaches it. Both bounds
    give one step of slack for rounding."""
    fields = [f"g{i}" for i in range(len(_LETTER_GROUPS))] + ["rest"]
    shared = sum((F.least(F.col(f"{a_counts}.{f}"), F.col(f"{b_counts}.{f}")) for f in fields), F.lit(0))
    total = F.col(f"{a_counts}.n") + F.col(f"{b_counts}.n")
    budget = F.floor((F.lit(1.0) - floor) * total + F.lit(1e-6)).cast("int")
    # with a third argument the distance stops at the budget and returns -1 beyond
    edits = F.call_function("levenshtein", F.col(a), F.col(b), budget)
    return (shared * 2 >= floor * total - F.lit(1e-6)) & (edits >= 0)


def blocked_pairs(left: DataFrame, right: DataFrame, block: str, floor: float, one_sided: bool,
                  rows_per_task: int = ROWS_PER_BLOCK_TASK) -> DataFrame:
    """Pairs of rows in the same block whose lengths are compatible with a
    similarity of ``floor``, as columns ``l`` and ``r`` (structs of all columns).

    Both inputs hold ``block``, ``key`` and ``n`` (text length, above 0 if ``floor`` is). Lengths fall
    into geometric bands, so a row meets its own and the next band only. A block
    with many rows is dealt out over salts: each left row goes to one salt, each
    right row to all salts of its block, so no task holds a whole hot block; few
    small blocks are dealt out over eight salts all the same. At a
    floor of zero or less no length is incompatible and all rows share a band.
    ``one_sided`` drops the mirror pair and the pair of a row with itself; use it
    when both sides are the same table.
    """
    if floor > 0:
        step = max(1e-6, -math.log(floor / (2.0 - floor)) * (1 + 1e-6))  # slack for rounding at the edge
        band = F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int")
    else:
        band = F.lit(0)
    reach = F.explode(F.array(*([band - 1] if not one_sided else []), band, band + 1))
    l_rows = left.select(F.col(block).alias("_block"), band.alias("_band"), reach.alias("_other"),
                         F.struct(*left.columns).alias("l"))
    r_rows = right.select(F.col(block).alias("_block"), band.alias("_other"), F.struct(*right.columns).alias("r"))
    keys = ["_block", "_band", "_other"]
    keys.append("_salt")
    sized = left.groupBy(F.col(block).alias("_block"), band.alias("_band")).agg(F.count("*").alias("_rows"))
    parts = F.greatest(F.lit(LEAST_SALTS), F.ceil(F.col("_rows") / F.lit(rows_per_task))).cast("int")
    sized = sized.select("_block", "_band", parts.alias("_parts"))
    near = F.explode(F.array(*([F.col("_band") - 1] if not one_sided else []), F.col("_band"), F.col("_band") + 1))
    l_rows = l_rows.join(sized, ["_block", "_band"]).withColumn(
        "_salt", F.pmod(F.xxhash64("l.key"), F.col("_parts")).cast("int"))
    r_rows = r_rows.join(sized.withColumn("_other", near), ["_block", "_other"]).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    # a fixed partition count: the work per byte is quadratic here, so merging
    # partitions by size would undo the salting
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    l_rows = l_rows.select(*keys, "l").repartition(parts, *keys)
    r_rows = r_rows.select(*keys, "r").repartition(parts, *keys)
    pairs = l_rows.join(r_rows.hint("shuffle_hash"), keys)
    if one_sided:
        pairs = pairs.filter((F.col("_other") > F.col("_band")) | (F.col("l.key") < F.col("r.key")))
    return pairs.select("l", "r")


def event_similarity(pairs: DataFrame, metric: str = "ratio") -> DataFrame:
    """0.6 title + 0.4 location over (new_title, new_location, old_title,
    old_location); the newer record is the first argument."""
    if metric == "ratio":
        # few bytes but much Python work: deal the pairs out, whatever their size
        pairs = pairs.repartition(pairs.sparkSession.sparkContext.defaultParallelism)
    low = {c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in
           ("new_title", "old_title", "new_location", "old_location")}
    return pairs.withColumn("event_similarity", similarity(low["new_title"], low["old_title"], metric) * 0.6
                            + similarity(low["new_location"], low["old_location"], metric) * 0.4)


def location_similarity(a: Column, b: Column) -> Column:
    return F.when((a == b) & (a != ""), 1.0).when((a != "") & (b != ""), 0.5).otherwise(0.0)


def time_similarity(a: Column, b: Column) -> Column:
    """Falls from 1 to 0 over six hours; 0.5 when a time is unknown."""
    hours = F.abs(F.timestamp_diff("MICROSECOND", a, b)) / F.lit(3.6e9)
    return F.coalesce(F.greatest(F.lit(0.0), F.lit(1.0) - hours / F.lit(6.0)), F.lit(0.5))


def incident_similarity(title_sim: Column, location_sim: Column, same_type: Column, time_sim: Column) -> Column:
    return (title_sim * 0.5 + location_sim * 0.3 + F.when(same_type, 1.0).otherwise(0.0) * 0.1 + time_sim * 0.1)
