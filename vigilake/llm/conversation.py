"""Least edits that repair the turn structure of conversations, by a parallel Viterbi search."""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.llm.common import in_ranges, ship
from vigilake.session import cut

#: Rows in a chunk, and fix-up passes before chunks that still change are joined by products of their cost matrices.
CHUNK, PASSES = 4096, 8
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States by what was put out last: nothing, system, user, assistant; and what each takes next.
NEXT = (2, 2, 3, 2)
#: Cost left in each state when no row follows.
LEFT = (0, 4, 2, 0)
ROLES = {2: "user", 3: "assistant"}
_INITIALS = "sua"  # codes 0, 1, 2; any other initial is 3; truncated rows add 4
_BIG = 1 << 40


# --- one chunk -----------------------------------------------------------------

def costs_before(code: int, after) -> list[int]:
    """Least cost from each state before a row, from those after it."""
    kind, extra = code & 3, TRUNCATED if code & 4 else 0
    direct = []
    for state in range(4):
        best = min(DELETE + after[state], REROLE + extra + after[NEXT[state]])
        kept = _kept(kind, state)
        direct.append(best if kept is None else min(best, KEEP + extra + after[kept]))
    # an insertion leads on to another state before the same row
    user, assistant = min(direct[2], INSERT + direct[3]), min(direct[3], INSERT + direct[2])
    return [min(direct[0], INSERT + user), min(direct[1], INSERT + user), user, assistant]


def _kept(kind: int, state: int) -> int | None:
    """State after keeping a row of this initial, if that is allowed."""
    return kind + 1 if kind < 3 and (kind + 1 == NEXT[state] or kind == state == 0) else None


def chunk_costs(codes: bytes, after) -> list[int]:
    for code in reversed(codes):
        after = costs_before(code, after)
    return list(after)


def chunk_edits(codes: bytes, after, state: int) -> tuple[list[str], int]:
    """The least edits of a chunk entered in ``state``: the letters of each row, insertions
    before it first, and the state behind it. Of equal costs the smaller letter is taken."""
    ahead = [list(after)]
    for code in reversed(codes):
        ahead.append(costs_before(code, ahead[-1]))
    letters = []
    for code, here, behind in zip(codes, ahead[:0:-1], ahead[-2::-1]):
        extra, found = TRUNCATED if code & 4 else 0, ""
        while True:
            if here[state] == DELETE + behind[state]:
                found += "D"
                break
            if here[state] == INSERT + here[NEXT[state]]:
                found, state = found + "I", NEXT[state]
                continue
            kept = _kept(code & 3, state)
            if kept is not None and here[state] == KEEP + extra + behind[kept]:
                found, state = found + "K", kept
            else:
                found, state = found + "R", NEXT[state]
            break
        letters.append(found)
    return letters, state


@F.pandas_udf(T.ArrayType(T.LongType()))
def _costs(codes: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([chunk_costs(bytes(c), [int(x) for x in a]) for c, a in zip(codes, after)])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _matrix(codes: pd.Series) -> pd.Series:
    """Cost from each state before a chunk (slow index) to each behind it."""
    found = []
    for c in codes:
        columns = [chunk_costs(bytes(c), [0 if s == k else _BIG for s in range(4)]) for k in range(4)]
        found.append([min(columns[k][s], _BIG) for s in range(4) for k in range(4)])
    return pd.Series(found)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _exits(codes: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([[chunk_edits(bytes(c), [int(x) for x in a], s)[1] for s in range(4)] for c, a in zip(codes, after)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _edits(codes: pd.Series, after: pd.Series, state: pd.Series) -> pd.Series:
    return pd.Series([chunk_edits(bytes(c), [int(x) for x in a], int(s))[0] for c, a, s in zip(codes, after, state)])


# --- chunks of one conversation -----------------------------------------------------

def _shifted(df: DataFrame, by: int, *names: str) -> DataFrame:
    """``df``'s columns under ``names`` with a ``_2``, keyed as the chunk that stands ``by`` before."""
    return df.select("conv", (F.col("chunk") - by).alias("chunk"), *[F.col(n).alias(f"{n}_2") for n in names])


def costs_behind(chunks: DataFrame, passes: int = PASSES) -> DataFrame:
    """``conv, chunk, codes, after, base``: the costs behind each chunk, up to a constant.

    Each chunk but the last of its conversation starts from a speculative vector of equal
    costs. A fix-up pass hands each chunk the vector that the chunk behind it has
    before itself, and reruns those whose own vector differed from it by more than a
    constant; a constant is all that remains when no vector changes, and the constants
    of a conversation add up to what its first chunk lacks (``base``). Where chunks
    pass differences through, such passes move one chunk at a time: after ``passes`` of
    them the vectors come from products of the chunks' cost matrices, whose reach doubles in
    each round. The driver sees one number per pass.
    """
    zero, end = F.array(*[F.lit(0).cast("long")] * 4), F.array(*[F.lit(x).cast("long") for x in LEFT])
    # each chunk starts from the end or from equal costs
    now = cut(chunks.withColumn("after", F.when(F.col("chunk") == F.col("n_chunks") - 1, end).otherwise(zero))
              .withColumn("before", _costs("codes", "after")))
    for _ in range(passes):
        # what the chunk behind has before itself, less the constant
        apart = F.array(*[F.col("before_2")[s] - F.col("after")[s] for s in range(4)])
        met = now.join(_shifted(now, 1, "before"), ["conv", "chunk"], "left").withColumn("apart", apart)
        moved = F.col("before_2").isNotNull() & (F.array_max("apart") != F.array_min("apart"))
        stale = cut(met.filter(moved).select(*chunks.columns, F.col("before_2").alias("after")))
        if stale.isEmpty():
            return met.select(*chunks.columns, "after", F.when(
                F.col("before_2").isNotNull(), F.col("apart")[0]).otherwise(0).alias("base"), "before")
        rerun = stale.withColumn("before", _costs("codes", "after"))
        now = cut(now.join(stale.select("conv", "chunk"), ["conv", "chunk"], "left_anti").unionByName(rerun))
    # suffix products: the matrix of a chunk and the next 2^k - 1, while any chunk has a next one
    product = F.array(*[
        F.array_min(F.array(*[F.col("m")[4 * s + k] + F.col("m_2")[4 * k + t] for k in range(4)]))
        for s in range(4) for t in range(4)])
    reach = cut(chunks.select("conv", "chunk", "n_chunks", _matrix("codes").alias("m")))
    most = chunks.agg(F.max("n_chunks")).first()[0]
    step = 1
    while step < most:
        met = reach.join(_shifted(reach, step, "m"), ["conv", "chunk"], "left")
        reach = cut(met.select("conv", "chunk", "n_chunks", F.when(
            F.col("m_2").isNotNull(), product).otherwise(F.col("m")).alias("m")))
        step *= 2
    before = F.array(*[F.array_min(F.array(*[F.col("m")[4 * s + k] + F.lit(LEFT[k]) for k in range(4)])) for s in range(4)])
    exact = cut(reach.select("conv", "chunk", before.alias("before")))
    met = chunks.join(exact, ["conv", "chunk"]).join(_shifted(exact, 1, "before"), ["conv", "chunk"], "left")
    return met.select(*chunks.columns, F.coalesce("before_2", end).alias("after"), F.lit(0).cast("long").alias("base"), "before")


def entry_states(solved: DataFrame) -> DataFrame:
    """``conv, chunk, state`` before each chunk. A chunk maps the state before it to one behind
    it; maps of neighbours are joined over doubling reaches."""
    maps = cut(solved.select("conv", "chunk", "n_chunks", _exits("codes", "after").alias("m")))
    most = maps.agg(F.max("n_chunks")).first()[0] or 0
    step = 1
    while step < most:
        earlier = maps.select("conv", (F.col("chunk") + step).alias("chunk"), F.col("m").alias("m_2"))
        met = maps.join(earlier, ["conv", "chunk"], "left")
        maps = cut(met.select("conv", "chunk", "n_chunks", F.when(
            F.col("m_2").isNotNull(), F.transform("m_2", lambda s: F.element_at("m", s + 1))).otherwise(F.col("m")).alias("m")))
        step *= 2
    return maps.filter("chunk < n_chunks - 1").select("conv", (F.col("chunk") + 1).alias("chunk"), F.col("m")[0].alias("state"))


# --- rows ---------------------------------------------------------------------------

_FILLED = r"[^\x20\x09-\x0D]"


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text; nulls of the texts as one space) with the faults that the crc
    of ``conv_id:turn`` deals out; equal rows are one with ``copies``."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    kept = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fault.alias("_fault"))
    return kept.filter("_fault <> 0").select(
        "conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"), F.when(F.col("_fault") == 3, 2).otherwise(1).alias("_times")
    ).groupBy("conv_id", "turn", "role", "text").agg(F.sum("_times").alias("copies"))


def faults(rows: DataFrame) -> DataFrame:
    """Adds ``conv`` (the id as text, null apart), ``blank, again, truncated`` to rows with ``copies``.

    A text that a conversation has again is known by the first turn that has it: one aggregate
    and a join on all columns, so a text that recurs in a third of all rows is no hot key.
    """
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    keyed = rows.withColumn("conv", conv).withColumn("_order", order).withColumn("_sha", F.sha2("text", 256))
    first = keyed.groupBy("conv", "role", "_sha").agg(F.min("_order").alias("_order")).withColumn("_first", F.lit(True))
    blank = ~F.col("text").rlike(_FILLED)
    cut_off = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return (keyed.withColumn("_known", F.col("_order.known")).withColumn("_turn", F.coalesce("turn", F.lit(0)))
            .join(first.select("conv", "role", "_sha", F.col("_order.known").alias("_known"),
                               F.coalesce("_order.turn", F.lit(0)).alias("_turn"), "_first"),
                  ["conv", "role", "_sha", "_known", "_turn"], "left")
            .select("conv", "conv_id", "turn", "role", "text", "copies", blank.alias("blank"),
                    (~blank & F.col("_first").isNull()).alias("again"),
                    (~blank & F.col("_first").isNotNull() & cut_off).alias("truncated")))


def numbered(rows: DataFrame, chunk: int) -> DataFrame:
    """Adds ``at`` (order over all conversations), and ``chunk, place`` of the rows an edit is sought for.

    Rows are dealt into ranges of (conversation, turn, role, text), numbered inside each, and
    the numbers of a conversation's earlier ranges are added: one row per range and
    conversation at its edge meets there.
    """
    keys = ["conv", "turn", "role", "text"]
    parted = in_ranges(rows, *[F.col(k).asc_nulls_first() for k in keys])
    inside = Window.partitionBy("part").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    live = (~F.col("blank") & ~F.col("again")).cast("long")
    here = parted.withColumn("at", F.col("part").cast("long") * (1 << 40) + F.row_number().over(inside)).withColumn(
        "_live", live).withColumn("_upto", F.sum("_live").over(
            Window.partitionBy("part", "conv").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)))
    sums = parted.groupBy("conv", "part").agg(F.sum(live).alias("_n"))
    offsets = sums.select("conv", "part", F.coalesce(F.sum("_n").over(
        Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    place = F.coalesce("_upto", F.lit(0)) + F.col("_offset")
    return here.join(offsets, ["conv", "part"]).withColumn(
        "chunk", F.when(F.col("_live") == 1, F.floor(place / chunk))).drop("_upto", "_offset", "_live", "part")


def _replayed(batches):
    """One row per conversation: its rows come together and in order, and are never held."""
    names = ["conv", "conv_id", "illegal", "cost", "audit", "repaired_sha256"]
    current, seen = None, None
    done: list[tuple] = []

    def finished():
        state, audit, digest, lines, illegal, _, conv_id, cost = seen
        while state in (1, 2):
            state = NEXT[state]
            audit.append("I")
            cost += INSERT
            digest.update((b"\n" if lines else b"") + f"{ROLES[state]}:".encode())
            lines += 1
        done.append((current, conv_id, illegal, cost, "".join(audit), digest.hexdigest()))

    def handed(kinds):
        out = pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)], names=names)
        done.clear()
        return out

    kinds = None
    for batch in batches:
        kinds = [pa.string(), batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.string()]
        for row in zip(*[batch.column(c) for c in ("conv", "conv_id", "role", "text", "copies", "truncated", "letters")]):
            conv, conv_id, role, text, copies, truncated, letters = (x.as_py() for x in row)
            if conv != current:
                if current is not None:
                    finished()
                # state, letters, hash, lines, illegal pairs, last initial, id, cost
                current, seen = conv, [0, [], hashlib.sha256(), 0, 0, None, conv_id, 0]
            initial = role[:1]
            if seen[5] is not None and seen[5] + initial not in ("su", "ua", "au"):
                seen[4] += 1
            seen[4] += copies - 1
            seen[5] = initial
            letters = letters or "D"
            for letter in letters:
                if letter == "D":
                    seen[7] += DELETE
                    continue
                if letter == "K":
                    line, seen[0] = f"{role}:{text}", _INITIALS.index(initial) + 1
                else:
                    seen[0] = NEXT[seen[0]]
                    line = f"{ROLES[seen[0]]}:" + ("" if letter == "I" else text)
                    seen[7] += INSERT if letter == "I" else REROLE
                if letter != "I":
                    seen[7] += TRUNCATED * truncated
                seen[2].update((b"\n" if seen[3] else b"") + line.encode("utf-8", "surrogatepass"))
                seen[3] += 1
            seen[1].append(letters + "D" * (copies - 1))
            seen[7] += DELETE * (copies - 1)
        yield handed(kinds)
    if current is not None:
        finished()
        yield handed(kinds)


def repaired(rows: DataFrame, chunk: int = CHUNK, passes: int = PASSES) -> DataFrame:
    """``conv_id, illegal, cost, audit, repaired_sha256`` of each conversation of ``rows``
    (conv_id, turn, role, text, copies, blank, again, truncated as ``faults`` gives them).

    Rows that must go have one edit and leave the state as it is, so the search runs over
    the others, in chunks of ``chunk`` rows that hold a byte each. Costs come from behind
    (``costs_behind``), the states before chunks from maps (``entry_states``); then each chunk
    traces its edits by itself. A conversation may have any share of all rows up to there.
    Only its audit and digest are of one piece: rows stream through one task in order.
    """
    ship(rows.sparkSession)
    ordered = cut(numbered(rows, chunk))
    kind = F.instr(F.lit(_INITIALS), F.substring("role", 1, 1))
    code = F.when((kind > 0) & (F.col("role") != ""), kind - 1).otherwise(3) + F.col("truncated").cast("int") * 4
    entries = F.array_sort(F.collect_list(F.struct("at", F.substring(F.hex(code), -1, 1).alias("code"))))
    chunks = (ordered.filter("chunk IS NOT NULL").groupBy("conv", "chunk").agg(entries.alias("_rows"))
              .select("conv", "chunk", F.transform("_rows", lambda r: r["at"]).alias("ats"),
                      F.unhex(F.array_join(F.transform("_rows", lambda r: F.concat(F.lit("0"), r["code"])), "")).alias("codes")))
    counts = chunks.groupBy("conv").agg(F.max("chunk").alias("_last"))
    chunks = cut(chunks.join(counts, "conv").withColumn("n_chunks", F.col("_last") + 1).drop("_last"))
    light = chunks.select("conv", "chunk", "n_chunks", "codes")
    # nearly all conversations are one chunk, which ends where they end
    long = costs_behind(light.filter("n_chunks > 1"), passes)
    solved = cut(light.filter("n_chunks = 1").withColumn("after", F.array(*[F.lit(x).cast("long") for x in LEFT]))
                 .unionByName(long.select(*light.columns, "after")))
    states = entry_states(solved.filter("n_chunks > 1"))
    traced = (solved.join(states, ["conv", "chunk"], "left").join(chunks.select("conv", "chunk", "ats"), ["conv", "chunk"])
              .select("ats", _edits("codes", "after", F.coalesce("state", F.lit(0))).alias("letters"))
              .select(F.explode(F.arrays_zip("ats", "letters")).alias("r")).select(F.col("r.ats").alias("at"), "r.letters"))
    lines = (ordered.drop("chunk").join(traced, "at", "left").repartition("conv").sortWithinPartitions("conv", "at")
             .select("conv", "conv_id", "role", "text", "copies", "truncated", "letters"))
    kind_of_id = rows.schema["conv_id"].dataType.simpleString()
    return lines.mapInArrow(_replayed, f"conv string, conv_id {kind_of_id}, illegal long, cost long, audit string, "
                                       "repaired_sha256 string").drop("conv")


def conversation_repairs(conversations: DataFrame, chunk: int = CHUNK, passes: int = PASSES) -> DataFrame:
    """One row per original ``conv_id`` (null is one): faults of its damaged rows and the cheapest repair.

    ``gaps, blank, duplicate, truncated, illegal, cost`` (longs), ``audit``, ``repaired_sha256``. Rows go
    by turn, nulls first; of one turn by role and text, copies of a row beside it. A role may
    be any text: its first character counts. Other columns aren't read. A conversation
    without rows after the damage has zeros, an empty audit and the hash of an empty text.
    """
    rows = cut(faults(damaged(conversations)))
    fixed = repaired(rows, chunk, passes)
    of = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv")
    turns = rows.groupBy("conv", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("copies") - F.when(F.col("again"), 0).otherwise(1))).alias("duplicate"),
        F.sum(F.col("truncated").cast("long")).alias("truncated"))
    counts = turns.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")])
    every = conversations.select("conv_id", of).distinct()
    out = every.join(counts, "conv", "left").join(fixed.select(of, "illegal", "cost", "audit", "repaired_sha256"), "conv", "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
