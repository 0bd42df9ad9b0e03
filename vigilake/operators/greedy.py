"""Order-dependent greedy selection as parallel rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilake.session import cut


def greedy_select(nodes: DataFrame, edges: DataFrame, preselected: DataFrame | None = None) -> DataFrame:
    """Keep a node unless an earlier *kept* node blocks it.

    ``nodes`` has ``node`` and a unique ``ord``; ``edges`` has ``node`` and
    ``blocker`` (the pair conflicts when the blocker is earlier and kept).
    ``preselected`` nodes are kept from the start and earlier than all others.
    Returns ``node, ord, kept``.

    This is the lexicographically first maximal independent set: in every round
    a node without an undecided earlier neighbour is kept, and everything it
    blocks is dropped. The result equals the one-by-one rule; on randomly ordered
    input the number of rounds grows with log^2 n (Blelloch, Fineman, Shun 2012).
    Each round is checkpointed, so a lost executor replays one round at most.
    """
    ranked = nodes.select("node", "ord")
    order_of = ranked.withColumnRenamed("node", "blocker").withColumnRenamed("ord", "blocker_ord")
    earlier = edges.select("node", "blocker").distinct().join(ranked, "node")
    fixed = None
    if preselected is not None:
        fixed = edges.join(preselected.select(F.col("node").alias("blocker")), "blocker", "left_semi").select(
            "node").distinct()
    earlier = cut(earlier.join(order_of, "blocker").filter(F.col("blocker_ord") < F.col("ord")).select(
        "node", "blocker"))
    settled = ranked.join(earlier.select("node").distinct(), "node", "left_anti").withColumn("kept", F.lit(True))
    open_nodes = ranked.join(earlier.select("node").distinct(), "node", "left_semi")
    if fixed is not None:
        lost = ranked.join(fixed, "node", "left_semi").withColumn("kept", F.lit(False))
        settled = settled.join(fixed, "node", "left_anti").unionByName(lost)
        open_nodes = open_nodes.join(fixed, "node", "left_anti")
    settled, live = cut(settled), earlier

    while True:
        kept = settled.filter("kept").select(F.col("node").alias("blocker"))
        dropped = live.join(kept, "blocker", "left_semi").select("node").distinct()
        undecided = open_nodes.join(settled.select("node"), "node", "left_anti")
        lost = undecided.join(dropped, "node", "left_semi").withColumn("kept", F.lit(False))
        after = undecided.join(dropped, "node", "left_anti")
        waiting = live.join(after.select("node"), "node", "left_semi").join(
            after.select(F.col("node").alias("blocker")), "blocker", "left_semi").select("node").distinct()
        won = after.join(waiting, "node", "left_anti").withColumn("kept", F.lit(True))
        fresh = cut(lost.unionByName(won))
        if fresh.isEmpty():
            return settled
        settled = cut(settled.unionByName(fresh))
        live = cut(live.join(settled.filter(~F.col("kept")).select(F.col("node").alias("blocker")),
                             "blocker", "left_anti")
                   .join(settled.select("node"), "node", "left_anti"))


def chain_select(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Keep a row unless the *last kept* row of its key blocks it: ``key, node, kept, blocker``.

    ``rows`` has ``key``, ``node`` (unique) and ``ord`` (unique inside a key); ``edges`` has ``node``
    and ``blocker``, an earlier row of the same key that blocks it. ``blocker`` of the result is
    the kept row that blocks a row, null for kept ones.

    If a row is kept, the next kept one is the first behind it that it does not block: one
    behind the unbroken run of rows it blocks. So the kept rows are the chain of these
    pointers from the first row of a key. Pointers double in every round and each round marks
    what marked rows point at, so a chain of n rows is found in log2(n) rounds, not n. The
    result equals the one-by-one rule. Each round is checkpointed; the driver sees a number.
    """
    ranked = cut(rows.select("key", "node", F.row_number().over(Window.partitionBy("key").orderBy("ord")).alias("rank")))
    behind = ranked.select(F.col("node").alias("blocker"), F.col("rank").alias("from"))
    placed = cut(edges.select("node", "blocker").distinct().join(ranked, "node").join(behind, "blocker")
                 .select("key", "node", "blocker", "rank", "from"))
    nth = F.row_number().over(Window.partitionBy("blocker").orderBy("rank"))
    runs = placed.withColumn("_nth", nth).filter(F.col("rank") - F.col("from") == F.col("_nth")).groupBy(
        F.col("blocker").alias("node")).agg(F.count("*").alias("run"))
    ahead = ranked.join(runs, "node", "left").select(
        "key", "rank", (F.col("rank") + 1 + F.coalesce("run", F.lit(0))).alias("to"))
    last = ranked.groupBy("key").agg(F.max("rank").alias("last"))
    jump = cut(ahead.join(last, "key").filter("to <= last").select("key", "rank", "to"))
    marked, seen = cut(ranked.filter("rank = 1").select("key", "rank")), -1
    while True:
        reached = marked.join(jump, ["key", "rank"]).select("key", F.col("to").alias("rank"))
        marked = cut(marked.unionByName(reached).distinct())
        count = marked.count()
        if count == seen:
            break
        seen = count
        onward = jump.select("key", F.col("rank").alias("to"), F.col("to").alias("beyond"))
        jump = cut(jump.join(onward, ["key", "to"]).select("key", "rank", F.col("beyond").alias("to")))
    out = ranked.join(marked.withColumn("kept", F.lit(True)), ["key", "rank"], "left").withColumn(
        "kept", F.coalesce("kept", F.lit(False)))
    # the kept row that blocks a row is the only one before it whose next kept row is not
    reach = ahead.join(marked, ["key", "rank"]).withColumnRenamed("rank", "from")
    by = placed.join(reach, ["key", "from"]).filter(F.col("rank") < F.col("to")).select("node", "blocker")
    return out.join(by, "node", "left").select("key", "node", "kept", "blocker")
