"""Merkle fixity audit of WARC records."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.session import cut

RECORDS_PER_FILE = 1000
#: Bytes of a file that one lowest node covers, and children of each node above.
RANGE_BYTES, FAN_OUT = 65_536, 8


def payload(url: Column, html: Column, page_id: Column) -> Column:
    """A WARC response record as text; null url and html are empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def archive(pages: DataFrame, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Pages as records of files: ``file, offset, page_id, payload``.

    A file holds the ids of one run of ``per_file``; offsets are running sums of record
    lengths by id inside it. Rows without id form file -1. Equal ids follow one
    another by payload hash.
    """
    made = pages.select(
        F.coalesce(F.floor(F.col("page_id") / per_file), F.lit(-1)).cast("long").alias("file"), "page_id",
        payload(F.col("url"), F.col("html"), F.col("page_id")).alias("payload"))
    before = Window.partitionBy("file").orderBy("page_id", F.xxhash64("payload")).rowsBetween(
        Window.unboundedPreceding, -1)
    size = F.octet_length("payload").cast("long")
    return made.select("file", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("offset"), "page_id", "payload")


def leaves(records: DataFrame) -> DataFrame:
    """``file, offset, length, digest`` of ``file, offset, payload``: the leaves of the trees."""
    return records.select("file", "offset", F.octet_length("payload").cast("long").alias("length"),
                          F.sha2("payload", 256).alias("digest"))


def node_of(parts: Column) -> Column:
    """Digest over (position, digest) parts in their order."""
    ordered = F.transform(F.sort_array(F.collect_list(parts)), lambda p: F.concat_ws(":", p["at"], p["digest"]))
    return F.sha2(F.array_join(ordered, ","), 256)


def tree(leaf: DataFrame, depth: int, range_bytes: int = RANGE_BYTES, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """Levels of the trees, lowest first: ``file, node, digest``.

    The lowest nodes hash the leaves that start in one offset range, every node
    above the ``fan_out`` nodes below it; the last level has one root per file. A
    group is what fits in a range, or ``fan_out`` digests.
    """
    levels = [cut(leaf.groupBy("file", F.floor(F.col("offset") / range_bytes).cast("long").alias("node")).agg(
        node_of(F.struct(F.col("offset").alias("at"), F.concat_ws("+", "length", "digest").alias("digest"))).alias(
            "digest")))]
    for _ in range(depth):
        levels.append(levels[-1].groupBy("file", F.floor(F.col("node") / fan_out).cast("long").alias("up")).agg(
            node_of(F.struct(F.col("node").alias("at"), "digest")).alias("digest")).withColumnRenamed("up", "node"))
    return levels


def differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose digest is not the same in both, or is in one only."""
    x, y = a.select(*keys, F.col("digest").alias("x")), b.select(*keys, F.col("digest").alias("y"))
    return x.join(y, keys, "full").filter(~F.col("x").eqNullSafe(F.col("y"))).select(*keys)


def audit(first: DataFrame, second: DataFrame, range_bytes: int = RANGE_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """Records in which two replicas (``file, offset, payload``) differ.

    Roots are compared first; below a level only the children of nodes that differ
    are read, down to offset ranges and then to their records. Returns ``file,
    offset, status, first_digest, second_digest`` with status ``changed``, ``missing``
    (not in the second) or ``extra``. Payloads are hashed once and only digests kept.
    Null payloads have a null digest, equal to another null. A record is a file and
    an offset; repeated ones are compared as many times as they meet. Equal or empty
    replicas: no rows. Depth follows from the largest offset, one number.
    """
    one, two = cut(leaves(first)), cut(leaves(second))
    last = one.unionByName(two).agg(F.max("offset")).first()[0]
    depth = max(1, math.ceil(math.log((last or 0) // range_bytes + 1, fan_out) + 1e-9))
    up, vp = tree(one, depth, range_bytes, fan_out), tree(two, depth, range_bytes, fan_out)
    wrong = differing(up[-1], vp[-1], ["file", "node"])
    for level in range(depth - 1, -1, -1):
        under = wrong.withColumnRenamed("node", "above")
        here = [t[level].withColumn("above", F.floor(F.col("node") / fan_out).cast("long"))
                .join(under, ["file", "above"], "left_semi") for t in (up, vp)]
        wrong = differing(*here, ["file", "node"])
    x, y = [leaf.withColumn("node", F.floor(F.col("offset") / range_bytes).cast("long"))
            .join(wrong, ["file", "node"], "left_semi")
            .select("file", "offset", F.struct("length", "digest").alias(name))
            for leaf, name in ((one, "x"), (two, "y"))]
    status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").otherwise("changed")
    return x.join(y, ["file", "offset"], "full").filter(~F.col("x").eqNullSafe(F.col("y"))).select(
        "file", "offset", status.alias("status"), F.col("x.digest").alias("first_digest"),
        F.col("y.digest").alias("second_digest"))


def damaged(records: DataFrame) -> DataFrame:
    """A replica as a failing disk leaves it: by page id some records lose their first
    letter to another, some their last byte, and some are gone. The others are intact."""
    n = F.col("page_id")
    text = F.when(n % 97 == 13, F.concat(F.lit("X"), F.expr("substring(payload, 2)"))).when(
        n % 163 == 7, F.expr("substring(payload, 1, char_length(payload) - 1)")).otherwise(F.col("payload"))
    return records.filter(n.isNull() | (n % 211 != 5)).withColumn("payload", text)


def audited_pages(pages: DataFrame) -> DataFrame:
    """The audit of the pages' archive against its damaged replica, with the page of each record."""
    kept = archive(pages)
    found = audit(kept, damaged(kept))
    return found.join(kept.select("file", "offset", "page_id"), ["file", "offset"], "left").select(
        "page_id", "file", "offset", "status", "first_digest", "second_digest")
