"""Fixity audit of WARC replicas with Merkle trees.

Each page is a WARC response record. Files hold the records of a range of ids in order, so every record has an
offset. A leaf covers one id and the offset range of its records; it hashes how many records there are and
the sums of their SHA-256 digests in four parts, so repeated records need no list. An inner node hashes
its up to ``fanout`` children in order; the root covers the file. The audit joins the roots of two replicas,
then only the children of nodes that differ, level by level, and reports the leaves where they end.

Null url or html count as empty. Records without an id have a file of their own per hash of their content.
A file or leaf that one replica lacks differs from any other. Equal replicas, and empty ones, yield no leaf.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelflow.session import materialize

FANOUT = 8
DEPTH = 3
SPARE_FILES = 1024
SPARE = -(1 << 62)  # below the file of any id


def records(pages: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """(file, slot, page_id, digest, length): one WARC record per row of pages (page_id, url, html)."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), name, F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )
    whole = F.concat(head, html, F.lit("\r\n\r\n"))
    size = fanout**depth
    spare = F.lit(SPARE) - F.pmod(F.xxhash64(url, html), F.lit(SPARE_FILES))
    file = F.coalesce(F.expr(f"cast((page_id - pmod(page_id, {size})) div {size} as long)"), spare)
    slot = F.coalesce(F.pmod("page_id", F.lit(size)), F.lit(0)).cast("long")
    return pages.select(
        file.alias("file"), slot.alias("slot"), F.col("page_id").cast("long").alias("page_id"),
        F.sha2(whole, 256).alias("digest"), F.octet_length(whole).cast("long").alias("length"),
    )


def leaves(recs: DataFrame) -> DataFrame:
    """(file, node, hash, begin, end): leaf nodes with their offset ranges."""
    total = F.sum("length").over(
        Window.partitionBy("file").orderBy("slot", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = recs.withColumn("end", total).withColumn("begin", F.col("end") - F.col("length"))
    parts = [
        F.sum(F.conv(F.substring("digest", 1 + 15 * i, 15 if i < 4 else 4), 16, 10).cast("decimal(38,0)")).cast("string")
        for i in range(5)
    ]
    return placed.groupBy("file", F.col("slot").alias("node")).agg(
        F.sha2(F.concat_ws("|", F.count("*").cast("string"), *parts), 256).alias("hash"),
        F.min("begin").alias("begin"), F.max("end").alias("end"),
    )


def tree(recs: DataFrame, fanout: int = FANOUT, depth: int = DEPTH, name: str = "tree") -> list[DataFrame]:
    """Levels from the roots down to the leaves, each (file, node, hash, begin, end)."""
    levels = [materialize(leaves(recs), name)]
    for _ in range(depth):
        child = F.array_sort(F.collect_list(F.struct("node", "hash")))  # at most fanout children
        up = levels[0].groupBy("file", F.floor(F.col("node") / fanout).cast("long").alias("parent")).agg(
            F.sha2(F.concat_ws("|", F.transform(child, lambda c: F.concat_ws(":", c["node"].cast("string"), c["hash"]))), 256)
            .alias("hash"),
            F.min("begin").alias("begin"), F.max("end").alias("end"),
        )
        levels.insert(0, materialize(up.withColumnRenamed("parent", "node"), name))
    return levels


def _paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """(file, node, and hash, begin, end of each side), whichever side has the node."""
    a = left.select("file", "node", *[F.col(c).alias(f"{c}_a") for c in ("hash", "begin", "end")])
    b = right.select("file", "node", *[F.col(c).alias(f"{c}_b") for c in ("hash", "begin", "end")])
    return a.join(b, ["file", "node"], "full")


def audit(left: DataFrame, right: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """Roots of all files and the leaves that differ, from the records of two replicas.

    Columns: file, page_id (null in root rows and for records without id), level (0: root), status (``same``,
    ``altered``, ``missing``: only in left, ``extra``: only in right), hash, begin and end of both sides.
    """
    one, two = tree(left, fanout, depth, "left"), tree(right, fanout, depth, "right")
    status = (
        F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra")
        .when(F.col("hash_a") == F.col("hash_b"), "same").otherwise("altered")
    )
    roots = materialize(_paired(one[0], two[0]).withColumn("status", status), "roots")
    bad = roots.where("status <> 'same'")
    for a, b in zip(one[1:], two[1:]):
        parent = bad.select("file", F.col("node").alias("above"))
        wanted = [
            side.withColumn("above", F.floor(F.col("node") / fanout).cast("long"))
            .join(parent, ["file", "above"], "left_semi").drop("above")
            for side in (a, b)
        ]
        bad = materialize(_paired(*wanted).withColumn("status", status).where("status <> 'same'"), "branch")
    ids = F.when(F.col("file") > SPARE, F.col("file") * fanout**depth + F.col("node"))
    columns = ["status", "hash_a", "hash_b", "begin_a", "end_a", "begin_b", "end_b"]
    nothing = F.lit(None).cast("long")
    return roots.select("file", nothing.alias("page_id"), F.lit(0).alias("level"), *columns).union(
        bad.select("file", ids.alias("page_id"), F.lit(depth).alias("level"), *columns)
    )
