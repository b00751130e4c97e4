"""Fixity audit of WARC replicas by Merkle trees, in DataFrame functions.

Method. Pages become response records; a file has the records of `per_file` page ids in a row, ordered by page id, URL and digest.
A leaf hashes a record's digest with its range of offsets. Nodes hash up to 16 children in order, first within a file,
then over files, up to one root. Two replicas' roots are compared; where they differ, their children are joined and
compared, and so on down: only children of nodes that differ are ever joined. What differs at the leaves is located
corruption. Record bodies are read once per replica and never shuffled; leaves are about 100 bytes.

Defined results. Null url or html: empty. Rows without page_id are records of file -1. Repeated rows are records each.
Replicas of different length: records past the other's end are `missing` or `extra`. Empty tables have no root and
nothing to report. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stash

FAN_OUT = 16


def records(pages: DataFrame) -> DataFrame:
    """(page_id, url, record): WARC/1.0 response records."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    return pages.select("page_id", url.alias("url"), F.concat(head, html, F.lit("\r\n\r\n")).alias("record"))


def manifest(recs: DataFrame, per_file: int = 1024) -> DataFrame:
    """(file_no, record_no, page_id, offset, length, digest, hash): one leaf per record."""
    one = recs.select(
        F.coalesce(F.floor(F.col("page_id") / per_file), F.lit(-1)).cast("long").alias("file_no"), "page_id", "url",
        F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"),
    )
    order = Window.partitionBy("file_no").orderBy("page_id", "url", "digest")
    placed = one.withColumn("record_no", (F.row_number().over(order) - 1).cast("long")).withColumn(
        "offset", F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    leaf = F.sha2(F.concat_ws(":", "offset", "length", "digest"), 256)
    return placed.select("file_no", "record_no", "page_id", "offset", "length", "digest", leaf.alias("hash"))


def build(nodes: DataFrame) -> list[DataFrame]:
    """Levels of (replica, tree, no, hash) from the given nodes up to one node for each replica's tree."""
    levels = [nodes]
    most = nodes.agg(F.max("no")).first()[0] or 0
    while most > 0:
        child = F.struct("no", "hash")
        gathered = levels[-1].groupBy("replica", "tree", F.floor(F.col("no") / FAN_OUT).alias("up")).agg(F.array_sort(F.collect_list(child)).alias("c"))
        text = F.array_join(F.transform("c", lambda x: F.concat(x["no"].cast("string"), F.lit("="), x["hash"])), ",")
        levels.append(stash(gathered.select("replica", "tree", F.col("up").alias("no"), F.sha2(text, 256).alias("hash")), "nodes"))
        most //= FAN_OUT
    return levels


def descend(levels: list[DataFrame], trees: DataFrame | None = None) -> DataFrame:
    """(tree, no) of the lowest nodes that differ between replicas a and b, by way of differing nodes only; trees: where to look."""
    found = None
    for level in reversed(levels):
        sides = []
        for r in ("a", "b"):
            side = level.where(F.col("replica") == r).select("tree", "no", F.col("hash").alias(r))
            if found is not None:
                parents = found.select(F.col("tree").alias("p_tree"), F.col("no").alias("p_no"))
                side = side.join(parents, (F.col("tree") == F.col("p_tree")) & (F.floor(F.col("no") / FAN_OUT) == F.col("p_no")), "left_semi")
            elif trees is not None:
                side = side.join(trees, "tree", "left_semi")
            sides.append(side)
        found = sides[0].join(sides[1], ["tree", "no"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("tree", "no")
    return found


def locate(leaves: DataFrame) -> DataFrame:
    """(file_no, record_no) of the leaves (replica, file_no, record_no, hash) that differ between the replicas a and b."""
    files = build(leaves.select("replica", F.col("file_no").alias("tree"), F.col("record_no").alias("no"), "hash"))
    low = leaves.agg(F.min("file_no")).first()[0] or 0
    over = build(files[-1].select("replica", F.lit(0).cast("long").alias("tree"), (F.col("tree") - low).alias("no"), "hash"))
    differing = stash(descend(over).select((F.col("no") + low).alias("tree")), "files")
    return descend(files, differing).select(F.col("tree").alias("file_no"), F.col("no").alias("record_no"))


def audit(a: DataFrame, b: DataFrame, per_file: int = 1024) -> DataFrame:
    """Each record of two replicas (page_id, url, record): file_no, record_no, page_id, offset, length, digest of `a` (of `b` if extra), status.

    status: intact, corrupt (digests differ), moved (only offsets differ), missing or extra (in `b`).
    """
    sides = [manifest(r, per_file).select(F.lit(name).alias("replica"), "*") for name, r in (("a", a), ("b", b))]
    leaves = stash(sides[0].unionByName(sides[1]), "leaves")
    found = locate(leaves.select("replica", "file_no", "record_no", "hash"))
    key, own = ["file_no", "record_no"], ["page_id", "offset", "length", "digest"]
    side_a, side_b = (leaves.where(F.col("replica") == r).select(*key, *own) for r in ("a", "b"))
    other = side_b.select(*key, *[F.col(c).alias(f"b_{c}") for c in own])
    bad = found.join(side_a, key, "left").join(other, key, "left")
    status = (
        F.when(F.col("digest").isNull(), "extra").when(F.col("b_digest").isNull(), "missing").when(F.col("digest") != F.col("b_digest"), "corrupt").otherwise("moved")
    )
    located = bad.select(*key, status.alias("status"), *[F.col(f"b_{c}") for c in own])
    everything = side_a.join(located, key, "full_outer")
    return everything.select(
        *key, *[F.when(F.col("status") == "extra", F.col(f"b_{c}")).otherwise(F.col(c)).alias(c) for c in own], F.coalesce("status", F.lit("intact")).alias("status")
    )


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known damage: one page in 101 has its first character overwritten, one in 1009 lacks its last."""
    key, html = F.col("page_id") * 7919, F.col("html")
    cut = F.when(F.pmod(key, F.lit(1009)) == 7, F.substring(html, 1, F.length(html) - 1)).otherwise(html)
    return pages.withColumn("html", F.when(F.pmod(key, F.lit(101)) == 5, F.concat(F.lit("#"), F.substr(html, F.lit(2)))).otherwise(cut))
