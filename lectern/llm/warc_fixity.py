"""Merkle fixity audit of WARC archives.

Every record is hashed. The records that start in one range of offsets of an archive hash to a leaf node, sixteen
neighbouring ranges to the node above, and so on to the archive's root. Two replicas agree on an archive when their
roots do; where they do not, only the branches that differ are followed down to the records. Nodes are grouped by
(archive, range), so an archive of any size is spread over its ranges, and no group is larger than a range holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.session import materialise

RANGE_BYTES = 1 << 16
FANOUT = 16
VERSION = "WARC/1.0\r\n"


def record_of(url: Column, record_id: Column, payload: Column) -> Column:
    """The bytes of a resource record. A null payload is empty, a null address or id is left blank."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit(VERSION + "WARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """archive, offset, record of the uncompressed WARC files under ``path``, read in splits.

    Files are cut where a record's version line begins. A payload that contains that line is cut there too: an audit
    is as strict for the parts as for the whole. Offsets come from the lengths of a split's records and the splits
    before it, so no file meets in one task.
    """
    parts = spark.read.text(path, lineSep=VERSION).select(
        F.col("_metadata.file_path").alias("archive"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("no"), F.col("value").cast("binary").alias("rest"),
    )
    # What stands before the first version line is empty in a sound file; a damaged start stays as a record.
    rows = parts.withColumn("first", F.row_number().over(Window.partitionBy("archive", "split").orderBy("no")) == 1)
    rows = rows.withColumn("head", F.col("first") & (F.col("split") == 0)).filter("not head or octet_length(rest) > 0")
    record = F.when(F.col("head"), F.col("rest")).otherwise(F.concat(F.lit(VERSION).cast("binary"), F.col("rest")))
    rows = materialise(rows.select("archive", "split", "no", record.alias("record")), "warc").withColumn("n", F.octet_length("record").cast("bigint"))
    splits = rows.groupBy("archive", "split").agg(F.sum("n").alias("bytes"))
    base = splits.select("archive", "split", (F.sum("bytes").over(Window.partitionBy("archive").orderBy("split")) - F.col("bytes")).alias("base"))
    within = F.sum("n").over(Window.partitionBy("archive", "split").orderBy("no")) - F.col("n")
    return rows.withColumn("within", within).join(base, ["archive", "split"]).select(
        "archive", (F.col("base") + F.col("within")).alias("offset"), "record"
    )


def hashed(records: DataFrame) -> DataFrame:
    """archive, offset, n_bytes, hash of every record; equal rows count once. A null record is an empty one."""
    record = F.coalesce("record", F.lit(b""))
    # Records and inner nodes are hashed with different first bytes, so one cannot pass for the other.
    return records.select(
        "archive", "offset", F.octet_length(record).cast("bigint").alias("n_bytes"), F.sha2(F.concat(F.lit(b"\x00"), record), 256).alias("hash")
    ).distinct()


def parent_hash(order: list[str], child: str) -> Column:
    """Hash over the children in order, each with its place."""
    members = F.array_sort(F.collect_list(F.struct(*order, child)))
    text = F.array_join(F.transform(members, lambda m: F.concat_ws(":", *[m[c].cast("string") for c in (*order, child)])), "\n")
    return F.sha2(F.concat(F.lit(b"\x01"), text.cast("binary")), 256)


def tree_height(leaves: DataFrame) -> int:
    """Levels above the records: the lowest level counts ranges, the top one has a single node for every archive."""
    last = leaves.agg(F.max("offset")).first()[0] or 0
    height, ranges = 1, last // RANGE_BYTES
    while ranges:
        height, ranges = height + 1, ranges // FANOUT
    return height


def build_tree(leaves: DataFrame, height: int) -> list[DataFrame]:
    """The levels of the tree of ``leaves`` (from ``hashed``): level 0 the records, then archive, node, hash."""
    levels = [leaves]
    node = F.expr(f"coalesce(`offset`, 0) div {RANGE_BYTES}")
    level = leaves.withColumn("node", node).groupBy("archive", "node").agg(parent_hash(["offset", "n_bytes"], "hash").alias("hash"))
    for _ in range(height):
        levels.append(materialise(level, "merkle"))
        up = F.expr(f"node div {FANOUT}")
        level = levels[-1].withColumn("up", up).groupBy("archive", "up").agg(parent_hash(["node"], "hash").alias("hash")).withColumnRenamed("up", "node")
    return levels


def differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, hash_a, hash_b where one side lacks a row or the hashes differ."""
    left = a.select(*keys, F.col("hash").alias("hash_a"))
    right = b.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col("hash").alias("hash_b"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    joined = left.join(right, same, "full").filter(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
    here = F.col("hash_a").isNotNull()
    return joined.select(*[F.when(here, F.col(k)).otherwise(F.col(f"b_{k}")).alias(k) for k in keys], "hash_a", "hash_b")


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """archive, offset, n_bytes, problem, hash_a, hash_b for every record on which two replicas differ.

    ``a`` and ``b`` have archive, offset, record. ``problem`` is ``changed`` where both have a record at the offset,
    ``missing`` where only ``a`` has one, ``extra`` where only ``b``. A null archive or offset is a place of its own.
    Two different records at one place are compared as a pair of rows each. Empty tables agree.
    """
    left, right = materialise(hashed(a), "fixity"), materialise(hashed(b), "fixity")
    height = max(tree_height(left), tree_height(right))
    trees = build_tree(left, height), build_tree(right, height)
    found = differing(trees[0][height], trees[1][height], ["archive", "node"])
    for level in range(height - 1, -1, -1):
        bad = materialise(found.select(F.col("archive").alias("bad_archive"), F.col("node").alias("bad_node")).distinct(), "differing")
        up = F.expr(f"node div {FANOUT}") if level else F.expr(f"coalesce(`offset`, 0) div {RANGE_BYTES}")
        under = [
            t[level].join(bad, F.col("archive").eqNullSafe(F.col("bad_archive")) & (up == F.col("bad_node")), "left_semi")
            for t in trees
        ]
        found = differing(*under, ["archive", "node"] if level else ["archive", "offset", "n_bytes"])
    # A record of another length at the same place is one change, not a missing and an extra record.
    rows = found.groupBy("archive", "offset").agg(
        F.max("hash_a").alias("hash_a"), F.max("hash_b").alias("hash_b"),
        F.coalesce(F.max(F.when(F.col("hash_a").isNotNull(), F.col("n_bytes"))), F.max("n_bytes")).alias("n_bytes"),
    )
    problem = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("changed")
    return rows.select("archive", "offset", "n_bytes", problem.alias("problem"), "hash_a", "hash_b")


def archive_pages(pages: DataFrame, per_archive: int = 1000) -> DataFrame:
    """archive, offset, record, page_id: ``pages`` (page_id, url, html) as archives of consecutive ids.

    Pages without id go to archives by checksum. Equal rows are written one after the other.
    """
    number = F.expr(f"page_id div {per_archive}").cast("string")
    spare = F.concat(F.lit("x"), F.crc32(F.concat_ws(" ", "url", "html").cast("binary")).cast("string"))
    rows = pages.select("page_id", record_of(F.col("url"), F.col("page_id"), F.col("html")).alias("record"), F.coalesce(number, spare).alias("archive"))
    rows = rows.withColumn("n", F.octet_length("record").cast("bigint")).withColumn("mark", F.xxhash64("record"))
    order = Window.partitionBy("archive").orderBy("page_id", "mark").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("offset", F.sum("n").over(order) - F.col("n"))
    return placed.select(F.concat(F.lit("pages-"), "archive", F.lit(".warc")).alias("archive"), "offset", "record", "page_id")
