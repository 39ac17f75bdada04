"""WARC fixity audit over Merkle trees.

Records of an archive lie in files in the order of their numbers. A record's place in the tree is the rank of its number
among those of both replicas, so a lost record leaves a hole and shifts nothing. A leaf is an offset range of a
file: the gap before it, its length and the SHA-256 of the whole record; an inner node hashes the ordered ranges
of its children (start and end from the node's own start, gap, digest), `fan` to a node, up to
one root per replica. Two replicas are compared from the root: only below nodes that differ
are children looked at, so equal branches cost one comparison. Offsets are a column of the input where it has one
(`offset`), else records follow each other without gaps.

Every level is a groupBy over `fan` times fewer rows; descents are joins on node numbers.
Nothing but a count comes to the driver.

Cases: a null number is replaced by a negative one, from a checksum of the target; records that share a number share a
leaf, which hashes them in the order of their digests; a null target, body or record reads as empty;
two empty replicas agree; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import if_small, materialise


def warc_record(number: Column, url: Column, body: Column) -> Column:
    """A WARC/1.1 response record as text."""
    body, url = F.coalesce(body, F.lit("")), F.coalesce(url, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:"), number.cast("string"), F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """number, record (text) of each page."""
    unnamed = -1 - F.crc32(F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    number = F.coalesce(F.col(id_col).cast("long"), unnamed)
    return pages.select(number.alias("number"), warc_record(number, F.col(url_col).cast("string"), F.col(body_col).cast("string")).alias("record"))


def leaves(rows: DataFrame) -> DataFrame:
    """number, offset (null if not given), bytes, digest: one leaf per record number."""
    given = F.col("offset").cast("long") if "offset" in rows.columns else F.lit(None).cast("long")
    record = F.coalesce(F.col("record"), F.lit(""))
    own = rows.select("number", given.alias("offset"), F.octet_length(record).cast("long").alias("bytes"), F.sha2(record, 256).alias("digest"))
    grouped = own.groupBy("number").agg(F.min("offset").alias("offset"), F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.array_sort(F.collect_list("digest")).alias("all"))
    return grouped.select("number", "offset", "bytes", F.when(F.col("n") == 1, F.col("all")[0]).otherwise(F.sha2(F.array_join("all", ","), 256)).alias("digest"))


def _ranks(numbers: DataFrame) -> DataFrame:
    """number, node: the rank of each number from 0, by ranges that are counted and then ranked each on its own."""
    parts = materialise(numbers.distinct().repartitionByRange("number").withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    ahead = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))  # a row for each partition
    rank = F.row_number().over(Window.partitionBy("part").orderBy("number")) - 1
    return parts.withColumn("rank", rank).join(if_small(ahead), "part").select("number", (F.col("rank") + F.col("ahead")).cast("long").alias("node"))


def _placed(own: DataFrame, ranks: DataFrame, replica: int, file_records: int) -> DataFrame:
    """The leaves of a replica with node, file, start, end and gap."""
    order = Window.partitionBy("file").orderBy("node")  # a file at a time
    placed = own.join(ranks, "number").withColumn("file", F.floor(F.col("node") / file_records).cast("long"))
    placed = placed.withColumn("start", F.coalesce("offset", F.sum("bytes").over(order) - F.col("bytes"))).withColumn("end", F.col("start") + F.col("bytes"))
    gap = F.col("start") - F.lag("end", 1, 0).over(order)
    return placed.select(F.lit(replica).alias("replica"), "node", "number", "file", "start", "end", gap.alias("gap"), "digest")


def _above(nodes: DataFrame, fan: int) -> DataFrame:
    """The next level of both trees: children are hashed with their places, so that a hole or a shift changes the parent."""
    ranges = "array_sort(collect_list(struct(node, start, end, gap, digest)))"
    text = "array_join(transform(c, x -> concat_ws(':', x.node, x.start - c[0].start, x.end - c[0].start, x.gap, x.digest)), ',')"
    up = nodes.withColumn("up", F.floor(F.col("node") / fan).cast("long"))
    up = up.groupBy("replica", "up").agg(F.expr(ranges).alias("c"))
    return up.select("replica", F.col("up").alias("node"), F.expr("c[0].start AS start"), F.expr("c[size(c) - 1].end AS end"), F.expr("c[0].gap AS gap"), F.sha2(F.expr(text), 256).alias("digest"))


def _differing(nodes: DataFrame) -> DataFrame:
    """node, expected, found, expected_gap, found_gap of the nodes that are not the same in both trees."""
    sides = [F.max(F.when(F.col("replica") == k, F.col(c))).alias(name) for k, c, name in ((0, "digest", "expected"), (1, "digest", "found"), (0, "gap", "expected_gap"), (1, "gap", "found_gap"))]
    return nodes.groupBy("node").agg(*sides).where("NOT (expected <=> found AND expected_gap <=> found_gap)")


def audit(reference: DataFrame, replica: DataFrame, *, fan: int = 16, file_records: int = 4096) -> DataFrame:
    """The differing leaves: number, file, offset, bytes, status (corrupt, missing, extra, moved), digests, levels.

    Inputs have (number, record) and may have offset, the place in the file. The result's offset is the place in the
    reference file; null for an extra record. `moved`: the right bytes after a gap (or overlap) that the reference doesn't have.
    """
    own, other = materialise(leaves(reference)), materialise(leaves(replica))
    ranks = materialise(_ranks(own.select("number").union(other.select("number"))))
    tree = [materialise(_placed(own, ranks, 0, file_records).unionByName(_placed(other, ranks, 1, file_records)))]
    high = ranks.count() - 1
    while high > 0:
        high //= fan
        tree.append(materialise(_above(tree[-1], fan)))
    # Each level is written once and so is what differs on it: a descent reads no branch that agrees.
    differ = _differing(tree[-1])
    for nodes in tree[-2::-1]:
        up = materialise(differ).select(F.col("node").alias("up"))
        differ = _differing(nodes.withColumn("up", F.floor(F.col("node") / fan).cast("long")).join(up, "up", "left_semi"))
    placed = tree[0].where("replica = 0").select("node", F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("bytes"))
    status = F.when(F.col("expected").isNull(), "extra").when(F.col("found").isNull(), "missing").when(F.expr("expected = found"), "moved").otherwise("corrupt")
    return (
        differ.join(ranks, "node")
        .join(placed, "node", "left")
        .select("number", F.floor(F.col("node") / file_records).cast("long").alias("file"), "offset", "bytes", status.alias("status"), "expected", "found", F.lit(len(tree) - 1).alias("levels"))
    )


def damaged(rows: DataFrame) -> DataFrame:
    """A replica with known faults: by the CRC-32 of its number a record in 41 has a letter changed, one in 83 is cut short and one in 127 lost."""
    mark = F.crc32(F.col("number").cast("string"))
    half = (F.length("record") / 2).cast("int")
    changed = F.concat(F.expr("substring(record, 1, CAST(length(record) / 2 AS int))"), F.lit("~"), F.expr("substring(record, CAST(length(record) / 2 AS int) + 2)"))
    record = F.when(mark % 41 == 0, changed).when(mark % 83 == 0, F.col("record").substr(F.lit(1), half)).otherwise(F.col("record"))
    return rows.where(mark % 127 != 0).withColumn("record", record)
