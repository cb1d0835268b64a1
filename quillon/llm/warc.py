"""Merkle fixity audit of WARC replicas.

A replica's records are hashed one by one.  A leaf covers a distinct record: its id, length, content
hash and number of copies.  Records of a file are ordered by id and content hash; every node above
covers one range of that order, and so one range of offsets: first the records of an id that share
two hash digits, then an id, then 16, 256 and all ids of the file.  Auditing compares the files' roots
and descends only where digests differ; what remains below is aligned by record id, so a record that
changed its length, was lost or was added is one finding and its neighbours are none.

Digests hold no offsets: nodes carry them as labels (lo, hi).  Record hashes and lengths are all that
is shuffled, never record contents; the lowest nodes are sums that merge before the shuffle, so an id
with very many records never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import kept

RECORDS_PER_FILE = 4096
#: Files of records without an id.
NULL_FILES = 64
#: Digits of a node's path at each level, the file's root last.
LEVELS = (5, 3, 2, 1, 0)
ID = ["file", "slot", "page_id"]


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The WARC response record of a page; null url or html count as empty."""
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    head = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"
    return F.concat(
        F.lit(head), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"),
    )


def leaves(pages: DataFrame, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """file, slot, page_id, path, seq, offset, length, copies, record_sha256 of a replica's distinct records.

    A file holds the records of ``per_file`` (4096 at most) consecutive page ids, in the order of id and
    hash; records without an id are spread over files of their own by their url.  Repeated rows are one
    leaf with their number.  Other columns don't matter; an empty table has no leaves.
    """
    if not 0 < per_file <= RECORDS_PER_FILE:
        raise ValueError(f"a file holds the records of 1 to {RECORDS_PER_FILE} ids")
    page, url, text = F.col("page_id").cast("long"), F.coalesce("url", F.lit("")), record(F.col("page_id"), F.col("url"), F.col("html"))
    file = F.coalesce(F.floor(page / F.lit(per_file)).cast("long"), -1 - F.pmod(F.xxhash64(url, F.lit(1)), F.lit(NULL_FILES)))
    slot = F.coalesce(F.pmod(page, F.lit(per_file)), F.pmod(F.xxhash64(url, F.lit(2)), F.lit(per_file)))
    hashed = pages.select(file.alias("file"), slot.alias("slot"), page.alias("page_id"), F.octet_length(text).cast("long").alias("length"), F.sha2(text, 256).alias("record_sha256"))
    once = hashed.groupBy("file", "slot", "page_id", "length", "record_sha256").agg(F.count("*").alias("copies"))
    path = F.concat(F.lower(F.lpad(F.hex("slot"), 3, "0")), F.substring("record_sha256", 1, 2))
    once = once.withColumn("path", path)
    # places in two steps: of a path within its file, then within the path
    size = once.groupBy("file", "path").agg(F.sum(F.col("length") * F.col("copies")).alias("bytes"), F.sum("copies").alias("n"))
    before = Window.partitionBy("file").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    base = size.select("file", "path", sums("bytes", before).alias("_bytes"), sums("n", before).alias("_n"))
    inner = Window.partitionBy("file", "path").orderBy("record_sha256", "page_id", "length").rowsBetween(Window.unboundedPreceding, -1)
    placed = once.withColumn("_in", sums(F.col("length") * F.col("copies"), inner)).withColumn("_k", sums("copies", inner)).join(base, ["file", "path"])
    return placed.select(*ID, "path", (F.col("_n") + F.col("_k")).alias("seq"), (F.col("_bytes") + F.col("_in")).alias("offset"), "length", "copies", "record_sha256")


def tree(leaf: DataFrame) -> DataFrame:
    """Nodes (file, depth, path, lo, hi, digest) of all levels, from a kept table of ``leaves``."""
    text = F.sha2(F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("length").cast("string"), F.col("copies").cast("string"), "record_sha256"), 256)
    limbs = [F.conv(F.substring(text, 1 + 15 * i, 15), 16, 10).cast("long").alias(f"x{i}") for i in range(4)]
    rows = leaf.select("file", "path", F.col("offset").alias("lo"), (F.col("offset") + F.col("length") * F.col("copies")).alias("hi"), *limbs)
    low = rows.groupBy("file", "path").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *(F.bit_xor(f"x{i}").alias(f"x{i}") for i in range(4)), F.count("*").alias("n"))
    low = low.select("file", "path", "lo", "hi", F.sha2(F.concat_ws(":", "x0", "x1", "x2", "x3", "n"), 256).alias("digest"))
    parts = int(leaf.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    node, out = low.repartition(parts, "file"), None  # a file has 2 ** 20 such nodes at most
    for depth in LEVELS:
        if depth < LEVELS[0]:
            node = node.groupBy("file", F.substring("path", 1, depth).alias("path")).agg(
                F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sha2(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("path", "digest"))), lambda x: F.concat_ws(":", x["path"], x["digest"]))), 256).alias("digest")
            )
        level = node.select("file", F.lit(depth).alias("depth"), "path", "lo", "hi", "digest")
        out = level if out is None else out.union(level)
    return out


def audit(primary: DataFrame, replica: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots, damage) for two kept tables of ``leaves``.

    roots: file, file_root of the primary.  damage: the leaves that differ with their status: ``corrupt``
    (the replica has other contents for the id) and ``missing`` as the primary has them, ``extra`` as the
    replica has them.  Of several records of one id as many as differ on both sides are corrupt, the rest
    missing or extra, in the order of their hashes.  Empty tables have neither.
    """
    ours, theirs = kept(tree(primary), "tree"), kept(tree(replica), "tree")
    suspect = None
    for i in range(len(LEVELS) - 1, -1, -1):
        a, b = (x.where(F.col("depth") == LEVELS[i]).select("file", "path", "digest") for x in (ours, theirs))
        if suspect is not None:
            up = F.substring("path", 1, LEVELS[i + 1])
            a, b = (x.withColumn("_up", up).join(suspect, ["file", "_up"], "left_semi").drop("_up") for x in (a, b))
        a, b = a.withColumnRenamed("digest", "_a"), b.withColumnRenamed("digest", "_b")
        differ = a.join(b, ["file", "path"], "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
        suspect = kept(differ.select("file", F.col("path").alias("_up")), "suspects")
    nodes = suspect.withColumnRenamed("_up", "path")
    a, b = (x.join(nodes, ["file", "path"], "left_semi") for x in (primary, replica))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*ID, "length", "copies", "record_sha256"]]
    rank = F.row_number().over(Window.partitionBy(*ID).orderBy("record_sha256", "length"))
    left = a.alias("a").join(b.alias("b"), [F.col("a.path") == F.col("b.path"), *same], "left_anti").withColumn("_r", rank)
    right = b.alias("b").join(a.alias("a"), [F.col("a.path") == F.col("b.path"), *same], "left_anti").withColumn("_r", rank)
    pairs = [F.col("a.file") == F.col("b.file"), F.col("a.slot") == F.col("b.slot"), F.col("a.page_id").eqNullSafe(F.col("b.page_id")), F.col("a._r") == F.col("b._r")]
    lost = left.alias("a").join(right.select(*ID, "_r").withColumn("_there", F.lit(1)).alias("b"), pairs, "left")
    ours_said = lost.select(*(F.col(f"a.{c}") for c in primary.columns), F.when(F.col("_there") == 1, "corrupt").otherwise("missing").alias("status"))
    added = right.alias("b").join(left.select(*ID, "_r").alias("a"), pairs, "left_anti").select(*primary.columns, F.lit("extra").alias("status"))
    return ours.where("depth = 0").select("file", F.col("digest").alias("file_root")), ours_said.union(added)
