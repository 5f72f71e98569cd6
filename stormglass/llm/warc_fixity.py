"""Operator 4: Merkle fixity audit of WARC replicas.

Records are serialised as WARC/1.1 response records and hashed.  A file holds the
pages of a range of ids; its records lie in order of id, and each has an offset, the
sum of the lengths before it.  Records are the leaves of a tree, whose nodes cover
ranges of ids in order, FANOUT children a node, up to one root a file; a node's hash
covers its children's hashes and offset ranges in order.  The audit compares roots of two replicas and descends only into nodes that
differ, level by level, down to records.

Ranges are cut by id, not by count, so a lost record changes one branch and not all
that follow.  Everything is built-in functions; only ids, lengths and hashes are
shuffled.

Cases: a null html or url is an empty one; records with a null id belong to a file of their own,
spread over its leaves by their hashes, so that an altered one is missing from one leaf and extra in
another, or changes both where other records share them; records that share an id (or such a leaf) in one
replica are one leaf, hashed from their number and the sums of their hashes' pieces, so that no list of
them is gathered;
a record that one replica lacks is reported as missing or extra; empty replicas have
no roots; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

#: Ids of a file, children of a node.  FILE_IDS is a power of FANOUT.
FILE_IDS, FANOUT, LEVELS = 4096, 16, 3
#: The file of the records without an id.
NO_ID_FILE = -(2**62)


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A response record as text; its Content-Length counts UTF-8 bytes."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def leaves(pages: DataFrame) -> DataFrame:
    """One row for each id: file_no, slot (its place in the file's range), page_id, offset, length and hash."""
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    hashed = pages.select(F.col("page_id").cast("long").alias("page_id"), record.alias("record")).select("page_id", F.sha2("record", 256).alias("record_hash"), F.octet_length("record").cast("long").alias("length"))
    spread = F.conv(F.substring("record_hash", 1, 3), 16, 10).cast("long")
    slot = F.coalesce(F.pmod("page_id", F.lit(FILE_IDS)), spread).cast("int")
    piece = lambda i: F.conv(F.substring("record_hash", 15 * i + 1, 15), 16, 10).cast("decimal(20,0)")
    sums = [F.sum(piece(i)).alias(f"sum_{i}") for i in range(4)]
    by_id = hashed.groupBy("page_id", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min("record_hash").alias("least"), *sums, F.sum("length").alias("length"))
    file_no = F.coalesce(F.floor(F.col("page_id") / FILE_IDS), F.lit(NO_ID_FILE)).cast("long")
    several = F.sha2(F.concat_ws(":", "n", *(f"sum_{i}" for i in range(4))), 256)
    placed = by_id.select(file_no.alias("file_no"), "slot", "page_id", "length", F.when(F.col("n") == 1, F.col("least")).otherwise(several).alias("hash"))
    before = Window.partitionBy("file_no").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def tree(leaf_rows: DataFrame) -> list[DataFrame]:
    """Levels from the leaves (0) to the roots: file_no, node, hash, lo and hi (the offsets covered)."""
    level = leaf_rows.select("file_no", F.col("slot").alias("node"), "hash", F.col("offset").alias("lo"), (F.col("offset") + F.col("length")).alias("hi"))
    out = [level]
    for _ in range(LEVELS):
        parent = F.floor(F.col("node") / FANOUT).cast("int").alias("node")
        kids = F.array_sort(F.collect_list(F.struct("child", "hash", "lo", "hi"))).alias("kids")
        nodes = level.select("file_no", parent, F.col("node").alias("child"), "hash", "lo", "hi").groupBy("file_no", "node").agg(kids, F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        # Ranges count from the node's own begin, so that what is lost before it leaves the node as it is.
        covered = F.transform("kids", lambda x: F.concat_ws(":", x["child"], x["lo"] - F.col("lo"), x["hi"] - F.col("lo"), x["hash"]))
        level = nodes.select("file_no", "node", F.sha2(F.array_join(covered, ";"), 256).alias("hash"), "lo", "hi")
        level = cut(level)
        out.append(level)
    return out


def audit(replica_a: DataFrame, replica_b: DataFrame) -> DataFrame:
    """One row for each record that differs between two replicas (page_id, url, html).

    Columns: page_id, file_no, status (changed, missing or extra in b), hash_a, hash_b,
    offset_a and length_a, offset_b and length_b: where the record lies in each replica.
    """
    sides = []
    for pages in (replica_a, replica_b):
        leaf_rows = cut(leaves(pages))
        sides.append((leaf_rows, tree(leaf_rows)))
    (leaf_a, tree_a), (leaf_b, tree_b) = sides
    suspects = None
    for level in range(LEVELS, -1, -1):
        a = tree_a[level].select("file_no", "node", F.col("hash").alias("hash_a"))
        b = tree_b[level].select("file_no", "node", F.col("hash").alias("hash_b"))
        if suspects is not None:
            keep = suspects.select("file_no", F.col("node").alias("parent"))
            at = lambda side: side.withColumn("parent", F.floor(F.col("node") / FANOUT).cast("int")).join(keep, ["file_no", "parent"], "left_semi").drop("parent")
            a, b = at(a), at(b)
        # Written at each level, so that the next one starts from what differs and no more.
        suspects = cut(a.join(b, ["file_no", "node"], "full_outer").filter(~F.col("hash_a").eqNullSafe(F.col("hash_b"))))
    place = lambda side, x: side.select("file_no", F.col("slot").alias("node"), F.col("page_id").alias(f"id_{x}"), F.col("offset").alias(f"offset_{x}"), F.col("length").alias(f"length_{x}"))
    found = suspects.join(place(leaf_a, "a"), ["file_no", "node"], "left").join(place(leaf_b, "b"), ["file_no", "node"], "left")
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("changed")
    return found.select(F.coalesce("id_a", "id_b").alias("page_id"), "file_no", status.alias("status"), "hash_a", "hash_b", "offset_a", "length_a", "offset_b", "length_b")


def damaged_replica(pages: DataFrame) -> DataFrame:
    """A second replica with faults at fixed places, to audit: of ids, 1 of 97 altered, 1 of 211 lost, 1 of 503 twice as an id beyond."""
    page_id = F.col("page_id")
    kept = pages.filter((page_id % 211 != 5) | page_id.isNull())
    altered = kept.withColumn("html", F.when(page_id % 97 == 3, F.concat(F.col("html"), F.lit("\u0001"))).otherwise(F.col("html")))
    added = pages.filter(page_id % 503 == 7).withColumn("page_id", -page_id)
    return altered.unionByName(added)


def op4_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return audit(pages, damaged_replica(pages))


ORACLE_SQL = {
    "op4_merkle_fixity": f"""
    WITH b AS (
        SELECT page_id, url, CASE WHEN page_id % 97 = 3 THEN html || chr(1) ELSE html END AS html FROM pages WHERE page_id % 211 <> 5
        UNION ALL SELECT -page_id, url, html FROM pages WHERE page_id % 503 = 7),
    rec AS (
        SELECT side, page_id, 'WARC/1.1' || e || 'WARC-Type: response' || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e || 'WARC-Target-URI: ' || url || e
            || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen(html) || e || e || html || e || e AS record
        FROM (SELECT 'a' AS side, page_id, url, html, chr(13) || chr(10) AS e FROM pages UNION ALL SELECT 'b', page_id, url, html, chr(13) || chr(10) FROM b)),
    leaf AS (
        SELECT side, page_id, CAST(floor(page_id / {FILE_IDS}.0) AS BIGINT) AS file_no, sha256(record) AS hash, strlen(record) AS length FROM rec),
    placed AS (
        SELECT *, coalesce(sum(length) OVER (PARTITION BY side, file_no ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM leaf)
    SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.file_no, b.file_no) AS file_no,
        CASE WHEN b.hash IS NULL THEN 'missing' WHEN a.hash IS NULL THEN 'extra' ELSE 'changed' END AS status,
        a.hash AS hash_a, b.hash AS hash_b, CAST(a."offset" AS BIGINT) AS offset_a, CAST(a.length AS BIGINT) AS length_a, CAST(b."offset" AS BIGINT) AS offset_b, CAST(b.length AS BIGINT) AS length_b
    FROM (SELECT * FROM placed WHERE side = 'a') a FULL OUTER JOIN (SELECT * FROM placed WHERE side = 'b') b ON a.page_id = b.page_id
    WHERE a.hash IS DISTINCT FROM b.hash
    """
}
QUERIES = {"op4_merkle_fixity": op4_merkle_fixity}
