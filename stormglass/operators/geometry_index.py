"""The geometries' side table laid out for look-ups: a look-up reads a row group of one file, or nothing.

Rows are dealt to buckets by the hash of their ref, a folder and a file each, sorted by ref, with small row groups and a bloom filter on
ref.  The folder's names carry the number of buckets, so a look-up prunes to its bucket by the plan alone; in there the row groups' bounds and the
filter leave one group, and none for most refs that are not there.

Cases: a null ref is never found; of repeated refs all rows come; an empty store is an empty folder, in which nothing is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .geometry import collections

#: Rows of a bucket at most, about, and bytes of a row group.
BUCKET_ROWS, GROUP_BYTES = 200_000, 2**20
_COLUMNS = "ref string, geometry string, size long, touch_seq long"


def bucket_of(ref: Column, of: Column) -> Column:
    return F.pmod(F.xxhash64(ref), of).cast("int")


def write(store: DataFrame, path: str, bucket_rows: int = BUCKET_ROWS) -> int:
    """Lay out ``store`` (ref, geometry, size, touch_seq) at ``path``; gives the number of buckets."""
    n = max(1, -(-store.count() // bucket_rows))
    dealt = store.select(*(c.split()[0] for c in _COLUMNS.split(", "))).withColumns({"of": F.lit(n), "bucket": bucket_of(F.col("ref"), F.lit(n))})
    out = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "ref").write.partitionBy("of", "bucket").mode("overwrite")
    for name, value in (("bloom.filter.enabled#ref", "true"), ("bloom.filter.expected.ndv#ref", str(bucket_rows)), ("block.size", str(GROUP_BYTES)), ("page.size", str(2**16))):
        out = out.option(f"parquet.{name}", value)
    out.parquet(path)
    return n


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{_COLUMNS}, of int, bucket int").parquet(path)


def lookup(spark: SparkSession, path: str, ref: str) -> DataFrame:
    """One row (ref, body), or none: not found."""
    found = read(spark, path).filter((F.col("bucket") == bucket_of(F.lit(ref), F.col("of"))) & (F.col("ref") == ref))
    return collections(found)


def lookup_all(spark: SparkSession, path: str, refs: DataFrame) -> DataFrame:
    """(ref, body) of all of ``refs`` (ref) that are there: each bucket meets the refs of its own."""
    store = read(spark, path)
    of = store.select("of").limit(1).collect()
    if not of:
        return collections(store)
    wanted = refs.select("ref").filter("ref is not null").distinct().withColumn("bucket", bucket_of(F.col("ref"), F.lit(of[0][0])))
    return collections(store.join(wanted, ["bucket", "ref"], "left_semi"))
