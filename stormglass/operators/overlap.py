"""Which alerts share a code with which entries, for all entries at once.

An entry meets an alert through each code that both have.  No list of all pairs has to be made distinct:

* ``counted`` adds up how many alerts each code of an entry has, and takes off what that counts more than once, found by pairs of codes (``several``).  Alerts (entries)
  with the same codes are one kind, so its work goes by kinds and not by pairs of entries and alerts.
* ``paired`` keeps the entries and the alerts of each code in lists of some PART ids.  Two lists of a code are a block, which one task turns into pairs, less
  those that meet through an earlier code: each id brings its earlier codes along, so such pairs are told inside the block and never listed.
  Pairs go out as they are made: they are neither shuffled nor spilled, and a code that all alerts have, or all entries want, is dealt by its blocks.
  A block's pairs go out alert by alert, each with the same GROUP of entries again, and a task has few enough ids for Parquet's dictionaries: a result of many pairs takes little disk.

A list of more than LONG codes has too many pairs of codes; entries and alerts with such lists are compared by bitmaps.  There, alerts are numbered in order of their
ids.  A code's alerts are a bitmap, in buckets of BITS numbers; an entry's are those of its
codes, united bucket by bucket (``matches``).  The buckets of a code that many alerts have
are dealt to parts of PART_BUCKETS, and the entries that want it go to all of its parts.  A bitmap for each
entry and bucket costs some KB however few its alerts are, so this is for few entries or few alerts.

Cases: null ids and null or empty codes match nothing; repeated ids are one alert (entry) with the codes of all its
rows; entries or alerts without codes have no match; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .order import placed

#: Bits of a bucket of Spark's bitmaps, and buckets of a code that one task joins.
BITS, PART_BUCKETS = 32768, 8
#: Ids of a list of a code, and codes beyond which a row is long.
PART, LONG = 4096, 32
#: Ids in the lists of one task: Parquet has a dictionary for twice as many. What stands for no code.
TASK, ALL = 65536, -1
#: Entries that go out together with an alert: they are the same for the next one, near enough for Parquet's compression to find.
GROUP = 256


def _codes(df: DataFrame, key: str, codes: str) -> DataFrame:
    rows = df.select(F.col(key).alias("key"), F.explode(codes).alias("code"))
    return rows.filter("key is not null and code is not null").filter(F.col("code").cast("string") != "")


def numbered(alerts: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, n): each id once with its number, from 1."""
    ids = alerts.select(F.col(id_col).alias("id")).filter("id is not null").distinct()
    return placed(ids, [F.col("id")], place="at", size="of").select("id", (F.col("at") + 1).alias("n"))


def matches(entries: DataFrame, alerts: DataFrame, numbers: DataFrame, entry_col: str = "entry_id", id_col: str = "id", entry_codes: str = "regions", codes: str = "geocode_same") -> DataFrame:
    """(entry_id, bucket, bitmap): the alerts, by their ``numbers``, that share a code with each entry."""
    coded = _codes(alerts, id_col, codes).join(numbers, F.col("key") == F.col("id"))
    bitmaps = written(coded.groupBy("code", F.bitmap_bucket_number("n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bitmap")))
    parts = written(bitmaps.groupBy("code").agg(F.floor(F.max("bucket") / PART_BUCKETS).alias("last")))
    wanted = _codes(entries, entry_col, entry_codes).distinct().join(parts, "code").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    met = wanted.join(bitmaps.withColumn("part", F.floor(F.col("bucket") / PART_BUCKETS)), ["code", "part"])
    return met.groupBy(F.col("key").alias("entry_id"), "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def counts(found: DataFrame) -> DataFrame:
    """(entry_id, n_alerts) of ``matches``."""
    return found.groupBy("entry_id").agg(F.sum(F.bitmap_count("bitmap")).alias("n_alerts"))


def pairs(found: DataFrame, numbers: DataFrame) -> DataFrame:
    """(entry_id, id) of ``matches``."""
    kind = found.schema["entry_id"].dataType.simpleString()

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(batch.column(2)[i].as_py(), np.uint8), bitorder="little"))
                n = (batch.column(1)[i].as_py() - 1) * BITS + at + 1
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], len(n)), pa.array(n, pa.int64())], names=["entry_id", "n"])

    return found.select("entry_id", "bucket", "bitmap").mapInArrow(bits, f"entry_id {kind}, n long").join(numbers, "n").select("entry_id", "id")


def coded(df: DataFrame, key: str, codes: str) -> DataFrame:
    """(key, codes): each id once with its codes, in order; those without any are left out."""
    wanted = F.filter(F.col(codes).cast("array<string>"), lambda c: c.isNotNull() & (c != ""))
    rows = df.select(F.col(key).alias("key"), wanted.alias("codes")).filter("key is not null and size(codes) > 0")
    return rows.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"))


def _pairs_of(codes: str) -> Column:
    """Each two of a row's codes, in order."""
    later = lambda c, i: F.transform(F.slice(codes, i + 2, F.size(codes)), lambda d: F.struct(c.alias("a"), d.alias("b")))
    return F.flatten(F.transform(codes, later))


def several(entries: DataFrame, alerts: DataFrame) -> DataFrame:
    """(e, a, shared): entries (e, codes) and alerts (a, codes) that share several codes, and these in order."""
    of = lambda df: df.select(*df.columns, F.explode(_pairs_of("codes")).alias("p"))
    met = of(entries.withColumnRenamed("codes", "wanted").withColumn("codes", F.col("wanted"))).join(of(alerts), "p").select("e", "a", "p", F.array_intersect("wanted", alerts["codes"]).alias("shared"))
    # Of the pairs of codes that two rows share, the first stands for all.
    return met.filter((F.col("p.a") == F.col("shared")[0]) & (F.col("p.b") == F.col("shared")[1])).select("e", "a", "shared")


def _long(df: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Rows of few codes, those of many, and whether there are any of these."""
    many = df.filter(F.size("codes") > LONG)
    return df.filter(F.size("codes") <= LONG), many, not many.isEmpty()


def counted(entries: DataFrame, alerts: DataFrame, entry_col: str = "entry_id", id_col: str = "id", entry_codes: str = "regions", codes: str = "geocode_same") -> DataFrame:
    """(entry_id, n_alerts) of the entries with a match."""
    members, coming = written(coded(entries, entry_col, entry_codes)), written(coded(alerts, id_col, codes))
    kinds = written(members.select("codes").distinct().select(F.monotonically_increasing_id().alias("e"), "codes"))
    few, many, long_kinds = _long(kinds)
    few_alerts, many_alerts, long_alerts = _long(coming)
    sorts = written(few_alerts.groupBy("codes").agg(F.count(F.lit(1)).alias("n")).select(F.monotonically_increasing_id().alias("a"), "codes", "n"))
    of_code = sorts.select(F.explode("codes").alias("code"), "n").groupBy("code").agg(F.sum("n").alias("n"))
    each = few.select("e", F.explode("codes").alias("code")).join(of_code, "code").select("e", "n")
    twice = several(few, sorts.select("a", "codes")).join(sorts.select("a", "n"), "a").select("e", (F.col("n") * (1 - F.size("shared"))).alias("n"))
    parts = each.unionByName(twice)
    for there, k, a in ((long_kinds, many, coming), (long_alerts, few, many_alerts)):
        if there:
            parts = parts.unionByName(counts(matches(k, a, numbered(a, "key"), "e", "key", "codes", "codes")).toDF("e", "n"))
    found = parts.groupBy("e").agg(F.sum("n").alias("n_alerts")).join(kinds, "e")
    return members.join(found, "codes").select(F.col("key").alias("entry_id"), "n_alerts")


def paired(entries: DataFrame, alerts: DataFrame, entry_col: str = "entry_id", id_col: str = "id", entry_codes: str = "regions", codes: str = "geocode_same") -> DataFrame:
    """(entry_id, id) of all pairs that share a code, each once; a block's pairs are together, alert by alert."""
    wants, has = (_codes(df, key, c).select(F.col("key").alias(k), F.col("code").cast("string").alias("code")) for df, key, c, k in ((entries, entry_col, entry_codes, "e"), (alerts, id_col, codes, "a")))
    sizes = lambda rows, k: rows.groupBy("code").agg(F.count(F.lit(1)).alias(f"{k}_size")).withColumn(f"{k}_parts", F.ceil(F.col(f"{k}_size") / PART))
    shared = written(sizes(wants, "e").join(sizes(has, "a"), "code").withColumn("c", F.monotonically_increasing_id()))
    # Codes go by their numbers from here on, those that only one side has not at all.
    of = lambda rows, k: written(rows.join(shared.select("code", "c"), "code").groupBy(k).agg(F.array_sort(F.collect_set("c")).alias("codes")))
    wanting, coming = of(wants, "e"), of(has, "a")
    few, many, long_entries = _long(wanting)
    few_alerts, many_alerts, long_alerts = _long(coming)
    size = shared.agg(F.sum(F.col("e_size") * F.col("a_parts") + F.col("a_size") * F.col("e_parts"))).first()[0] or 0
    n_tasks, block = -(-size // TASK) or 1, ["c", "e_part", "a_part"]

    def dealt(rows: DataFrame, k: str, other: str, *more: Column) -> DataFrame:
        """Each id in a part of each of its codes, told by a hash, once for each part of the other side, with the codes before this one."""
        each = rows.select(k, "codes", F.posexplode("codes").alias("at", "c")).join(shared, "c")
        parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_parts") - 1)).alias(f"{other}_part")
        return each.select("c", F.pmod(F.xxhash64(k), f"{k}_parts").alias(f"{k}_part"), parts, k, F.slice("codes", 1, F.col("at")).alias("before"), *more).repartition(n_tasks, *block)

    # A group of a block's entries, at ALL, and those of them that want each earlier code, too.
    wanted = dealt(few, "e", "a", F.pmod(F.hash("e"), F.ceil(F.col("e_size") / F.col("e_parts") / GROUP)).alias("group")).withColumn("code", F.explode(F.concat(F.array(F.lit(ALL)), "before")))
    lists = wanted.groupBy(*block, "group", "code").agg(F.collect_list("e").alias("es")).groupBy(*block, "group").agg(F.map_from_entries(F.collect_list(F.struct("code", "es"))).alias("by"))
    ids = dealt(few_alerts, "a", "e").groupBy(*block).agg(F.collect_list(F.struct("a", "before")).alias("ids"))
    each = lists.join(ids, block).select("by", F.element_at("by", F.lit(ALL)).alias("es"), F.explode("ids").alias("id"))
    met = F.flatten(F.filter(F.transform("id.before", lambda c: F.try_element_at("by", c)), lambda es: es.isNotNull()))
    left = each.select(F.col("id.a").alias("id"), "es", met.alias("met")).select("id", F.when(F.size("met") == 0, F.col("es")).otherwise(F.array_except("es", "met")).alias("es"))
    # An inner explode would have Spark make the lists twice, once to see which are empty.
    found = left.select(F.explode_outer("es").alias("entry_id"), "id").filter("entry_id is not null")
    for there, e, a in ((long_entries, many, coming), (long_alerts, few, many_alerts)):
        if there:
            numbers = written(numbered(a, "a"))
            found = found.unionByName(pairs(matches(e, a, numbers, "e", "a", "codes", "codes"), numbers))
    return found
