"""A place for each row in a global order, without one task that sees all rows.

Rows are dealt by ranges of the order, sorted within each range and numbered there; the counts of
the ranges before it are added to each number.  Equal rows, however many, spread over ranges:
the last key of a range is a running number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: monotonically_increasing_id has the partition above these bits and the row below them.
ROW_BITS = 33


def placed(df: DataFrame, order: list[Column | tuple[Column, bool]], by: list[Column] | None = None, place: str = "place", size: str = "size") -> DataFrame:
    """``df`` with ``place``, from 0 in ``order`` among the rows of its ``by`` (all rows without it), and ``size``, the number of these.

    A key of ``order`` ascends, nulls first; (key, True) descends, nulls last.  A null in ``by`` is a
    group of its own, rows that are equal in ``order`` follow each other in any sequence, an empty table
    gives an empty one.  Any names of columns will do, but for those of the two new ones.
    """
    by = by or []
    keys = {f"b{i}": c for i, c in enumerate(by)}
    order = [k if isinstance(k, tuple) else (k, False) for k in order]
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(c.alias(n) for n, c in keys.items()), F.monotonically_increasing_id().alias("tie"), *(c.alias(f"o{i}") for i, (c, _) in enumerate(order)))
    sort = [*map(F.col, keys), *(F.desc(f"o{i}") if down else F.asc(f"o{i}") for i, (_, down) in enumerate(order)), F.col("tie")]
    ranged = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("at", F.monotonically_increasing_id())
    table = written(ranged.select("row", *keys, "at", F.shiftright("at", ROW_BITS).alias("range")))
    counts = table.groupBy(*keys, "range").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("begin"))
    offsets = _of_groups(counts, list(keys)) if keys else _of_ranges(counts)
    offsets = written(offsets.select(*(F.col(n).alias(f"_{n}") for n in keys), F.col("range").alias("_range"), "begin", "before", "total"))
    same = reduce(lambda x, n: x & F.col(n).eqNullSafe(F.col(f"_{n}")), keys, F.col("range") == F.col("_range"))
    return table.join(offsets, same).select("row.*", (F.col("at") - F.col("begin") + F.col("before")).alias(place), F.col("total").alias(size))


def _of_groups(counts: DataFrame, keys: list[str]) -> DataFrame:
    """A group has one row here for each range that it reaches into."""
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumns({"before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "total": F.sum("n").over(whole)})


def _of_ranges(counts: DataFrame) -> DataFrame:
    """Without groups there are as many rows as shuffle partitions; the driver adds them up."""
    out, before = [], 0
    for r in sorted(counts.collect(), key=lambda r: r["range"]):
        out.append((r["range"], r["begin"], before))
        before += r["n"]
    return counts.sparkSession.createDataFrame([(*x, before) for x in out], "range long, begin long, before long, total long")

