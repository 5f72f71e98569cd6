"""The side table of geometries: puts, reads, purges and eviction by total size.

``touches`` is an append-only log: ref, geometry, size (characters of the text) and
touch_seq, growing.  A put appends a row; a read appends one with a null geometry, which
only makes the entry newer.  A store, which ``entries`` makes of a log, is a log too, without what
was deleted; so ``sync`` takes and gives stores, and nothing that is gone comes back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, dims
from ..functions.text import text_of


def eligible(alerts: DataFrame) -> DataFrame:
    """Alerts whose geometry is kept: not terminal, with a ref and a geometry."""
    return alerts.filter(~classify.is_terminal(F.col("phase")) & (text_of(F.col("geometry_ref")) != "") & (text_of(F.col("geometry")) != ""))


def puts(alerts: DataFrame, seq: Column) -> DataFrame:
    """Log rows for the geometries of ``alerts``."""
    return eligible(alerts).select(F.col("geometry_ref").alias("ref"), "geometry", F.length("geometry").cast("long").alias("size"), seq.alias("touch_seq"))


def reads(refs: DataFrame, seq: Column) -> DataFrame:
    """Log rows for reads of ``refs`` (ref)."""
    return refs.select("ref", F.lit(None).cast("string").alias("geometry"), F.lit(None).cast("long").alias("size"), seq.alias("touch_seq"))


def entries(touches: DataFrame) -> DataFrame:
    """One row for each ref that was put: its last geometry and its last touch."""
    was_put = F.col("size").isNotNull()
    last = lambda c: F.max_by(F.when(was_put, F.col(c)), F.when(was_put, F.col("touch_seq"))).alias(c)
    return touches.groupBy("ref").agg(last("geometry"), last("size"), F.max("touch_seq").alias("touch_seq")).filter("size is not null")


def delete(store: DataFrame, refs: DataFrame) -> DataFrame:
    return store.join(refs.select("ref"), "ref", "left_anti")


def purge(store: DataFrame, current: DataFrame, prefix: str = "") -> DataFrame:
    """``store`` without the refs that start with ``prefix`` and are not in ``current`` (ref)."""
    gone = store.filter(F.startswith("ref", F.lit(prefix))).join(current.select("ref"), "ref", "left_anti").select("ref")
    return delete(store, gone)


def evict(store: DataFrame, cap: int = dims.GEOMETRY_LIMIT_CHARS, by: tuple[str, ...] = ()) -> DataFrame:
    """The newest entries whose sizes add up to ``cap`` at most, for each value of ``by``.

    A store is one cache, bounded by ``cap``: entries older than the newest that exceed it
    are gone.  Sums are first taken over ranges of touch_seq, so no task sees all rows.
    """
    span = 100_000
    keys = list(by)
    parts = store.withColumn("_part", F.floor(F.col("touch_seq") / span))
    totals = parts.groupBy(*keys, "_part").agg(F.sum("size").alias("_sum"))
    newer = Window.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_part", F.coalesce(F.sum("_sum").over(newer), F.lit(0)).alias("_newer"))
    inside = Window.partitionBy(*keys, "_part").orderBy(F.desc("touch_seq"), "ref").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.withColumn("_run", F.sum("size").over(inside)).join(before, [*keys, "_part"])
    return placed.filter(F.col("_run") + F.col("_newer") <= cap).select(store.columns)


def sync(store: DataFrame, alerts: DataFrame, seq: Column, provider: str) -> DataFrame:
    """The store after a poll of ``provider``, from the one before (and touches since): the poll's geometries are put, then those of the provider that it lacks go."""
    new = puts(alerts, seq)
    return evict(purge(entries(store.unionByName(new)), new.select("ref").distinct(), f"{provider}:"))


def collections(store: DataFrame) -> DataFrame:
    """(ref, body): each entry's geometry as a FeatureCollection."""
    feature = F.struct(F.lit("Feature").alias("type"), F.parse_json("geometry").alias("geometry"), F.struct("ref").alias("properties"))
    return store.select("ref", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))).alias("body"))


def lookup(store: DataFrame, ref: str) -> DataFrame:
    """One row (ref, body), or none: not found."""
    return collections(store.filter(F.col("ref") == ref))
