"""The geometries' side table, kept from poll to poll: what a poll does not touch is neither read nor written.

The same rules as ``operators.geometry``: puts and reads make an entry the newest, a poll's end removes what its provider no longer lists,
and then the oldest go until the sizes add up to the cap.  What is kept:

* keyed state, by cache, provider and shard of the ref: the size and last touch of each entry.  Only touched entries are
  written; a purge looks at the entries of its own provider's shards.
* ``log``: what each touch takes from one range of touches and adds to another, ranges being folders.
* ``sums``: the sum of sizes of each range that has any, a few bytes a range.
* ``floors``: how far eviction has come in each cache.  It always takes the oldest, so an entry is there if its
  touch is above the floor, and an evicted one needs no write of its own.

At the end of a poll the sums, newest first, tell in which range the cap is passed, and only that range's log is read to find where.
The next poll's rows carry the floor with them, so a poll that runs again meets the same one.

Cases: a read of a ref that is not there, deleted or evicted does nothing; a put of one is an entry anew; of two puts in a poll the later counts; equal touches go by ref, the
larger first out; a poll without rows still purges; an entry larger than the cap goes, and all older ones with it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import dims
from .stateful import use_rocksdb

SHARDS, SPAN = 16, 1000
PUT, READ, DELETE, PURGE = "put", "read", "delete", "purge"
#: Touches; ``touch_seq`` grows from poll to poll, a purge has the first of its poll.
TOUCH = "cache string, provider string, ref string, kind string, size long, touch_seq long"
_INPUT = f"{TOUCH}, shard int, floor_seq long, floor_ref string"
#: What a touch adds to the entry ``ref`` at ``touch_seq`` of a range (sign 1), or takes from it (-1).
CHANGE = "cache string, range long, ref string, touch_seq long, size long, sign int"
_SUMS, _FLOORS = "cache string, range long, total long", "cache string, floor_seq long, floor_ref string"


class Touched(StatefulProcessor):
    """Entries of one shard."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "ref string", "size long, touch_seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        cache = key[0]
        out = lambda ref, entry, sign: _Change(cache, entry[1] // SPAN, ref, entry[1], entry[0], sign)
        for r in sorted(rows, key=lambda r: (r.kind == PURGE, r.touch_seq)):
            there = lambda ref, entry: r.floor_seq is None or entry[1] > r.floor_seq or (entry[1] == r.floor_seq and ref < r.floor_ref)  # noqa: B023, E731
            if r.kind == PURGE:
                for (ref,), entry in list(self.entries.iterator()):
                    if entry[1] < r.touch_seq:
                        self.entries.removeKey((ref,))
                        if there(ref, entry):
                            yield out(ref, entry, -1)
                continue
            old = tuple(self.entries.getValue((r.ref,))) if self.entries.containsKey((r.ref,)) else None
            live = old is not None and there(r.ref, old)
            if live:
                yield out(r.ref, old, -1)
            if r.kind == PUT or (r.kind == READ and live):
                new = (r.size if r.kind == PUT else old[0], r.touch_seq)
                self.entries.updateValue((r.ref,), new)
                yield out(r.ref, new, 1)
            elif old is not None:
                self.entries.removeKey((r.ref,))

    def close(self) -> None:
        pass


_Change = Row("cache", "range", "ref", "touch_seq", "size", "sign")


def _latest(spark: SparkSession, path: str, name: str, schema: str) -> tuple[int, DataFrame]:
    """The newest version of a small table, and its number; empty before the first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [int(f.getPath().getName()) for f in system.listStatus(where) if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))] if system.exists(where) else []
    if not found:
        return -1, spark.createDataFrame([], schema)
    return max(found), spark.read.schema(schema).parquet(f"{path}/{name}/{max(found)}")


def publish(path: str, poll: int, touches: DataFrame, purged: list[tuple[str, str]] = ()) -> None:
    """Add the touches of a poll (TOUCH), and for each (cache, provider) of ``purged`` that it listed all it has, to the input of the store at ``path``."""
    spark = touches.sparkSession
    first = touches.agg(F.min("touch_seq")).first()[0]
    _, floors = _latest(spark, path, "floors", _FLOORS)
    rows = touches.withColumn("shard", F.pmod(F.xxhash64("ref"), F.lit(SHARDS)).cast("int"))
    ends = spark.createDataFrame([(c, p, None, PURGE, None, first if first is not None else 2**62) for c, p in purged], TOUCH)
    rows = rows.unionByName(ends.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1)))))
    rows.join(floors, "cache", "left").select([c.split()[0] for c in _INPUT.split(", ")]).write.mode("overwrite").parquet(f"{path}/input/poll={poll}")


def _settle(changes: DataFrame, batch: int, path: str, cap: int) -> None:
    """Log the changes of a micro-batch, add them to the sums, and move the floors."""
    spark = changes.sparkSession
    changes.write.mode("overwrite").partitionBy("range").parquet(f"{path}/log/batch={batch}")
    delta = spark.read.schema(CHANGE).parquet(f"{path}/log/batch={batch}")
    before = [spark.read.schema(s).parquet(f"{path}/{n}/{batch - 1}") if batch else spark.createDataFrame([], s) for n, s in (("sums", _SUMS), ("floors", _FLOORS))]
    added = delta.groupBy("cache", "range").agg(F.sum(F.col("sign") * F.col("size")).alias("total"))
    sums = before[0].unionByName(added).groupBy("cache", "range").agg(F.sum("total").alias("total")).filter("total <> 0")
    newest = Window.partitionBy("cache").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = sums.withColumn("running", F.sum("total").over(newest))
    crossed = running.filter(F.col("running") > cap).groupBy("cache").agg(F.max_by(F.struct("range", (F.col("running") - F.col("total")).alias("newer")), "range").alias("x")).select("cache", "x.range", "x.newer").collect()
    floors, kept = before[1], sums
    if crossed:  # one row a cache that is over its cap
        over = spark.createDataFrame(crossed, "cache string, range long, newer long")
        # The folders of other ranges are not read.
        log = spark.read.option("basePath", f"{path}/log").schema(f"{CHANGE}, batch int").parquet(f"{path}/log").filter(F.col("range").isin(*{r["range"] for r in crossed})).filter(F.col("batch") <= batch)
        entries = log.join(over, ["cache", "range"]).groupBy("cache", "range", "newer", "ref", "touch_seq").agg(F.sum(F.col("sign") * F.col("size")).alias("size"), F.sum("sign").alias("n")).filter("n > 0")
        old = before[1].select("cache", F.col("floor_seq").alias("old_seq"), F.col("floor_ref").alias("old_ref"))
        live = entries.join(old, "cache", "left").filter("old_seq is null or touch_seq > old_seq or (touch_seq = old_seq and ref < old_ref)")
        order = Window.partitionBy("cache").orderBy(F.desc("touch_seq"), "ref").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = live.withColumn("running", F.col("newer") + F.sum("size").over(order))
        new = placed.filter(F.col("running") > cap).groupBy("cache", "range", "newer").agg(F.min_by(F.struct("touch_seq", "ref"), "running").alias("f"))
        cut = placed.filter(F.col("running") <= cap).groupBy("cache").agg(F.sum("size").alias("left"))
        new = new.join(cut, "cache", "left").select("cache", "range", F.col("f.touch_seq").alias("floor_seq"), F.col("f.ref").alias("floor_ref"), F.coalesce("left", F.lit(0)).alias("left"))
        floors = before[1].join(new.select("cache"), "cache", "left_anti").unionByName(new.select("cache", "floor_seq", "floor_ref"))
        edge = new.select("cache", F.col("range").alias("edge"), "left")
        # Ranges below the floor hold nothing any more, that of the floor what is above it.
        kept = sums.join(edge, "cache", "left").filter("edge is null or range >= edge").withColumn("total", F.when(F.col("range") == F.col("edge"), F.col("left")).otherwise(F.col("total"))).filter("total <> 0").select("cache", "range", "total")
    floors.write.mode("overwrite").parquet(f"{path}/floors/{batch}")
    kept.write.mode("overwrite").parquet(f"{path}/sums/{batch}")


def run(spark: SparkSession, path: str, cap: int = dims.GEOMETRY_LIMIT_CHARS):
    """Take in the poll that was published last; each poll is published after the one before it was taken in, whose floors it carries."""
    use_rocksdb(spark)
    rows = spark.readStream.schema(_INPUT).parquet(f"{path}/input")
    changes = rows.groupBy("cache", "provider", "shard").transformWithState(Touched(), CHANGE, "Append", "None")
    query = changes.writeStream.foreachBatch(lambda df, n: _settle(df, n, path, cap)).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def entries(spark: SparkSession, path: str) -> DataFrame:
    """cache, ref, size and touch_seq of what is in the store."""
    _, floors = _latest(spark, path, "floors", _FLOORS)
    log = spark.read.schema(CHANGE).option("basePath", f"{path}/log").parquet(f"{path}/log")
    live = log.groupBy("cache", "ref", "touch_seq", "range").agg(F.sum(F.col("sign") * F.col("size")).alias("size"), F.sum("sign").alias("n")).filter("n > 0")
    return live.join(floors, "cache", "left").filter("floor_seq is null or touch_seq > floor_seq or (touch_seq = floor_seq and ref < floor_ref)").select("cache", "ref", "size", "touch_seq")
