"""Snapshot comparison as a stream: the same events as operators.lifecycle.events, a few polls at a time.

Input rows are alerts (entry_id, poll_seq, poll_ts, ordinal, id, event and the compared
columns) and one marker row for each poll that succeeded (``is_marker``), without which a
poll that lists nothing could not remove anything.  A failed poll sends nothing.  All rows of
a poll, marker included, come in one micro-batch; a batch may hold several polls.  Polls
that are not later than the last one seen are replays and are ignored.

State: the last poll of each entry and the alerts that are active after it, as Parquet tables
beside the checkpoint, one version a micro-batch.  A micro-batch is compared as in batch, with
its state as the poll before: rows are dealt by (entry_id, id), and no entry is held in one
task but to number the events of a poll.  The polls of a micro-batch are written first, so that
Spark knows how few they are and deals no alerts by entry to find theirs.  Output and state are
overwritten by batch number, so a batch that is repeated after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify
from ..operators import lifecycle
from ..operators.lifecycle import CARRIED

OUT = "entry_id string, poll_seq long, poll_ts timestamp, event_type string, event_seq int, incident_id string, event string, severity string, phase string, phase_changed boolean, changed_fields string, area_desc string"
_LAST = "entry_id string, poll_seq long, poll_ts timestamp"
_ACTIVE = "entry_id string, poll_seq long, ordinal long, id string, " + ", ".join(f"{c} string" for c in CARRIED)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _none(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows, as the optimiser sees too: a join with it is no shuffle."""
    columns = (c.split() for c in schema.split(", "))
    return spark.range(1).filter(F.lit(False)).select(*(F.lit(None).cast(kind).alias(c) for c, kind in columns))


def unseen(rows: DataFrame, last: DataFrame) -> DataFrame:
    """The polls in ``rows`` that are later than the last one of their entry."""
    marks = rows.filter("is_marker").groupBy("entry_id", "poll_seq").agg(F.min("poll_ts").alias("poll_ts"))
    seen = last.select("entry_id", F.col("poll_seq").alias("seen"))
    return marks.join(seen, "entry_id", "left").filter("seen is null or poll_seq > seen").select(_names(_LAST))


def compare(rows: DataFrame, last: DataFrame, active: DataFrame, marks: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The events of the polls in ``rows``, and what ``last`` and ``active`` are after them; ``marks`` are the polls, if they are known."""
    marks = unseen(rows, last) if marks is None else marks
    of = lambda df, polls: df.join(polls.select("entry_id", "poll_seq"), ["entry_id", "poll_seq"], "left_semi")
    polls = marks.unionByName(last)
    incoming = of(rows.filter("not is_marker").select(_names(_ACTIVE)), marks).unionByName(active)
    found = of(lifecycle.events(incoming, polls), marks).withColumn("changed_fields", F.array_join("changed_fields", ",")).select(_names(OUT))
    newest = polls.groupBy("entry_id").agg(F.max_by("poll_ts", "poll_seq").alias("poll_ts"), F.max("poll_seq").alias("poll_seq")).select(_names(_LAST))
    current = lifecycle.last_of_each(of(incoming, newest))
    return found, newest, current.filter(~classify.is_terminal(F.col("phase"))).select(_names(_ACTIVE))


def step(rows: DataFrame, batch: int, sink: str, state: str) -> None:
    """Compare one micro-batch with the state of the one before, and write its events and its state."""
    spark = rows.sparkSession
    at = lambda n, name: f"{state}/{n}/{name}"
    kept = lambda n, name, schema: spark.read.schema(schema).parquet(at(n, name))
    before = [kept(batch - 1, name, s) if batch else _none(spark, s) for name, s in (("last", _LAST), ("active", _ACTIVE))]
    unseen(rows, before[0]).write.mode("overwrite").parquet(at(batch, "polls"))
    found, last, active = compare(rows, *before, kept(batch, "polls", _LAST))
    found.write.mode("overwrite").parquet(f"{sink}/batch={batch}")
    last.write.mode("overwrite").parquet(at(batch, "last"))
    active.write.mode("overwrite").parquet(at(batch, "active"))
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/{batch - 2}")
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def events(stream: DataFrame) -> DataFrame:
    """A stream of rows in the columns that ``drain`` compares."""
    return stream.select(*dict.fromkeys([*_names(_LAST), *_names(_ACTIVE)]), "is_marker")


def drain(out: DataFrame, sink: str, checkpoint: str) -> None:
    """Compare what is there of ``out`` and add the events to a Parquet table at ``sink``, with the ``batch`` of each; changed_fields is joined by commas."""
    each = lambda rows, batch: step(rows, batch, sink, f"{checkpoint}/alerts")
    out.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
