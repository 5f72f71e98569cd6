"""Polls at an interval: each tick reads a feed and appends one snapshot, which streaming.lifecycle compares.

A poll that succeeds writes its alerts and a marker row as one partition (entry_id,
poll_seq), also if it lists nothing; one that fails writes nothing, so that it changes no
state.  ``poll_seq`` is the micro-batch's number, so a poll that is repeated after a failure of
the driver replaces itself.  The rate source is the clock only.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import normalize
from ..operators.lifecycle import CARRIED
from ..sources.settings import SCAN_INTERVAL

LOG = logging.getLogger(__name__)
#: The columns of a snapshot.
SNAPSHOT = "entry_id string, poll_seq long, poll_ts timestamp, ordinal long, id string, " + ", ".join(f"{c} string" for c in CARRIED) + ", is_marker boolean"


def snapshot(alerts: DataFrame, entry_id: str, poll_seq: int, now: datetime) -> DataFrame:
    """The normalised rows of one poll and its marker, in columns of SNAPSHOT."""
    stamp = {"entry_id": F.lit(entry_id), "poll_seq": F.lit(poll_seq).cast("long"), "poll_ts": F.lit(now).cast("timestamp")}
    rows = normalize.normalize(alerts.withColumns(stamp)).select(*stamp, F.col("ordinal").cast("long").alias("ordinal"), "id", *CARRIED).withColumn("is_marker", F.lit(False))
    marker = alerts.sparkSession.range(1).select(*(c.alias(n) for n, c in stamp.items()), F.lit(True).alias("is_marker"))
    return rows.unionByName(marker, allowMissingColumns=True)


def poll_once(read: Callable[[], DataFrame], entry_id: str, poll_seq: int, sink: str, now: datetime | None = None) -> bool:
    """Write the snapshot of one poll to the Parquet table at ``sink``, in place of an earlier try; False if reading fails."""
    try:
        # One file a poll, so that a stream over the table never sees a part of it.
        snapshot(read(), entry_id, poll_seq, now or datetime.now(UTC)).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("entry_id", "poll_seq").parquet(sink)
    except Exception as error:  # whatever the feed or the network brings
        LOG.warning("poll %d of %s failed: %s", poll_seq, entry_id, error)
        return False
    return True


def start(spark: SparkSession, read: Callable[[], DataFrame], entry_id: str, sink: str, checkpoint: str, scan_interval: int = SCAN_INTERVAL) -> StreamingQuery:
    """Poll every ``scan_interval`` seconds until the query is stopped."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, n: poll_once(read, entry_id, n, sink) and None).trigger(processingTime=f"{scan_interval} seconds").option("checkpointLocation", checkpoint).start()
