"""Snapshot comparison by keyed state: each poll is compared where its alerts' state lies.

Input rows are those of ``streaming.lifecycle``: alerts, and a marker row for each poll that succeeded.  Alerts are
dealt by entry and shard of their id, and each marker goes to all SHARDS of its entry, so that a shard
knows that a poll was there and which of its alerts that poll did not list.  No entry is one key.  (A timer per alert
would not do: it fires by one watermark for all entries, so the poll of one entry would end alerts of
another whose poll failed.)

State of a shard: a map of its active alerts, of which only those are written that a poll adds, changes or
removes, and one value with the last poll and the places of the alerts in it, which removed alerts are ordered by.
A stream can begin with the active alerts of a table (``initial``).

Cases: a poll without a marker (it failed) is ignored, and so is one that is not later than the last; of repeated ids in a
poll the last one counts, in the first one's place; a micro-batch may hold several polls of several entries, a poll must not be
split over micro-batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import dims
from ..operators import lifecycle
from ..operators.lifecycle import CARRIED
from ..operators.order import placed

SHARDS = 32
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ALERT = ", ".join(f"{c} string" for c in CARRIED)
#: A change of an alert, from ``old`` to ``new``, of which one may be null.
CHANGE = f"entry_id string, poll_seq long, poll_ts timestamp, id string, old struct<{', '.join(f'{c}: string' for c in CARRIED)}>, new struct<{', '.join(f'{c}: string' for c in CARRIED)}>, old_at long, new_at long"


class Transitions(StatefulProcessor):
    """Changes of the alerts of one shard from poll to poll."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getMapState("active", "id string", _ALERT)
        self.last = handle.getValueState("last", "poll_seq long, places string")

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        """A row has the last poll and ``alerts``, an array of (id, ordinal, columns)."""
        self.last.update((initialState.poll_seq, json.dumps({a["id"]: a["ordinal"] for a in initialState.alerts})))
        for a in initialState.alerts:
            self.active.updateValue((a["id"],), tuple(a[c] for c in CARRIED))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        entry_id = key[0]
        seen, places = -1, {}
        if self.last.exists():
            seen, text = self.last.get()
            places = json.loads(text)
        polls: dict[int, datetime] = {}
        listed: dict[int, dict[str, tuple[int, int, tuple]]] = {}
        for r in rows:
            # By place: a Row looks for a name among all of its names each time.
            _, _, poll_seq, poll_ts, ordinal, id, *alert, is_marker = tuple(r)
            if poll_seq <= seen:
                continue
            if is_marker:
                polls[poll_seq] = poll_ts
                continue
            poll = listed.setdefault(poll_seq, {})
            if id in poll:
                first, last, row = poll[id]
                poll[id] = (min(first, ordinal), *((ordinal, tuple(alert)) if ordinal > last else (last, row)))
            else:
                poll[id] = (ordinal, ordinal, tuple(alert))
        if not polls:
            return
        active = {k[0]: tuple(v) for k, v in self.active.iterator()}
        before = dict(active)
        for poll in sorted(polls):
            now = listed.get(poll, {})
            change = lambda id, old, new, old_at, new_at: _Change(entry_id, poll, polls[poll], id, old and _Alert(*old), new and _Alert(*new), old_at, new_at)  # noqa: B023, E731
            for id in [i for i in active if i not in now]:
                yield change(id, active.pop(id), None, places[id], None)
            for id, (place, _, row) in now.items():
                old = active.get(id)
                if old != row:
                    yield change(id, old, row, places.get(id) if old else None, place)
                if row[_PHASE] in dims.TERMINAL:
                    active.pop(id, None)
                else:
                    active[id] = row
            places = {id: now[id][0] for id in active}
        for id in before.keys() - active.keys():
            self.active.removeKey((id,))
        for id, row in active.items():
            if before.get(id) != row:
                self.active.updateValue((id,), row)
        self.last.update((max(polls), json.dumps(places)))

    def close(self) -> None:
        pass


_PHASE = CARRIED.index("phase")
_Alert, _Change = Row(*CARRIED), Row("entry_id", "poll_seq", "poll_ts", "id", "old", "new", "old_at", "new_at")


def shard_of(id: Column) -> Column:
    return F.pmod(F.xxhash64(id), F.lit(SHARDS)).cast("int")


def initial(active: DataFrame, polls: DataFrame) -> DataFrame:
    """The state that a stream begins with: ``active`` (entry_id, id, ordinal, CARRIED), as after the last of ``polls`` (entry_id, poll_seq)."""
    last = polls.groupBy("entry_id").agg(F.max("poll_seq").alias("poll_seq")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))))
    alerts = active.withColumn("shard", shard_of(F.col("id"))).groupBy("entry_id", "shard").agg(F.collect_list(F.struct("id", F.col("ordinal").cast("long").alias("ordinal"), *CARRIED)).alias("alerts"))
    none = F.array().cast(alerts.schema["alerts"].dataType)
    return last.join(alerts, ["entry_id", "shard"], "left").select("entry_id", "shard", "poll_seq", F.coalesce("alerts", none).alias("alerts"))


def changes(stream: DataFrame, begin: DataFrame | None = None) -> DataFrame:
    """A stream in columns of CHANGE."""
    every = F.sequence(F.lit(0), F.lit(SHARDS - 1))
    dealt = stream.withColumn("shard", F.explode(F.when(F.col("is_marker"), every).otherwise(F.array(shard_of(F.col("id"))))))
    rows = dealt.select("entry_id", "shard", "poll_seq", "poll_ts", F.col("ordinal").cast("long").alias("ordinal"), "id", *CARRIED, "is_marker")  # as Transitions takes them apart
    keyed = lambda df: df.groupBy("entry_id", "shard")
    return keyed(rows).transformWithState(Transitions(), CHANGE, "Append", "None", initialState=None if begin is None else keyed(begin))


def events(stream: DataFrame, begin: DataFrame | None = None) -> DataFrame:
    """A stream of events as in ``operators.lifecycle.events``, with what they are ordered by (gone, place) in place of event_seq."""
    rows = changes(stream, begin)
    changed = F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), lifecycle.changed_fields("old", "new")).otherwise(F.array().cast("array<string>"))
    return lifecycle.described(rows.withColumn("changed_fields", changed)).withColumn("changed_fields", F.array_join("changed_fields", ","))


def numbered(found: DataFrame) -> DataFrame:
    """Events with their event_seq in each poll, in place of gone and place; no poll is one task."""
    rows = placed(found, [F.col("gone"), F.col("place")], by=[F.col("entry_id"), F.col("poll_seq")], place="_at", size="_of")
    return rows.select("*", (F.col("_at") + 1).cast("int").alias("event_seq")).drop("gone", "place", "_at", "_of")


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed state of this kind needs."""
    spark.conf.set(PROVIDER, ROCKSDB)
