"""Snapshot comparison: single steps, random histories against a stateful fold, and the stream against the batch form."""

from __future__ import annotations

import random
import re
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stormglass.operators import lifecycle
from stormglass.streaming import lifecycle as stream

START = datetime(2026, 1, 1, tzinfo=UTC)
SCHEMA = "entry_id string, poll_seq long, ordinal long, id string, event string, headline string, description string, instruction string, severity_normalized string, phase string, expires string, area_desc string"
NEVER = "2099-01-01T00:00:00+00:00"


def alert(seq, id_, ordinal=0, phase="new", headline="h", expires=NEVER, entry="e", instruction=None):
    return (entry, seq, ordinal, id_, "Storm", headline, "d", instruction, "severe", phase, expires, "area")


def frames(spark, rows, polls, entry="e"):
    incoming = spark.createDataFrame(rows, SCHEMA)
    spine = spark.createDataFrame([(e, s, START + timedelta(hours=s)) for e, s in (p if isinstance(p, tuple) else (entry, p) for p in polls)], "entry_id string, poll_seq long, poll_ts timestamp")
    return incoming, spine


def found(spark, rows, polls, seq=None, **options):
    events = lifecycle.events(*frames(spark, rows, polls), **options).orderBy("entry_id", "poll_seq", "event_seq").collect()
    return [(r["event_type"][9:], r["incident_id"], r["phase"], r["phase_changed"], r["changed_fields"]) for r in events if seq in (None, r["poll_seq"])]


def test_created_updated_removed(spark):
    assert found(spark, [alert(0, "a")], [0]) == [("created", "a", "new", True, [])]
    assert found(spark, [alert(0, "a"), alert(1, "a", phase="update")], [0, 1], 1) == [("updated", "a", "update", True, ["phase"])]
    assert found(spark, [alert(0, "a"), alert(1, "a", headline="g")], [0, 1], 1) == [("updated", "a", "new", False, ["headline"])]
    assert found(spark, [alert(0, "a"), alert(1, "a", headline="g", instruction="i", expires="2098-01-01T00:00:00Z")], [0, 1], 1) == [("updated", "a", "new", False, ["headline", "instruction", "expires"])]
    assert found(spark, [alert(0, "a"), alert(1, "a")], [0, 1], 1) == []
    assert found(spark, [alert(0, "a"), alert(1, "a", phase="cancel")], [0, 1], 1) == [("removed", "a", "cancel", True, ["phase"])]


def test_polls_that_list_nothing_or_fail(spark):
    assert found(spark, [alert(0, "a")], [0, 1], 1) == [("removed", "a", "cancel", True, [])]
    at = (START + timedelta(hours=1)).isoformat()
    assert found(spark, [alert(0, "a", expires=at)], [0, 1], 1) == [("removed", "a", "expired", True, [])]
    # Poll 1 failed: it is not in the spine, and poll 2 is compared with poll 0.
    assert found(spark, [alert(0, "a"), alert(2, "a")], [0, 2], 2) == []
    assert found(spark, [], [0, 1]) == []


def test_terminal_at_first_sight(spark):
    rows = [alert(0, "a", phase="cancel"), alert(1, "a", phase="cancel")]
    again = ("removed", "a", "cancel", True, [])
    assert found(spark, rows, [0, 1, 2]) == [again, again]
    assert found(spark, rows, [0, 1, 2], dedupe_terminal=True) == [again]


def test_repeated_ids_and_order(spark):
    rows = [alert(0, "a", 0, headline="1"), alert(0, "b", 1), alert(0, "a", 2, headline="2"), alert(0, "x", 3), alert(0, "y", 4), alert(1, "c", 0), alert(1, "a", 1, headline="2")]
    assert [x[1] for x in found(spark, rows, [0, 1], 0)] == ["a", "b", "x", "y"]
    assert [x[:2] for x in found(spark, rows, [0, 1], 1)] == [("created", "c"), ("removed", "b"), ("removed", "x"), ("removed", "y")]
    states = {(r["poll_seq"], r["id"]): (r["headline"], r["previous_phase"], r["phase_changed"]) for r in lifecycle.active(*frames(spark, rows, [0, 1])).collect()}
    assert states[0, "a"] == ("2", "", True) and states[1, "a"] == ("2", "new", False) and len(states) == 6


def test_entity_ids(spark):
    events = lifecycle.events(*frames(spark, [alert(0, "a"), alert(0, "b", 1)], [0]))
    registry = spark.createDataFrame([("e", "a", "sensor.a", "extra")], "entry_id string, incident_id string, entity_id string, event string")
    assert {r["incident_id"]: r["entity_id"] for r in lifecycle.with_entity_ids(events, registry).collect()} == {"a": "sensor.a", "b": None}


def history(seed, entries=3, polls=12):
    """Rows and spine of random histories, and their events by a fold that keeps state."""
    rng = random.Random(seed)
    rows, spine, want = [], [], []
    for e in (f"e{i}" for i in range(entries)):
        state: dict[str, tuple] = {}
        for seq in range(polls):
            if rng.random() < 0.15:
                continue
            spine.append((e, seq))
            poll = []
            for place in range(rng.choice([0, 1, 3, 6])):
                expires = rng.choice([NEVER, (START + timedelta(hours=rng.randint(0, polls))).isoformat(), "soon", ""])
                poll.append(alert(seq, rng.choice("abcde"), place, rng.choice(["new", "new", "update", "cancel", "expired"]), rng.choice("xy"), expires, e))
            rows += poll
            last, n, after = {r[3]: r for r in reversed(poll)} and {}, 0, {}
            for r in poll:
                last[r[3]] = r
            for i, r in last.items():
                old = state.get(i)
                names = [c for c, k in zip(("headline", "phase", "expires"), (5, 9, 10), strict=True) if old and old[k] != r[k]]
                kind = "removed" if r[9] in ("cancel", "expired") else "created" if not old else "updated" if names else None
                if kind:
                    n += 1
                    want.append((e, seq, n, kind, i, r[9], not old or old[9] != r[9], ",".join(names)))
                if r[9] not in ("cancel", "expired"):
                    after[i] = r
            for i, old in state.items():
                if i not in last:
                    n += 1
                    try:
                        over = datetime.fromisoformat(old[10]) <= START + timedelta(hours=seq)
                    except ValueError:
                        over = False
                    want.append((e, seq, n, "removed", i, "expired" if over else "cancel", True, ""))
            state = after
    return rows, spine, sorted(want)


def flat(events):
    return sorted((r["entry_id"], r["poll_seq"], r["event_seq"], r["event_type"][9:], r["incident_id"], r["phase"], r["phase_changed"], r["changed_fields"] if isinstance(r["changed_fields"], str) else ",".join(r["changed_fields"])) for r in events.collect())


@pytest.mark.parametrize("seed", range(3))
def test_random_histories_against_a_fold(spark, seed):
    rows, spine, want = history(seed, entries=12)
    assert flat(lifecycle.events(*frames(spark, rows, spine))) == want


def test_stream_equals_fold(spark, tmp_path):
    rows, spine, want = history(7)
    incoming, polls = frames(spark, rows, spine)
    marked = incoming.join(polls, ["entry_id", "poll_seq"]).withColumn("is_marker", F.lit(False)).unionByName(polls.withColumn("is_marker", F.lit(True)), allowMissingColumns=True)
    for part in ("poll_seq < 5", "poll_seq >= 5", "poll_seq = 3"):  # the last one is a replay
        marked.filter(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(marked.schema).parquet(f"{tmp_path}/in")
        stream.drain(stream.events(source), f"{tmp_path}/out", f"{tmp_path}/state")
    assert flat(spark.read.parquet(f"{tmp_path}/out")) == want


def test_stream_deals_one_entry_by_id(spark, tmp_path):
    """One entry's alerts are many keys, without Python; a repeated batch changes nothing."""
    rows = [alert(seq, f"a{i}", i) for seq in range(4) for i in range(300) if (i + seq) % 3]
    incoming, polls = frames(spark, rows, range(4))
    marked = incoming.join(polls, ["entry_id", "poll_seq"]).withColumn("is_marker", F.lit(False)).unionByName(polls.withColumn("is_marker", F.lit(True)), allowMissingColumns=True)
    want = flat(lifecycle.events(incoming, polls))
    for batch in (0, 1, 1, 2):
        stream.step(stream.events(marked.filter(F.col("poll_seq").between(2 * batch, 2 * batch + 1))), batch, f"{tmp_path}/out", f"{tmp_path}/state")
    assert flat(spark.read.parquet(f"{tmp_path}/out")) == want
    last, active = (spark.read.parquet(f"{tmp_path}/state/1/{name}") for name in ("last", "active"))
    assert active.count() == 200
    plan = stream.compare(marked, last, active)[0]._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(entry_id#\d+, id#\d+", plan) and "Python" not in plan and "Pandas" not in plan


def test_one_shuffle_of_one_scan(spark, tmp_path):
    """Alerts are read once and shuffled once; only the table of polls is joined."""
    incoming, polls = frames(spark, [alert(0, "a")], [0, 1])
    incoming.write.parquet(f"{tmp_path}/alerts")
    plan = lifecycle.diff(spark.read.parquet(f"{tmp_path}/alerts"), polls)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert plan.count("Join") == 1 and "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_polling(spark, tmp_path):
    from stormglass import schema
    from stormglass.streaming import polling

    feed = lambda *ids: schema.as_alerts(spark.createDataFrame([(i, n, "Flood Watch", "Severe", "Alert") for n, i in enumerate(ids)], "id string, ordinal long, event string, severity string, msg_type string"), ("ordinal",))
    sink = f"{tmp_path}/snapshots"

    def broken():
        raise OSError("no answer")

    polls = [lambda: feed("a", "b"), broken, lambda: feed("b").limit(1), lambda: feed("x").limit(0)]
    done = [polling.poll_once(read, "e", n, sink, START + timedelta(hours=n)) for n, read in enumerate(polls)]
    assert done == [True, False, True, True]
    rows = spark.read.schema(polling.SNAPSHOT).parquet(sink)
    events = lifecycle.events(rows.filter("not is_marker"), rows.filter("is_marker").select("entry_id", "poll_seq", "poll_ts"))
    assert [x[1:5] for x in flat(events)] == [(0, 1, "created", "a"), (0, 2, "created", "b"), (2, 1, "removed", "a"), (3, 1, "removed", "b")]
    query = polling.start(spark, lambda: feed("a"), "live", f"{tmp_path}/live", f"{tmp_path}/ticks", scan_interval=1)
    try:
        # The clock never runs dry, so wait for a batch, not for all.
        deadline = time.monotonic() + 60
        while time.monotonic() < deadline and not (query.lastProgress and query.lastProgress["batchId"] >= 1):
            time.sleep(0.2)
    finally:
        query.stop()
    assert polling.poll_once(lambda: feed("a"), "live", 0, f"{tmp_path}/live")  # a repeated poll replaces itself
    assert spark.read.parquet(f"{tmp_path}/live").filter("is_marker and poll_seq = 0").count() == 1
    assert spark.read.parquet(f"{tmp_path}/live").filter("is_marker").count() >= 1


def test_stream_joins_its_polls_without_a_shuffle(spark, tmp_path, monkeypatch):
    """One entry's alerts do not meet in one task to find their polls: these are few, and Spark knows it, in the first batch too."""
    from pyspark.sql import DataFrameWriter

    rows = [alert(seq, f"a{i}", i) for seq in range(4) for i in range(30) if (i + seq) % 3]
    incoming, polls = frames(spark, rows, range(4))
    incoming.join(polls, ["entry_id", "poll_seq"]).withColumn("is_marker", F.lit(False)).unionByName(polls.withColumn("is_marker", F.lit(True)), allowMissingColumns=True).write.parquet(f"{tmp_path}/in")
    marked = stream.events(spark.read.parquet(f"{tmp_path}/in"))
    plans, write = [], DataFrameWriter.parquet

    def noted(self, *args, **options):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    for batch in (0, 1):
        stream.step(marked.filter(F.col("poll_seq").between(2 * batch, 2 * batch + 1)), batch, f"{tmp_path}/out", f"{tmp_path}/state")
    assert len(plans) >= 6 and not any("SortMergeJoin" in p for p in plans)
    monkeypatch.undo()
    assert flat(spark.read.parquet(f"{tmp_path}/out")) == flat(lifecycle.events(incoming, polls))


def test_replay_is_made_in_one_pass(spark, monkeypatch):
    """The table of events is read and normalised once, however many micro-batches its polls become."""
    from pyspark.sql import DataFrameWriter

    from stormglass.plans.queries import QUERIES

    paths, write = [], DataFrameWriter.parquet

    def noted(self, path, *args, **options):
        paths.append(path)
        return write(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    n = QUERIES["streaming_lifecycle"](spark, "/root/testdata/sf0.001").count()
    monkeypatch.undo()
    assert n == QUERIES["lifecycle_events"](spark, "/root/testdata/sf0.001").count()
    assert sum("/out/" in p for p in paths) == 3
    assert len([p for p in paths if "/out/" not in p and "/state/" not in p]) == 1
