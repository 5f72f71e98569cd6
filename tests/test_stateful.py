"""The stream of polls, keyed state and the transactional table."""

from __future__ import annotations

import json
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stormglass.functions import dims
from stormglass.operators import lifecycle
from stormglass.operators.lifecycle import CARRIED
from stormglass.plans.stream_queries import run_stream
from stormglass.sources import poll_stream
from stormglass.sources.connector import open_document
from stormglass.streaming import lru, sink, stateful

COLUMNS = ["entry_id", "poll_seq", "event_type", "event_seq", "incident_id", "phase", "phase_changed", "changed_fields", "severity"]


def polls_of(entry: str, n: int, seed: int) -> dict[int, list[dict]]:
    """Alerts of some polls; alerts come, stay, change, end and go, and one is listed twice."""
    rng = random.Random(seed)
    now: dict[str, dict] = {}
    out = {}
    for poll in range(n):
        for i in [i for i in now if rng.random() < 0.2]:
            del now[i]
        for i in [i for i in now if rng.random() < 0.1]:
            now[i] = now[i] | {"headline": f"h{poll}"}
        for i in [i for i in now if rng.random() < 0.1]:
            now[i] = now[i] | {"msg_type": "Cancel"}
        for k in range(rng.randrange(4)):
            now[f"{entry}-{poll}-{k}"] = {"id": f"{entry}-{poll}-{k}", "event": "Flood Warning", "msg_type": "Alert", "headline": "h", "severity": "Severe", "expires": "2024-01-05T00:00:00Z", "provider": "eccc"}
        rows = list(now.values()) + ([dict(rng.choice(list(now.values())), headline="twice")] if now else [])
        rng.shuffle(rows)
        out[poll] = [r | {"ordinal": i} for i, r in enumerate(rows)]
    return out


def publish(log: Path, entry: str, poll: int, alerts: list[dict], status: str = "ok") -> None:
    folder = log / f"poll_seq={poll}" / f"entry_id={entry}"
    folder.mkdir(parents=True, exist_ok=True)
    at = f"2024-01-{1 + poll % 28:02d}T00:00:00+00:00"
    lines = [{"poll_ts": at, "request": "r", "page_no": k, "body": json.dumps(alerts[k::2])} for k in range(2)] if alerts else []
    (folder / "part-0.json").write_text("".join(json.dumps(x) + "\n" for x in [*lines, {"poll_ts": at, "status": status}]))


def in_batch(spark, published: list[tuple]) -> list[tuple]:
    """The events of (entry, poll, alerts) by the operator in batch."""
    from stormglass import schema
    from stormglass.operators import normalize

    at = lambda poll: f"2024-01-{1 + poll % 28:02d}T00:00:00Z"
    names = ("id", "event", "msg_type", "headline", "severity", "expires", "provider", "ordinal")
    rows = [(e, p, at(p), *(a[n] for n in names)) for e, p, alerts in published for a in alerts]
    df = spark.createDataFrame(rows, "entry_id string, poll_seq long, at string, id string, event string, msg_type string, headline string, severity string, expires string, provider string, ordinal long").withColumn("poll_ts", F.col("at").cast("timestamp"))
    alerts = normalize.normalize(schema.as_alerts(df, ("entry_id", "poll_seq", "poll_ts", "ordinal")))
    polls = spark.createDataFrame([(e, p, at(p)) for e, p, _ in published], "entry_id string, poll_seq long, at string").withColumn("poll_ts", F.col("at").cast("timestamp"))
    found = lifecycle.events(alerts, polls).withColumn("changed_fields", F.array_join("changed_fields", ","))
    return sorted(tuple(r) for r in found.select(COLUMNS).collect())


def in_stream(spark, folder: Path, columns) -> list[tuple]:
    return sorted(tuple(r) for r in stateful.numbered(sink.committed(spark, f"{folder}/events", columns)).select(COLUMNS).collect())


def test_equal_to_batch_over_thirty_polls_of_two_entries_one_of_which_fails_at_times(spark, tmp_path):
    feeds = {e: polls_of(e, 30, i) for i, e in enumerate(("a", "b"))}
    fails = {("b", p) for p in (0, 7, 8, 20)}
    published = []
    for step in range(3):
        for poll in range(10 * step, 10 * step + 10):
            for e, polls in feeds.items():
                failed = (e, poll) in fails
                publish(tmp_path / "log", e, poll, [] if failed else polls[poll], "timeout" if failed else "ok")
                published += [] if failed else [(e, poll, polls[poll])]
        _, columns = run_stream(spark, str(tmp_path / "log"), str(tmp_path))
        assert in_stream(spark, tmp_path, columns) == in_batch(spark, published)


def test_state_is_written_in_proportion_to_what_changes(spark, tmp_path):
    alert = lambda i, headline="h": {"id": f"x{i}", "event": "e", "msg_type": "Alert", "headline": headline, "severity": "Minor", "expires": "2025-01-01T00:00:00Z", "provider": "eccc"}
    written = []
    for poll, changed in enumerate((0, 3, 0)):
        publish(tmp_path / "log", "e", poll, [alert(i, f"h{poll}" if i < changed else "h1" if i < 3 and poll == 2 else "h") | {"ordinal": i} for i in range(400)])
        query, _ = run_stream(spark, str(tmp_path / "log"), str(tmp_path))
        written.append(sum(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]))
    assert written[0] >= 400 and written[1] <= 3 + stateful.SHARDS and written[2] <= stateful.SHARDS


def test_begins_with_the_alerts_of_a_table(spark, tmp_path):
    polls = polls_of("a", 6, 9)
    published = [("a", p, polls[p]) for p in polls]
    from stormglass import schema
    from stormglass.operators import normalize

    names = ("id", "event", "msg_type", "headline", "severity", "expires", "provider", "ordinal")
    df = spark.createDataFrame([(p, *(a[n] for n in names)) for p in (0, 1, 2) for a in polls[p]], "poll_seq long, id string, event string, msg_type string, headline string, severity string, expires string, provider string, ordinal long")
    df = df.withColumns({"entry_id": F.lit("a"), "poll_ts": F.expr("timestamp'2024-01-01T00:00:00Z' + make_dt_interval(cast(poll_seq as int))")})
    times = df.select("entry_id", "poll_seq", "poll_ts").distinct()
    active = lifecycle.active(normalize.normalize(schema.as_alerts(df, ("entry_id", "poll_seq", "poll_ts", "ordinal"))), times).filter("poll_seq = 2")
    begin = stateful.initial(active.select("entry_id", "id", "ordinal", *CARRIED), times.select("entry_id", "poll_seq"))
    for p in polls:
        publish(tmp_path / "log", "a", p, polls[p])
    _, columns = run_stream(spark, str(tmp_path / "log"), str(tmp_path), begin)
    assert in_stream(spark, tmp_path, columns) == [r for r in in_batch(spark, published) if r[1] > 2]


def test_a_batch_that_failed_gets_the_same_polls_again(spark, tmp_path):
    poll_stream.register(spark)
    polls = polls_of("a", 4, 3)
    for p in (0, 1):
        publish(tmp_path / "log", "a", p, polls[p])
    seen = []

    def failing(rows, batch):
        seen.append((batch, sorted((r.poll_seq, r.page_no or 0, r.body or "") for r in rows.collect())))
        if len(seen) == 1:
            raise RuntimeError("stopped midway")

    def run():
        stream = spark.readStream.format("warning_polls").option("log", str(tmp_path / "log")).load()
        stream.writeStream.foreachBatch(failing).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="stopped midway"):
        run()
    publish(tmp_path / "log", "a", 2, polls[2])
    run()
    run()
    assert seen[0] == seen[1] and {p for p, _, _ in seen[1][1]} == {0, 1}
    assert {p for _, rows in seen[2:] for p, _, _ in rows} == {2}


class Feed(BaseHTTPRequestHandler):
    """Answers by path; /slow sends a byte now and then, without end."""

    def do_GET(self):  # noqa: N802
        answers = {"/good/zone=Z.json": {"type": "FeatureCollection", "features": []}, "/odd/zone=Z.json": {"type": "Problem", "detail": "no such zone"}, f"/list/{dims.country_slug('DE')}.json": {"warnings": {}}}
        if self.path.startswith("/slow"):
            self.send_response(200)
            self.end_headers()
            for _ in range(100):
                self.wfile.write(b" ")
                time.sleep(0.05)
            return
        body = b"{" if self.path.startswith("/broken") else json.dumps(answers[self.path]).encode() if self.path in answers else None
        self.send_response(404 if body is None else 200)
        self.end_headers()
        self.wfile.write(body or b"")

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def server():
    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Feed)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}"
    httpd.shutdown()


def test_each_fault_has_its_status_and_the_whole_fetch_one_limit(server):
    status = lambda path, **more: poll_stream.fetch({"path": f"{server}/{path}", "zone": "Z", "timeout": "0.6", **more})[-1]["status"]
    assert [status(p) for p in ("good", "odd", "broken", "missing")] == ["ok", "invalid", "malformed", "unreachable"]
    began = time.monotonic()
    assert status("slow") == "timeout" and time.monotonic() - began < 2
    with pytest.raises(TimeoutError):
        open_document(f"{server}/slow", 0.4)
    assert time.monotonic() - began < 3
    assert poll_stream.fetch({"path": f"{server}/good", "provider": "meteoalarm"})[-1] == {"status": "invalid", "detail": "no country is set"}
    assert poll_stream.fetch({"path": f"{server}/good", "provider": "meteoalarm", "country": "XX"})[-1]["status"] == "invalid"
    assert status("list", provider="meteoalarm", country="DE") == "invalid"
    assert [x.get("status") for x in poll_stream.fetch({"path": f"{server}/good", "zone": "Z"})] == [None, "ok"]


def test_live_polls_are_logged_once_and_by_the_clock(spark, server, tmp_path):
    entries = [{"entry_id": "up/1", "path": f"{server}/good", "zone": "Z"}, {"entry_id": "down", "path": f"{server}/odd", "zone": "Z"}]
    reader = poll_stream.PollReader({"log": str(tmp_path), "entries": json.dumps(entries), "interval": "3600", "start": "2024-01-01T00:00:00+00:00"})
    end = reader.latestOffset()
    assert end["poll"] == int((time.time() - 1704067200) // 3600)
    parts = reader.partitions({"poll": end["poll"] - 5}, end)
    first = [list(reader.read(p)) for p in parts]
    assert [(r[0][0], r[-1][3]) for r in first] == [("up/1", "ok"), ("down", "invalid")] and first[0][0][1] == end["poll"]
    again = reader.partitions({"poll": end["poll"] - 5}, end)
    assert [type(p) for p in again] == [poll_stream.Logged]
    assert sorted(map(repr, reader.read(again[0]))) == sorted(repr(x) for r in first for x in r)
    assert len(list(tmp_path.rglob("fetched.json"))) == 2


def test_a_task_that_dies_leaves_nothing_and_a_commit_is_whole(spark, tmp_path):
    sink.register(spark)
    log = str(tmp_path / "log")
    df = spark.range(100).repartition(4)
    df.write.format("alert_log").option("path", log).mode("append").save()
    bad = df.withColumn("id", F.when(F.col("id") == 99, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="killed"):
        bad.write.format("alert_log").option("path", log).mode("append").save()
    (tmp_path / "log/data/.left.parquet").write_bytes(b"part of a file")
    (tmp_path / "log/data/left.parquet").write_bytes(b"of a task that was killed")
    rows = lambda: sorted(r.id for r in sink.committed(spark, log, df.schema).collect())
    spark.range(100, 103).write.format("alert_log").option("path", log).mode("append").save()
    assert rows() == list(range(103)) and not list((tmp_path / "log/data").glob("*left*"))
    spark.range(3).write.format("alert_log").option("path", log).mode("overwrite").save()
    assert rows() == [0, 1, 2]


def test_a_batch_that_runs_twice_is_there_once(tmp_path):
    import pyarrow as pa

    writer = sink.StreamWriter({"path": str(tmp_path)})
    batch = lambda: iter([pa.record_batch({"x": [1, 2]})])
    for _ in range(2):
        writer.commit([writer.write(batch()), writer.write(iter(())), None], 7)
    writer.abort([writer.write(batch())], 8)
    assert len(list((tmp_path / "data").iterdir())) == 1 and len(list((tmp_path / "batches").iterdir())) == 1


def plain_lru(polls: list[tuple[str, list[tuple]]], cap: int) -> list[dict]:
    """The store after each poll of a provider, by a dictionary from the oldest to the newest."""
    store: dict[str, tuple[int, int]] = {}
    out = []
    for provider, touches in polls:
        listed = set()
        for ref, kind, size, seq in touches:
            if kind == "put":
                store[ref] = (size, seq)
                listed.add(ref)
            elif kind == "read" and ref in store:
                store[ref] = (store[ref][0], seq)
            elif kind == "delete":
                store.pop(ref, None)
        first = min((t[3] for t in touches), default=2**62)
        store = {r: e for r, e in store.items() if not r.startswith(provider) or e[1] >= first}
        total = 0
        newest = sorted(store.items(), key=lambda x: (-x[1][1], x[0]))
        store = {}
        for r, e in newest:
            total += e[0]
            if total > cap:
                break
            store[r] = e
        out.append(dict(store))
    return out


def test_lru_over_thirty_polls_equals_a_dictionary_and_writes_what_is_touched(spark, tmp_path):
    rng = random.Random(6)
    polls, seq = [], 0
    for _ in range(30):
        provider = rng.choice(["a:", "b:"])
        touches = []
        for ref in rng.sample(range(40), rng.randrange(12)):
            seq += rng.randrange(400)
            kind = rng.choice(["put", "put", "put", "read", "delete"])
            touches.append((f"{provider}{ref}", kind, rng.randrange(1, 90) if kind == "put" else None, seq))
        other = "b:" if provider == "a:" else "a:"
        if rng.random() < 0.5:
            seq += 1
            touches.append((f"{other}{rng.randrange(40)}", "read", None, seq))
        seq += 1
        polls.append((provider, touches))
    want = plain_lru(polls, 400)
    path = str(tmp_path)
    for k, (provider, touches) in enumerate(polls):
        df = spark.createDataFrame([("c", ref[:2], *rest) for ref, *rest in ((t[0], t[0], *t[1:]) for t in touches)], lru.TOUCH)
        lru.publish(path, k, df, [("c", provider)])
        query = lru.run(spark, path, 400)
        got = {r.ref: (r.size, r.touch_seq) for r in lru.entries(spark, path).collect()}
        assert got == want[k], k
        written = sum(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"])
        assert written <= len(touches)
    assert sum(map(len, want)) / 30 < 30


def test_rows_are_taken_apart_by_place():
    class State(dict):
        """A map state and a value state."""

        exists = lambda self: False
        iterator = lambda self: iter(self.items())
        updateValue = lambda self, key, value: self.update({key: value})

    shard = stateful.Transitions()
    shard.active, shard.last = State(), type("Last", (), {"exists": lambda _: False, "update": lambda _, value: None})()
    alert = lambda x: tuple(x if c == "event" else "new" for c in stateful.CARRIED)
    row = lambda at, x, marker=False: ("e", 0, 1, None, at, None if marker else "a", *alert(x), marker)
    found = list(shard.handleInputRows(("e", 0), iter([row(3, "third"), row(7, "last"), row(7, "again"), row(5, "fifth"), row(None, "", True)]), None))
    assert [(c.id, c.old, c.new.event, c.new_at) for c in found] == [("a", None, "last", 3)] and shard.active == {("a",): alert("last")}
