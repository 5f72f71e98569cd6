"""Queries of the streams: polls in a log, keyed state, a transactional table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..operators import lifecycle, normalize, serve
from ..operators.lifecycle import CARRIED
from ..sources import poll_stream
from ..storage import shared_folder
from ..streaming import lru, sink, stateful
from .registry import query
from .snapshots import EVENTS_SQL, normalised, polls, raw, table

EVENT_COLUMNS = ("poll_seq", "event_type", "event_seq", "incident_id", "event", "severity", "phase", "phase_changed", "changed_fields", "area_desc")
#: Alerts of one document of the log, by their numbers.
PAGE = 1000
#: The polls that fail in ``failed_polls``: those with this remainder.
FAILS, FAILED = 5, 3


def write_log(spark, sf, log, failed=None):
    """The table's polls as a log: documents of PAGE events at most, and the status of each poll; those for which ``failed`` is true broke off after some documents."""
    alerts = raw(spark, sf)
    fields = [c for c in alerts.columns if c not in ("entry_id", "event_id", "poll_seq", "poll_ts")]
    page = alerts.groupBy("entry_id", "poll_seq", "poll_ts", F.floor(F.col("event_id") / PAGE).cast("int").alias("page_no")).agg(F.to_json(F.collect_list(F.struct(*fields))).alias("body"))
    ended = polls(spark, sf).select("entry_id", "poll_seq", "poll_ts", F.lit(poll_stream.OK).alias("status"))
    if failed is not None:
        page = page.filter(~failed | (F.col("page_no") % 2 == 0))
        ways = F.array(*map(F.lit, (poll_stream.LATE, poll_stream.REFUSED, poll_stream.BROKEN, poll_stream.INVALID)))
        ended = ended.withColumn("status", F.when(failed, F.get(ways, (F.col("poll_seq") % 4).cast("int"))).otherwise(F.col("status")))
    lines = page.unionByName(ended, allowMissingColumns=True).withColumn("poll_ts", F.date_format("poll_ts", "yyyy-MM-dd'T'HH:mm:ssXXX"))
    lines.repartition("poll_seq", F.pmod("page_no", F.lit(64))).write.mode("append").partitionBy("poll_seq", "entry_id").json(log)


def alerts_of(pages):
    """Normalised alerts and markers, in the columns of ``streaming.polling.SNAPSHOT``, of the documents and statuses of a stream of polls."""
    fields = f"array<struct<ordinal: long, {', '.join(f'{c}: {t}' for c, t in schema.FIELDS.items())}>>"
    counts = pages.filter(F.col("body").isNotNull() | (F.col("status") == poll_stream.OK))
    each = counts.select("entry_id", "poll_seq", "poll_ts", F.col("body").isNull().alias("is_marker"), F.explode_outer(F.from_json("body", fields)).alias("a"))
    rows = each.select("entry_id", "poll_seq", "poll_ts", "is_marker", "a.*").filter("is_marker or id is not null")
    return normalize.normalize(schema.as_alerts(rows, ("entry_id", "poll_seq", "poll_ts", "ordinal", "is_marker"))).select("entry_id", "poll_seq", "poll_ts", "ordinal", "id", *CARRIED, "is_marker")


def run_stream(spark, log, folder, begin=None):
    """Compare the polls of the log, as far as they are there and new, and commit their events to a table of the folder."""
    poll_stream.register(spark)
    sink.register(spark)
    stateful.use_rocksdb(spark)
    found = stateful.events(alerts_of(spark.readStream.format("warning_polls").option("log", log).load()), begin)
    out = found.writeStream.format("alert_log").option("path", f"{folder}/events").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    return out, found.schema


@query(f"WITH {EVENTS_SQL} SELECT {', '.join(EVENT_COLUMNS)} FROM e")
def stateful_lifecycle(spark, sf):
    """The events of all polls, from a log of documents through the stream of polls, keyed state and the transactional table."""
    folder = shared_folder(spark)
    write_log(spark, sf, f"{folder}/log")
    _, columns = run_stream(spark, f"{folder}/log", folder)
    return stateful.numbered(sink.committed(spark, f"{folder}/events", columns)).select(*EVENT_COLUMNS)


#: Alerts are compared with those of the last poll that did not fail.
_NEXT = f"(o.poll_seq + 1 + CASE WHEN (o.poll_seq + 1) % {FAILS} = {FAILED} THEN 1 ELSE 0 END)"
_FAILED_SQL = EVENTS_SQL.replace("o.poll_seq + 1", _NEXT).replace("FROM events)", f"FROM events WHERE date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) % {FAILS} <> {FAILED})")


@query(f"WITH {_FAILED_SQL} SELECT {', '.join(EVENT_COLUMNS)} FROM e")
def failed_polls(spark, sf):
    """As ``stateful_lifecycle``, with polls that fail in each way: what they brought changes nothing."""
    folder = shared_folder(spark)
    write_log(spark, sf, f"{folder}/log", F.col("poll_seq") % FAILS == FAILED)
    _, columns = run_stream(spark, f"{folder}/log", folder)
    return stateful.numbered(sink.committed(spark, f"{folder}/events", columns)).select(*EVENT_COLUMNS)


#: A queue that the test tables' polls fill.
QUEUE = 25


@query(f"""WITH {EVENTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY poll_seq ORDER BY event_seq) AS place FROM e WHERE event_type = 'incident_removed')
    SELECT poll_seq, incident_id, 'Incident removed: ' || event || ' (' || phase || ')' AS title, phase AS message_phase FROM r WHERE place <= {QUEUE}""")
def archive_queue(spark, sf):
    """Removed incidents, as far as the queue takes them, committed to the archive's table."""
    sink.register(spark)
    path = shared_folder(spark)
    found = serve.archive(serve.queued(lifecycle.events(normalised(spark, sf), polls(spark, sf)), QUEUE))
    found.write.format("alert_log").option("path", path).mode("append").save()
    return sink.committed(spark, path, found.schema).select("poll_seq", "incident_id", "title", F.get_json_object("message", "$.phase").alias("message_phase"))


#: Polls of ``geometry_lru_kept``, and a cap that they pass.
LRU_POLLS, LRU_CAP = 5, 15_000


def _kept(k: int) -> str:
    """The store after a poll, from the one before it."""
    provider = "eccc" if k % 3 == 1 else "nws"
    return f"""p{k} AS (SELECT DISTINCT '{provider}:' || user_id AS ref, length('ring ' || user_id || ' of {k}') AS size, CAST({k} AS BIGINT) AS touch_seq FROM events WHERE event_id % {LRU_POLLS} = {k}),
    u{k} AS (SELECT * FROM p{k} UNION ALL SELECT * FROM s{k - 1} WHERE ref NOT IN (SELECT ref FROM p{k}) AND NOT starts_with(ref, '{provider}:')),
    s{k} AS (SELECT ref, size, touch_seq FROM (SELECT *, sum(size) OVER (ORDER BY touch_seq DESC, ref ROWS UNBOUNDED PRECEDING) AS run FROM u{k}) WHERE run <= {LRU_CAP})"""


@query(f"WITH s0_ AS (SELECT '' AS ref, 0 AS size, CAST(0 AS BIGINT) AS touch_seq WHERE false), {', '.join(_kept(k) for k in range(LRU_POLLS)).replace('FROM s-1 ', 'FROM s0_ ')} SELECT ref, size, touch_seq FROM s{LRU_POLLS - 1}")
def geometry_lru_kept(spark, sf):
    """The store after some polls, each of which changes only what it touches."""
    path = shared_folder(spark)
    e = table(spark, sf, "events")
    for k in range(LRU_POLLS):
        provider = "eccc" if k % 3 == 1 else "nws"
        user = F.col("user_id").cast("string")
        size = F.length(F.concat(F.lit("ring "), user, F.lit(f" of {k}"))).cast("long")
        touches = e.filter(F.col("event_id") % LRU_POLLS == k).select(F.lit("all").alias("cache"), F.lit(provider).alias("provider"), F.concat(F.lit(f"{provider}:"), user).alias("ref"), F.lit(lru.PUT).alias("kind"), size.alias("size"), F.lit(k).cast("long").alias("touch_seq")).distinct()
        lru.publish(path, k, touches, [("all", provider)])
        lru.run(spark, path, LRU_CAP)
    return lru.entries(spark, path).select("ref", "size", "touch_seq")
