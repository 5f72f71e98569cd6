"""Views of the current alerts: entities, counts, attributes, archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import checks, dims, ident
from . import lifecycle

VERSION = "1.0"


def sync_entities(current: DataFrame, tracked: DataFrame, grace: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Ids to add and to remove, from those that are current, tracked and (on the first sync) exempt; all have key columns alike."""
    keys = current.columns
    add = current.join(tracked, keys, "left_anti").distinct()
    remove = tracked.join(current, keys, "left_anti")
    return add, (remove.join(grace, keys, "left_anti") if grace is not None else remove).distinct()


def sync_history(current: DataFrame, polls: DataFrame, hydrated: DataFrame) -> DataFrame:
    """What every poll adds and removes: (entry_id, poll_seq, id, action).

    ``current`` has (entry_id, poll_seq, id), ``hydrated`` (entry_id, id) what was tracked
    before the first poll; its ids are exempt from removal at that poll alone.
    """
    order = Window.partitionBy("entry_id").orderBy("poll_seq")
    numbers = polls.select("entry_id", "poll_seq").distinct().withColumn("poll_no", F.row_number().over(order))
    last = numbers.groupBy("entry_id").agg(F.max("poll_no").alias("last_no"))
    # Exempt ids are tracked before the first poll and through it.
    kept = hydrated.select("entry_id", "id", F.explode(F.array(F.lit(0), F.lit(1))).alias("poll_no"), F.lit(False).alias("there"))
    rows = current.join(numbers, ["entry_id", "poll_seq"]).select("entry_id", "id", "poll_no", F.lit(True).alias("there"))
    tracked = rows.unionByName(kept).join(last, "entry_id").repartition("entry_id", "id").groupBy("entry_id", "id", "poll_no", "last_no").agg(F.max("there").alias("there"))
    # One shuffle by id: each row looks at the polls before and after it.
    of_id = Window.partitionBy("entry_id", "id").orderBy("poll_no")
    comes = F.col("there") & (F.coalesce(F.lag("poll_no").over(of_id), F.lit(-1)) != F.col("poll_no") - 1)
    goes = (F.coalesce(F.lead("poll_no").over(of_id), F.lit(-1)) != F.col("poll_no") + 1) & (F.col("poll_no") < F.col("last_no"))
    steps = F.array_compact(F.array(F.when(comes, F.struct("poll_no", F.lit("add").alias("action"))), F.when(goes, F.struct((F.col("poll_no") + 1).alias("poll_no"), F.lit("remove").alias("action")))))
    found = tracked.select("entry_id", "id", steps.alias("steps")).select("entry_id", "id", F.explode("steps").alias("x")).select("entry_id", "id", "x.poll_no", "x.action")
    return found.join(numbers, ["entry_id", "poll_no"]).select("entry_id", "poll_seq", "id", "action")


def attributes(extra: dict[str, Column] | None = None) -> Column:
    """An alert's attributes as JSON: all columns but the geometry, without nulls, empty texts and empty lists."""

    def value(name: str, kind: str) -> Column:
        c = F.col(name)
        return F.nullif(c, F.lit("")) if kind == "string" else F.when(F.size(c) > 0, c) if kind.startswith("array") else c

    fields = [value(n, k).alias(n) for n, k in schema.FIELDS.items() if n != "geometry"]
    return F.to_json(F.struct(*fields, *(c.alias(n) for n, c in (extra or {"incident_platform_version": F.lit(VERSION)}).items())), {"ignoreNullFields": "true"})


def entities(active: DataFrame) -> DataFrame:
    """One entity for each current alert: unique and object id, state, name, icon and attributes."""
    unique = ident.unique_id(F.col("entry_id"), F.col("provider"), F.col("id"))
    return active.select("entry_id", F.col("id").alias("incident_id"), unique.alias("unique_id"), ident.object_id(F.col("event"), unique).alias("object_id"), F.col("severity_normalized").alias("state"), F.col("event").alias("name"), "icon", attributes().alias("attributes"))


def counts(active: DataFrame, polls: DataFrame) -> DataFrame:
    """How many alerts are current after each poll, zero included."""
    n = active.groupBy("entry_id", "poll_seq").agg(F.count(F.lit(1)).alias("n"))
    return polls.select("entry_id", "poll_seq").join(n, ["entry_id", "poll_seq"], "left").select("entry_id", "poll_seq", F.coalesce("n", F.lit(0)).cast("long").alias("active_count"))


def last_updated(polls: DataFrame) -> DataFrame:
    """The time of each entry's last poll that succeeded; ``polls`` may have a status, ok or failed."""
    ok = F.col("status") == "ok" if "status" in polls.columns else F.lit(True)
    return polls.groupBy("entry_id").agg(F.max(F.when(ok, F.col("poll_ts"))).alias("last_updated"))


def devices(entries: DataFrame, manufacturer: str = "Stormglass") -> DataFrame:
    """Title, manufacturer and model of each entry."""
    columns = [F.col(c) for c in ("provider", "zone_id", "gps_loc", "tracker_entity", "province", "regions", "region_labels", "country")]
    return entries.select("entry_id", checks.title(*columns).alias("title"), F.lit(manufacturer).alias("manufacturer"), F.upper("provider").alias("model"))


def queued(events: DataFrame, most: int = dims.ARCHIVE_QUEUE) -> DataFrame:
    """``events`` less the removals that an archive's queue has no room for.

    The removals of a poll come at once, in order of event_seq, and wait until the first are sent: ``most`` of them
    fit, later ones are refused.
    """
    gone = F.col("event_type") == lifecycle.REMOVED
    place = F.row_number().over(Window.partitionBy("poll_ts").orderBy("event_seq", "entry_id", "incident_id"))
    return events.filter(~gone).unionByName(events.filter(gone).withColumn("_place", place).filter(F.col("_place") <= most).drop("_place"))


def archive(events: DataFrame) -> DataFrame:
    """Removed incidents as messages: a title and the event as JSON."""
    gone = events.filter(F.col("event_type") == lifecycle.REMOVED)
    payload = F.struct(*(c for c in events.columns if c not in ("event_type", "event_seq")))
    return gone.select("entry_id", "poll_seq", "incident_id", F.concat(F.lit("Incident removed: "), "event", F.lit(" ("), "phase", F.lit(")")).alias("title"), F.to_json(payload).alias("message"))


def carry_selection(fetched: DataFrame, selected: DataFrame) -> DataFrame:
    """The fetched regions (code, label) whose code is selected; codes that are no longer offered are dropped."""
    return fetched.join(selected.select("code").distinct(), "code", "left_semi")
