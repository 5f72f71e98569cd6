"""Changes between successive snapshots of a feed.

``incoming`` has the normalised rows of all snapshots: entry_id, poll_seq, ordinal, id,
event, phase, expires, area_desc and the other columns that are compared.  ``polls`` has
one row (entry_id, poll_seq, poll_ts) for each poll that succeeded, empty ones included;
failed polls are not in it and change nothing.

A poll is compared with the non-terminal rows of the poll before it, and nothing
else.  So all history is compared at once: rows are dealt by (entry_id, id), and each looks
at the row of its id before it and after it.  One shuffle does that, of one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, clock, dims

KEY = ("entry_id", "poll_seq", "id")
CREATED, UPDATED, REMOVED = "incident_created", "incident_updated", "incident_removed"
#: What a comparison or an event needs of a row.
CARRIED = ("event", *dims.DIFF_COLUMNS)


def last_of_each(incoming: DataFrame) -> DataFrame:
    """One row for each id of a snapshot: the last one's values at the first one's place."""
    # Rows are sorted by these keys in their order: most ids differ, few entries do.
    columns = [c for c in incoming.columns if c not in (*KEY, "ordinal")]
    last = incoming.groupBy("id", "entry_id", "poll_seq").agg(F.max_by(F.struct(*columns), "ordinal").alias("row"), F.min("ordinal").alias("ordinal"))
    return last.select(*KEY, "ordinal", *(F.col(f"row.{c}").alias(c) for c in columns))


def changed_fields(before: str, after: str) -> Column:
    """The names of DIFF_COLUMNS that differ between two structs, in that order."""
    return F.array_compact(F.array(*(F.when(~F.col(f"{before}.{c}").eqNullSafe(F.col(f"{after}.{c}")), F.lit(c)) for c in dims.DIFF_COLUMNS)))


def numbered(polls: DataFrame) -> DataFrame:
    """``polls`` with the number of each among its entry's, and the poll that follows."""
    order = Window.partitionBy("entry_id").orderBy("poll_seq")
    following = lambda c: F.lead(c).over(order).alias(f"next_{c[5:]}")
    return polls.select("entry_id", "poll_seq", "poll_ts", F.row_number().over(order).alias("poll_no"), following("poll_seq"), following("poll_ts"))


def in_sequence(incoming: DataFrame, polls: DataFrame) -> DataFrame:
    """One row for each id of a snapshot, with ``before`` (poll_no, ordinal, row: of the poll before, if the id was active there) and ``next_no``, the id's next poll."""
    rows = last_of_each(incoming.repartition("entry_id", "id")).join(numbered(polls), ["entry_id", "poll_seq"])
    order = Window.partitionBy("id", "entry_id").orderBy("poll_seq")  # as last_of_each has sorted them
    last = F.lag(F.struct("poll_no", "ordinal", F.struct(*CARRIED).alias("row"))).over(order)
    rows = rows.withColumns({"before": last, "next_no": F.lead("poll_no").over(order)})
    was_active = (F.col("before.poll_no") == F.col("poll_no") - 1) & ~classify.is_terminal(F.col("before.row.phase"))
    return rows.withColumn("before", F.when(was_active, F.col("before")))


def diff(incoming: DataFrame, polls: DataFrame) -> DataFrame:
    """Before and after of every alert at every poll: entry_id, poll_seq, id, poll_ts, old, new, old_at, new_at, changed_fields."""
    rows = in_sequence(incoming.select(*KEY, "ordinal", *CARRIED), polls)
    row = F.struct(*CARRIED)
    now = F.struct("poll_seq", "poll_ts", F.col("before.row").alias("old"), row.alias("new"), F.col("before.ordinal").alias("old_at"), F.col("ordinal").alias("new_at"))
    stays = F.coalesce(F.col("next_no") == F.col("poll_no") + 1, F.lit(False))
    leaves = ~classify.is_terminal(F.col("phase")) & F.col("next_seq").isNotNull() & ~stays
    then = F.struct(F.col("next_seq").alias("poll_seq"), F.col("next_ts").alias("poll_ts"), row.alias("old"), F.when(F.lit(False), row).alias("new"), F.col("ordinal").alias("old_at"), F.when(F.lit(False), F.col("ordinal")).alias("new_at"))
    both = rows.select("entry_id", "id", F.explode(F.when(leaves, F.array(now, then)).otherwise(F.array(now))).alias("x")).select("entry_id", "id", "x.*")
    changed = F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), changed_fields("old", "new")).otherwise(F.array().cast("array<string>"))
    return both.withColumn("changed_fields", changed)


def events(incoming: DataFrame, polls: DataFrame, dedupe_terminal: bool = False) -> DataFrame:
    """The events of every poll, in columns of schema.EVENT.

    Created: new and not terminal.  Removed: terminal now, or gone; an alert that is new and
    terminal at once is removed without having been created, and again at each poll that lists
    it (not with ``dedupe_terminal``).  Updated: compared columns differ.  Events of a poll
    come in the order of its rows, then those that are gone in the order they had.
    """
    rows = diff(incoming, polls)
    if dedupe_terminal:
        old, ended = F.col("old"), classify.is_terminal(F.col("new.phase"))
        history = Window.partitionBy("entry_id", "id").orderBy("poll_seq")
        repeated = old.isNull() & ended & F.coalesce(F.lag(ended).over(history), F.lit(False))
        rows = rows.withColumn("_repeated", F.coalesce(repeated, F.lit(False))).filter("not _repeated")
    found = described(rows)
    order = Window.partitionBy("entry_id", "poll_seq").orderBy("gone", "place")
    return found.withColumn("event_seq", F.row_number().over(order)).select(*(c for c in found.columns[:4]), "event_seq", *(c for c in found.columns[4:] if c not in ("gone", "place")))


def described(rows: DataFrame) -> DataFrame:
    """The events of changes (entry_id, poll_seq, poll_ts, id, old, new, old_at, new_at, changed_fields), and what orders those of a poll: gone, place."""
    old, new, ended = F.col("old"), F.col("new"), classify.is_terminal(F.col("new.phase"))
    kind = F.when(new.isNull() | ended, REMOVED).when(old.isNull(), CREATED).when(F.size("changed_fields") > 0, UPDATED)
    gone = classify.last_phase(clock.instant(F.col("old.expires")), F.col("poll_ts"))
    phase = F.when(new.isNull(), gone).otherwise(F.col("new.phase"))
    either = lambda c: F.when(new.isNull(), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))
    return rows.withColumn("event_type", kind).filter("event_type is not null").select(
        "entry_id",
        "poll_seq",
        "poll_ts",
        "event_type",
        F.col("id").alias("incident_id"),
        either("event").alias("event"),
        either("severity_normalized").alias("severity"),
        phase.alias("phase"),
        (old.isNull() | (F.col("old.phase") != phase)).alias("phase_changed"),
        "changed_fields",
        either("area_desc").alias("area_desc"),
        new.isNull().alias("gone"),
        F.coalesce("new_at", "old_at").alias("place"),
    )


def active(incoming: DataFrame, polls: DataFrame) -> DataFrame:
    """The rows that are current after each poll, with previous_phase and phase_changed."""
    columns = [c for c in incoming.columns if c not in ("previous_phase", "phase_changed", "poll_ts")]
    rows = in_sequence(incoming.select(columns), polls).filter(~classify.is_terminal(F.col("phase")))
    previous = F.coalesce("before.row.phase", F.lit(""))
    return rows.select(*columns, "poll_ts", previous.alias("previous_phase"), (previous != F.col("phase")).alias("phase_changed"))


def with_entity_ids(found: DataFrame, registry: DataFrame) -> DataFrame:
    """Events with the entity_id of ``registry`` (entry_id, incident_id, entity_id), null where it has none."""
    return found.join(registry.select("entry_id", "incident_id", "entity_id"), ["entry_id", "incident_id"], "left")
