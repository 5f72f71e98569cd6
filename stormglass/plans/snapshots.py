"""Alert snapshots out of the ``events`` table.

Every day is a poll at its end; a user is an alert, whose kind, severity and expiry
come from the event.  SNAPSHOT_SQL builds the same rows as ``raw`` and ``normalised``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import dims
from ..operators import normalize

EVENT_NAMES = {"view": "Flood Warning", "click": "High Wind Watch", "purchase": "Snow Squall Warning", "error": "Tornado Warning", "signup": "Heat-Advisory"}
MESSAGES = {"view": "Alert", "click": "Alert", "purchase": "Update", "error": "Cancel", "signup": "Actual"}
SIGNIFICANCE, PHENOMENA = ("W", "A", "Y", "S", ""), ("TO", "HW", "EW", "FL", "", "WS", "TS")
LEVELS = ("1; green; Minor", "2; yellow; Moderate", "3; Orange ; Severe", "4;red;Extreme", "3")
PROVIDERS = ("nws", "eccc", "meteoalarm")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], n):
    return F.get(F.array(*map(F.lit, values)), n.cast("int"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert rows as a provider would give them, with entry_id, event_id, poll_seq, poll_ts and ordinal."""
    e = table(spark, sf_dir, "events")
    e = e.withColumns({"poll_seq": F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long"), "k": F.get_json_object("props", "$.k").cast("int")})
    day = F.lit("2024-01-01T00:00:00+00:00").cast("timestamp")
    hours = lambda n: F.make_dt_interval(F.lit(0), n.cast("int"))
    band = F.when(F.col("value") < 100, "Minor").when(F.col("value") < 200, "Moderate").when(F.col("value") < 300, "SEVERE").when(F.col("value") < 400, "Extreme").otherwise("Odd")
    expires = F.date_format(day + hours(F.col("poll_seq") * 24 + F.col("k")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = e.select(
        F.lit("e1").alias("entry_id"),
        "event_id",
        "poll_seq",
        (day + hours((F.col("poll_seq") + 1) * 24)).alias("poll_ts"),
        F.col("event_id").alias("ordinal"),
        F.col("user_id").cast("string").alias("id"),
        dims.literal_map(EVENT_NAMES)[F.col("event_type")].alias("event"),
        dims.literal_map(MESSAGES)[F.col("event_type")].alias("msg_type"),
        band.alias("severity"),
        expires.alias("expires"),
        F.concat(F.lit("Headline "), "event_type").alias("headline"),
        F.concat(F.lit("Level "), F.floor(F.col("value") / 100).cast("string")).alias("description"),
        F.concat(F.lit("Area "), (F.col("user_id") % 10).cast("string")).alias("area_desc"),
        _pick(PROVIDERS, F.col("event_id") % 3).alias("provider"),
        _pick(SIGNIFICANCE, F.col("event_id") % 5).alias("vtec_significance"),
        _pick(PHENOMENA, F.col("event_id") % 7).alias("vtec_phenomena"),
        F.create_map(F.lit("awareness_level"), F.array(_pick(LEVELS, F.col("event_id") % 5))).alias("parameters"),
    )
    return schema.as_alerts(rows, ("entry_id", "event_id", "poll_seq", "poll_ts", "ordinal"))


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize(raw(spark, sf_dir))


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A poll for each day up to the last event's."""
    day = F.lit("2024-01-01T00:00:00+00:00").cast("timestamp")
    last = table(spark, sf_dir, "events").agg(F.max(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))).alias("last")).filter("last >= 0")
    days = last.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).alias("n"))
    return days.select(F.lit("e1").alias("entry_id"), F.col("n").alias("poll_seq"), (day + F.make_dt_interval(F.lit(0), ((F.col("n") + 1) * 24).cast("int"))).alias("poll_ts"))


def case_sql(x: str, values: dict[str, str], other: str = "NULL") -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {other} END"


def _pick_sql(values: tuple[str, ...], n: str) -> str:
    return f"CASE {n} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def needles_sql(x: str, needles: tuple[tuple[str, str], ...]) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, '{n}') THEN '{i}'" for n, i in needles) + " END"


def icon_sql(provider: str, event: str) -> str:
    name = f"lower(trim({event}))"
    exact = case_sql(name, dims.EXACT_ICONS)
    listed = needles_sql(name, dims.NEEDLES)
    return (
        f"coalesce(CASE WHEN {name} = '' THEN NULL WHEN {provider} = 'nws' THEN coalesce({exact}, {listed}) "
        f"WHEN {provider} = 'meteoalarm' THEN {needles_sql(f'replace(replace({name}, chr(45), chr(32)), chr(95), chr(32))', dims.EUROPEAN_NEEDLES)} ELSE {listed} END, '{dims.DEFAULT_ICON}')"
    )


COLOUR_SQL = case_sql("lower(trim(split_part(level, ';', 2)))", dims.COLOURS)
SEVERITY_SQL = f"""CASE provider
    WHEN 'nws' THEN CASE WHEN sig = '' THEN lower(severity) WHEN sig = 'W' AND phen IN ('TO', 'EW') THEN 'extreme' ELSE {case_sql("sig", dims.SIGNIFICANCE, "'unknown'")} END
    WHEN 'meteoalarm' THEN coalesce({COLOUR_SQL}, lower(severity)) ELSE lower(severity) END"""
#: CTEs ev (raw rows), s (normalised), d (one row for each poll and id).
SNAPSHOT_SQL = f"""
    ev AS (
        SELECT event_id, event_id AS ordinal, CAST(user_id AS VARCHAR) AS id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS poll_seq,
            CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INTEGER) AS k, {case_sql("event_type", EVENT_NAMES)} AS event, {case_sql("event_type", MESSAGES)} AS msg_type,
            CASE WHEN value < 100 THEN 'Minor' WHEN value < 200 THEN 'Moderate' WHEN value < 300 THEN 'SEVERE' WHEN value < 400 THEN 'Extreme' ELSE 'Odd' END AS severity,
            'Headline ' || event_type AS headline, 'Level ' || CAST(CAST(floor(value / 100) AS BIGINT) AS VARCHAR) AS description, 'Area ' || CAST(user_id % 10 AS VARCHAR) AS area_desc,
            {_pick_sql(PROVIDERS, "event_id % 3")} AS provider, {_pick_sql(SIGNIFICANCE, "event_id % 5")} AS sig, {_pick_sql(PHENOMENA, "event_id % 7")} AS phen, {_pick_sql(LEVELS, "event_id % 5")} AS level
        FROM events),
    s AS (
        SELECT *, poll_seq * 24 + k AS expires_h, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (poll_seq * 24 + k), '%Y-%m-%dT%H:%M:%SZ') AS expires,
            CASE WHEN sn IN ('extreme', 'severe', 'moderate', 'minor') THEN sn ELSE 'unknown' END AS severity_normalized,
            CASE WHEN k < 24 THEN 'expired' ELSE {case_sql("msg_type", dims.PHASES, "'new'")} END AS phase
        FROM (SELECT *, {SEVERITY_SQL} AS sn FROM ev)),
    d AS (
        SELECT * EXCLUDE (ordinal, rn, first_at), first_at AS ordinal
        FROM (SELECT *, row_number() OVER (PARTITION BY poll_seq, id ORDER BY ordinal DESC) AS rn, min(ordinal) OVER (PARTITION BY poll_seq, id) AS first_at FROM s) WHERE rn = 1)
"""
_DIFFERS = " || ".join(f"CASE WHEN o.{c} IS DISTINCT FROM n.{c} THEN ',{c}' ELSE '' END" for c in dims.DIFF_COLUMNS if c != "instruction")
#: CTE e: the events of all polls.
EVENTS_SQL = f"""{SNAPSHOT_SQL},
    j AS (
        SELECT coalesce(n.poll_seq, o.poll_seq + 1) AS poll_seq, coalesce(n.id, o.id) AS id, n.id AS nid, o.id AS oid, n.phase AS np, o.phase AS op, o.expires_h AS oh,
            coalesce(n.event, o.event) AS event, coalesce(n.severity_normalized, o.severity_normalized) AS severity, coalesce(n.area_desc, o.area_desc) AS area_desc, n.ordinal AS n_at, o.ordinal AS o_at,
            CASE WHEN n.id IS NULL OR o.id IS NULL THEN '' ELSE ltrim({_DIFFERS}, ',') END AS changed_fields
        FROM (SELECT * FROM d WHERE phase NOT IN ('cancel', 'expired')) o FULL OUTER JOIN d n ON n.id = o.id AND n.poll_seq = o.poll_seq + 1
        WHERE coalesce(n.poll_seq, o.poll_seq + 1) <= (SELECT max(poll_seq) FROM ev)),
    e0 AS (
        SELECT *, CASE WHEN nid IS NULL OR np IN ('cancel', 'expired') THEN 'incident_removed' WHEN oid IS NULL THEN 'incident_created' WHEN changed_fields <> '' THEN 'incident_updated' END AS event_type,
            CASE WHEN nid IS NULL THEN CASE WHEN (poll_seq + 1) * 24 >= oh THEN 'expired' ELSE 'cancel' END ELSE np END AS phase FROM j),
    e AS (
        SELECT poll_seq, event_type, CAST(row_number() OVER (PARTITION BY poll_seq ORDER BY nid IS NULL, coalesce(n_at, o_at)) AS INTEGER) AS event_seq, id AS incident_id, event, severity, phase,
            oid IS NULL OR op <> phase AS phase_changed, changed_fields, area_desc, nid, oid FROM e0 WHERE event_type IS NOT NULL)
"""
