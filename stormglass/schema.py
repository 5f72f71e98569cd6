"""The row types: alerts, events, and the feeds' documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of an alert, in order.  Texts default to '', lists to empty; those marked null stay null.
ALERT = """
id string, url string, identifier string,
event string, msg_type string, status string, scope string, category string, urgency string, severity string, certainty string, response_type string,
sent string, effective string, onset string, expires string, ends string,
headline string, description string, instruction string, note string, web string,
area_desc string, affected_zones array<string>, affected_zone_uris array<string>, geocode_ugc array<string>, geocode_same array<string>, geometry string, geometry_ref string, bbox array<double>,
event_code_nws string, event_code_same string,
vtec array<string>, vtec_office string, vtec_phenomena string, vtec_significance string, vtec_action string, vtec_tracking string,
sender string, sender_name string,
references array<string>, replaced_by string, replaced_at string, parent_id string,
parameters map<string,array<string>>,
headline_alt string, description_alt string, instruction_alt string, language string, language_alt string,
provider string,
severity_normalized string, phase string, icon string,
previous_phase string, phase_changed boolean
""".replace("\n", " ").strip()
FIELDS = dict(x.strip().split(" ", 1) for x in ALERT.replace("map<string,array<string>>", "map<string;array<string>>").split(","))
FIELDS = {k: v.replace(";", ",") for k, v in FIELDS.items()}
NULLABLE = ("ends", "instruction", "instruction_alt", "geometry", "bbox", "parameters")

#: The columns of an event; event_type is incident_created, incident_updated or incident_removed.
EVENT = "entry_id string, poll_seq long, poll_ts timestamp, event_type string, event_seq int, incident_id string, event string, severity string, phase string, phase_changed boolean, changed_fields array<string>, area_desc string"

GEOJSON_PAGE = """
type string, detail string, pagination struct<next: string>,
features array<struct<geometry: string, properties: struct<
 id: string, `@id`: string, event: string, messageType: string, status: string, scope: string, category: string, urgency: string, severity: string, certainty: string, response: string,
 sent: string, effective: string, onset: string, expires: string, ends: string, headline: string, description: string, instruction: string, note: string, web: string, areaDesc: string,
 affectedZones: array<string>, geocode: struct<UGC: array<string>, SAME: array<string>>, eventCode: struct<NationalWeatherService: array<string>, SAME: array<string>>,
 sender: string, senderName: string, references: array<string>, replacedBy: string, replacedAt: string, parameters: map<string, array<string>>>>>
""".replace("\n", " ")
ATOM_FEED = "entry array<struct<id: string, updated: string, summary: string, link: array<struct<_href: string>>, category: array<struct<_term: string>>, polygon: string>>"
_AREA = "struct<areaDesc: string, polygon: string, geocode: array<struct<valueName: string, value: string>>>"
_INFO = f"struct<language: string, category: string, event: string, responseType: string, urgency: string, severity: string, certainty: string, onset: string, expires: string, senderName: string, headline: string, description: string, instruction: string, web: string, parameter: array<struct<valueName: string, value: string>>, area: array<{_AREA}>>"
WARNINGS = f"warnings array<struct<uuid: string, alert: struct<identifier: string, sender: string, sent: string, status: string, msgType: string, scope: string, info: array<{_INFO}>>>>"
REGIONS = "array<struct<code: string, EMMA_ID: string, name: string, areaDesc: string>>"


def default_of(field: str) -> Column:
    kind = FIELDS[field]
    if field in NULLABLE:
        return F.lit(None).cast(kind)
    if kind.startswith("array"):
        return F.array().cast(kind)
    return F.lit(False if kind == "boolean" else "nws" if field == "provider" else "")


def as_alerts(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with all alert columns in order, defaults where one is missing or null, and ``extra`` columns first."""
    have = set(df.columns)
    value = lambda f: default_of(f) if f not in have else F.col(f).cast(FIELDS[f]) if f in NULLABLE else F.coalesce(F.col(f).cast(FIELDS[f]), default_of(f))
    return df.select(*extra, *(value(f).alias(f) for f in FIELDS))
