"""Identities of alerts: stable over updates, short, and the same in every language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import slug, text_of, vtec_field


def short_sha256(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, 12)


def vtec_id(vtec: Column, url: Column) -> Column:
    """From office, phenomena, significance, tracking number and year of a VTEC string, else from the URL."""
    parts = [vtec_field(vtec, f) for f in ("office", "phenomena", "significance", "tracking")]
    key = F.concat_ws(".", *parts, F.concat(F.lit("20"), vtec_field(vtec, "year")))
    return short_sha256(F.when(vtec_field(vtec, "year") != "", key).otherwise(text_of(url)))


def area_id(geocode: Column, sent: Column, urgency: Column) -> Column:
    """From the area, the day and the urgency, so that language variants agree."""
    return short_sha256(F.concat(text_of(geocode), F.substring(text_of(sent), 1, 10), text_of(urgency)))


def message_id(identifier: Column, uuid: Column) -> Column:
    """From the message's identifier, else its uuid."""
    return short_sha256(F.coalesce(F.nullif(identifier, F.lit("")), text_of(uuid)))


def unique_id(entry_id: Column, provider: Column, alert_id: Column) -> Column:
    return F.concat_ws("_", entry_id, provider, alert_id)


def object_id(event: Column, unique: Column, prefix: str = "alert") -> Column:
    """``prefix``, a readable name and eight digits of the unique id's hash; null without an event."""
    return F.when(text_of(event) != "", F.concat_ws("_", F.lit(prefix), slug(event), F.substring(F.sha1(unique), 1, 8)))


def geometry_ref(provider: Column, alert_id: Column, geometry: Column) -> Column:
    return F.when(text_of(geometry) != "", F.concat(provider, F.lit(":"), alert_id)).otherwise(F.lit(""))
