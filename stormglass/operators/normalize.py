"""Normalisation of alert rows, in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, clock, geo, ident, text


def normalize(alerts: DataFrame, now: Column | str = "poll_ts") -> DataFrame:
    """``alerts`` with severity_normalized, phase, icon, bbox, geometry_ref, and the texts within their limits.

    All are functions of the row as it came and of the column ``now``.
    """
    now = F.col(now) if isinstance(now, str) else now
    level = F.get(F.try_element_at(F.col("parameters"), F.lit("awareness_level")), F.lit(0))
    new = {
        "severity_normalized": classify.severity(F.col("provider"), F.col("severity"), F.col("vtec_significance"), F.col("vtec_phenomena"), level),
        "phase": classify.phase(F.col("msg_type"), clock.instant(F.col("expires")), now),
        "icon": classify.icon(F.col("provider"), F.col("event")),
        "bbox": geo.box(F.col("geometry")),
        "geometry_ref": ident.geometry_ref(F.col("provider"), F.col("id"), F.col("geometry")),
        "event": text.character_cap(F.col("event")),
        "description": text.byte_cap(F.col("description")),
        "instruction": text.byte_cap(F.col("instruction")),
    }
    return alerts.withColumns(new)
