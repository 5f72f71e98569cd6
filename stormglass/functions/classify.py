"""Severity, lifecycle phase and icon."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims
from .text import strip, text_of


def colour_severity(awareness_level: Column) -> Column:
    """Severity of a "3; orange; Severe" level by its colour; null if there is none that is known."""
    colour = F.lower(strip(F.get(F.split(awareness_level, ";"), F.lit(1))))
    return F.try_element_at(dims.literal_map(dims.COLOURS), colour)


def vtec_severity(significance: Column, phenomena: Column, severity: Column) -> Column:
    """Severity by VTEC significance; without one, the message's own."""
    own = F.coalesce(F.nullif(F.lower(severity), F.lit("")), F.lit("unknown"))
    extreme = (significance == "W") & phenomena.isin(*dims.EXTREME_PHENOMENA)
    known = F.coalesce(F.try_element_at(dims.literal_map(dims.SIGNIFICANCE), significance), F.lit("unknown"))
    return F.when(text_of(significance) == "", own).when(F.coalesce(extreme, F.lit(False)), "extreme").otherwise(known)


def severity(provider: Column, cap_severity: Column, significance: Column, phenomena: Column, awareness_level: Column) -> Column:
    """One of SEVERITIES, by the provider's own scale where it has one."""
    own = F.lower(text_of(cap_severity))
    raw = F.when(provider == "nws", vtec_severity(significance, phenomena, cap_severity)).when(provider == "meteoalarm", F.coalesce(colour_severity(awareness_level), own)).otherwise(own)
    return F.when(raw.isin(*dims.SEVERITIES), raw).otherwise("unknown")


def message_phase(msg_type: Column) -> Column:
    return F.coalesce(F.try_element_at(dims.literal_map(dims.PHASES), msg_type), F.lit("new"))


def phase(msg_type: Column, expires_ts: Column, now: Column) -> Column:
    """``expired`` once ``now`` is past the expiry, else the message type's phase."""
    return F.when(now > expires_ts, "expired").otherwise(message_phase(msg_type))


def last_phase(expires_ts: Column, now: Column) -> Column:
    """The phase of an alert that is gone: expired at its expiry or later, else cancelled."""
    return F.when(now >= expires_ts, "expired").otherwise("cancel")


def is_terminal(x: Column) -> Column:
    return x.isin(*dims.TERMINAL)


def first_needle(text: Column, needles: tuple[tuple[str, str], ...]) -> Column:
    """The icon of the first needle that ``text`` contains, else null."""
    out = None
    for needle, icon_name in needles:
        hit = F.contains(text, F.lit(needle))
        value = F.lit(icon_name)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def icon(provider: Column, event: Column) -> Column:
    # The text is bound as an array element: every needle names it, and it is made once.
    return F.get(F.transform(F.array(F.lower(strip(text_of(event)))), lambda name: _icon_of(provider, name)), F.lit(0))


def _icon_of(provider: Column, name: Column) -> Column:
    exact = F.try_element_at(dims.literal_map(dims.EXACT_ICONS), name)
    european = F.get(F.transform(F.array(F.translate(name, "-_", "  ")), lambda folded: first_needle(folded, dims.EUROPEAN_NEEDLES)), F.lit(0))
    found = F.when(provider == "meteoalarm", european).when(provider == "nws", F.coalesce(exact, first_needle(name, dims.NEEDLES))).otherwise(first_needle(name, dims.NEEDLES))
    return F.coalesce(F.when(name != "", found), F.lit(dims.DEFAULT_ICON))
