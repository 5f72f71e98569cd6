"""Constant dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, which results depend on.

SEVERITIES = ("extreme", "severe", "moderate", "minor", "unknown")
SIGNIFICANCE = {"W": "severe", "A": "moderate", "Y": "minor", "S": "unknown"}
EXTREME_PHENOMENA = ("TO", "EW")
COLOURS = {"green": "unknown", "yellow": "moderate", "orange": "severe", "red": "extreme"}
PHASES = {"Alert": "new", "Update": "update", "Cancel": "cancel"}
TERMINAL = ("cancel", "expired")
DIFF_COLUMNS = ("headline", "description", "instruction", "severity_normalized", "phase", "expires", "area_desc")
#: Removals that wait for the archive at most.
ARCHIVE_QUEUE = 100
PROVINCES = ("AB", "BC", "MB", "NB", "NL", "NS", "NT", "NU", "ON", "PE", "QC", "SK", "YT")

COUNTRIES = {
    "AT": "Austria", "BE": "Belgium", "BA": "Bosnia and Herzegovina", "BG": "Bulgaria", "HR": "Croatia", "CY": "Cyprus",
    "CZ": "Czechia", "DK": "Denmark", "EE": "Estonia", "FI": "Finland", "FR": "France", "DE": "Germany", "GR": "Greece",
    "HU": "Hungary", "IS": "Iceland", "IE": "Ireland", "IL": "Israel", "IT": "Italy", "LV": "Latvia", "LT": "Lithuania",
    "LU": "Luxembourg", "MT": "Malta", "MD": "Moldova", "ME": "Montenegro", "NL": "Netherlands", "MK": "Republic of North Macedonia",
    "NO": "Norway", "PL": "Poland", "PT": "Portugal", "RO": "Romania", "RS": "Serbia", "SK": "Slovakia", "SI": "Slovenia",
    "ES": "Spain", "SE": "Sweden", "CH": "Switzerland", "UA": "Ukraine", "UK": "United Kingdom",
}
#: The feed name that does not follow from the country's name.
ODD_SLUGS = {"BA": "bosnia-herzegovina"}

EXACT_ICONS = {
    "tornado warning": "mdi:weather-tornado", "tornado watch": "mdi:weather-tornado",
    "severe thunderstorm warning": "mdi:weather-lightning", "severe thunderstorm watch": "mdi:weather-lightning",
    "flood warning": "mdi:home-flood", "flood watch": "mdi:home-flood",
    "flash flood warning": "mdi:water", "flash flood watch": "mdi:water",
    "coastal flood warning": "mdi:waves", "coastal flood watch": "mdi:waves",
    "winter storm warning": "mdi:snowflake-alert", "winter storm watch": "mdi:snowflake-alert",
    "winter weather advisory": "mdi:snowflake", "blizzard warning": "mdi:snowflake-alert", "ice storm warning": "mdi:snowflake-melt",
    "excessive heat warning": "mdi:weather-sunny-alert", "excessive heat watch": "mdi:weather-sunny-alert", "heat advisory": "mdi:weather-sunny-alert",
    "red flag warning": "mdi:fire", "fire weather watch": "mdi:fire",
    "high wind warning": "mdi:weather-windy", "high wind watch": "mdi:weather-windy", "wind advisory": "mdi:weather-windy",
    "dense fog advisory": "mdi:weather-fog", "air quality alert": "mdi:smog", "special weather statement": "mdi:alert-circle",
    "hurricane warning": "mdi:weather-hurricane", "hurricane watch": "mdi:weather-hurricane",
    "tropical storm warning": "mdi:weather-hurricane", "tropical storm watch": "mdi:weather-hurricane",
    "tsunami warning": "mdi:tsunami", "tsunami watch": "mdi:tsunami",
}
NEEDLES = (
    ("tornado", "mdi:weather-tornado"), ("thunderstorm", "mdi:weather-lightning"), ("blizzard", "mdi:snowflake-alert"), ("snowfall", "mdi:snowflake"),
    ("snow squall", "mdi:snowflake-alert"), ("winter storm", "mdi:snowflake-alert"), ("freezing rain", "mdi:snowflake-melt"),
    ("freezing drizzle", "mdi:snowflake-melt"), ("rainfall", "mdi:weather-pouring"), ("wind", "mdi:weather-windy"), ("heat", "mdi:weather-sunny-alert"),
    ("extreme cold", "mdi:snowflake-thermometer"), ("frost", "mdi:snowflake-thermometer"), ("fog", "mdi:weather-fog"), ("smog", "mdi:smog"),
    ("air quality", "mdi:smog"), ("hurricane", "mdi:weather-hurricane"), ("tropical storm", "mdi:weather-hurricane"), ("tsunami", "mdi:tsunami"),
    ("flood", "mdi:home-flood"),
)
EUROPEAN_NEEDLES = (
    ("avalanche", "mdi:snowflake-alert"), ("fire", "mdi:fire"), ("thunderstorm", "mdi:weather-lightning"), ("snow/ice", "mdi:snowflake"),
    ("snow", "mdi:snowflake"), ("ice", "mdi:snowflake-melt"), ("frost", "mdi:snowflake-thermometer"), ("rain flood", "mdi:home-flood"),
    ("flood", "mdi:home-flood"), ("rain", "mdi:weather-pouring"), ("wind", "mdi:weather-windy"), ("gale", "mdi:weather-windy"), ("fog", "mdi:weather-fog"),
    ("extreme high temp", "mdi:weather-sunny-alert"), ("extreme low temp", "mdi:snowflake-thermometer"),
    ("high temperature", "mdi:weather-sunny-alert"), ("low temperature", "mdi:snowflake-thermometer"), ("coastal event", "mdi:waves"),
    ("coastal", "mdi:waves"), ("wave", "mdi:waves"),
)
DEFAULT_ICON = "mdi:alert"

VTEC = r"^/[A-Z]\.([A-Z]{3})\.([A-Z]{4})\.([A-Z]{2})\.([A-Z])\.(\d{4})\.(\d{2})\d{4}T\d{4}Z-\d{6}T\d{4}Z/"
VTEC_FIELDS = ("action", "office", "phenomena", "significance", "tracking", "year")
GPS = r"^-?\d+\.?\d*\s*,\s*-?\d+\.?\d*$"
ZONES = r"^[A-Za-z]{2}[CZ]\d{3}(,[A-Za-z]{2}[CZ]\d{3})*$"
LANGUAGES = (
    "auto", "bg", "bs", "cs", "da", "de", "el", "en", "es", "et", "fi", "fr", "he", "hr", "hu", "is", "it", "lt", "lv", "me", "mk", "mt", "nl", "no",
    "pl", "pt", "ro", "ru", "sk", "sl", "sr", "sv", "uk",
)

TEXT_LIMIT_BYTES, STATE_LIMIT_CHARS, GEOMETRY_LIMIT_CHARS, PAGE_LIMIT = 4096, 255, 5_000_000, 6


def country_slug(code: str) -> str:
    return ODD_SLUGS.get(code) or COUNTRIES[code].lower().replace(" ", "-")


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
