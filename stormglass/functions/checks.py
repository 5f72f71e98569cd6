"""Validation of settings, and titles.  A validator gives struct(value, error): error is null if the value is fine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims
from .geo import gps
from .text import strip, text_of


def _checked(fine: Column, cleaned: Column, value: Column, error: str) -> Column:
    fine = F.coalesce(fine, F.lit(False))
    return F.struct(F.when(fine, cleaned).otherwise(value).alias("value"), F.when(~fine, F.lit(error)).alias("error"))


def check_gps(value: Column) -> Column:
    at = gps(value)
    fine = F.regexp_like(value, F.lit(dims.GPS)) & at["lat"].between(-90, 90) & at["lon"].between(-180, 180)
    return _checked(fine, F.concat(at["lat"].cast("string"), F.lit(","), at["lon"].cast("string")), value, "invalid_gps")


def check_zone(value: Column) -> Column:
    cleaned = F.upper(strip(value))
    return _checked(F.regexp_like(cleaned, F.lit(dims.ZONES)), cleaned, value, "invalid_zone")


def check_province(value: Column) -> Column:
    cleaned = F.upper(strip(value))
    return _checked(cleaned.isin(*dims.PROVINCES), cleaned, value, "invalid_province")


def check_country(value: Column) -> Column:
    cleaned = F.upper(strip(value))
    return _checked(cleaned.isin(*dims.COUNTRIES), cleaned, value, "invalid_country")


def options_fine(scan_interval: Column, timeout: Column, language: Column) -> Column:
    return scan_interval.between(60, 3600) & timeout.between(5, 120) & language.isin(*dims.LANGUAGES)


def title(provider: Column, zone_id: Column, gps_loc: Column, tracker: Column, province: Column, regions: Column, region_labels: Column, country: Column, prefix: str = "Alerts") -> Column:
    """An entry's title, led by ``prefix``, by the first of its locations that is set (not null)."""
    name = F.coalesce(F.try_element_at(dims.literal_map(dims.COUNTRIES), country), text_of(country))
    labels = F.array_sort(F.map_values(region_labels))
    extra = F.size(labels) - 1
    several = F.concat(text_of(country), F.lit(" — "), F.get(labels, F.lit(0)), F.when(extra > 0, F.concat(F.lit(" +"), extra.cast("string"))).otherwise(""))
    counted = F.concat(name, F.lit(" — "), F.size(regions).cast("string"), F.lit(" regions"))
    where = (
        F.when(zone_id.isNotNull(), zone_id)
        .when(gps_loc.isNotNull(), gps_loc)
        .when(tracker.isNotNull(), F.substring_index(tracker, ".", -1))
        .when(province.isNotNull(), province)
        .when(regions.isNotNull(), F.when(F.coalesce(F.size(labels), F.lit(0)) > 0, several).otherwise(counted))
        .when(country.isNotNull(), name)
        .otherwise("Unknown")
    )
    return F.concat(F.lit(f"{prefix} "), F.upper(provider), F.lit(" ("), where, F.lit(")"))


def matches_province(area_desc: Column, geocode: Column, province: Column) -> Column:
    """The area code starts with the province, or the area's name contains it anywhere."""
    p = F.upper(province)
    return (F.upper(F.substring(text_of(geocode), 1, 2)) == p) | F.contains(F.upper(text_of(area_desc)), p)
