"""Which alerts concern an entry, and one row out of an alert's languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks, geo
from ..functions.text import text_of


def of_province_or_point(alerts: DataFrame, province: str = "", gps_loc: str = "") -> DataFrame:
    """Canadian alerts of a province, else those whose polygon holds the point, else none."""
    if province:
        return alerts.filter(checks.matches_province(F.col("area_desc"), F.col("geocode"), F.lit(province)))
    at = geo.gps(F.lit(gps_loc))
    return alerts.filter(F.coalesce(geo.in_geometry(at["lat"], at["lon"], F.col("geometry")), F.lit(False)))


def of_point(alerts: DataFrame, gps_loc: str) -> DataFrame:
    """European alerts with a ring that holds the point.

    No alerts give none; alerts of which none has a geometry raise, and so does an
    unreadable point.
    """
    counts = alerts.agg(F.count(F.lit(1)).alias("n"), F.count_if(text_of(F.col("geometry")) != "").alias("shapes")).first()
    if counts["n"] == 0:
        return alerts
    if counts["shapes"] == 0:
        raise ValueError("the feed has no polygons")
    parts = gps_loc.split(",")
    try:
        lat, lon = float(parts[0]), float(parts[1])
    except (ValueError, IndexError):
        raise ValueError(f"not a position: {gps_loc!r}") from None
    return alerts.filter(geo.in_geometry(F.lit(lat), F.lit(lon), F.col("geometry")))


def has_region(regions: list[str]) -> Column:
    """Whether ``geocode_same`` has one of the region codes; empty codes do not count."""
    wanted = [r for r in regions if r]
    return F.arrays_overlap("geocode_same", F.array(*map(F.lit, wanted))) if wanted else F.lit(False)


def of_regions(alerts: DataFrame, regions: list[str]) -> DataFrame:
    """Alerts with one of the region codes; without any there are none."""
    return alerts.filter(has_region(regions))


def of_european_entry(alerts: DataFrame, gps_loc: str = "", regions: list[str] | None = None) -> DataFrame:
    """By point if there is one, else by regions, else all."""
    if gps_loc:
        return of_point(alerts, gps_loc)
    return of_regions(alerts, regions) if regions else alerts


def region_join(alerts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The alerts that have a code of ``wanted`` (code), for region lists of any size."""
    codes = alerts.select("id", F.explode("geocode_same").alias("code")).join(wanted.select("code").distinct(), "code", "left_semi").select("id").distinct()
    return alerts.join(codes, "id", "left_semi")


def merge_languages(alerts: DataFrame, preferred: Column | str, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row for each alert out of its language variants, in order of ``ordinal``.

    The last variant of the preferred language is the alert and the last other one its
    alternate; without a preferred one these are the first two.  The alternate's texts fill
    the _alt columns.
    """
    preferred = F.lit(preferred) if isinstance(preferred, str) else preferred
    row = F.struct(*alerts.columns)
    is_preferred = F.col("language") == preferred
    at = lambda agg, cond: agg(F.when(cond, row), F.when(cond, F.col("ordinal")))
    placed = alerts.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal")))
    nth = lambda n: F.first(F.when(F.col("_n") == n, row), ignorenulls=True)
    groups = placed.groupBy(*keys).agg(
        at(F.max_by, is_preferred).alias("main"),
        at(F.max_by, ~is_preferred).alias("other"),
        nth(1).alias("first"),
        nth(2).alias("second"),
        F.min("ordinal").alias("position"),
    )
    main = F.coalesce("main", "first")
    other = F.when(F.col("main").isNotNull(), F.col("other")).otherwise(F.col("second"))
    picked = groups.select(main.alias("m"), other.alias("o"), "position")
    alt = {f"{c}_alt": F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"m.{c}_alt")) for c in ("headline", "description", "instruction", "language")}
    return picked.select(*(alt[c].alias(c) if c in alt else F.col("position").alias(c) if c == "ordinal" else F.col(f"m.{c}").alias(c) for c in alerts.columns))
