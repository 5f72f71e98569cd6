"""Settings of entries: what each of them asks for.

``entries`` has entry_id, provider, zone_id, gps_loc, tracker_entity, province, country,
regions, region_labels, scan_interval, timeout and language; null where unset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks, dims, geo, text

ENTRY = "entry_id string, provider string, zone_id string, gps_loc string, tracker_entity string, province string, country string, regions array<string>, region_labels map<string,string>, scan_interval int, timeout int, language string"
#: Seconds between polls and until one is given up.
SCAN_INTERVAL, TIMEOUT = 300, 30


def resolve(entries: DataFrame, trackers: DataFrame, host_language: str = "en") -> DataFrame:
    """Entries with trackers' positions and a concrete language.

    ``trackers`` has tracker_entity, latitude and longitude.  A tracker without a latitude,
    or with latitude zero, has no position: gps_loc is empty.
    """
    place = F.when(F.coalesce(F.col("latitude"), F.lit(0.0)) != 0, F.concat(F.col("latitude").cast("string"), F.lit(","), F.col("longitude").cast("string"))).otherwise("")
    prefix = host_language.split("-", 1)[0].lower() or "en"
    auto = F.when(F.col("provider") == "meteoalarm", F.lit(prefix)).otherwise(F.lit("fr-CA" if host_language.startswith("fr") else "en-CA"))
    joined = entries.join(trackers.select("tracker_entity", "latitude", "longitude"), "tracker_entity", "left")
    return joined.withColumns(
        {
            "gps_loc": F.when(F.col("tracker_entity").isNotNull(), place).otherwise(F.col("gps_loc")),
            "language": F.when(F.coalesce("language", F.lit("auto")) == "auto", auto).otherwise(F.col("language")),
            "scan_interval": F.coalesce("scan_interval", F.lit(SCAN_INTERVAL)),
            "timeout": F.coalesce("timeout", F.lit(TIMEOUT)),
        }
    ).select(entries.columns)


def faults(entries: DataFrame) -> DataFrame:
    """(entry_id, errors): what is wrong with each entry's settings; unset ones are fine."""
    tests = [
        F.when(F.col("zone_id").isNotNull(), checks.check_zone(F.col("zone_id"))["error"]),
        F.when(F.col("gps_loc").isNotNull(), checks.check_gps(F.col("gps_loc"))["error"]),
        F.when(F.col("province").isNotNull(), checks.check_province(F.col("province"))["error"]),
        F.when(F.col("country").isNotNull(), checks.check_country(F.col("country"))["error"]),
        F.when(~checks.options_fine(F.coalesce("scan_interval", F.lit(SCAN_INTERVAL)), F.coalesce("timeout", F.lit(TIMEOUT)), F.coalesce("language", F.lit("auto"))), F.lit("invalid_options")),
    ]
    return entries.select("entry_id", F.array_compact(F.array(*tests)).alias("errors"))


def request_query(zone_id: Column, gps_loc: Column) -> Column:
    """The query of a US request: by zone, else by point rounded to four places; empty if there is neither."""
    at = geo.gps(gps_loc)
    point = F.concat(F.lit("point="), F.round(at["lat"], 4).cast("string"), F.lit(","), F.round(at["lon"], 4).cast("string"))
    return F.when(text.text_of(zone_id) != "", F.concat(F.lit("zone="), zone_id)).otherwise(F.coalesce(point, F.lit("")))


def country_dimension(spark) -> DataFrame:
    """(country, name, slug) of the European feeds, by name as a list of choices shows them."""
    return spark.createDataFrame([(c, n, dims.country_slug(c)) for c, n in dims.COUNTRIES.items()], "country string, name string, slug string").orderBy("name")
