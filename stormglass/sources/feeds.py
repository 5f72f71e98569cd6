"""Feed documents to alerts.

A parser takes one document a row, with whatever columns name it (``keep``), and gives
ALERT columns and ``ordinal``, the alert's place in its document.  Documents that break a
feed's rules raise where ``strict`` and give no rows otherwise; see ``faults``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import dims, geo, ident, text


def _texts(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<string>"))


def geojson_fault(body: Column) -> Column:
    """Why a page is no FeatureCollection, else null."""
    page = F.from_json(body, schema.GEOJSON_PAGE)
    return F.when(page["type"].isNull() | (page["type"] != "FeatureCollection"), F.concat(F.lit("unexpected response: "), F.coalesce(page["detail"], page["type"], F.lit("not JSON"))))


def warnings_fault(body: Column) -> Column:
    """Why a document has no list of warnings, else null."""
    found = F.try_parse_json(body)
    listed = F.try_variant_get(found, "$.warnings", "variant")
    none = listed.isNull() | F.is_variant_null(listed)
    return F.when(found.isNull(), "invalid JSON").when(F.try_variant_get(found, "$.warnings", "array<variant>").isNull() & ~none, "warnings is not a list")


def _checked(df: DataFrame, body: str, fault: Column, strict: bool) -> DataFrame:
    df = df.withColumn("_fault", fault)
    if strict:
        return df.withColumn(body, F.when(F.col("_fault").isNotNull(), F.raise_error(F.col("_fault"))).otherwise(F.col(body))).drop("_fault")
    return df.filter(F.col("_fault").isNull()).drop("_fault")


def parse_geojson(df: DataFrame, body: str = "body", page_no: str | None = None, keep: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """US-style GeoJSON pages; of a paged scan (``page_no`` from 0) the first PAGE_LIMIT pages count."""
    if page_no:
        df = df.filter(F.col(page_no) < dims.PAGE_LIMIT)
    pages = _checked(df, body, geojson_fault(F.col(body)), strict)
    pages = pages.select(*keep, F.posexplode(F.from_json(body, schema.GEOJSON_PAGE)["features"]).alias("ordinal", "feature"))
    p = F.col("feature.properties")
    vtec = _texts(F.try_element_at(p["parameters"], F.lit("VTEC")))
    first = lambda x: text.text_of(F.get(x, F.lit(0)))
    one = first(vtec)
    same_name = dict(
        event="event", msg_type="messageType", status="status", scope="scope", category="category", urgency="urgency", severity="severity", certainty="certainty", response_type="response", sent="sent",
        effective="effective", onset="onset", expires="expires", ends="ends", description="description", instruction="instruction", note="note", web="web", area_desc="areaDesc", sender="sender", sender_name="senderName",
        replaced_by="replacedBy", replaced_at="replacedAt", parameters="parameters", references="references", affected_zone_uris="affectedZones", url="id", identifier="id",
    )
    return schema.as_alerts(
        pages.select(
            *keep,
            "ordinal",
            ident.vtec_id(one, F.coalesce(p["id"], p["@id"])).alias("id"),
            *(p[b].alias(a) for a, b in same_name.items()),
            F.coalesce(F.nullif(p["headline"], F.lit("")), F.get(F.try_element_at(p["parameters"], F.lit("NWSheadline")), F.lit(0))).alias("headline"),
            text.zone_codes(_texts(p["affectedZones"])).alias("affected_zones"),
            p["geocode"]["UGC"].alias("geocode_ugc"),
            p["geocode"]["SAME"].alias("geocode_same"),
            F.nullif(F.col("feature.geometry"), F.lit("null")).alias("geometry"),
            first(p["eventCode"]["NationalWeatherService"]).alias("event_code_nws"),
            first(p["eventCode"]["SAME"]).alias("event_code_same"),
            vtec.alias("vtec"),
            *(text.vtec_field(one, f).alias(f"vtec_{f}") for f in dims.VTEC_FIELDS[:-1]),
            F.lit("nws").alias("provider"),
        ),
        (*keep, "ordinal"),
    )


def parse_atom(df: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """Canadian Atom feeds: one row for each language of an alert whose status is Actual; broken XML raises.

    An extra column ``geocode`` has the area code.
    """
    options = {"rowTag": "feed", "ignoreNamespace": "true", "mode": "FAILFAST"}
    entries = df.select(*keep, F.posexplode(F.from_xml(body, schema.ATOM_FEED, options)["entry"]).alias("ordinal", "e"))
    terms = F.filter(F.transform(_texts(F.col("e.category._term")), text.text_of), lambda t: t != "")
    value = lambda key: text.category_value(terms, key)
    summary = text.text_of(F.col("e.summary"))
    area = F.coalesce(F.nullif(value("areaDesc"), F.lit("")), F.when(F.startswith(summary, F.lit("Area:")), text.strip(F.substring(summary, 6, 2**30))))
    ring = geo.spaced_ring(F.col("e.polygon"))
    rows = entries.select(
        *keep,
        "ordinal",
        value("geocode").alias("geocode"),
        ident.area_id(value("geocode"), F.col("e.updated"), value("urgency")).alias("id"),
        F.col("e.id").alias("url"),
        *(value(k).alias(a) for a, k in (("event", "event"), ("msg_type", "msgType"), ("status", "status"), ("severity", "severity"), ("urgency", "urgency"), ("certainty", "certainty"), ("expires", "expires"), ("language", "language"))),
        F.col("e.updated").alias("sent"),
        area.alias("area_desc"),
        F.when(ring.isNotNull(), geo.geometry_of(F.array(ring))).alias("geometry"),
        F.get(F.col("e.link._href"), F.lit(0)).alias("web"),
        F.lit("eccc").alias("provider"),
    )
    return schema.as_alerts(rows.filter(F.col("status") == "Actual"), (*keep, "ordinal", "geocode"))


def pick_info(infos: Column, preferred: Column) -> tuple[Column, Column]:
    """The info block of the preferred language prefix, else of English, else the first; and the first other block."""
    prefixes = F.transform(infos, lambda i: text.language_prefix(i["language"]))
    at = F.coalesce(F.when(preferred != "", F.nullif(F.array_position(prefixes, preferred), F.lit(0))), F.nullif(F.array_position(prefixes, F.lit("en")), F.lit(0)), F.lit(1)).cast("int")
    return F.get(infos, at - 1), F.get(infos, F.when(at == 1, 1).otherwise(0))


def parse_warnings(df: DataFrame, body: str = "body", preferred: Column | None = None, keep: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """European JSON warnings: one row for each warning whose status is Actual or missing and that has an info block."""
    preferred = text.language_prefix(F.lit("en") if preferred is None else preferred)
    docs = _checked(df.withColumn("_preferred", preferred), body, warnings_fault(F.col(body)), strict)
    rows = docs.select(*keep, "_preferred", F.posexplode(F.from_json(body, schema.WARNINGS)["warnings"]).alias("ordinal", "w"))
    rows = rows.filter(F.col("w").isNotNull() & (text.text_of(F.col("w.alert.status")).isin("", "Actual")) & (F.coalesce(F.size("w.alert.info"), F.lit(0)) > 0))
    main, other = pick_info(F.col("w.alert.info"), F.col("_preferred"))
    rows = rows.withColumns({"i": main, "o": other})
    i, o, a = F.col("i"), F.col("o"), F.col("w.alert")
    plain = {"event": "event", "urgency": "urgency", "severity": "severity", "certainty": "certainty", "onset": "onset", "expires": "expires", "headline": "headline", "description": "description", "web": "web", "sender_name": "senderName", "language": "language"}
    return schema.as_alerts(
        rows.select(
            *keep,
            "ordinal",
            ident.message_id(a["identifier"], F.col("w.uuid")).alias("id"),
            *(a[b].alias(n) for n, b in (("identifier", "identifier"), ("msg_type", "msgType"), ("status", "status"), ("scope", "scope"), ("sent", "sent"), ("sender", "sender"))),
            *(i[b].alias(n) for n, b in plain.items()),
            text.first_of(i["category"]).alias("category"),
            text.first_of(i["responseType"]).alias("response_type"),
            F.nullif(i["instruction"], F.lit("")).alias("instruction"),
            text.join_areas(i["area"]).alias("area_desc"),
            text.emma_codes(i["area"]).alias("geocode_same"),
            geo.geometry_of(geo.area_rings(i["area"])).alias("geometry"),
            text.flatten_parameters(i["parameter"]).alias("parameters"),
            o["headline"].alias("headline_alt"),
            o["description"].alias("description_alt"),
            F.nullif(o["instruction"], F.lit("")).alias("instruction_alt"),
            o["language"].alias("language_alt"),
            F.lit("meteoalarm").alias("provider"),
        ),
        (*keep, "ordinal"),
    )


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """Alerts of several feeds under one schema."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _first_labels(pairs: DataFrame) -> DataFrame:
    first = Window.partitionBy("code").orderBy("ordinal")
    return pairs.filter("code <> ''").withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("code", F.coalesce(F.nullif("label", F.lit("")), "code").alias("label"), "ordinal")


def regions_of_endpoint(df: DataFrame, body: str = "body", page_no: str | None = None) -> DataFrame:
    """(code, label, ordinal) of a region list, bare or under ``regions``; anything else gives none.

    A list may come in several documents, in order of ``page_no``.
    """
    listed = F.coalesce(F.when(F.startswith(F.ltrim(body), F.lit("[")), F.from_json(body, schema.REGIONS)), F.from_json(body, f"regions {schema.REGIONS}")["regions"])
    page = F.lit(0) if page_no is None else F.col(page_no)
    rows = df.select(page.alias("page"), F.posexplode(listed).alias("at", "r")).filter("r is not null").withColumn("ordinal", F.struct("page", "at"))
    pick = lambda a, b: text.strip(F.coalesce(F.nullif(F.col(a), F.lit("")), text.text_of(F.col(b))))
    return _first_labels(rows.select(pick("r.code", "r.EMMA_ID").alias("code"), pick("r.name", "r.areaDesc").alias("label"), "ordinal"))


def regions_of_warnings(df: DataFrame, body: str = "body") -> DataFrame:
    """(code, label, ordinal) from the areas of all info blocks of all warnings, whatever their status."""
    at = df.select(F.posexplode(F.from_json(body, schema.WARNINGS)["warnings"]).alias("p0", "w"))
    at = at.select("p0", F.posexplode("w.alert.info").alias("p1", "i")).select("p0", "p1", F.posexplode("i.area").alias("p2", "a"))
    at = at.select("p0", "p1", "p2", F.col("a.areaDesc").alias("label"), F.posexplode("a.geocode").alias("p3", "g")).filter("g.valueName = 'EMMA_ID'")
    return _first_labels(at.select(text.text_of(F.col("g.value")).alias("code"), text.text_of(F.col("label")).alias("label"), F.struct("p0", "p1", "p2", "p3").alias("ordinal")))


def regions(endpoint: DataFrame, warnings: DataFrame, body: str = "body", page_no: str | None = None) -> DataFrame:
    """(code, label) of the endpoint, or, if it has none, of the warnings, sorted by label without case; none at all raises."""
    found = regions_of_endpoint(endpoint, body, page_no)
    if found.isEmpty():
        found = regions_of_warnings(warnings, body)
    if found.isEmpty():
        raise ValueError("no regions found")
    return found.orderBy(F.lower("label"), "ordinal").select("code", "label")
