"""Queries over whole feed documents, locations, stores and settings.

Documents are made of the ``events`` table, eight events each: event n, of user u, lies in
the square of one degree at latitude 45 + u % 10 and longitude -80 - u % 10, and some of its
fields are missing or broken.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock, dims, ident
from ..operators import geometry, geometry_index, lifecycle, locate, serve
from ..operators.order import placed
from ..sources import feeds, settings
from ..storage import shared_folder, written
from . import snapshots
from .registry import query
from .snapshots import EVENTS_SQL, SNAPSHOT_SQL, normalised, polls, table

#: The position that location queries ask for, in the square of users with u % 10 = 2.
AT = "47.5,-81.5"
#: Regions of one document of a list.
REGIONS_A_PAGE = 500


def _events(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    return e.withColumns({"doc": F.floor(F.col("event_id") / 8), "u": F.col("user_id") % 10, "key": F.col("event_id").cast("string")})


def _documents(parts, part):
    """(doc, parts): each document's parts in order of event."""
    return parts.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.expr(part).alias("part")))), lambda x: x["part"]).alias("parts"))


def _text(*xs):
    return F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))


def _corners(u):
    """Latitude and longitude of a square's corners, as texts."""
    lat, lon = 45 + u, -80 - u
    return [(_text(a, ".0"), _text(b, ".0")) for a, b in ((lat, lon), (lat + 1, lon), (lat + 1, lon + 1), (lat, lon + 1))]


def _ring_sql(u: str) -> str:
    at = [(f"(45 + {u})", f"(-80 - {u})"), (f"(46 + {u})", f"(-80 - {u})"), (f"(46 + {u})", f"(-79 - {u})"), (f"(45 + {u})", f"(-79 - {u})")]
    return "'[' || " + " || ',' || ".join(f"'[' || {lon} || '.0,' || {lat} || '.0]'" for lat, lon in at) + " || ']'"


def _polygon_sql(u: str) -> str:
    return f"""'{{"type":"Polygon","coordinates":[' || {_ring_sql(u)} || ']}}'"""


# Canadian feeds


def _atom(spark, sf):
    e = _events(spark, sf)
    n, u = F.col("event_id"), F.col("u")
    term = lambda k, v: _text(f'<category term="{k}=', v, '"/>')
    geocode = F.concat(F.get(F.array(F.lit("ON"), F.lit("QC"), F.lit("MB")), (F.col("user_id") % 3).cast("int")), F.col("user_id").cast("string"))
    area = F.when(n % 11 == 0, "Lake Ontario").otherwise(_text("Lake ", u))
    flat = [x for corner in _corners(u) for x in corner]
    ring = F.concat_ws(" ", *flat)
    shape = F.when(n % 5 == 1, ring).when(n % 5 == 2, F.concat_ws(" ", *flat[:5], F.lit("b"), *flat[6:])).when(n % 5 == 3, F.concat_ws(" ", *flat[:7])).when(n % 5 == 4, F.concat_ws(" ", *flat[:4]))
    entry = F.concat(
        _text("<entry><id>", n, "</id><updated>", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), '</updated><link href="https://x/', n, '"/><summary>Area: Shore ', u, " </summary>"),
        term("status", F.when(n % 4 == 0, "Test").otherwise("Actual")),
        term("event", F.col("event_type")),
        term("geocode", geocode),
        term("urgency", F.when(n % 2 == 0, "Past").otherwise("Future")),
        term("language", F.when(n % 2 == 0, "en-CA").otherwise("fr-CA")),
        F.when(n % 3 != 0, term("areaDesc", area)).otherwise(""),
        F.coalesce(_text("<georss:polygon>", shape, "</georss:polygon>"), F.lit("")),
        F.lit("</entry>"),
    )
    docs = _documents(e.withColumn("entry", entry), "entry")
    head = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:georss="http://www.georss.org/georss">'
    return feeds.parse_atom(docs.select(_text(head, F.array_join("parts", ""), "</feed>").alias("body")))


_ATOM_SQL = f"""atom AS (
    SELECT *, CASE user_id % 3 WHEN 0 THEN 'ON' WHEN 1 THEN 'QC' ELSE 'MB' END || user_id AS geocode, CASE WHEN event_id % 2 = 0 THEN 'Past' ELSE 'Future' END AS urgency,
        CASE WHEN event_id % 3 = 0 THEN 'Shore ' || u WHEN event_id % 11 = 0 THEN 'Lake Ontario' ELSE 'Lake ' || u END AS area_desc, CASE WHEN event_id % 5 = 1 THEN {_polygon_sql("u")} END AS geometry
    FROM (SELECT *, user_id % 10 AS u FROM events) WHERE event_id % 4 <> 0)"""


@query(f"""WITH {_ATOM_SQL} SELECT event_id, substr(sha256(geocode || strftime(ts, '%Y-%m-%d') || urgency), 1, 12) AS id, event_type AS event, urgency, CASE WHEN event_id % 2 = 0 THEN 'en-CA' ELSE 'fr-CA' END AS language,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS sent, area_desc, geocode, 'https://x/' || event_id AS web, geometry FROM atom""")
def atom_alerts(spark, sf):
    return _atom(spark, sf).select(F.col("url").cast("long").alias("event_id"), "id", "event", "urgency", "language", "sent", "area_desc", "geocode", "web", "geometry")


@query(f"""WITH {_ATOM_SQL} SELECT 'province' AS entry, event_id FROM atom WHERE geocode LIKE 'ON%' OR contains(upper(area_desc), 'ON') UNION ALL SELECT 'point', event_id FROM atom WHERE event_id % 5 = 1 AND u = 2""")
def locate_canadian(spark, sf):
    """A province counts before a point; without either there are no alerts."""
    rows = written(_atom(spark, sf).select("url", "area_desc", "geocode", "geometry"))  # parsed once for all entries
    of = lambda name, **where: locate.of_province_or_point(rows, **where).select(F.lit(name).alias("entry"), F.col("url").cast("long").alias("event_id"))
    return of("province", province="on", gps_loc=AT).unionByName(of("point", gps_loc=AT)).unionByName(of("none"))


# European feeds


def _warnings(spark, sf):
    e = _events(spark, sf)
    n, u = F.col("event_id"), F.col("u")
    pairs = lambda v, sep: [F.concat(lat, F.lit(sep), lon) for lat, lon in _corners(v)]
    ring = lambda v: F.concat_ws(" ", *pairs(v, ","))
    two = F.concat_ws(" ", *(pairs(u, ",")[:2] * 2))
    shape = F.when(n % 5 == 2, F.concat_ws(" ", *pairs(u, ";"))).when(n % 5 == 4, two).when(n % 5 != 0, ring(u))

    def area(v, polygon):
        code = lambda name, value: F.struct(F.lit(name).alias("valueName"), value.alias("value"))
        return F.struct(_text("Area ", v).alias("areaDesc"), polygon.alias("polygon"), F.array(code("EMMA_ID", _text("DE0", v)), code("other", F.lit("x"))).alias("geocode"))

    areas = F.array_compact(F.array(area(u, shape), F.when(n % 5 == 3, area(u + 1, ring(u + 1))), F.when(n % 5 == 3, area(u, F.lit(None).cast("string")))))
    parameter = lambda k, v: F.struct(F.lit(k).alias("valueName"), F.lit(v).alias("value"))

    def info(language):
        return F.struct(
            F.lit(language).alias("language"),
            F.array(F.lit("Met"), F.lit("Geo")).alias("category"),
            F.lit("Shelter").alias("responseType"),
            F.col("event_type").alias("event"),
            _text(f"{language} ", F.col("event_type")).alias("headline"),
            F.when(n % 2 == 0, "").otherwise("Stay in").alias("instruction"),
            F.array(parameter("level", ""), parameter("level", "2; yellow"), parameter("", "z"), parameter("level", "x")).alias("parameter"),
            areas.alias("area"),
        )

    infos = F.when(n % 7 == 0, F.array().cast(f"array<{e.select(info('de-DE').alias('i')).schema['i'].dataType.simpleString()}>")).when(n % 3 == 0, F.array(info("de-DE"))).otherwise(F.array(info("de-DE"), info("en")))
    status = F.when(n % 4 == 0, "Test").when(n % 4 == 1, "").when(n % 4 == 3, "Actual")
    alert = F.struct(F.when(n % 5 == 0, "").otherwise(_text("id-", n)).alias("identifier"), F.col("key").alias("sender"), status.alias("status"), infos.alias("info"))
    docs = _documents(e.withColumn("warning", F.struct(_text("uuid-", n).alias("uuid"), alert.alias("alert"))), "warning")
    return feeds.parse_warnings(docs.select(F.to_json(F.struct(F.col("parts").alias("warnings"))).alias("body")))


_WARNINGS_SQL = f"""w AS (
    SELECT *, event_id % 3 <> 0 AS english, {_ring_sql("u")} AS ring, {_ring_sql("(u + 1)")} AS ring2 FROM (SELECT *, user_id % 10 AS u FROM events) WHERE event_id % 4 <> 0 AND event_id % 7 <> 0)"""


@query(f"""WITH {_WARNINGS_SQL} SELECT event_id, substr(sha256(CASE WHEN event_id % 5 = 0 THEN 'uuid-' ELSE 'id-' END || event_id), 1, 12) AS id, CASE WHEN english THEN 'en' ELSE 'de-DE' END AS language, CASE WHEN english THEN 'en ' ELSE 'de-DE ' END || event_type AS headline,
    CASE WHEN english THEN 'de-DE ' || event_type ELSE '' END AS headline_alt, CASE WHEN english THEN 'de-DE' ELSE '' END AS language_alt, CASE WHEN event_id % 2 = 1 THEN 'Stay in' END AS instruction, 'Met' AS category, 'Shelter' AS response_type,
    'Area ' || u || CASE WHEN event_id % 5 = 3 THEN ', Area ' || (u + 1) ELSE '' END AS area_desc, 'DE0' || u || CASE WHEN event_id % 5 = 3 THEN ',DE0' || (u + 1) ELSE '' END AS codes, '2; yellow; x' AS level,
    CASE event_id % 5 WHEN 1 THEN '{{"type":"Polygon","coordinates":[' || ring || ']}}' WHEN 3 THEN '{{"type":"MultiPolygon","coordinates":[[' || ring || '],[' || ring2 || ']]}}' END AS geometry FROM w""")
def warning_alerts(spark, sf):
    rows = _warnings(spark, sf)
    return rows.select(F.col("sender").cast("long").alias("event_id"), "id", "language", "headline", "headline_alt", "language_alt", "instruction", "category", "response_type", "area_desc", F.array_join("geocode_same", ",").alias("codes"), F.col("parameters")["level"][0].alias("level"), "geometry")


@query(f"""WITH {_WARNINGS_SQL} SELECT 'point' AS entry, event_id FROM w WHERE (event_id % 5 = 1 AND u = 2) OR (event_id % 5 = 3 AND u IN (1, 2))
    UNION ALL SELECT 'regions', event_id FROM w WHERE u IN (3, 7) OR (event_id % 5 = 3 AND u IN (2, 6)) UNION ALL SELECT 'all', event_id FROM w""")
def locate_european(spark, sf):
    """A point counts before regions; without either all alerts are meant."""
    rows = written(_warnings(spark, sf).select("sender", "geocode_same", "geometry"))  # parsed once for all entries
    codes = ["DE03", "", "DE07"]
    of = lambda name, **where: locate.of_european_entry(rows, **where).select(F.lit(name).alias("entry"), F.col("sender").cast("long").alias("event_id"))
    return of("point", gps_loc=AT, regions=codes).unionByName(of("regions", regions=codes)).unionByName(of("all"))


def _region_pages(spark, sf):
    """A region list with repeated codes, REGIONS_A_PAGE suppliers a document."""
    s = table(spark, sf, "supplier").filter("s_suppkey is not null")
    one = F.struct("s_suppkey", F.struct(F.col("s_nationkey").cast("string").alias("EMMA_ID"), F.concat(F.lit(" "), "s_name").alias("name")).alias("r"))
    pages = s.groupBy(F.floor(F.col("s_suppkey") / REGIONS_A_PAGE).alias("page_no")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["r"]).alias("regions"))
    return pages.select("page_no", F.to_json(F.struct("regions")).alias("body"))


@query("SELECT CAST(s_nationkey AS VARCHAR) AS code, arg_min(trim(s_name), s_suppkey) AS label FROM supplier GROUP BY 1")
def regions_endpoint(spark, sf):
    """A region list with repeated codes, of which the first counts."""
    pages = _region_pages(spark, sf)
    return feeds.regions(pages, pages.select(F.lit("{}").alias("body")), page_no="page_no")


@query("""WITH f AS (SELECT s_nationkey AS code, arg_min(trim(s_name), s_suppkey) AS label, min(s_suppkey) AS pos FROM supplier GROUP BY 1)
    SELECT CAST(code AS VARCHAR) AS code, label, CAST(row_number() OVER (ORDER BY lower(label), pos) AS INTEGER) AS place FROM f""")
def regions_dedup_sort(spark, sf):
    """The places of the regions of a list in its order."""
    found = feeds.regions_of_endpoint(_region_pages(spark, sf), page_no="page_no")
    return placed(found, [F.lower("label"), F.col("ordinal")]).select("code", "label", (F.col("place") + 1).cast("int").alias("place"))


@query("SELECT event_id, user_id, CAST(row_number() OVER (ORDER BY user_id DESC, event_id) - 1 AS BIGINT) AS place FROM events")
def events_in_order(spark, sf):
    """A place for each event of the whole table."""
    e = table(spark, sf, "events").select("event_id", "user_id")
    return placed(e, [(F.col("user_id"), True), F.col("event_id")]).drop("size")


@query("SELECT 'DE' || n_nationkey AS code, CASE WHEN n_nationkey % 3 = 0 THEN 'DE' || n_nationkey ELSE n_name END AS label FROM nation")
def regions_fallback(spark, sf):
    """An endpoint without regions: areas of the warnings, of any status, count; a label that is missing is the code."""
    n = table(spark, sf, "nation")
    label = F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("n_name"))
    code = F.struct(F.lit("EMMA_ID").alias("valueName"), _text("DE", F.col("n_nationkey")).alias("value"))
    warning = F.struct(F.struct(F.lit("Test").alias("status"), F.array(F.struct(F.array(F.struct(label.alias("areaDesc"), F.array(code, code).alias("geocode"))).alias("area"))).alias("info")).alias("alert"))
    docs = n.agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", warning.alias("w")))), lambda x: x["w"]).alias("warnings"))  # 25 nations
    return feeds.regions(docs.select(F.lit('{"regions": []}').alias("body")), docs.select(F.to_json(F.struct("warnings")).alias("body")))


# US feeds


@query("""WITH g AS (SELECT *, user_id % 10 AS u FROM events)
    SELECT event_id, substr(sha256(CASE WHEN event_id % 3 = 0 THEN 'urn:' || event_id ELSE 'KABC.TO.W.' || lpad(CAST(user_id % 10000 AS VARCHAR), 4, '0') || '.2025' END), 1, 12) AS id, event_type AS event, 'urn:' || event_id AS url, CASE WHEN event_id % 2 = 0 THEN 'NWS ' || u ELSE 'Own' END AS headline,
    'ABC00' || u AS zones, 'ABC' || u || ',ABC' || (u + 1) AS geocode_ugc, 'SVW' AS event_code_nws, '' AS event_code_same, 'urn:a,urn:b' AS refs, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'KABC' END AS vtec_office, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS ends,
    CASE WHEN event_id % 5 <> 0 THEN '{"coordinates":[' || (-80 - u) || '.5,' || (45 + u) || '.5],"type":"Point"}' END AS geometry FROM g""")
def geojson_alerts(spark, sf):
    e = _events(spark, sf)
    n, u = F.col("event_id"), F.col("u")
    texts = lambda *xs: F.array(*(x if not isinstance(x, str) else F.lit(x) for x in xs))
    vtec = _text("/O.NEW.KABC.TO.W.", F.lpad((F.col("user_id") % 10000).cast("string"), 4, "0"), ".250412T1430Z-250412T1530Z/")
    named = (F.lit("NWSheadline"), texts(_text("NWS ", u), "second"))
    properties = F.struct(
        _text("urn:", n).alias("id"),
        F.col("event_type").alias("event"),
        F.when(n % 2 == 1, "Own").otherwise("").alias("headline"),
        texts(_text("https://x/zones/abc00", u), "https://x/zones/").alias("affectedZones"),
        F.struct(texts(_text("ABC", u), _text("ABC", u + 1)).alias("UGC")).alias("geocode"),
        F.struct(texts("SVW", "TOR").alias("NationalWeatherService"), F.array().cast("array<string>").alias("SAME")).alias("eventCode"),
        texts("urn:a", "urn:b").alias("references"),
        F.when(n % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("ends"),
        F.when(n % 3 == 0, F.create_map(*named)).otherwise(F.create_map(*named, F.lit("VTEC"), texts(vtec, "other"))).alias("parameters"),
    )
    point = F.when(n % 5 != 0, F.parse_json(_text('{"type": "Point", "coordinates": [', -80 - u, ".5, ", 45 + u, ".5]}")))
    docs = _documents(e.withColumn("feature", F.to_json(F.struct(point.alias("geometry"), properties.alias("properties")))), "feature")
    body = _text('{"type": "FeatureCollection", "features": [', F.array_join("parts", ","), "]}")
    rows = feeds.parse_geojson(docs.select(body.alias("body")))
    joined = lambda c, name: F.array_join(c, ",").alias(name)
    return rows.select(F.substring("url", 5, 30).cast("long").alias("event_id"), "id", "event", "url", "headline", joined("affected_zones", "zones"), joined("geocode_ugc", "geocode_ugc"), "event_code_nws", "event_code_same", joined("references", "refs"), "vtec_office", "ends", "geometry")


# Stores

_CAP = 100_000


@query(f"""WITH t AS (SELECT doc_id, 'nws:' || doc_id AS ref, length(text) AS size, CASE WHEN doc_id % 10 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS touch FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 4 <> 1 AND length(text) > 0)
    SELECT ref, size, touch AS touch_seq FROM (SELECT *, sum(size) OVER (ORDER BY touch DESC) AS run FROM t) WHERE run <= {_CAP}""")
def geometry_touches(spark, sf):
    """Puts of those that are not terminal, reads that make entries newer, deletions, eviction."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    ref = ident.geometry_ref(F.lit("nws"), F.col("doc_id").cast("string"), F.col("text"))
    alerts = d.select("doc_id", ref.alias("geometry_ref"), F.col("text").alias("geometry"), F.when(F.col("doc_id") % 4 == 1, "cancel").otherwise("new").alias("phase"))
    log = geometry.puts(alerts, F.col("doc_id"))
    touched = log.filter("touch_seq % 10 = 0").select("ref", (F.col("touch_seq") + 1_000_000_000).alias("at"))
    log = log.unionByName(geometry.reads(touched, F.col("at")))
    gone = alerts.filter("doc_id % 7 = 0").select(F.col("geometry_ref").alias("ref"))
    return geometry.evict(geometry.delete(geometry.entries(log), gone), _CAP).select("ref", "size", "touch_seq")


def _polled(seq: int) -> str:
    provider = "eccc" if seq == 1 else "nws"
    return f"SELECT DISTINCT '{provider}:' || user_id AS ref, length('ring ' || user_id || ' of {seq}') AS size, CAST({seq} AS BIGINT) AS touch_seq FROM events WHERE event_id % 4 = {seq % 4}"


def _synced(seq: int) -> str:
    """The store after a poll, from the one before, within the limit."""
    provider = "eccc" if seq == 1 else "nws"
    return f"""p{seq} AS ({_polled(seq)}), u{seq} AS (SELECT * FROM p{seq} UNION ALL SELECT * FROM s{seq - 1} WHERE ref NOT IN (SELECT ref FROM p{seq}) AND NOT starts_with(ref, '{provider}:')),
    s{seq} AS (SELECT ref, size, touch_seq FROM (SELECT *, sum(size) OVER (ORDER BY touch_seq DESC, ref ROWS UNBOUNDED PRECEDING) AS run FROM u{seq}) WHERE run <= {dims.GEOMETRY_LIMIT_CHARS})"""


@query(f"WITH s0 AS (SELECT '' AS ref, 0 AS size, CAST(0 AS BIGINT) AS touch_seq WHERE false), {', '.join(map(_synced, range(1, 5)))} SELECT ref, size, touch_seq FROM s4")
def geometry_sync(spark, sf):
    """Four polls of two providers: what a later poll of a provider lacks goes, and stays away."""
    e = table(spark, sf, "events").select("event_id", "user_id")
    store = spark.createDataFrame([], "ref string, geometry string, size long, touch_seq long")
    for seq in range(1, 5):
        provider = "eccc" if seq == 1 else "nws"
        shape = _text("ring ", F.col("user_id"), f" of {seq}")
        alerts = e.filter(F.col("event_id") % 4 == seq % 4).select(_text(f"{provider}:", F.col("user_id")).alias("geometry_ref"), shape.alias("geometry"), F.lit("new").alias("phase")).distinct()
        store = written(geometry.sync(store, alerts, F.lit(seq).cast("long"), provider))
    return store.select("ref", "size", "touch_seq")


@query("""SELECT 'nws:' || doc_id AS ref, '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"coordinates":[' || (doc_id % 90) || '.5,1.5],"type":"Point"},"properties":{"ref":"nws:' || doc_id || '"}}]}' AS body FROM documents WHERE doc_id = 3""")
def geometry_lookup(spark, sf):
    d = table(spark, sf, "documents")
    point = _text('{"type":"Point","coordinates":[', F.col("doc_id") % 90, ".5,1.5]}")
    return geometry.lookup(d.select(_text("nws:", F.col("doc_id")).alias("ref"), point.alias("geometry")), "nws:3")


@query("""SELECT 'nws:' || doc_id AS ref, '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"coordinates":[' || (doc_id % 90) || '.5,1.5],"type":"Point"},"properties":{"ref":"nws:' || doc_id || '"}}]}' AS body
    FROM documents WHERE doc_id IN (SELECT doc_id * 3 FROM labels)""")
def geometry_lookup_indexed(spark, sf):
    """The store of all documents' points laid out by ref, and a look-up of three times each labelled id: many are not there."""
    path = shared_folder(spark)
    d = table(spark, sf, "documents")
    point = _text('{"type":"Point","coordinates":[', F.col("doc_id") % 90, ".5,1.5]}")
    store = d.select(_text("nws:", F.col("doc_id")).alias("ref"), point.alias("geometry"), F.length(point).cast("long").alias("size"), F.col("doc_id").alias("touch_seq"))
    geometry_index.write(store, path)
    return geometry_index.lookup_all(spark, path, table(spark, sf, "labels").select(_text("nws:", F.col("doc_id") * 3).alias("ref")))


# Views

_PARAMETERS_SQL = """'{"awareness_level":["' || level || '"]}'"""
_ATTRIBUTE_SQL = """'{"id":"' || id || '","event":"' || event || '","msg_type":"' || msg_type || '","severity":"' || severity || '","expires":"' || expires || '","headline":"' || headline || '","description":"' || description || '","area_desc":"' || area_desc || '"'
    || CASE WHEN phen = '' THEN '' ELSE ',"vtec_phenomena":"' || phen || '"' END || CASE WHEN sig = '' THEN '' ELSE ',"vtec_significance":"' || sig || '"' END || ',"parameters":' || """ + _PARAMETERS_SQL + """ || ',"provider":"' || provider || '","severity_normalized":"' || severity_normalized || '","phase":"' || phase || '","icon":"' || icon || '","phase_changed":false,"incident_platform_version":"1.0"}'"""


@query(f"""WITH {SNAPSHOT_SQL}, i AS (SELECT *, {snapshots.icon_sql("provider", "event")} AS icon, 'e1_' || provider || '_' || id AS unique_id FROM s)
    SELECT event_id, unique_id, 'alert_' || trim(regexp_replace(lower(event), '[^a-z0-9]+', '_', 'g'), '_') || '_' || substr(sha1(unique_id), 1, 8) AS object_id, severity_normalized AS state, event AS name, icon, {_ATTRIBUTE_SQL} AS attributes FROM i""")
def entity_views(spark, sf):
    rows = normalised(spark, sf)
    # The event's number rides along in entry_id, which names each entity.
    found = serve.entities(rows.withColumn("entry_id", F.concat(F.lit("e1#"), F.col("event_id").cast("string"))))
    plain = F.regexp_replace("unique_id", "#[0-9]+", "")
    return found.select(F.regexp_extract("unique_id", "#([0-9]+)", 1).cast("long").alias("event_id"), plain.alias("unique_id"), ident.object_id(F.col("name"), plain).alias("object_id"), "state", "name", "icon", "attributes")


@query("""SELECT c_custkey AS entry_id, 'Alerts ' || CASE c_custkey % 3 WHEN 0 THEN 'NWS (' || CASE WHEN c_custkey % 2 = 0 THEN 'TXC' || c_custkey ELSE 'Unknown' END WHEN 1 THEN 'ECCC (ON' ELSE 'METEOALARM (Republic of North Macedonia — 2 regions' END || ')' AS title,
    'Stormglass' AS manufacturer, CASE c_custkey % 3 WHEN 0 THEN 'NWS' WHEN 1 THEN 'ECCC' ELSE 'METEOALARM' END AS model FROM customer""")
def device_info(spark, sf):
    none = lambda kind: F.lit(None).cast(kind)
    third = lambda n, x: F.when(F.col("c_custkey") % 3 == n, x)
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("entry_id"),
        F.get(F.array(*map(F.lit, snapshots.PROVIDERS)), (F.col("c_custkey") % 3).cast("int")).alias("provider"),
        third(0, F.when(F.col("c_custkey") % 2 == 0, _text("TXC", F.col("c_custkey")))).alias("zone_id"),
        none("string").alias("gps_loc"),
        none("string").alias("tracker_entity"),
        third(1, F.lit("ON")).alias("province"),
        third(2, F.array(F.lit("MK001"), F.lit("MK002"))).alias("regions"),
        none("map<string,string>").alias("region_labels"),
        third(2, F.lit("MK")).alias("country"),
    )
    return serve.devices(c)


@query(f"WITH {EVENTS_SQL} SELECT poll_seq, incident_id, event_type, CASE WHEN CAST(incident_id AS BIGINT) % 3 <> 0 THEN 'sensor.alert_' || incident_id END AS entity_id FROM e")
def event_entity_ids(spark, sf):
    registry = table(spark, sf, "events").select(F.lit("e1").alias("entry_id"), F.col("user_id").cast("string").alias("incident_id")).distinct().filter("cast(incident_id as long) % 3 <> 0")
    found = lifecycle.with_entity_ids(lifecycle.events(normalised(spark, sf), polls(spark, sf)), registry.withColumn("entity_id", F.concat(F.lit("sensor.alert_"), "incident_id")))
    return found.select("poll_seq", "incident_id", "event_type", "entity_id")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS label FROM nation WHERE n_nationkey % 3 > 0 AND n_nationkey IN (SELECT c_nationkey FROM customer)")
def selection_carried(spark, sf):
    """The nations of all customers are selected; a third of them has codes that are no longer offered."""
    offered = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("label"))
    code = F.col("c_nationkey").cast("string")
    chosen = table(spark, sf, "customer").select(F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("old "), code)).otherwise(code).alias("code"))
    return serve.carry_selection(offered, chosen)


# Settings


def _entries(spark, sf):
    n = F.col("c_custkey")
    of = lambda m, r, x: F.when(n % m == r, x)
    columns = {
        "provider": F.get(F.array(*map(F.lit, snapshots.PROVIDERS)), (n % 3).cast("int")),
        "zone_id": of(5, 1, F.when(n % 2 == 0, _text(" txz", F.lpad((n % 1000).cast("string"), 3, "0"), " ")).otherwise("no zone")),
        "gps_loc": of(5, 2, F.when(n % 2 == 0, _text("45.123456,-", n % 90, ".5")).otherwise("91,0")),
        "tracker_entity": of(5, 3, _text("person.p", n % 100)),
        "province": of(5, 4, F.when(n % 2 == 0, "on").otherwise("xx")),
        "country": of(3, 2, F.when(n % 2 == 0, "de").otherwise("zz")),
        "regions": F.lit(None).cast("array<string>"),
        "region_labels": F.lit(None).cast("map<string,string>"),
        "scan_interval": of(4, 1, F.when(n % 8 == 1, 59).otherwise(3600)),
        "timeout": of(4, 2, F.when(n % 8 == 2, 121).otherwise(5)),
        "language": of(2, 1, F.lit("auto")),
    }
    return table(spark, sf, "customer").select(n.cast("string").alias("entry_id"), *(c.alias(k) for k, c in columns.items()))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS entry_id, CASE c_custkey % 5 WHEN 2 THEN CASE WHEN c_custkey % 2 = 0 THEN '45.123456,-' || c_custkey % 90 || '.5' ELSE '91,0' END WHEN 3 THEN CASE WHEN c_custkey % 4 = 0 THEN '' ELSE (c_custkey % 4) || '.5,' || (c_custkey % 100) || '.25' END END AS gps_loc,
    CASE WHEN c_custkey % 3 = 2 THEN 'fr' ELSE 'fr-CA' END AS language, CAST(CASE c_custkey % 8 WHEN 1 THEN 59 WHEN 5 THEN 3600 ELSE 300 END AS INTEGER) AS scan_interval, CAST(CASE c_custkey % 8 WHEN 2 THEN 121 WHEN 6 THEN 5 ELSE 30 END AS INTEGER) AS timeout FROM customer""")
def settings_resolved(spark, sf):
    """Trackers' positions, of which some are missing, and concrete languages."""
    entries = _entries(spark, sf)
    at = F.regexp_extract("tracker_entity", "p([0-9]+)", 1).cast("int")
    trackers = entries.filter("tracker_entity is not null").select("tracker_entity").distinct()
    trackers = trackers.select("tracker_entity", F.when(at % 4 != 0, at % 4 + 0.5).alias("latitude"), (at + 0.25).alias("longitude"))
    return settings.resolve(entries, trackers, "fr-FR").select("entry_id", "gps_loc", "language", "scan_interval", "timeout")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS entry_id, concat_ws(',', CASE WHEN c_custkey % 10 = 1 THEN 'invalid_zone' END, CASE WHEN c_custkey % 10 = 7 THEN 'invalid_gps' END, CASE WHEN c_custkey % 10 = 9 THEN 'invalid_province' END,
    CASE WHEN c_custkey % 6 = 5 THEN 'invalid_country' END, CASE WHEN c_custkey % 8 IN (1, 2) THEN 'invalid_options' END) AS errors FROM customer""")
def settings_faults(spark, sf):
    return settings.faults(_entries(spark, sf)).select("entry_id", F.array_join("errors", ",").alias("errors"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'zone=TXZ' || user_id WHEN 1 THEN 'point=45.1235,-' || user_id % 90 || '.5' ELSE '' END AS query FROM events""")
def request_queries(spark, sf):
    n, user = F.col("event_id"), F.col("user_id")
    zone = F.when(n % 4 == 0, _text("TXZ", user)).when(n % 4 == 1, "")
    point = F.when(n % 4 == 1, _text("45.123456, -", user % 90, ".5")).when(n % 4 == 2, "45.1")
    return _events(spark, sf).select("event_id", settings.request_query(zone, point).alias("query"))


@query("""SELECT event_id, CASE event_id % 11 WHEN 7 THEN NULL WHEN 3 THEN date_trunc('day', ts) WHEN 4 THEN date_trunc('minute', ts) WHEN 5 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 6 THEN date_trunc('week', ts)
    WHEN 8 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 9 THEN date_trunc('second', ts) + INTERVAL 7230 SECOND ELSE date_trunc('second', ts) END AS at FROM events""")
def iso_instants(spark, sf):
    """Extended, basic, with a comma, a day, a minute, an offset, a week, no instant at all, an offset of hours, one with seconds, another separator."""
    of = lambda form: F.date_format("ts", form)
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), F.col("ts")).cast("string"), F.lit("-W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    forms = (of("yyyy-MM-dd'T'HH:mm:ss'Z'"), of("yyyyMMdd'T'HHmmss'Z'"), of("yyyy-MM-dd HH:mm:ss',000'"), of("yyyy-MM-dd"), of("yyyy-MM-dd'T'HH:mm"), of("yyyy-MM-dd'T'HH:mm:ss'+0200'"), week, of("yyyy-MM-dd'T'HH'h'"))
    forms += (of("yyyy-MM-dd'T'HH:mm:ss'+02'"), of("yyyy-MM-dd'T'HH:mm:ss'-02:00:30'"), of("yyyy-MM-dd'_'HH:mm:ss"))
    text = F.get(F.array(*forms), (F.col("event_id") % 11).cast("int"))
    return _events(spark, sf).select("event_id", clock.instant(text).alias("at"))
