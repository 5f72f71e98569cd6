"""Queries of the scalars, the lifecycle and the views; those of whole feed documents are in ``feed_queries``."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import checks, classify, clock, dims, geo, ident, text
from ..operators import geometry, lifecycle, locate, overlap, quadtree, serve
from ..operators.needles import first_needles
from ..storage import move, shared_folder
from ..streaming import lifecycle as stream
from . import feed_queries, snapshots, stream_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from .snapshots import EVENTS_SQL, SNAPSHOT_SQL, normalised, polls, raw, table

# Normalisation


@query(f"WITH {SNAPSHOT_SQL} SELECT provider, severity_normalized, phase, count(*) AS n FROM s GROUP BY ALL")
def alert_severity_rollup(spark, sf):
    return normalised(spark, sf).groupBy("provider", "severity_normalized", "phase").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SNAPSHOT_SQL} SELECT event_id, provider, severity_normalized FROM s")
def severity_dispatch(spark, sf):
    return normalised(spark, sf).select("event_id", "provider", "severity_normalized")


@query(f"WITH {SNAPSHOT_SQL} SELECT event_id, {snapshots.COLOUR_SQL} AS colour_severity FROM s")
def awareness_color(spark, sf):
    return raw(spark, sf).select("event_id", classify.colour_severity(F.col("parameters")["awareness_level"][0]).alias("colour_severity"))


@query(f"WITH {SNAPSHOT_SQL} SELECT event_id, expires, phase FROM s")
def phase_compute(spark, sf):
    return normalised(spark, sf).select("event_id", "expires", "phase")


@query(f"WITH {SNAPSHOT_SQL} SELECT event_id, CASE WHEN k <= 24 THEN 'expired' ELSE 'cancel' END AS last_phase FROM s")
def terminal_inference(spark, sf):
    return raw(spark, sf).select("event_id", classify.last_phase(clock.instant(F.col("expires")), F.col("poll_ts")).alias("last_phase"))


@query(f"""WITH x AS (SELECT doc_id, {snapshots._pick_sql(snapshots.PROVIDERS, "doc_id % 3")} AS provider, text || CASE doc_id % 6 WHEN 0 THEN ' Tornado Warning' WHEN 1 THEN ' snow/ice' WHEN 2 THEN ' COASTAL-event' WHEN 3 THEN ' Frost' ELSE '' END AS event FROM documents),
    y AS (SELECT doc_id, provider, CASE WHEN doc_id % 5 = 0 THEN 'Heat Advisory' ELSE event END AS event FROM x)
    SELECT doc_id, {snapshots.icon_sql("provider", "event")} AS icon FROM y""")
def icon_dispatch(spark, sf):
    d = table(spark, sf, "documents")
    tail = F.element_at(F.array(*map(F.lit, (" Tornado Warning", " snow/ice", " COASTAL-event", " Frost", "", ""))), (F.col("doc_id") % 6 + 1).cast("int"))
    event = F.when(F.col("doc_id") % 5 == 0, "Heat Advisory").otherwise(F.concat("text", tail))
    provider = F.get(F.array(*map(F.lit, snapshots.PROVIDERS)), (F.col("doc_id") % 3).cast("int"))
    return d.select("doc_id", classify.icon(provider, event).alias("icon"))


_NEEDLE_ROWS = ", ".join(f"({i}, '{n}', '{v}')" for i, (n, v) in enumerate(dims.NEEDLES))


@query(f"""WITH n(pos, needle, icon) AS (VALUES {_NEEDLE_ROWS})
    SELECT doc_id, coalesce(arg_min(icon, pos), '{dims.DEFAULT_ICON}') AS icon FROM documents LEFT JOIN n ON contains(lower(text), needle) GROUP BY doc_id""")
def icon_theta_join(spark, sf):
    # The needles are few and constant, so the join is a chain of conditions in one projection, without a shuffle.
    return table(spark, sf, "documents").select("doc_id", F.coalesce(classify.first_needle(F.lower("text"), dims.NEEDLES), F.lit(dims.DEFAULT_ICON)).alias("icon"))


@query("""WITH c AS (SELECT doc_id, text, CASE WHEN strlen(text) <= 4096 THEN NULL ELSE (SELECT max(n) FROM generate_series(1023, 4093) AS g(n) WHERE n <= length(text) AND strlen(left(text, n)) <= 4093) END AS cut FROM documents)
    SELECT doc_id, strlen(t) AS n_bytes, sha256(t) AS digest FROM (SELECT doc_id, CASE WHEN cut IS NULL THEN text ELSE left(text, cut) || '…' END AS t FROM c)""")
def soft_cap_bytes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", text.byte_cap(F.col("text")).alias("t"))
    return d.select("doc_id", F.octet_length("t").cast("long").alias("n_bytes"), F.sha2("t", 256).alias("digest"))


@query("SELECT doc_id, CASE WHEN length(text) > 255 THEN left(text, 254) || '…' ELSE text END AS state FROM documents")
def state_truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.character_cap(F.col("text")).alias("state"))


# Identities

_VTEC_SQL = """v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN 'x/O.NEW.KABC' ELSE '/O.NEW.K' || CASE o_orderstatus WHEN 'F' THEN 'FFF' WHEN 'O' THEN 'OOO' ELSE 'PPP' END
    || '.TO.' || substr('WAYS', CAST(o_orderkey % 4 AS INTEGER) + 1, 1) || '.' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || '.' || strftime(o_orderdate, '%y%m%dT0000Z') || '-000000T0000Z/ and more' END AS vtec FROM orders)"""
_VTEC_RE = dims.VTEC


def _vtec_rows(spark, sf):
    o = table(spark, sf, "orders")
    office = F.when(F.col("o_orderstatus") == "F", "FFF").when(F.col("o_orderstatus") == "O", "OOO").otherwise("PPP")
    sign = F.substring(F.lit("WAYS"), (F.col("o_orderkey") % 4 + 1).cast("int"), F.lit(1))
    number = F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0")
    full = F.concat(F.lit("/O.NEW.K"), office, F.lit(".TO."), sign, F.lit("."), number, F.lit("."), F.date_format("o_orderdate", "yyMMdd'T0000Z'"), F.lit("-000000T0000Z/ and more"))
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "").when(F.col("o_orderkey") % 11 == 0, "x/O.NEW.KABC").otherwise(full).alias("vtec"))


@query(f"WITH {_VTEC_SQL} SELECT o_orderkey, " + ", ".join(f"regexp_extract(vtec, '{_VTEC_RE}', {i}) AS {f}" for i, f in enumerate(dims.VTEC_FIELDS, 1)) + " FROM v")
def vtec_parse(spark, sf):
    return _vtec_rows(spark, sf).select("o_orderkey", *(text.vtec_field(F.col("vtec"), f).alias(f) for f in dims.VTEC_FIELDS))


_X = [f"regexp_extract(vtec, '{_VTEC_RE}', {i})" for i in range(7)]


@query(f"WITH {_VTEC_SQL} SELECT o_orderkey, substr(sha256(CASE WHEN {_X[6]} <> '' THEN {_X[2]} || '.' || {_X[3]} || '.' || {_X[4]} || '.' || {_X[5]} || '.20' || {_X[6]} ELSE 'urn:' || o_orderkey END), 1, 12) AS id FROM v")
def vtec_identity(spark, sf):
    return _vtec_rows(spark, sf).select("o_orderkey", ident.vtec_id(F.col("vtec"), F.concat(F.lit("urn:"), "o_orderkey")).alias("id"))


@query("SELECT event_id, substr(sha256(event_type || strftime(ts, '%Y-%m-%d') || CAST(user_id AS VARCHAR)), 1, 12) AS id FROM events")
def composite_identity(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", ident.area_id(F.col("event_type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("user_id").cast("string")).alias("id"))


@query("SELECT doc_id, substr(sha256(CASE WHEN doc_id % 3 = 0 THEN 'doc-' || doc_id ELSE source END), 1, 12) AS id FROM documents")
def identifier_fallback_identity(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", ident.message_id(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("id"))


@query("""SELECT p_partkey, 'e1_nws_' || p_partkey AS unique_id, 'alert_' || trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') || '_' || substr(sha1('e1_nws_' || p_partkey), 1, 8) AS object_id FROM part""")
def object_id_slug(spark, sf):
    p = table(spark, sf, "part")
    unique = ident.unique_id(F.lit("e1"), F.lit("nws"), F.col("p_partkey").cast("string"))
    return p.select("p_partkey", unique.alias("unique_id"), ident.object_id(F.concat("p_name", F.lit(" / "), "p_brand"), unique).alias("object_id"))


# Parts of documents


@query("SELECT page_id, CASE WHEN split_part(url, '/', -1) = '' THEN '' ELSE upper(split_part(url, '/', -1)) || ',' END || 'ABC001' AS codes FROM pages")
def zone_codes(spark, sf):
    uris = F.array(F.col("url"), F.lit("https://x/zones/"), F.lit("https://x/zones/abC001"))
    return table(spark, sf, "pages").select("page_id", F.array_join(text.zone_codes(uris), ",").alias("codes"))


@query("SELECT event_id, event_type AS event, CAST(user_id AS VARCHAR) || '=x' AS code, '' AS missing FROM events")
def category_kv(spark, sf):
    e = table(spark, sf, "events")
    terms = F.array(F.lit("event=old"), F.lit("no pair"), F.concat(F.lit(" event = "), "event_type", F.lit(" ")), F.concat(F.lit("code="), F.col("user_id").cast("string"), F.lit("=x")))
    return e.select("event_id", *(text.category_value(terms, k).alias(k) for k in ("event", "code", "missing")))


@query("""SELECT conv_id, role, string_agg(v, '; ' ORDER BY turn) AS value FROM (SELECT conv_id, role, turn, text AS v FROM conversations WHERE length(text) > 0) GROUP BY conv_id, role""")
def parameter_flatten(spark, sf):
    c = table(spark, sf, "conversations").filter(F.length("text") > 0)
    entry = F.struct(F.col("role").alias("valueName"), F.col("text").alias("value"))
    lists = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", entry.alias("p")))), lambda x: x["p"]).alias("parameters"))
    flat = lists.select("conv_id", F.explode(text.flatten_parameters(F.col("parameters"))).alias("role", "values"))
    return flat.select("conv_id", "role", F.col("values")[0].alias("value"))


@query("""WITH f AS (SELECT conv_id, text AS w, min(turn) AS t FROM conversations GROUP BY ALL)
    SELECT conv_id, coalesce(string_agg(w, ', ' ORDER BY t) FILTER (w <> ''), '') AS area_desc FROM f GROUP BY conv_id""")
def area_join_distinct(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("w"))
    area = F.struct(F.col("w").alias("areaDesc"))
    lists = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", area.alias("a")))), lambda x: x["a"]).alias("areas"))
    return lists.select("conv_id", text.join_areas(F.col("areas")).alias("area_desc"))


# Geometry: an embedding's 64 numbers are a ring of 32 points (lon, lat)


def _rings(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.array(F.get("v", 2 * i), F.get("v", 2 * i + 1))).alias("ring"), "v")


_RING_SQL = "p AS (SELECT vec_id, i, CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y FROM embeddings, generate_series(0, 31) AS g(i))"
_INSIDE_SQL = """edges AS (SELECT a.vec_id, a.x AS xi, a.y AS yi, b.x AS xj, b.y AS yj FROM p a JOIN p b ON a.vec_id = b.vec_id AND b.i = (a.i + 31) % 32),
    inside AS (SELECT vec_id, count(*) FILTER ((yi > {lat}) <> (yj > {lat}) AND {lon} < (xj - xi) * ({lat} - yi) / CASE WHEN yj = yi THEN NULL ELSE yj - yi END + xi) % 2 = 1 AS inside FROM edges GROUP BY vec_id)"""


@query("""SELECT vec_id, CAST(i AS INTEGER) AS i, CAST(printf('%.6f', embedding[2 * i + 1]) AS DOUBLE) AS lon, CAST(printf('%.6f', embedding[2 * i + 2]) AS DOUBLE) AS lat,
    CASE WHEN vec_id % 5 > 0 THEN CAST(printf('%.6f', embedding[2 * i + 1]) AS DOUBLE) END AS pair_lon, CASE WHEN vec_id % 5 > 0 THEN CAST(printf('%.6f', embedding[2 * i + 2]) AS DOUBLE) END AS pair_lat
    FROM embeddings, generate_series(0, 31) AS g(i)""")
def polygon_parse(spark, sf):
    """Each point of a ring as parsed from spaced numbers and from pairs, some of which have another separator."""
    fixed = lambda x: F.format_number(x, 6)
    r = _rings(spark, sf)
    spaced = F.array_join(F.transform("ring", lambda p: F.concat(fixed(p[1]), F.lit(" "), fixed(p[0]))), "  ")
    pairs = F.array_join(F.transform("ring", lambda p: F.concat(fixed(p[1]), F.when(F.col("vec_id") % 5 == 0, ";").otherwise(","), fixed(p[0]))), " ")
    parsed = r.select("vec_id", geo.spaced_ring(spaced).alias("spaced"), geo.pair_ring(pairs).alias("pairs")).select("vec_id", "pairs", F.posexplode("spaced").alias("i", "p"))
    pair = F.get("pairs", F.col("i"))
    return parsed.select("vec_id", "i", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"), F.get(pair, F.lit(0)).alias("pair_lon"), F.get(pair, F.lit(1)).alias("pair_lat"))


@query(f"WITH {_RING_SQL}, {_INSIDE_SQL.format(lat='0.01', lon='0.02')} SELECT vec_id, inside FROM inside")
def point_in_polygon(spark, sf):
    return _rings(spark, sf).select("vec_id", geo.in_ring(F.lit(0.01), F.lit(0.02), F.col("ring")).alias("inside"))


@query(f"WITH {_RING_SQL} SELECT vec_id, min(x) AS min_lon, min(y) AS min_lat, max(x) AS max_lon, max(y) AS max_lat FROM p GROUP BY vec_id")
def bbox_polygon(spark, sf):
    b = _rings(spark, sf).select("vec_id", geo.box(geo.geometry_of(F.array("ring"))).alias("b"))
    return b.select("vec_id", *(F.col("b")[i].alias(n) for i, n in enumerate(("min_lon", "min_lat", "max_lon", "max_lat"))))


@query(f"WITH {_RING_SQL}, q(point_id, lat, lon) AS (VALUES (1, 0.01, 0.02), (2, -0.05, 0.0), (3, 0.2, 0.2)), edges AS (SELECT a.vec_id, a.x AS xi, a.y AS yi, b.x AS xj, b.y AS yj FROM p a JOIN p b ON a.vec_id = b.vec_id AND b.i = (a.i + 31) % 32) SELECT CAST(point_id AS BIGINT) AS point_id, vec_id AS shape_id FROM edges, q GROUP BY point_id, vec_id HAVING count(*) FILTER ((yi > lat) <> (yj > lat) AND lon < (xj - xi) * (lat - yi) / CASE WHEN yj = yi THEN NULL ELSE yj - yi END + xi) % 2 = 1")
def bbox_prefilter_pip(spark, sf):
    points = spark.createDataFrame([(1, 0.01, 0.02), (2, -0.05, 0.0), (3, 0.2, 0.2)], "point_id long, lat double, lon double")
    shapes = _rings(spark, sf).select(F.col("vec_id").alias("shape_id"), geo.geometry_of(F.array("ring")).alias("geometry"))
    return quadtree.points_in_shapes(points, shapes)


_NEEDLES_SQL = """w AS (SELECT item_id, list_filter(regexp_split_to_array(text, ' '), lambda x: x <> '') AS ws FROM benchmark),
    x AS (SELECT item_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM w, generate_series(2, 3) AS g(k)),
    n AS (SELECT array_to_string(ws[i:i + k - 1], ' ') AS needle, min(item_id * 1000000 + i * 2 + k) AS place FROM x GROUP BY 1)"""


@query(f"WITH {_NEEDLES_SQL} SELECT conv_id || ':' || turn AS text_id, arg_min(needle, place) AS needle, min(place) AS place FROM conversations JOIN n ON contains(text, needle) GROUP BY 1")
def needle_index_join(spark, sf):
    """The first run of two or three words of the benchmark that each turn of a conversation contains."""
    w = table(spark, sf, "benchmark").select("item_id", F.filter(F.split("text", " "), lambda x: x != "").alias("ws"))
    runs = lambda k: F.transform(F.sequence(F.lit(1), F.size("ws") - k + 1), lambda i: F.struct(F.array_join(F.slice("ws", i, k), " ").alias("needle"), (i * 2 + k).cast("long").alias("at")))
    found = w.filter(F.size("ws") >= 3).select("item_id", F.explode(F.concat(runs(2), runs(3))).alias("x"))
    needles = found.select("x.needle", (F.col("item_id") * 1000000 + F.col("x.at")).alias("place"))
    turns = table(spark, sf, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("text_id"), "text")
    return first_needles(turns, needles)


#: Three events of ten are in one city; a shape's size goes by its id, and every fiftieth is there too.
_CITY = "CASE WHEN {k} % 10 < 3 THEN 40.7 + ({k} % 97) / 10000.0 ELSE 25.0 + ({k} * 7919 % 25000) / 1000.0 END AS lat, CASE WHEN {k} % 10 < 3 THEN -74.0 + ({k} % 89) / 10000.0 ELSE -125.0 + ({k} * 10007 % 60000) / 1000.0 END AS lon"
_SIZE, _LAT, _LON = "0.1 * power(2, vec_id % 8)", "CASE WHEN vec_id % 50 = 0 THEN 40.7 ELSE 25.0 + (vec_id * 6971 % 25000) / 1000.0 END", "CASE WHEN vec_id % 50 = 0 THEN -74.0 ELSE -125.0 + (vec_id * 9973 % 60000) / 1000.0 END"


def _doubles(sql):
    """Literals with a point are decimals to Spark and DuckDB alike; here they are doubles."""
    return re.sub(r"(-?\b\d+\.\d+)", r"CAST(\1 AS DOUBLE)", sql)


@query(_doubles(f"""WITH q AS (SELECT event_id AS point_id, {_CITY.format(k="event_id")} FROM events),
    p AS (SELECT vec_id, i, {_LON} + {_SIZE} * CAST(embedding[2 * i + 1] AS DOUBLE) AS x, {_LAT} + {_SIZE} * CAST(embedding[2 * i + 2] AS DOUBLE) AS y FROM embeddings, generate_series(0, 7) AS g(i)),
    b AS (SELECT vec_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p GROUP BY vec_id),
    near AS (SELECT point_id, lat, lon, vec_id FROM q JOIN b ON lon >= x0 AND lon <= x1 AND lat >= y0 AND lat <= y1),
    edges AS (SELECT a.vec_id, a.x AS xi, a.y AS yi, b.x AS xj, b.y AS yj FROM p a JOIN p b ON a.vec_id = b.vec_id AND b.i = (a.i + 7) % 8)
    SELECT point_id, vec_id AS shape_id FROM near JOIN edges USING (vec_id) GROUP BY point_id, vec_id
    HAVING count(*) FILTER ((yi > lat) <> (yj > lat) AND lon < (xj - xi) * (lat - yi) / CASE WHEN yj = yi THEN NULL ELSE yj - yi END + xi) % 2 = 1"""))
def points_in_shapes_quadtree(spark, sf):
    """All events, as points of which three in ten are in one city, in shapes from small to large."""
    points = table(spark, sf, "events").select(F.col("event_id").alias("point_id"), *(F.expr(_doubles(x)) for x in _CITY.format(k="event_id").split(", ")))
    e = table(spark, sf, "embeddings").select("vec_id", *(F.expr(_doubles(x)).alias(n) for x, n in ((_SIZE, "size"), (_LAT, "lat"), (_LON, "lon"))), F.col("embedding").cast("array<double>").alias("v"))
    ring = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.array(F.col("lon") + F.col("size") * F.get("v", 2 * i), F.col("lat") + F.col("size") * F.get("v", 2 * i + 1)))
    return quadtree.points_in_shapes(points, e.select(F.col("vec_id").alias("shape_id"), geo.geometry_of(F.array(ring)).alias("geometry")))


@query("""WITH p AS (SELECT vec_id, r, i, CAST(embedding[16 * r + 2 * i + 1] AS DOUBLE) AS x, CAST(embedding[16 * r + 2 * i + 2] AS DOUBLE) AS y FROM embeddings, generate_series(0, 3) AS a(r), generate_series(0, 7) AS g(i)),
    edges AS (SELECT a.vec_id, a.r, a.x AS xi, a.y AS yi, b.x AS xj, b.y AS yj FROM p a JOIN p b ON a.vec_id = b.vec_id AND a.r = b.r AND b.i = (a.i + 7) % 8),
    rings AS (SELECT vec_id, r, count(*) FILTER ((yi > 0.01) <> (yj > 0.01) AND 0.02 < (xj - xi) * (0.01 - yi) / CASE WHEN yj = yi THEN NULL ELSE yj - yi END + xi) % 2 = 1 AS inside FROM edges GROUP BY vec_id, r)
    SELECT vec_id, bool_or(inside) AS inside FROM rings GROUP BY vec_id""")
def multi_ring_any(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rings = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.array(F.get("v", 16 * r + 2 * i), F.get("v", 16 * r + 2 * i + 1))))
    return e.select("vec_id", geo.in_geometry(F.lit(0.01), F.lit(0.02), geo.geometry_of(rings)).alias("inside"))


@query("""WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(CAST(user_id AS DOUBLE) / 2 AS VARCHAR) || ', ' || CAST(event_id % 400 AS VARCHAR) WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN 'a,b' ELSE '-1.5,' || CAST(event_id % 170 AS VARCHAR) END AS gps FROM events),
    y AS (SELECT *, try_cast(trim(split_part(gps, ',', 1)) AS DOUBLE) AS lat, try_cast(trim(split_part(gps, ',', 2)) AS DOUBLE) AS lon, regexp_full_match(gps, '-?\\d+\\.?\\d*\\s*,\\s*-?\\d+\\.?\\d*') AS form FROM x)
    SELECT event_id, CASE WHEN form AND abs(lat) <= 90 AND abs(lon) <= 180 THEN NULL ELSE 'invalid_gps' END AS error, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN lat END AS lat, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN lon END AS lon FROM y""")
def gps_parse_validate(spark, sf):
    e = table(spark, sf, "events")
    n = lambda m: (F.col("event_id") % m).cast("string")
    kind = F.col("event_id") % 4
    value = F.when(kind == 0, F.concat((F.col("user_id") / 2).cast("string"), F.lit(", "), n(400))).when(kind == 1, F.col("user_id").cast("string")).when(kind == 2, "a,b").otherwise(F.concat(F.lit("-1.5,"), n(170)))
    return e.select("event_id", checks.check_gps(value)["error"].alias("error"), geo.gps(value)["lat"].alias("lat"), geo.gps(value)["lon"].alias("lon"))


@query("SELECT c_custkey, substr(c_mktsegment, 1, 2) = 'MA' OR contains(upper(n_name || ' ' || c_mktsegment), 'MA') AS matches FROM customer JOIN nation ON n_nationkey = c_nationkey")
def province_match(spark, sf):
    j = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select("c_custkey", checks.matches_province(F.concat("n_name", F.lit(" "), "c_mktsegment"), F.col("c_mktsegment"), F.lit("ma")).alias("matches"))


@query("SELECT o_orderkey, bool_or(l_suppkey % 10 IN (3, 7)) AS overlaps FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def region_overlap(spark, sf):
    """Each order, as an alert, and whether it has one of two codes; an empty code does not count."""
    codes = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set((F.col("l_suppkey") % 10).cast("string")).alias("geocode_same"))
    alerts = table(spark, sf, "orders").join(codes, F.col("o_orderkey") == F.col("l_orderkey"))
    return alerts.select("o_orderkey", locate.has_region(["3", "", "7"]).alias("overlaps"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey IN (1, 3))")
def region_semi_join(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.array(F.col("c_nationkey").cast("string")).alias("geocode_same"))
    wanted = table(spark, sf, "nation").filter("n_regionkey in (1, 3)").select(F.col("n_nationkey").cast("string").alias("code"))
    return locate.region_join(c, wanted).select(F.col("id").alias("c_custkey"))


_OVERLAP_SQL = """e AS (SELECT c_custkey, unnest(['c' || c_custkey % 1000, 'd' || c_custkey % 997, CASE WHEN c_custkey % 500 = 0 THEN 'all' END]) AS code FROM customer),
    a AS (SELECT o_orderkey, unnest(['c' || o_orderkey % 1000, 'd' || o_orderkey % 997, 'all', NULL]) AS code FROM orders)"""


def _overlaps(spark, sf):
    """Orders as alerts, customers as entries; all alerts have one code, which few entries want."""
    code = lambda letter, key, mod: F.concat(F.lit(letter), (F.col(key) % mod).cast("string"))
    everywhere = F.when(F.col("c_custkey") % 500 == 0, "all")
    entries = table(spark, sf, "customer").select(F.col("c_custkey").alias("entry_id"), F.array(code("c", "c_custkey", 1000), code("d", "c_custkey", 997), everywhere).alias("regions"))
    alerts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array(code("c", "o_orderkey", 1000), code("d", "o_orderkey", 997), F.lit("all"), F.lit(None).cast("string")).alias("geocode_same"))
    return entries, alerts


@query(f"WITH {_OVERLAP_SQL} SELECT DISTINCT c_custkey AS entry_id, o_orderkey AS id FROM e JOIN a USING (code)")
def overlap_pairs(spark, sf):
    return overlap.paired(*_overlaps(spark, sf))


@query(f"WITH {_OVERLAP_SQL} SELECT c_custkey AS entry_id, count(DISTINCT o_orderkey) AS n_alerts FROM e JOIN a USING (code) GROUP BY 1")
def overlap_counts(spark, sf):
    return overlap.counted(*_overlaps(spark, sf))


# Languages


@query("""WITH g AS (SELECT conv_id, count(*) AS n, arg_max(text, turn) FILTER (role = 'assistant') AS m, arg_max(text, turn) FILTER (role <> 'assistant') AS o, arg_max(role, turn) FILTER (role <> 'assistant') AS o_role,
        arg_min(text, turn) AS first, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id),
    h AS (SELECT conv_id, arg_min(text, turn) AS second, arg_min(role, turn) AS second_role FROM conversations c WHERE turn > (SELECT min(turn) FROM conversations x WHERE x.conv_id = c.conv_id) GROUP BY conv_id)
    SELECT conv_id, coalesce(m, first) AS headline, CASE WHEN m IS NOT NULL THEN coalesce(o, '') ELSE coalesce(second, '') END AS headline_alt, CASE WHEN m IS NOT NULL THEN coalesce(o_role, '') ELSE coalesce(second_role, '') END AS language_alt
    FROM g LEFT JOIN h USING (conv_id)""")
def language_merge(spark, sf):
    c = table(spark, sf, "conversations")
    empty = {k: F.lit("") for k in ("description", "headline_alt", "description_alt", "language_alt")} | {"instruction": F.lit(None).cast("string"), "instruction_alt": F.lit(None).cast("string")}
    rows = c.select(F.col("conv_id").alias("id"), F.col("turn").alias("ordinal"), F.col("role").alias("language"), F.col("text").alias("headline")).withColumns(empty)
    return locate.merge_languages(rows, "assistant").select(F.col("id").alias("conv_id"), "headline", "headline_alt", "language_alt")


@query("""WITH t AS (SELECT conv_id, list(struct_pack(r := lower(split_part(role, '-', 1)), x := text) ORDER BY turn) AS infos FROM conversations GROUP BY conv_id),
    i AS (SELECT *, coalesce(nullif(list_position(list_transform(infos, lambda b: b.r), 'assistant'), 0), 1) AS pos FROM t)
    SELECT conv_id, CAST(pos AS INTEGER) AS picked, infos[pos].x AS main, CASE WHEN pos = 1 THEN infos[2].x ELSE infos[1].x END AS other FROM i""")
def info_block_pick(spark, sf):
    from ..sources.feeds import pick_info

    c = table(spark, sf, "conversations")
    infos = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("language"), x["text"].alias("text"))).alias("infos"))
    main, other = pick_info(F.col("infos"), F.lit("assistant"))
    at = F.coalesce(F.nullif(F.array_position(F.col("infos.language"), "assistant"), F.lit(0)), F.lit(1)).cast("int")
    return infos.select("conv_id", at.alias("picked"), main["text"].alias("main"), other["text"].alias("other"))


@query("SELECT doc_id, lower(split_part(upper(lang) || '-CA-x', '-', 1)) AS prefix FROM documents")
def lang_prefix(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.language_prefix(F.concat(F.upper("lang"), F.lit("-CA-x"))).alias("prefix"))


# Lifecycle


@query(f"WITH {SNAPSHOT_SQL} SELECT poll_seq, id, ordinal, event, severity_normalized, phase, expires FROM d")
def snapshot_dedup_last(spark, sf):
    return lifecycle.last_of_each(normalised(spark, sf)).select("poll_seq", "id", "ordinal", "event", "severity_normalized", "phase", "expires")


def _events(spark, sf):
    return lifecycle.events(normalised(spark, sf), polls(spark, sf))


_EVENT_COLUMNS = ("poll_seq", "event_type", "event_seq", "incident_id", "event", "severity", "phase", "phase_changed", "changed_fields", "area_desc")
_LIFECYCLE_SQL = f"WITH {EVENTS_SQL} SELECT {', '.join(_EVENT_COLUMNS)} FROM e"


@query(_LIFECYCLE_SQL)
def lifecycle_events(spark, sf):
    return _events(spark, sf).withColumn("changed_fields", F.array_join("changed_fields", ",")).select(*_EVENT_COLUMNS)


@query(f"WITH {EVENTS_SQL} SELECT changed_fields, count(*) AS n FROM e WHERE event_type = 'incident_updated' GROUP BY 1")
def changed_fields(spark, sf):
    found = _events(spark, sf).filter(F.col("event_type") == lifecycle.UPDATED)
    return found.groupBy(F.array_join("changed_fields", ",").alias("changed_fields")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EVENTS_SQL} SELECT poll_seq, incident_id, phase FROM e WHERE nid IS NULL")
def silent_removals(spark, sf):
    rows = lifecycle.diff(normalised(spark, sf), polls(spark, sf)).filter("new is null")
    return rows.select("poll_seq", F.col("id").alias("incident_id"), classify.last_phase(clock.instant(F.col("old.expires")), F.col("poll_ts")).alias("phase"))


@query(f"WITH {EVENTS_SQL} SELECT poll_seq, incident_id, phase FROM e WHERE oid IS NULL AND event_type = 'incident_removed'")
def removed_first_sight(spark, sf):
    rows = lifecycle.diff(normalised(spark, sf), polls(spark, sf)).filter(F.col("old").isNull() & classify.is_terminal(F.col("new.phase")))
    return rows.select("poll_seq", F.col("id").alias("incident_id"), F.col("new.phase").alias("phase"))


@query(f"WITH {EVENTS_SQL} SELECT n.poll_seq, n.id, n.phase, coalesce(o.phase, '') AS previous_phase, coalesce(o.phase, '') <> n.phase AS phase_changed FROM d n LEFT JOIN d o ON o.id = n.id AND o.poll_seq = n.poll_seq - 1 AND o.phase NOT IN ('cancel', 'expired') WHERE n.phase NOT IN ('cancel', 'expired')")
def active_state(spark, sf):
    rows = normalised(spark, sf).select(*lifecycle.KEY, "ordinal", *lifecycle.CARRIED)
    return lifecycle.active(rows, polls(spark, sf)).select("poll_seq", "id", "phase", "previous_phase", "phase_changed")


_HYDRATED = 20


@query(f"""WITH {SNAPSHOT_SQL}, cur AS (SELECT poll_seq, id FROM d WHERE phase NOT IN ('cancel', 'expired')),
    tracked AS (SELECT poll_seq, id FROM cur UNION SELECT p, CAST(u AS VARCHAR) FROM generate_series(0, {_HYDRATED - 1}) AS a(u), (VALUES (-1), (0)) AS b(p)),
    a AS (SELECT c.poll_seq, c.id FROM cur c ANTI JOIN tracked t ON t.id = c.id AND t.poll_seq = c.poll_seq - 1),
    r AS (SELECT t.poll_seq + 1 AS poll_seq, t.id FROM tracked t ANTI JOIN tracked c ON c.id = t.id AND c.poll_seq = t.poll_seq + 1 WHERE t.poll_seq + 1 <= (SELECT max(poll_seq) FROM ev))
    SELECT poll_seq, id, 'add' AS action FROM a UNION ALL SELECT poll_seq, id, 'remove' FROM r""")
def entity_sync(spark, sf):
    current = lifecycle.active(normalised(spark, sf).select(*lifecycle.KEY, "ordinal", *lifecycle.CARRIED), polls(spark, sf))
    hydrated = spark.range(_HYDRATED).select(F.lit("e1").alias("entry_id"), F.col("id").cast("string").alias("id"))
    return serve.sync_history(current, polls(spark, sf), hydrated).select("poll_seq", "id", "action")


@query(f"WITH {SNAPSHOT_SQL} SELECT p.poll_seq, count(d.id) AS active_count FROM (SELECT unnest(range((SELECT max(poll_seq) + 1 FROM ev))) AS poll_seq) p LEFT JOIN d ON d.poll_seq = p.poll_seq AND d.phase NOT IN ('cancel', 'expired') GROUP BY 1")
def active_count_per_poll(spark, sf):
    return serve.counts(lifecycle.active(normalised(spark, sf).select(*lifecycle.KEY, "ordinal", *lifecycle.CARRIED), polls(spark, sf)), polls(spark, sf)).select("poll_seq", "active_count")


@query("SELECT user_id, max(ts) FILTER (event_type <> 'error') AS last_updated FROM events GROUP BY user_id")
def last_updated(spark, sf):
    e = table(spark, sf, "events")
    log = e.select(F.col("user_id").alias("entry_id"), F.col("ts").alias("poll_ts"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))
    return serve.last_updated(log).select(F.col("entry_id").alias("user_id"), "last_updated")


# Geometry store: documents as geometries


@query("""WITH r AS (SELECT source, doc_id, length(text) AS size, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id DESC) AS run FROM documents) SELECT source, doc_id, size FROM r WHERE run <= 50000""")
def geometry_lru(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", F.length("text").cast("long").alias("size"), F.col("doc_id").alias("touch_seq"), F.col("doc_id").cast("string").alias("ref"))
    return geometry.evict(d, 50_000, ("source",)).select("source", "doc_id", "size")


@query("SELECT doc_id, lang || ':' || doc_id AS ref FROM documents WHERE NOT (lang = 'en' AND doc_id % 3 <> 0)")
def geometry_purge(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat("lang", F.lit(":"), F.col("doc_id").cast("string")).alias("ref"))
    return geometry.purge(d, d.filter("doc_id % 3 = 0").select("ref"), "en:")


@query("""SELECT vec_id, 'FeatureCollection' AS type, 'nws:' || vec_id AS ref, CAST(1 AS INTEGER) AS n_features, 'Polygon' AS geometry_type FROM embeddings""")
def feature_collection(spark, sf):
    shapes = _rings(spark, sf).select("vec_id", F.concat(F.lit("nws:"), F.col("vec_id").cast("string")).alias("ref"), geo.geometry_of(F.array("ring")).alias("geometry"))
    body = F.col("body")
    found = geometry.collections(shapes).join(shapes.select("vec_id", "ref"), "ref")
    field = lambda path: F.get_json_object(body, path)
    return found.select("vec_id", field("$.type").alias("type"), field("$.features[0].properties.ref").alias("ref"), F.json_array_length(field("$.features")).alias("n_features"), field("$.features[0].geometry.type").alias("geometry_type"))


# Views


@query(f"WITH {SNAPSHOT_SQL} SELECT event_id, provider, phase, CASE WHEN sig = '' THEN 0 ELSE 1 END + CASE WHEN phen = '' THEN 0 ELSE 1 END + 15 AS n_attributes FROM s")
def sparse_attributes(spark, sf):
    rows = normalised(spark, sf).select("event_id", serve.attributes().alias("a"))
    return rows.select("event_id", F.json_tuple("a", "provider", "phase").alias("provider", "phase"), F.size(F.json_object_keys("a")).alias("n_attributes"))


@query("""SELECT c_custkey, 'Alerts NWS (' || CASE c_custkey % 7 WHEN 0 THEN 'TXC' || c_custkey WHEN 1 THEN c_acctbal || ',1' WHEN 2 THEN 'phone' || c_custkey WHEN 3 THEN 'ON' WHEN 4 THEN 'DE — ' || least('A' || c_custkey, n_name) || ' +1' WHEN 5 THEN 'Germany' ELSE 'Unknown' END || ')' AS title FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def title_derive(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    of = lambda n, x: F.when(F.col("c_custkey") % 7 == n, x)
    key = F.col("c_custkey").cast("string")
    labels = F.create_map(F.lit("a"), F.concat(F.lit("A"), key), F.lit("b"), F.col("n_name"))
    country = F.when((F.col("c_custkey") % 7).isin(4, 5), "DE")
    parts = (of(0, F.concat(F.lit("TXC"), key)), of(1, F.concat(F.col("c_acctbal").cast("string"), F.lit(",1"))), of(2, F.concat(F.lit("device_tracker.phone"), key)), of(3, F.lit("ON")), of(4, F.array(F.lit("a"), F.lit("b"))), of(4, labels), country)
    return c.select("c_custkey", checks.title(F.lit("nws"), *parts).alias("title"))


@query(f"WITH {EVENTS_SQL} SELECT poll_seq, incident_id, 'Incident removed: ' || event || ' (' || phase || ')' AS title, phase AS message_phase FROM e WHERE event_type = 'incident_removed'")
def archive_removed(spark, sf):
    return serve.archive(_events(spark, sf)).select("poll_seq", "incident_id", "title", F.get_json_object("message", "$.phase").alias("message_phase"))


@query("SELECT page_id, url FROM pages WHERE page_id % 10 < 6")
def paged_scan_cap(spark, sf):
    from ..sources.feeds import parse_geojson

    p = table(spark, sf, "pages").withColumn("page_no", (F.col("page_id") % 10).cast("int"))
    feature = F.struct(F.struct(F.col("url").alias("id"), F.col("page_id").cast("string").alias("event")).alias("properties"))
    pages = p.withColumn("body", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))))
    return parse_geojson(pages, page_no="page_no").select(F.col("event").cast("long").alias("page_id"), "url")


@query("SELECT provider, count(*) AS n, count(DISTINCT id) AS n_ids FROM (SELECT 'nws' AS provider, CAST(event_id AS VARCHAR) AS id FROM events UNION ALL SELECT 'eccc', url FROM pages UNION ALL SELECT 'meteoalarm', source FROM documents) GROUP BY provider")
def provider_union(spark, sf):
    from ..schema import as_alerts
    from ..sources.feeds import union_feeds

    of = lambda name, key, provider: as_alerts(table(spark, sf, name).select(F.col(key).cast("string").alias("id"), F.lit(provider).alias("provider")))
    rows = union_feeds(of("events", "event_id", "nws"), of("pages", "url", "eccc"), of("documents", "source", "meteoalarm"))
    return rows.groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"))


#: Polls of one micro-batch of ``streaming_lifecycle``.
_AT_ONCE = 10


@query(_LIFECYCLE_SQL)
def streaming_lifecycle(spark, sf):
    """The stream's events: daily polls replayed as files, ten polls a micro-batch."""
    folder = shared_folder(spark)
    rows = normalised(spark, sf).select("entry_id", "poll_seq", "poll_ts", "ordinal", "id", *lifecycle.CARRIED).withColumn("is_marker", F.lit(False))
    replay = rows.unionByName(polls(spark, sf).withColumn("is_marker", F.lit(True)), allowMissingColumns=True)
    # All polls are made in one pass. A poll may be many files, so polls bound a micro-batch and not files: those of ten polls come in one move.
    replay.filter("poll_seq >= 0").withColumn("part", F.floor(F.col("poll_seq") / _AT_ONCE)).write.partitionBy("part").parquet(f"{folder}/polls")
    for part in range(-(-polls(spark, sf).count() // _AT_ONCE)):
        move(spark, f"{folder}/polls/part={part}", f"{folder}/in/{part}")
        source = spark.readStream.schema(replay.schema).parquet(f"{folder}/in/*")
        stream.drain(stream.events(source), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").select(*_EVENT_COLUMNS)
