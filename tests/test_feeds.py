"""Feed documents of each provider, broken ones included."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from stormglass import schema
from stormglass.sources import feeds


def digest(key: str) -> str:
    return hashlib.sha256(key.encode()).hexdigest()[:12]


def bodies(spark, *docs):
    return spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "page_no int, body string")


def feature(**properties):
    return {"geometry": {"type": "Point", "coordinates": [-80.5, 40.0]}, "properties": properties}


def collection(*features):
    return {"type": "FeatureCollection", "features": list(features)}


VTEC = "/O.NEW.KILN.SV.W.0001.250412T1430Z-250412T1530Z/"


def test_geojson_rows(spark):
    page = collection(
        feature(id="u1", event="Severe Thunderstorm Warning", messageType="Alert", headline=None, affectedZones=["https://x/zones/ohz001", "https://x/zones/"],
                eventCode={"NationalWeatherService": ["SVW"], "SAME": []}, parameters={"VTEC": [VTEC, "other"], "NWSheadline": ["Storm near"]}, references=["a", "b"]),
        feature(id="u1b", parameters={"VTEC": [VTEC.replace("NEW", "CON")]}),
        feature(id="u2", parameters={"VTEC": [VTEC.replace("250412T1430Z", "000000T0000Z")]}),
        feature(id="u3", parameters={"VTEC": ["no VTEC"]}),
        feature(**{"@id": "u4"}, headline="Own", parameters={"NWSheadline": ["Not this"]}),
        {"geometry": None, "properties": {"id": "u5", "ends": None}},
    )
    rows = feeds.parse_geojson(bodies(spark, page)).orderBy("ordinal").collect()
    assert [r["id"] for r in rows] == [digest("KILN.SV.W.0001.2025"), digest("KILN.SV.W.0001.2025"), digest("KILN.SV.W.0001.2000"), digest("u3"), digest("u4"), digest("u5")]
    first = rows[0]
    assert first["headline"] == "Storm near" and rows[4]["headline"] == "Own" and rows[3]["headline"] == ""
    assert first["affected_zones"] == ["OHZ001"] and len(first["affected_zone_uris"]) == 2
    assert (first["event_code_nws"], first["event_code_same"]) == ("SVW", "")
    assert (first["vtec_action"], first["vtec_office"], first["vtec_phenomena"], first["vtec_significance"], first["vtec_tracking"]) == ("NEW", "KILN", "SV", "W", "0001")
    assert rows[3]["vtec_office"] == "" and rows[3]["vtec"] == ["no VTEC"]
    assert json.loads(first["geometry"])["type"] == "Point" and rows[5]["geometry"] is None
    assert first["references"] == ["a", "b"] and first["provider"] == "nws" and rows[5]["ends"] is None
    assert [c for c in feeds.parse_geojson(bodies(spark, page)).columns if c != "ordinal"] == list(schema.FIELDS) and len(schema.FIELDS) == 56


def test_geojson_pages(spark):
    pages = bodies(spark, *(collection(feature(id=f"p{i}")) for i in range(8)))
    assert feeds.parse_geojson(pages, page_no="page_no").count() == 6
    problem = bodies(spark, {"type": "about:blank", "detail": "no such zone"})
    with pytest.raises(Exception, match="no such zone"):
        feeds.parse_geojson(problem).collect()
    assert feeds.parse_geojson(problem, strict=False).count() == 0
    assert feeds.parse_geojson(bodies(spark, "not json"), strict=False).count() == 0
    assert feeds.parse_geojson(bodies(spark, collection())).count() == 0


def entry(polygon=None, summary="", **terms):
    lines = "".join(f'<category term="{k}={v}"/>' for k, v in terms.items())
    ring = f"<georss:polygon>{polygon}</georss:polygon>" if polygon else ""
    return f'<entry><id>e</id><updated>2025-04-12T10:00:00Z</updated><link href="https://x/a"/><summary>{summary}</summary>{lines}{ring}</entry>'


def atom(*entries):
    return '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:georss="http://www.georss.org/georss">' + "".join(entries) + "</feed>"


def test_atom_rows(spark):
    doc = atom(
        entry("45.0 -80.0 46.0 -80.0 46.0 -79.0", status="Actual", event="wind", geocode="ON123", urgency="Past", language="en-CA", areaDesc="London"),
        entry(status="Actual", event="vent", geocode="ON123", urgency="Past", language="fr-CA", summary="Area: Toronto "),
        entry(status="Test", event="x", geocode="QC1"),
        entry("45.0 -80.0 46.0 -80.0 46.0", status="Actual", geocode="QC2"),
        entry("45.0 -80.0 46.0 b 46.0 -79.0", status="Actual", geocode="QC3"),
        '<entry><category term="status=Test"/><category term="no pair"/><category term=" status = Actual "/><category term="event=a=b"/></entry>',
    )
    rows = feeds.parse_atom(bodies(spark, doc)).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in rows] == [0, 1, 3, 4, 5]
    assert rows[0]["id"] == rows[1]["id"] == digest("ON1232025-04-12Past")
    assert json.loads(rows[0]["geometry"]) == {"type": "Polygon", "coordinates": [[[-80.0, 45.0], [-80.0, 46.0], [-79.0, 46.0]]]}
    assert rows[2]["geometry"] is None and rows[3]["geometry"] is None
    assert (rows[0]["area_desc"], rows[1]["area_desc"]) == ("London", "Toronto")
    assert rows[4]["event"] == "a=b" and rows[0]["web"] == "https://x/a"
    with pytest.raises(Exception):
        feeds.parse_atom(bodies(spark, "<feed><entry></feed>")).collect()


def info(language, event, **more):
    return {"language": language, "event": event, "area": [{"areaDesc": "A", "geocode": [{"valueName": "EMMA_ID", "value": "DE100"}, {"valueName": "other", "value": "x"}]}]} | more


def warning(n, *infos, **alert):
    return {"uuid": f"uuid-{n}", "alert": {"identifier": f"id-{n}", "status": "Actual", "info": list(infos)} | alert}


def test_warning_rows(spark):
    doc = {"warnings": [
        warning(0, info("de-DE", "STURM", category=["Met", "Geo"], responseType="Shelter"), info("en", "gale", instruction="Stay in")),
        warning(1, info("de", "x"), status="Test"),
        warning(2, info("it-IT", "vento"), info("fr", "vent"), status=""),
        warning(3),
        warning(4, info("EN-gb", "wind", parameter=[{"valueName": "p", "value": ""}, {"valueName": "p", "value": "b"}, {"valueName": "p", "value": "c"}, {"valueName": "", "value": "z"}, {"valueName": "q", "value": "1"}]), identifier=""),
        None,
    ]}
    rows = {r["ordinal"]: r for r in feeds.parse_warnings(bodies(spark, doc), preferred=F.lit("de")).collect()}
    assert sorted(rows) == [0, 2, 4]
    assert rows[0]["id"] == digest("id-0") and rows[4]["id"] == digest("uuid-4")
    assert (rows[0]["event"], rows[0]["language_alt"], rows[0]["instruction_alt"], rows[0]["instruction"]) == ("STURM", "en", "Stay in", None)
    assert (rows[0]["category"], rows[0]["response_type"], rows[0]["geocode_same"]) == ("Met", "Shelter", ["DE100"])
    assert (rows[2]["event"], rows[2]["language_alt"]) == ("vento", "fr")
    assert rows[4]["parameters"] == {"p": ["b; c"], "q": ["1"]} and rows[0]["parameters"] is None
    english = {r["ordinal"]: r["event"] for r in feeds.parse_warnings(bodies(spark, doc), preferred=F.lit("fr")).collect()}
    assert english == {0: "gale", 2: "vent", 4: "wind"}


def test_warning_shapes(spark):
    ring = "49.0,9.0 51.0,9.0 50.0,11.0 49.0,9.0"
    area = lambda p: {"area": [{"areaDesc": "A", "polygon": p}]}
    doc = {"warnings": [warning(0, info("en", "a", **area(ring))), warning(1, info("en", "b", **area([ring, "1,1 1,1 2,2", "bad", ring]))), warning(2, info("en", "c"))]}
    rows = [json.loads(r["geometry"]) if r["geometry"] else None for r in feeds.parse_warnings(bodies(spark, doc)).orderBy("ordinal").collect()]
    assert rows[0] == {"type": "Polygon", "coordinates": [[[9.0, 49.0], [9.0, 51.0], [11.0, 50.0], [9.0, 49.0]]]}
    assert rows[1]["type"] == "MultiPolygon" and len(rows[1]["coordinates"]) == 2 and rows[2] is None


def test_warning_faults(spark):
    for bad, words in (("{", "invalid JSON"), ({"warnings": {"a": 1}}, "not a list")):
        with pytest.raises(Exception, match=words):
            feeds.parse_warnings(bodies(spark, bad)).collect()
        assert feeds.parse_warnings(bodies(spark, bad), strict=False).count() == 0
    assert feeds.parse_warnings(bodies(spark, {"warnings": []}, {})).count() == 0


def test_regions(spark):
    listed = {"regions": [{"code": "B", "name": "beta"}, {"EMMA_ID": "A", "areaDesc": "Alpha"}, {"code": "B", "name": "again"}, {"code": " "}, None, {"code": "C"}]}
    warnings = bodies(spark, {"warnings": [warning(0, info("de", "x"), status="Test")]})
    want = [("A", "Alpha"), ("B", "beta"), ("C", "C")]
    for doc in (listed, listed["regions"]):
        assert [tuple(r) for r in feeds.regions(bodies(spark, doc), warnings).collect()] == want
    assert [tuple(r) for r in feeds.regions(bodies(spark, "broken"), warnings).collect()] == [("DE100", "A")]
    with pytest.raises(ValueError):
        feeds.regions(bodies(spark, []), bodies(spark, {"warnings": []}))


def test_connector(spark, tmp_path):
    from stormglass.sources import connector

    connector.register(spark)
    for i in range(8):
        name = "zone=TXC001.json" if i == 0 else f"p{i}.json"
        (tmp_path / name).write_text(json.dumps(collection(feature(id=f"p{i}")) | {"pagination": {"next": f"p{i + 1}.json"} if i < 7 else {}}))
    (tmp_path / "germany.json").write_text(json.dumps({"warnings": [warning(0, info("en", "gale"))]}))
    read = lambda **o: spark.read.format("warning_feed").options(path=str(tmp_path), **o).load()
    pages = read(provider="nws", zone="TXC001")
    assert pages.count() == 6 and feeds.parse_geojson(pages, page_no="page_no").count() == 6
    assert read(provider="nws").count() == 0
    assert feeds.parse_warnings(read(provider="meteoalarm", country="de")).first()["event"] == "gale"
    assert read(provider="meteoalarm", country="DE,FR").filter("request = 'germany'").count() == 1
    for options in ({"provider": "meteoalarm"}, {"provider": "meteoalarm", "country": "XX"}, {"provider": "other"}):
        with pytest.raises(Exception):
            read(**options).collect()


@pytest.mark.parametrize("name", ["locate_european", "locate_canadian"])
def test_a_feed_is_parsed_once_for_all_entries(spark, name):
    from stormglass.plans.queries import QUERIES

    assert not any("events.parquet" in f for f in QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles())


def test_rings_are_parsed_once_for_a_geometry(spark):
    from stormglass.functions import geo

    areas = spark.createDataFrame([([("1,2 3,4 5,6",), ("1,2 3,4 1,9",), ("1,2 3,4",), (None,)],)], "a array<struct<polygon: string>>").select(geo.geometry_of(geo.area_rings(F.col("a"))).alias("g"))
    assert json.loads(areas.first()["g"])["coordinates"] == [[[[2, 1], [4, 3], [6, 5]]], [[[2, 1], [4, 3], [9, 1]]]]
    assert areas._jdf.queryExecution().analyzed().toString().lower().count("rlike") == 2  # one for each number of a pair
