"""Column functions on small tables of cases."""

from __future__ import annotations

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from stormglass.functions import checks, classify, clock, geo, ident, text
from stormglass.sources import settings


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_colours(spark):
    levels = ["1; green; Minor", "2;yellow;x", "3; ORANGE ; Severe", "4;\tred", "3", "3; ", "", None, "3;PURPLE;weird"]
    assert column(spark, levels, classify.colour_severity) == ["unknown", "moderate", "severe", "extreme", None, None, None, None, None]


def test_severity_by_provider(spark):
    rows = [
        ("nws", "Severe", "", "", None, "severe"), ("nws", "Minor", "W", "TO", None, "extreme"), ("nws", "Minor", "W", "SV", None, "severe"), ("nws", "x", "A", "TO", None, "moderate"),
        ("nws", "x", "Y", "", None, "minor"), ("nws", "x", "S", "", None, "unknown"), ("nws", "Severe", "Q", "", None, "unknown"), ("nws", "", "", "", None, "unknown"),
        ("meteoalarm", "Severe", "", "", "1; green; x", "unknown"), ("meteoalarm", "Severe", "", "", "3", "severe"), ("eccc", "EXTREME", "W", "TO", None, "extreme"),
        ("eccc", " severe", "", "", None, "unknown"), ("eccc", None, None, None, None, "unknown"),
    ]
    df = spark.createDataFrame(rows, "p string, s string, sig string, phen string, level string, want string")
    got = df.select("want", classify.severity(*map(F.col, ("p", "s", "sig", "phen", "level"))).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_phases_at_the_very_instant(spark):
    df = spark.createDataFrame([("Alert", 0), ("Update", -1), ("Cancel", 1), ("Cancel", 0), ("Actual", 0), ("alert", 0), (None, 0)], "m string, late int")
    now, end = F.timestamp_seconds(F.lit(1000) + F.col("late")), F.timestamp_seconds(F.lit(1000))
    got = df.select(classify.phase(F.col("m"), end, now).alias("p"), classify.last_phase(end, now).alias("q")).collect()
    assert [tuple(r) for r in got] == [("new", "expired"), ("update", "cancel"), ("expired", "expired"), ("cancel", "expired"), ("new", "expired"), ("new", "expired"), ("new", "expired")]
    assert df.select(classify.phase(F.col("m"), F.lit(None).cast("timestamp"), now)).first()[0] == "new"


def test_instants_as_pythons_parser_reads_them(spark):
    days = ("2026-04-20", "20260420", "2026-W17-1", "2026W171")
    times = ("", "07", "07:30", "0730", "07:30:15", "073015", "07:30:15.25", "07:30:15,250000")
    offsets = ("", "Z", "+02", "-0230", "+02:00", "+02:00:30", "-020030")
    forms = [f"{d}{sep}{t}{o}" if t else d for d in days for t in times for o in (offsets if t else ("",)) for sep in (("T", " ", "_") if d == "2026-04-20" else ("T",))]

    def by_python(x):
        at = datetime.fromisoformat(x)
        return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1_000_000)

    assert column(spark, forms, lambda x: F.unix_micros(clock.instant(x))) == [by_python(x) for x in forms]


@pytest.mark.parametrize(
    ("written", "want"),
    [
        ("2026-04-20T18:00:00+02:00", datetime(2026, 4, 20, 16, tzinfo=UTC)), ("2026-04-20T18:00:00Z", datetime(2026, 4, 20, 18, tzinfo=UTC)), ("2026-04-20T18:00:00", datetime(2026, 4, 20, 18, tzinfo=UTC)),
        ("20260420T070000Z", datetime(2026, 4, 20, 7, tzinfo=UTC)), ("2026-W17-1", datetime(2026, 4, 20, tzinfo=UTC)), ("2026W171T0730+0200", datetime(2026, 4, 20, 5, 30, tzinfo=UTC)), ("2025-W53-1", None),
        ("2026-04-20T07:00:00,5Z", datetime(2026, 4, 20, 7, 0, 0, 500000, tzinfo=UTC)), ("20260420", datetime(2026, 4, 20, tzinfo=UTC)), ("2026-W17", datetime(2026, 4, 20, tzinfo=UTC)), ("202604", None),
        ("2026-04-20", datetime(2026, 4, 20, tzinfo=UTC)), ("2026-04-20 18:30", datetime(2026, 4, 20, 18, 30, tzinfo=UTC)), ("2026-04-20T18:00:00.25-0330", datetime(2026, 4, 20, 21, 30, 0, 250000, tzinfo=UTC)),
        ("2026", None), ("T18:00:00", None), (" 2026-04-20", None), ("2026-13-20", None), ("", None), (None, None), ("soon", None),
    ],
)
def test_instants(spark, written, want):
    (seconds,) = column(spark, [written], lambda x: F.unix_micros(clock.instant(x)))
    assert seconds == (None if want is None else round(want.timestamp() * 1_000_000))


def test_byte_cap_against_bytes(spark):
    rng = random.Random(1)
    texts = ["a" * 4196, "☃" * 1415, "short", "", None] + ["".join(rng.choice("aé☃😀") for _ in range(rng.randint(1000, 2500))) for _ in range(40)] + ["a" * k + "😀" * 1200 for k in range(4)]

    def slow(t):
        if t is None or len(t.encode()) <= 4096:
            return t
        return t.encode()[:4093].decode("utf-8", "ignore") + "…"

    got = column(spark, texts, text.byte_cap)
    assert got == [slow(t) for t in texts] and all(t is None or len(t.encode()) <= 4096 for t in got)


def test_character_cap(spark):
    assert column(spark, ["a" * 255, "é" * 256, None], text.character_cap) == ["a" * 255, "é" * 254 + "…", None]


def test_icons(spark):
    rows = [
        ("nws", " Tornado WARNING ", "weather-tornado"), ("nws", "Extreme Cold Warning", "snowflake-thermometer"), ("nws", "Odd", "alert"), ("nws", None, "alert"), ("eccc", "Snow Squall", "snowflake-alert"),
        ("eccc", "rainfall warning", "weather-pouring"), ("meteoalarm", "Snow/Ice", "snowflake"), ("meteoalarm", "coastal-event", "waves"), ("meteoalarm", "rain_flood", "home-flood"), ("meteoalarm", "STURMBÖEN", "alert"),
        ("meteoalarm", "gale-force gusts", "weather-windy"), ("meteoalarm", "tornado", "alert"), ("other", "high wind", "weather-windy"),
    ]
    df = spark.createDataFrame(rows, "p string, e string, want string")
    assert all(r["got"] == "mdi:" + r["want"] for r in df.select("want", classify.icon(F.col("p"), F.col("e")).alias("got")).collect())


def test_boxes(spark):
    shapes = [
        '{"type":"Polygon","coordinates":[[[-80,30],[-70,30],[-70,40],[-80,40],[-80,30]]]}', '{"type":"MultiPolygon","coordinates":[[[[-80,30],[-70,40]]],[[[-65,45],[-66,44]]]]}', '{"type":"Point","coordinates":[1,2]}',
        '{"type":"LineString","coordinates":[[0,5],[3,1]]}', '{"type":"GeometryCollection","geometries":[]}', "broken", None,
    ]
    assert column(spark, shapes, geo.box) == [[-80.0, 30.0, -70.0, 40.0], [-80.0, 30.0, -65.0, 45.0], [1.0, 2.0, 1.0, 2.0], [0.0, 1.0, 3.0, 5.0], None, None, None]


def test_ray_cast_against_plain_python(spark):
    rng = random.Random(2)
    rings = [[[round(rng.uniform(-3, 3), 1), round(rng.uniform(-3, 3), 1)] for _ in range(rng.randint(0, 9))] for _ in range(300)]

    def slow(lat, lon, ring):
        inside = False
        for i in range(len(ring)):
            (xi, yi), (xj, yj) = ring[i], ring[i - 1]
            if (yi > lat) != (yj > lat) and lon < (xj - xi) * (lat - yi) / (yj - yi) + xi:
                inside = not inside
        return inside

    for lat, lon in ((0.0, 0.0), (1.0, -1.0)):
        assert column(spark, rings, lambda r: geo.in_ring(F.lit(lat), F.lit(lon), r), "array<array<double>>") == [slow(lat, lon, r) for r in rings]


def test_rings(spark):
    assert column(spark, ["1 2 3 4 5 6", " 1\t2\n3 4 5 6 ", "1 2 3 4", "1 2 3 4 5", "1 2 3 4 5 x", "", None], geo.spaced_ring) == [[[2.0, 1.0], [4.0, 3.0], [6.0, 5.0]]] * 2 + [None] * 5
    assert column(spark, ["1,2 3,4 5,6", "1,2 3,4 1,2", "1,2 3,4 5", "1,2 3,4 1.0000001,2"], geo.pair_ring) == [[[2.0, 1.0], [4.0, 3.0], [6.0, 5.0]], None, None, None]


def test_validators(spark):
    pick = lambda f: lambda x: F.concat_ws("|", f(x)["value"], f(x)["error"])
    assert column(spark, ["51.5, -0.12", "91,0", "a,b", "1,2,3", None], pick(checks.check_gps)) == ["51.5,-0.12", "91,0|invalid_gps", "a,b|invalid_gps", "1,2,3|invalid_gps", "invalid_gps"]
    assert column(spark, [" txc001,ohz002 ", "txc1"], pick(checks.check_zone)) == ["TXC001,OHZ002", "txc1|invalid_zone"]
    assert column(spark, [" on", "XX"], pick(checks.check_province)) == ["ON", "XX|invalid_province"]
    assert column(spark, ["de", " fr ", "uk", "us", "USA", ""], pick(checks.check_country)) == ["DE", "FR", "UK", "us|invalid_country", "USA|invalid_country", "|invalid_country"]
    df = spark.createDataFrame([(60, 5, "auto", True), (59, 5, "auto", False), (3600, 120, "de", True), (60, 121, "de", False), (60, 5, "xx", False)], "s int, t int, l string, want boolean")
    assert all(r[0] == r[1] for r in df.select("want", checks.options_fine(F.col("s"), F.col("t"), F.col("l"))).collect())


def test_titles(spark):
    rows = [
        (dict(zone_id="OHC049"), "(OHC049)"), (dict(gps_loc="1,2"), "(1,2)"), (dict(tracker_entity="device_tracker.phone"), "(phone)"), (dict(province="ON"), "(ON)"), (dict(country="DE"), "(Germany)"), ({}, "(Unknown)"),
        (dict(country="DE", regions=["a", "b"], region_labels={"a": "Zeta", "b": "Alpha"}), "(DE — Alpha +1)"), (dict(country="DE", regions=["a"], region_labels={"a": "Zeta"}), "(DE — Zeta)"),
        (dict(country="DE", regions=["a", "b"]), "(Germany — 2 regions)"), (dict(zone_id="A", country="DE"), "(A)"),
    ]
    names = [c.split()[0] for c in settings.ENTRY.replace("map<string,string>", "map").split(", ")]
    df = spark.createDataFrame([tuple({"entry_id": str(i), "provider": "nws"}.get(n, r.get(n)) for n in names) for i, (r, _) in enumerate(rows)], settings.ENTRY)
    from stormglass.operators import serve

    got = {r["entry_id"]: r["title"] for r in serve.devices(df).collect()}
    assert [got[str(i)] for i in range(len(rows))] == [f"Alerts NWS {w}" for _, w in rows]


def test_settings(spark):
    base = dict(provider="nws", tracker_entity=None, gps_loc=None, language=None)
    rows = [base | dict(gps_loc="1,2"), base | dict(tracker_entity="t1", gps_loc="9,9"), base | dict(tracker_entity="t2"), base | dict(tracker_entity="t3"), base | dict(provider="meteoalarm", language="auto")]
    names = [c.split()[0] for c in settings.ENTRY.replace("map<string,string>", "map").split(", ")]
    df = spark.createDataFrame([tuple((r | {"entry_id": str(i)}).get(n) for n in names) for i, r in enumerate(rows)], settings.ENTRY)
    trackers = spark.createDataFrame([("t1", 3.5, 4.0), ("t2", 0.0, 4.0)], "tracker_entity string, latitude double, longitude double")
    got = {r["entry_id"]: r for r in settings.resolve(df, trackers, "fr-FR").collect()}
    assert [got[str(i)]["gps_loc"] for i in range(5)] == ["1,2", "3.5,4.0", "", "", None]
    assert [got[str(i)]["language"] for i in range(5)] == ["fr-CA"] * 4 + ["fr"] and got["0"]["scan_interval"] == 300
    odd = [dict(zone_id="txc001"), dict(zone_id="1", gps_loc="x", province="XX", country="us", timeout=1), dict(scan_interval=60, language="de"), {}]
    wrong = settings.faults(spark.createDataFrame([tuple((r | {"entry_id": str(i)}).get(n) for n in names) for i, r in enumerate(odd)], settings.ENTRY))
    assert {r["entry_id"]: r["errors"] for r in wrong.collect()} == {"0": [], "1": ["invalid_zone", "invalid_gps", "invalid_province", "invalid_country", "invalid_options"], "2": [], "3": []}
    q = spark.createDataFrame([("OHC1", "1,2"), ("", "40.123456,-80"), (None, "bad"), (None, None)], "z string, g string").select(settings.request_query(F.col("z"), F.col("g"))).collect()
    assert [r[0] for r in q] == ["zone=OHC1", "point=40.1235,-80.0", "", ""]


def test_identities(spark):
    assert column(spark, ["Tornado Warning", "", None], lambda e: ident.object_id(e, F.lit("u"))) == ["alert_tornado_warning_51e69892", None, None]
    assert column(spark, ["{}", "", None], lambda g: ident.geometry_ref(F.lit("nws"), F.lit("a"), g)) == ["nws:a", "", ""]


def test_normalisation_runs_no_python(spark):
    from stormglass.plans.snapshots import normalised

    plan = normalised(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
