"""Geometry store, location filters, language merge, entities and other views."""

from __future__ import annotations

import json
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from stormglass import schema
from stormglass.operators import geometry, lifecycle, locate, normalize, quadtree, serve

SQUARE = '{"type":"Polygon","coordinates":[[[9,49],[11,49],[11,51],[9,51]]]}'


def alerts(spark, *rows):
    """Alert rows from dicts, all other columns at their defaults."""
    names = sorted({k for r in rows for k in r} | {"id"})
    kinds = {"ordinal": "long", "geocode": "string"} | schema.FIELDS
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} {kinds[n]}" for n in names))
    return schema.as_alerts(df, tuple(n for n in names if n not in schema.FIELDS))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_defaults(spark):
    row = alerts(spark, {"id": "a", "headline": None}).first()
    assert row["headline"] == "" and row["vtec"] == [] and row["instruction"] is None and row["provider"] == "nws" and row["phase_changed"] is False


def test_normalize(spark):
    row = dict(id="a", event="Tornado Warning", severity="Minor", vtec_significance="W", vtec_phenomena="TO", msg_type="Update", expires="2026-01-01T00:00:00Z", description="d" * 5000, geometry=SQUARE)
    df = alerts(spark, row, {"id": "b", "geometry": '{"type":"GeometryCollection","geometries":[]}'}).withColumn("poll_ts", F.lit("2025-12-31T00:00:00Z").cast("timestamp"))
    a, b = normalize.normalize(df).orderBy("id").collect()
    assert (a["severity_normalized"], a["phase"], a["icon"], a["bbox"], a["geometry_ref"]) == ("extreme", "update", "mdi:weather-tornado", [9.0, 49.0, 11.0, 51.0], "nws:a")
    assert len(a["description"].encode()) == 4096 and a["instruction"] is None
    assert (b["bbox"], b["geometry_ref"], b["phase"], b["icon"]) == (None, "nws:b", "new", "mdi:alert")


def test_canadian_locations(spark):
    df = alerts(spark, {"id": "a", "geocode": "ON1"}, {"id": "b", "geocode": "QC1", "area_desc": "London"}, {"id": "c", "geocode": "AB1", "geometry": SQUARE})
    assert ids(locate.of_province_or_point(df, "ON", "50,10")) == ["a", "b"]
    assert ids(locate.of_province_or_point(df, "", "50,10")) == ["c"]
    assert ids(locate.of_province_or_point(df, "", "0,0")) == ids(locate.of_province_or_point(df)) == ids(locate.of_province_or_point(df, "", "bad")) == []


def test_european_locations(spark):
    two = '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1]]],[[[9,49],[11,49],[11,51],[9,51]]]]}'
    df = alerts(spark, {"id": "a", "geometry": SQUARE, "geocode_same": ["DE1", "DE2"]}, {"id": "b", "geometry": two, "geocode_same": ["DE3"]}, {"id": "c"})
    assert ids(locate.of_european_entry(df, "50,10", ["DE3"])) == ["a", "b"] and ids(locate.of_european_entry(df, "0.2,0.5")) == ["b"]
    assert ids(locate.of_european_entry(df, "", ["DE2", ""])) == ["a"] and ids(locate.of_european_entry(df)) == ["a", "b", "c"]
    assert ids(locate.of_regions(df, ["", ""])) == [] and ids(locate.of_point(df.limit(0), "bad")) == []
    for frame, gps in ((df.filter("id = 'c'"), "50,10"), (df, "bad"), (df, "1")):
        with pytest.raises(ValueError):
            locate.of_point(frame, gps)
    wanted = spark.createDataFrame([("DE2",), ("DE3",), ("DE3",)], "code string")
    assert ids(locate.region_join(df, wanted)) == ["a", "b"]


def test_spatial_join_against_all_pairs(spark):
    rng = random.Random(1)
    points = [(i, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(120)]
    shapes = []
    for i in range(30):
        x, y = rng.uniform(-5, 5), rng.uniform(-5, 5)
        shapes.append((i, json.dumps({"type": "Polygon", "coordinates": [[[x + rng.uniform(-2, 2), y + rng.uniform(-2, 2)] for _ in range(5)]]})))
    p = spark.createDataFrame(points, "point_id long, lat double, lon double")
    s = spark.createDataFrame([*shapes, (99, None), (98, "broken")], "shape_id long, geometry string")

    def inside(lat, lon, ring):
        odd = False
        for (xi, yi), (xj, yj) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
            odd ^= (yi > lat) != (yj > lat) and lon < (xj - xi) * (lat - yi) / (yj - yi) + xi
        return odd

    want = {(i, j) for i, lat, lon in points for j, g in shapes if inside(lat, lon, json.loads(g)["coordinates"][0])}
    for crowded in (20, 10**6):
        assert {tuple(r) for r in quadtree.points_in_shapes(p, s, crowded).collect()} == want


def test_language_merge(spark):
    make = lambda *langs: alerts(spark, *({"id": "a", "ordinal": i, "language": x, "headline": f"{x}{i}"} for i, x in enumerate(langs)))
    pick = lambda df, want: tuple(locate.merge_languages(df, want).select("headline", "headline_alt", "language_alt", "ordinal").first())
    assert pick(make("en", "fr"), "fr") == ("fr1", "en0", "en", 0)
    assert pick(make("en"), "fr") == ("en0", "", "", 0)
    assert pick(make("en", "fr", "en", "fr"), "en") == ("en2", "fr3", "fr", 0)
    assert pick(make("de", "it", "es"), "en") == ("de0", "it1", "it", 0)
    assert pick(make("en", "en"), "en") == ("en1", "", "", 0)


class Cache:
    """A bounded cache in plain Python: puts, reads and deletes one by one."""

    def __init__(self, cap):
        self.cap, self.rows = cap, OrderedDict()

    def put(self, ref, text):
        self.rows.pop(ref, None)
        self.rows[ref] = text
        while sum(map(len, self.rows.values())) > self.cap:
            self.rows.popitem(last=False)


@pytest.mark.parametrize("seed", range(3))
def test_eviction_against_put_by_put(spark, seed):
    rng = random.Random(seed)
    cache, log = Cache(60), []
    for at in range(60):
        ref, text = f"nws:{rng.randint(0, 9)}", "x" * rng.randint(1, 30)
        cache.put(ref, text)
        log.append((ref, text, len(text), at * 70_000))  # over many ranges of touch_seq
    touches = spark.createDataFrame(log, "ref string, geometry string, size long, touch_seq long")
    got = geometry.evict(geometry.entries(touches), 60)
    assert {r["ref"]: r["geometry"] for r in got.collect()} == dict(cache.rows)


def test_store_cycle(spark):
    first = alerts(spark, {"id": "a", "geometry": SQUARE, "geometry_ref": "nws:a", "phase": "new"}, {"id": "b", "geometry": SQUARE, "geometry_ref": "nws:b", "phase": "cancel"}, {"id": "c", "phase": "new"})
    log = geometry.puts(first, F.lit(1).cast("long"))
    assert [r["ref"] for r in log.collect()] == ["nws:a"]
    other = spark.createDataFrame([("eccc:z", "{}", 2, 0), ("nws:old", "{}", 2, 0)], log.schema)
    after = geometry.sync(log.unionByName(other), first, F.lit(2).cast("long"), "nws")
    assert sorted(r["ref"] for r in after.collect()) == ["eccc:z", "nws:a"]
    body = json.loads(geometry.lookup(after, "nws:a").first()["body"])
    assert body == {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": json.loads(SQUARE), "properties": {"ref": "nws:a"}}]}
    assert geometry.lookup(after, "nws:none").count() == 0
    refs = spark.createDataFrame([("nws:a",), ("nws:none",)], "ref string")
    assert [r["ref"] for r in geometry.delete(after, refs).collect()] == ["eccc:z"]
    # A read makes an entry newer; one that is larger than the cache evicts itself.
    touched = geometry.entries(other.unionByName(geometry.reads(spark.createDataFrame([("nws:old",)], "ref string"), F.lit(5).cast("long"))))
    assert [r["ref"] for r in geometry.evict(touched, 2).collect()] == ["nws:old"]
    assert geometry.evict(geometry.entries(log), 3).count() == 0


def test_nothing_gone_comes_back(spark):
    """Three polls of two providers: each works on the store of the one before."""
    seq = lambda n: F.lit(n).cast("long")
    rows = lambda *ids: alerts(spark, *({"id": i, "geometry": SQUARE, "geometry_ref": i, "phase": "new"} for i in ids))
    store = geometry.entries(geometry.puts(rows("nws:a", "nws:b"), seq(1)))
    store = geometry.sync(store, rows("nws:b"), seq(2), "nws")
    store = geometry.sync(store, rows("eccc:c"), seq(3), "eccc")
    assert sorted(r["ref"] for r in store.collect()) == ["eccc:c", "nws:b"]



def test_entity_sync(spark):
    frame = lambda *names: spark.createDataFrame([(n,) for n in names], "id string")
    cases = [("ab", "", "", "ab", ""), ("", "ab", "", "", "ab"), ("ac", "ab", "", "c", "b"), ("", "abc", "abc", "", ""), ("", "abn", "ab", "", "n"), ("", "", "", "", "")]
    for current, tracked, grace, add, remove in cases:
        a, r = serve.sync_entities(frame(*current), frame(*tracked), frame(*grace))
        assert (ids(a), ids(r)) == (sorted(add), sorted(remove))
    polls = spark.createDataFrame([("e", 3), ("e", 5)], "entry_id string, poll_seq long")
    current = spark.createDataFrame([("e", 3, "n")], "entry_id string, poll_seq long, id string")
    hydrated = spark.createDataFrame([("e", "a"), ("e", "n")], "entry_id string, id string")
    got = {(r["poll_seq"], r["id"], r["action"]) for r in serve.sync_history(current, polls, hydrated).collect()}
    assert got == {(5, "a", "remove"), (5, "n", "remove")}


def test_views(spark):
    rows = alerts(spark, {"id": "a", "event": "Flood Watch", "severity_normalized": "severe", "vtec": ["v"], "geometry": SQUARE, "parameters": {"k": ["x"]}}).withColumn("entry_id", F.lit("e"))
    view = serve.entities(rows).first()
    assert (view["unique_id"], view["state"], view["name"]) == ("e_nws_a", "severe", "Flood Watch") and view["object_id"].startswith("alert_flood_watch_")
    assert json.loads(view["attributes"]) == {"id": "a", "event": "Flood Watch", "severity_normalized": "severe", "vtec": ["v"], "parameters": {"k": ["x"]}, "provider": "nws", "phase_changed": False, "incident_platform_version": "1.0"}
    polls = spark.createDataFrame([("e", 0, 10, "ok"), ("e", 1, 20, "failed")], "entry_id string, poll_seq long, s long, status string").withColumn("poll_ts", F.timestamp_seconds("s"))
    assert {tuple(r) for r in serve.counts(rows.withColumn("poll_seq", F.lit(0)), polls).collect()} == {("e", 0, 1), ("e", 1, 0)}
    assert serve.last_updated(polls).select(F.unix_seconds("last_updated")).first()[0] == 10
    fetched = spark.createDataFrame([("A", "x"), ("B", "y")], "code string, label string")
    assert [r["code"] for r in serve.carry_selection(fetched, spark.createDataFrame([("B",), ("C",)], "code string")).collect()] == ["B"]


def test_archive(spark):
    rows = spark.createDataFrame([("e", 1, "incident_removed", 1, "a", "Storm", "expired"), ("e", 1, "incident_created", 2, "b", "Storm", "new")], "entry_id string, poll_seq long, event_type string, event_seq int, incident_id string, event string, phase string")
    (row,) = serve.archive(rows).collect()
    assert row["title"] == "Incident removed: Storm (expired)" and json.loads(row["message"])["incident_id"] == "a" and lifecycle.REMOVED == "incident_removed"


def test_region_overlap_has_a_row_for_each_order(spark):
    from stormglass.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    found = {r["o_orderkey"]: r["overlaps"] for r in QUERIES["region_overlap"](spark, sf).collect()}
    orders = spark.read.parquet(f"{sf}/lineitem.parquet").join(spark.read.parquet(f"{sf}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey").distinct()
    assert set(found) == {r["o_orderkey"] for r in orders.collect()} and set(found.values()) == {True, False}
