"""The quadtree: codes, covers, crowded cells."""

from __future__ import annotations

import json
import random
import uuid

from pyspark.sql import functions as F

from stormglass import storage
from stormglass.operators import quadtree


def shape(i, x, y, w, h):
    return (i, json.dumps({"type": "Polygon", "coordinates": [[[x, y], [x + w, y], [x + w, y + h], [x, y + h]]]}))


def test_codes_have_their_parents_as_prefixes(spark):
    rng = random.Random(1)
    side = 2**quadtree.DEEPEST
    rows = [(rng.randrange(side), rng.randrange(side)) for _ in range(50)] + [(0, 0), (side - 1, side - 1), (side - 1, 0)]
    df = spark.createDataFrame(rows, "x long, y long").withColumn("code", quadtree.morton(F.col("x"), F.col("y")))
    for r in df.withColumns({"back_x": quadtree.unspread(F.col("code"), 0), "back_y": quadtree.unspread(F.col("code"), 1)}).collect():
        assert r.code == sum((r.x >> i & 1) << 2 * i | (r.y >> i & 1) << 2 * i + 1 for i in range(quadtree.DEEPEST)) and (r.back_x, r.back_y) == (r.x, r.y)


def test_a_cover_is_bounded_whatever_the_size(spark):
    rng = random.Random(2)
    shapes = [shape(i, rng.uniform(-180, 100), rng.uniform(-90, 50), w := 10 ** rng.uniform(-4, 2), w * rng.uniform(0.01, 0.4)) for i in range(200)] + [shape(900, -180, -90, 360, 180), shape(901, 10, 10, 0, 0), shape(902, -300, 0, 900, 5)]
    cells = quadtree.cover(spark.createDataFrame(shapes, "shape_id long, geometry string")).collect()
    by = {}
    for c in cells:
        by.setdefault(c.shape_id, []).append(c)
    assert len(by) == len(shapes) and max(map(len, by.values())) <= quadtree.CELLS
    assert sum(len(x) for x in by.values()) / len(by) > 4


def test_a_city_is_split_and_spread_and_no_pair_is_lost(spark):
    rng = random.Random(3)
    points = [(i, 40 + rng.random() / 100, -74 + rng.random() / 100) if i % 10 < 3 else (i, rng.uniform(-80, 80), rng.uniform(-170, 170)) for i in range(3000)]
    points += [(9001, None, 3.0), (9002, 95.0, 200.0), (9003, 40.0, -74.0)]
    shapes = [shape(i, -74 + rng.uniform(-0.01, 0.01), 40 + rng.uniform(-0.01, 0.01), 0.004, 0.004) for i in range(60)] + [shape(100, -180, -90, 360, 180), shape(101, -75, 39, 2, 2), (102, None), (103, '{"type": "Polygon", "coordinates": [[[1, "x"]]]}')]
    p, s = spark.createDataFrame(points, "point_id long, lat double, lon double"), spark.createDataFrame(shapes, "shape_id long, geometry string")

    def inside(lat, lon, ring):
        odd = False
        for (xi, yi), (xj, yj) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
            odd ^= (yi > lat) != (yj > lat) and lon < (xj - xi) * (lat - yi) / (yj - yi) + xi
        return odd

    rings = {i: json.loads(g)["coordinates"][0] for i, g in shapes if g and '"x"' not in g}
    want = {(i, j) for i, lat, lon in points if lat is not None for j, ring in rings.items() if inside(lat, lon, ring)}
    located = p.filter("lat is not null").select("point_id", quadtree.morton(quadtree.column_of(F.col("lon")), quadtree.row_of(F.col("lat"))).alias("code"))
    first, _ = quadtree.adapted(quadtree.cover(s), located, crowded=10**9)
    split, levels = quadtree.adapted(quadtree.cover(s), located, crowded=100)
    candidates = lambda cells: cells.agg(F.sum("n_points")).first()[0]
    assert candidates(split) < 0.9 * candidates(first) and levels == sorted({r.level for r in split.collect()})
    assert split.groupBy("shape_id").count().agg(F.max("count")).first()[0] <= quadtree.CELLS * 4**quadtree.ROUNDS
    for parts in (50, 10**6):
        assert {tuple(r) for r in quadtree.points_in_shapes(p.union(p), s, crowded=100, part_points=parts).collect()} == want
    assert quadtree.points_in_shapes(p, s.limit(0)).collect() == [] and quadtree.points_in_shapes(p.limit(0), s).collect() == []


def shuffled(spark):
    found = spark._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_points_of_one_place_are_tested_once_and_pairs_are_not_shuffled(spark):
    points = spark.range(100_000).select(F.col("id").alias("point_id"), (F.col("id") % 10).cast("double").alias("lat"), F.lit(1.0).alias("lon"))
    shapes = spark.createDataFrame([shape(i, -1, -1, 5, 20) for i in range(40)], "shape_id long, geometry string")
    before = shuffled(spark)
    found = quadtree.points_in_shapes(points, shapes, part_points=3000)
    found.write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < 6_000_000  # 4 million pairs are some 30 MB
    assert found.agg(F.count("*"), F.countDistinct("point_id", "shape_id")).first() == (4_000_000, 4_000_000)


def test_rings_are_not_kept_for_each_cell(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    ring = lambda: [[rng.gauss(0, 0.1), rng.gauss(0, 0.1)] for _ in range(300)]
    shapes = spark.createDataFrame([(i, json.dumps({"type": "Polygon", "coordinates": [ring()]})) for i in range(200)], "shape_id long, geometry string")
    points = spark.createDataFrame([(1, 0.01, 0.02), (2, -0.05, 0.0)], "point_id long, lat double, lon double")
    monkeypatch.setattr(storage, "shared_folder", lambda _: f"{tmp_path}/{uuid.uuid4()}")
    assert quadtree.points_in_shapes(points, shapes).count() > 0
    # 60,000 points of rings are 1 MB once, and 16 MB in each cell of their covers.
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 3_000_000


def test_points_there_several_times_and_shapes_of_several_rings_give_one_pair(spark):
    points = [(1, 1.0, 1.0), (1, 1.0, 1.0), (1, 2.0, 2.0), (2, 1.0, 1.0), (None, 1.0, 1.0), (None, 2.0, 2.0), (3, -0.0, 0.0), (4, 0.0, -0.0)]
    square = [[-1, -1], [5, -1], [5, 5], [-1, 5]]
    shapes = [(7, json.dumps({"type": "MultiPolygon", "coordinates": [[square], [square]]})), (7, json.dumps({"type": "Polygon", "coordinates": [square]})), (8, json.dumps({"type": "Polygon", "coordinates": [[[50, 50], [51, 50], [51, 51]]]})), (None, json.dumps({"type": "Polygon", "coordinates": [square]}))]
    got = quadtree.points_in_shapes(spark.createDataFrame(points, "point_id long, lat double, lon double"), spark.createDataFrame(shapes, "shape_id long, geometry string")).collect()
    assert sorted(map(str, (r.point_id for r in got))) == sorted(2 * ["1", "2", "3", "4", "None"]) and {r.shape_id for r in got} == {7, None}
