"""Points in shapes on a quadtree: large shapes take few large cells, and crowded cells are split.

The world is a square of 2**DEEPEST cells a side, each named by its Morton code: the bits of its
two numbers in turn, so a cell's parent is its code without the last two bits.  The box of a ring is covered by the smallest cells of
which CELLS suffice, whatever its size.  A cell where many points and many rings meet is split into its quarters for
those rings, and the quarters that a ring's box does not touch fall away; so do cells without points.  Points
meet rings by their codes' prefixes, at the levels that the rings have.  A cell that keeps very many points, such as a
city, is dealt to several tasks by points.

Points of the same coordinates are one place, which meets the rings once; its points then get its shapes, dealt to several tasks
if they are very many.  While cells are split they are numbers and a box; rings are only put to those that are left.

Rows of a ring: CELLS * 4**ROUNDS at most, whatever the data.

Cases: coordinates beyond the world belong to its outermost cells; points with a null coordinate and rings with a
broken one meet nothing; a point on an edge is in or out as ``geo.in_ring`` says; repeated points and shapes give one pair; empty tables
give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..storage import written

#: Levels of cells; one of the deepest is some 40 m long at the equator.
DEEPEST = 20
#: Cells that cover a ring's box at first, and how often crowded ones are split.
CELLS, ROUNDS = 16, 4
#: Pairs of a point and a ring from which a cell is crowded, and points of a cell that one task takes.
CROWDED, PART_POINTS = 100_000, 20_000


def morton(x: Column, y: Column) -> Column:
    """The code of the cell in column ``x`` and row ``y``: their bits in turn."""

    def spread(n: Column) -> Column:
        out = n.cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask))
        return out

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def _number(degrees: Column, least: float, span: float) -> Column:
    """Which of the deepest columns (or rows) a coordinate lies in."""
    side = 2**DEEPEST
    return F.least(F.greatest(F.floor((degrees - least) / span * side), F.lit(0)), F.lit(side - 1)).cast("long")


def column_of(lon: Column) -> Column:
    return _number(lon, -180.0, 360.0)


def row_of(lat: Column) -> Column:
    return _number(lat, -90.0, 180.0)


def rings_of(shapes: DataFrame) -> DataFrame:
    """shape_id, ring and box of each outer ring of ``shapes`` (shape_id, geometry)."""
    return shapes.select("shape_id", F.explode(geo.outer_rings(F.col("geometry"))).alias("ring")).withColumn("box", geo.ring_box(F.col("ring"))).filter("box is not null")


def cover(shapes: DataFrame) -> DataFrame:
    """The cells of each outer ring of ``shapes`` (shape_id, geometry)."""
    return cells_of(rings_of(shapes).drop("ring"))


def cells_of(rings: DataFrame) -> DataFrame:
    """``rings`` without box, with its corner cells x0, y0, x1, y1, and level and cell: CELLS rows at most for each."""
    edge = lambda i: F.get("box", F.lit(i))
    rings = rings.withColumns({"x0": column_of(edge(0)), "y0": row_of(edge(1)), "x1": column_of(edge(2)), "y1": row_of(edge(3))}).drop("box")
    at = lambda c, level: _right(F.col(c), F.lit(DEEPEST) - level)
    n_cells = lambda level: (at("x1", level) - at("x0", level) + 1) * (at("y1", level) - at("y0", level) + 1)
    placed = rings.withColumn("level", F.array_max(F.filter(F.sequence(F.lit(0), F.lit(DEEPEST)), lambda level: n_cells(level) <= CELLS)))
    numbers = lambda low, high: F.explode(F.sequence(at(low, F.col("level")), at(high, F.col("level"))))
    return placed.withColumn("x", numbers("x0", "x1")).withColumn("y", numbers("y0", "y1")).withColumn("cell", morton(F.col("x"), F.col("y"))).drop("x", "y")


def _right(n: Column, bits: Column) -> Column:
    return F.call_function("shiftright", n, bits)


def _quarters(cells: DataFrame) -> DataFrame:
    """The quarters of each cell that the ring's box touches."""
    quarter = cells.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(3))))
    quarter = quarter.withColumns({"level": F.col("level") + 1, "cell": F.col("cell") * 4 + F.col("q")}).drop("q")
    x, y = (unspread(F.col("cell"), i) for i in (0, 1))
    size = _right(F.lit(2**DEEPEST), F.col("level"))  # the deepest columns that lie in a quarter
    touches = lambda n, low, high: (n * size <= F.col(high)) & ((n + 1) * size > F.col(low))
    return quarter.filter(touches(x, "x0", "x1") & touches(y, "y0", "y1"))


def unspread(code: Column, bit: int) -> Column:
    """The column (bit 0) or row (bit 1) of a code."""
    out = F.shiftright(code, bit).bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        out = out.bitwiseOR(F.shiftright(out, shift)).bitwiseAND(F.lit(mask))
    return out


def _at_levels(points: DataFrame, levels: list[int]) -> DataFrame:
    """``points`` with the cell of each at each of the levels."""
    prefixes = F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("code", 2 * (DEEPEST - k)).alias("cell")) for k in levels))
    return points.select("*", F.explode(prefixes).alias("p")).select(*points.columns, "p.level", "p.cell")


def adapted(cells: DataFrame, points: DataFrame, crowded: int = CROWDED, rounds: int = ROUNDS) -> tuple[DataFrame, list[int]]:
    """``cells`` with crowded ones split and those without points left out, with ``n_points``, the points of each; and their levels."""
    levels = [r["level"] for r in cells.select("level").distinct().collect()]  # DEEPEST + 1 at most
    for left in range(rounds, -1, -1):
        if not levels:
            return cells.withColumn("n_points", F.lit(0).cast("long")), []
        rings = cells.groupBy("level", "cell").agg(F.count(F.lit(1)).alias("n_rings"))
        met = _at_levels(points.select("code"), levels).groupBy("level", "cell").agg(F.count(F.lit(1)).alias("n_points")).join(rings, ["level", "cell"])
        full = F.lit(left > 0) & (F.col("n_points") * F.col("n_rings") > crowded) & (F.col("level") < DEEPEST)
        counted = written(cells.join(met, ["level", "cell"]).withColumn("full", full))
        found = {(r["level"], r["full"]) for r in counted.select("level", "full").distinct().collect()}
        if not any(full for _, full in found):
            break
        own = counted.drop("n_rings", "n_points", "full")
        cells = own.filter(~counted["full"]).unionByName(_quarters(own.filter(counted["full"])))
        levels = sorted({level + full for level, full in found} | {level for level, _ in found})
    return counted.drop("n_rings", "full"), sorted({level for level, _ in found})


def _places_in_shapes(places: DataFrame, shapes: DataFrame, crowded: int, part_points: int) -> DataFrame | None:
    """(place_no, heaps, shapes) of the ``places`` (place_no, lat, lon, code, heaps) in shapes, and all shapes of each; None if no place is near any."""
    rings = written(rings_of(shapes).withColumn("ring_no", F.monotonically_increasing_id()))
    cells, levels = adapted(cells_of(rings.select("ring_no", "box")), places, crowded)
    if not levels:
        return None
    parts = F.ceil(F.col("n_points") / part_points)
    busy = written(cells.select("level", "cell", parts.alias("parts")).distinct())
    # A crowded cell's places are dealt to its parts, each of which has all its rings.
    slots = cells.select("ring_no", "level", "cell", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")).join(rings, "ring_no").drop("ring_no")
    dealt = _at_levels(places, levels).join(busy, ["level", "cell"]).withColumn("part", F.pmod(F.xxhash64("place_no"), "parts"))
    lat, lon = F.col("lat"), F.col("lon")
    met = dealt.join(slots, ["level", "cell", "part"]).filter(geo.in_box(lat, lon, F.col("box")) & geo.in_ring(lat, lon, F.col("ring")))
    return met.groupBy("place_no", "heaps").agg(F.collect_set(F.struct("shape_id")).alias("shapes"))


def points_in_shapes(points: DataFrame, shapes: DataFrame, crowded: int = CROWDED, part_points: int = PART_POINTS) -> DataFrame:
    """(point_id, shape_id) of the points (point_id, lat, lon) inside the shapes (shape_id, geometry)."""
    located = points.filter("lat is not null and lon is not null").select("point_id", "lat", "lon")
    heaps = F.ceil(F.count(F.lit(1)) / part_points).alias("heaps")
    code = morton(column_of(F.col("lon")), row_of(F.col("lat"))).alias("code")
    places = written(located.groupBy("lat", "lon").agg(heaps).select(F.monotonically_increasing_id().alias("place_no"), "lat", "lon", code, "heaps"))
    inside = _places_in_shapes(places, shapes, crowded, part_points)
    if inside is None:
        return located.select("point_id", F.lit(None).cast(shapes.schema["shape_id"].dataType).alias("shape_id")).limit(0)
    inside = written(inside).withColumn("heap", F.explode(F.sequence(F.lit(0).cast("long"), F.col("heaps") - 1))).drop("heaps")

    def pairs(some: DataFrame) -> DataFrame:
        rows = some.join(places.select("lat", "lon", "place_no", "heaps"), ["lat", "lon"]).select("point_id", "place_no", F.pmod(F.xxhash64("point_id"), "heaps").alias("heap"))
        return rows.join(inside, ["place_no", "heap"]).select("point_id", F.explode("shapes.shape_id").alias("shape_id"))

    # Only points that are there several times can give a pair twice.
    again = written(located.groupBy(F.col("point_id").alias("again")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("again"))
    if again.isEmpty():
        return pairs(located)
    same = F.col("point_id").eqNullSafe(F.col("again"))
    return pairs(located.join(again, same, "left_anti")).unionByName(pairs(located.join(again, same, "left_semi")).distinct())
