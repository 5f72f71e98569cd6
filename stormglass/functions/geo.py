"""Rings, points and boxes.  A ring is a list of [lon, lat]; a geometry is GeoJSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import list_of, strip, text_of

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _bound(x: Column, f) -> Column:
    """``f`` of ``x``, which is made once however often ``f`` names it: it is bound as an array's element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def number(x: Column) -> Column:
    """A double from plain decimal text, else null."""
    return _bound(strip(x), lambda s: F.when(F.regexp_like(s, F.lit(_NUMBER)), s.try_cast("double")))


def gps(x: Column) -> Column:
    """struct(lat, lon) of "lat,lon" text, null unless both are numbers; further parts are ignored."""
    parts = F.split(text_of(x), ",")
    lat, lon = number(F.get(parts, F.lit(0))), number(F.get(parts, F.lit(1)))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def spaced_ring(x: Column) -> Column:
    """A ring from "lat lon lat lon ..."; null with under three points, an odd count or a bad number."""

    def ring(n: Column) -> Column:
        size = F.size(n)
        fine = (size >= 6) & (size % 2 == 0) & F.forall(n, lambda v: v.isNotNull())
        return F.when(fine, F.transform(F.sequence(F.lit(0), F.greatest(F.floor(size / 2).cast("int") - 1, F.lit(0))), lambda i: F.array(F.get(n, 2 * i + 1), F.get(n, 2 * i))))

    return _bound(F.transform(F.split(strip(text_of(x)), r"(?U)\s+"), number), ring)


def pair_ring(x: Column) -> Column:
    """A ring from "lat,lon lat,lon ..."; null with under three different points (to six places) or a bad pair."""

    def ring(points: Column) -> Column:
        fine = F.forall(points, lambda p: p[0].isNotNull() & p[1].isNotNull()) & (F.size(F.array_distinct(F.transform(points, lambda p: F.struct(F.round(p[0], 6), F.round(p[1], 6))))) >= 3)
        return F.when(fine, points)

    pairs = F.split(strip(text_of(x)), r"(?U)\s+")
    swapped = lambda p: _bound(F.split(p, ",", 2), lambda q: F.array(number(F.get(q, F.lit(1))), number(F.get(q, F.lit(0)))))
    return _bound(F.transform(pairs, swapped), ring)


def area_rings(areas: Column) -> Column:
    """The rings of all areas' polygon fields (text or JSON list of texts); unreadable ones are left out."""
    texts = F.flatten(F.transform(F.coalesce(areas, F.array()), lambda a: list_of(a["polygon"])))
    return F.filter(F.transform(texts, pair_ring), lambda r: r.isNotNull())


def geometry_of(rings: Column) -> Column:
    """GeoJSON text: null of no ring, a Polygon of one, a MultiPolygon of more, each ring a polygon of its own."""

    def text(r: Column) -> Column:
        one = F.to_json(F.struct(F.lit("Polygon").alias("type"), r.alias("coordinates")))
        more = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.transform(r, lambda x: F.array(x)).alias("coordinates")))
        return F.when(F.size(r) == 1, one).when(F.size(r) > 1, more)

    return _bound(rings, text)


def _type(geometry: Column) -> Column:
    return F.get_json_object(geometry, "$.type")


def _coordinates(geometry: Column, nesting: int) -> Column:
    return F.from_json(F.get_json_object(geometry, "$.coordinates"), "array<" * nesting + "double" + ">" * nesting)


def outer_rings(geometry: Column) -> Column:
    """Outer rings of a Polygon or MultiPolygon, holes left out; empty for anything else."""
    none = F.array().cast("array<array<array<double>>>")
    return F.coalesce(
        F.when(_type(geometry) == "Polygon", F.slice(_coordinates(geometry, 3), 1, 1)).when(_type(geometry) == "MultiPolygon", F.transform(_coordinates(geometry, 4), lambda p: F.get(p, F.lit(0)))), none
    )


def ring_box(points: Column) -> Column:
    """[min lon, min lat, max lon, max lat] of points, null unless every one has two numbers."""
    lon, lat = F.transform(points, lambda p: F.get(p, F.lit(0))), F.transform(points, lambda p: F.get(p, F.lit(1)))
    fine = (F.size(points) > 0) & F.forall(points, lambda p: F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())
    return F.when(fine, F.array(F.array_min(lon), F.array_min(lat), F.array_max(lon), F.array_max(lat)))


def box(geometry: Column) -> Column:
    """The box of a Point, LineString, Polygon or MultiPolygon with all its rings; null for anything else."""
    kind = _type(geometry)
    points = (
        F.when(kind == "Point", F.array(_coordinates(geometry, 1)))
        .when(kind == "LineString", _coordinates(geometry, 2))
        .when(kind == "Polygon", F.flatten(_coordinates(geometry, 3)))
        .when(kind == "MultiPolygon", F.flatten(F.flatten(_coordinates(geometry, 4))))
    )
    return ring_box(points)


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd ray cast: half-open in latitude, strictly to the left in longitude; false for an empty ring."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.pmod(i - 1, n))
        xi, yi, xj, yj = a[0], a[1], b[0], b[1]
        return ((yi > lat) != (yj > lat)) & F.coalesce(lon < F.try_divide((xj - xi) * (lat - yi), yj - yi) + xi, F.lit(False))

    odd = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(False), lambda acc, i: acc != crosses(i))
    return F.coalesce((n > 0) & odd, F.lit(False))


def in_box(lat: Column, lon: Column, bounds: Column) -> Column:
    """Whether a point lies in a box; a cheap test that in_ring can only pass after."""
    return lon.between(F.get(bounds, F.lit(0)), F.get(bounds, F.lit(2))) & lat.between(F.get(bounds, F.lit(1)), F.get(bounds, F.lit(3)))


def in_geometry(lat: Column, lon: Column, geometry: Column) -> Column:
    """Whether a point lies in any outer ring, rings' boxes first."""
    return F.exists(outer_rings(geometry), lambda r: in_box(lat, lon, ring_box(r)) & in_ring(lat, lon, r))
