"""Geometry as arrays: WKT and GeoJSON to edges, ray casting, distances, buffers.

Polygons are ``ARRAY<ARRAY<ARRAY<STRUCT<lat,lon>>>>`` (polygon, ring, point); edges replace points by
segments. Everything is a native higher-order expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridwarden.constants import EARTH_RADIUS_KM
from gridwarden.functions.basic import Value, col, lit

TOLERANCE = 1.0e-9


def haversine_km(lat1: Value, lon1: Value, lat2: Value, lon2: Value) -> Column:
    a = F.pow(F.sin((F.radians(col(lat2)) - F.radians(col(lat1))) / 2.0), 2) + F.cos(F.radians(col(lat1))) * F.cos(
        F.radians(col(lat2))
    ) * F.pow(F.sin((F.radians(col(lon2)) - F.radians(col(lon1))) / 2.0), 2)
    return 2.0 * EARTH_RADIUS_KM * F.asin(F.sqrt(a))


def point_buffer_wkt(lat: Value, lon: Value, radius_km: float = 25.0, segments: int = 32) -> Column:
    """Polygon text of a circle around a point; NULL without a point."""
    y, x = col(lat), col(lon)
    dlat = lit(radius_km) / 110.574
    dlon = lit(radius_km) / (lit(111.320) * F.greatest(F.cos(F.radians(y)), lit(1.0e-6)))

    def corner(i: Column) -> Column:
        angle = i.cast("double") * (2.0 * 3.141592653589793) / float(segments)
        return F.format_string("%.6f %.6f", x + dlon * F.cos(angle), y + dlat * F.sin(angle))

    ring = F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), corner)
    body = F.array_join(F.concat(ring, F.slice(ring, 1, 1)), ", ")
    return F.when(y.isNotNull() & x.isNotNull(), F.concat(F.lit("POLYGON(("), body, F.lit("))")))


def polygons_from_wkt(value: Value) -> Column:
    """POLYGON and MULTIPOLYGON text to polygons; NULL for other text."""
    shape = F.lower(F.trim(col(value)))
    multi = shape.startswith("multipolygon")
    body = F.regexp_replace(shape, r"^(multi)?polygon\s*", "")
    body = F.when(multi, body).otherwise(F.concat(F.lit("("), body, F.lit(")")))
    body = F.regexp_replace(F.regexp_replace(body, r"^\(\s*\(\s*\(", ""), r"\)\s*\)\s*\)$", "")

    def point(p: Column) -> Column:
        xy = F.split(F.trim(p), r"\s+")
        return F.struct(F.try_element_at(xy, F.lit(2)).try_cast("double").alias("lat"), xy[0].try_cast("double").alias("lon"))

    def ring(r: Column) -> Column:
        return F.transform(F.split(r, ","), point)

    parsed = F.transform(
        F.split(body, r"\)\s*\)\s*,\s*\(\s*\("), lambda p: F.transform(F.split(p, r"\)\s*,\s*\("), ring)
    )
    return _whole(F.when(shape.rlike(r"^(multi)?polygon\s*\("), parsed))


def polygons_from_geojson(value: Value) -> Column:
    """Polygon and MultiPolygon GeoJSON text to polygons; NULL for other text."""
    head = F.from_json(col(value), "type string, coordinates string")
    one = F.array(F.from_json(head["coordinates"], "array<array<array<double>>>"))
    many = F.from_json(head["coordinates"], "array<array<array<array<double>>>>")
    kind = F.lower(head["type"])
    raw = F.when(kind == "polygon", one).when(kind == "multipolygon", many)
    return _whole(
        F.transform(
            raw,
            lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.struct(q[1].alias("lat"), q[0].alias("lon")))),
        )
    )


def _whole(polygons: Column) -> Column:
    """NULL unless every ring has three readable points."""

    def bad(r: Column) -> Column:
        return (F.size(r) < 3) | F.exists(r, lambda q: q["lat"].isNull() | q["lon"].isNull())

    broken = F.exists(polygons, lambda p: F.coalesce((F.size(p) == 0) | F.exists(p, bad), F.lit(True)))
    return F.when(~broken & (F.size(polygons) > 0), polygons)


def ring_edges(polygons: Column) -> Column:
    """Points to segments; the ring is closed if its text was not."""

    def edges(r: Column) -> Column:
        def edge(q: Column, i: Column) -> Column:
            nxt = F.get(r, (i + 1) % F.size(r))
            return F.struct(q["lat"].alias("lat1"), q["lon"].alias("lon1"), nxt["lat"].alias("lat2"), nxt["lon"].alias("lon2"))

        return F.transform(r, edge)

    return F.transform(polygons, lambda p: F.transform(p, edges))


def bounds(polygons: Column) -> dict[str, Column]:
    points = F.flatten(F.flatten(polygons))
    return {
        "min_lat": F.array_min(F.transform(points, lambda q: q["lat"])),
        "max_lat": F.array_max(F.transform(points, lambda q: q["lat"])),
        "min_lon": F.array_min(F.transform(points, lambda q: q["lon"])),
        "max_lon": F.array_max(F.transform(points, lambda q: q["lon"])),
    }


def _in_ring(ring: Column, lat: Column, lon: Column, closed_top: bool) -> Column:
    """Odd number of segments crossed by the ray towards larger longitudes."""

    def crossed(e: Column) -> Column:
        low, high = F.least(e["lat1"], e["lat2"]), F.greatest(e["lat1"], e["lat2"])
        spans = (lat > low) & (lat <= high) if closed_top else (lat >= low) & (lat < high)
        run = e["lat2"] - e["lat1"]
        at = e["lon1"] + (lat - e["lat1"]) * (e["lon2"] - e["lon1"]) / F.when(F.abs(run) >= 1.0e-12, run)
        return F.coalesce(spans & (at > lon), F.lit(False))

    return F.size(F.filter(ring, crossed)) % 2 == 1


def _on_ring(ring: Column, lat: Column, lon: Column) -> Column:
    def touches(e: Column) -> Column:
        dy, dx = e["lat2"] - e["lat1"], e["lon2"] - e["lon1"]
        py, px = lat - e["lat1"], lon - e["lon1"]
        length2, along = dy * dy + dx * dx, py * dy + px * dx
        point = F.hypot(py, px) <= TOLERANCE
        segment = (F.abs(dy * px - dx * py) <= TOLERANCE) & (along >= -TOLERANCE) & (along - length2 <= TOLERANCE)
        return F.when(length2 <= TOLERANCE * TOLERANCE, point).otherwise(segment)

    return F.exists(ring, touches)


def contains(edges: Column, lat: Value, lon: Value, boundary: bool = True) -> Column:
    """Point in any of the polygons. With ``boundary`` points on outer or hole edges count as inside."""
    y, x = col(lat), col(lon)

    def inside(p: Column) -> Column:
        outer, holes = p[0], F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))
        if boundary:
            return (_in_ring(outer, y, x, True) | _on_ring(outer, y, x)) & ~F.exists(
                holes, lambda h: _in_ring(h, y, x, True) & ~_on_ring(h, y, x)
            )
        return _in_ring(outer, y, x, False) & ~F.exists(holes, lambda h: _in_ring(h, y, x, False))

    return F.exists(edges, inside)


def segment_distance(e: Column, lat: Value, lon: Value) -> Column:
    """Distance in degrees from a point to a segment."""
    y, x = col(lat), col(lon)
    dy, dx = e["lat2"] - e["lat1"], e["lon2"] - e["lon1"]
    length2 = dy * dy + dx * dx
    along = F.coalesce(((y - e["lat1"]) * dy + (x - e["lon1"]) * dx) / F.when(length2 > 0, length2), lit(0.0))
    t = F.greatest(lit(0.0), F.least(lit(1.0), along))
    return F.sqrt(F.pow(y - (e["lat1"] + t * dy), 2) + F.pow(x - (e["lon1"] + t * dx), 2))


def box_distance(lat: Value, lon: Value) -> Column:
    """Distance in degrees from a point to the box columns min_lat, max_lat, min_lon and max_lon."""
    y, x = col(lat), col(lon)
    gap_y = F.greatest(F.col("min_lat") - y, y - F.col("max_lat"), lit(0.0))
    gap_x = F.greatest(F.col("min_lon") - x, x - F.col("max_lon"), lit(0.0))
    return F.sqrt(gap_y * gap_y + gap_x * gap_x)
