"""Spatial joins by degree buckets: point in polygon, nearest boundary, radius."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwarden.functions import geometry as geo
from gridwarden.functions.basic import check, col, once, text
from gridwarden.session import cut_lineage, temporary

BUCKET = 1.0


def round_coordinates(df: DataFrame, digits: int = 4) -> DataFrame:
    """Coordinates as doubles rounded half to even; unreadable ones become NULL."""
    return df.withColumns({c: F.bround(F.col(c).try_cast("double"), digits) for c in ("latitude", "longitude")})


def boundary_edges(boundaries: DataFrame, geometry: str = "geometry", fmt: str = "geojson", strict: bool = True) -> DataFrame:
    """Replace geometry text by edge arrays and bounds. ``strict`` fails on unreadable geometry, else drops it."""
    parse = {"geojson": geo.polygons_from_geojson, "wkt": geo.polygons_from_wkt}[fmt]
    out = once(boundaries, {"_polygons": parse(geometry)})
    if strict:
        out = out.withColumn("_polygons", check(F.col("_polygons").isNotNull(), F.col("_polygons"), f"unsupported {fmt} geometry"))
    else:
        out = out.filter(F.col("_polygons").isNotNull())
    out = once(out, {"edges": geo.ring_edges(F.col("_polygons")), **geo.bounds(F.col("_polygons"))})
    return out.drop("_polygons", geometry)


def bucket(value: Column | str, size: float = BUCKET) -> Column:
    """Number of the cell of ``size`` degrees that holds a coordinate."""
    return F.floor(col(value) / size).cast("int")


def bucket_index(boundaries: DataFrame, size: float = BUCKET, reach: int = 0, clip_edges: bool = True) -> DataFrame:
    """One row per boundary and bucket its bounds touch (plus ``reach`` buckets around).

    With ``clip_edges`` a bucket keeps only the edges a ray from inside it towards larger longitudes can
    meet, so a long border is spread over its buckets instead of being copied whole into each.
    """

    def span(low: str, high: str) -> Column:
        return F.sequence(bucket(low, size) - reach, bucket(high, size) + reach)

    out = boundaries.withColumn("_bi", F.explode_outer(span("min_lat", "max_lat"))).withColumn("_bj", F.explode_outer(span("min_lon", "max_lon")))
    return _clipped(out, size) if clip_edges else out


def _clipped(cells: DataFrame, size: float) -> DataFrame:
    """Keep the edges that a ray from inside the cell _bi, _bj towards larger longitudes can meet."""
    pad = 2 * geo.TOLERANCE
    low, high, left = F.col("_bi") * size - pad, (F.col("_bi") + 1) * size + pad, F.col("_bj") * size - pad

    def near(e: Column) -> Column:
        return (
            (F.greatest(e["lat1"], e["lat2"]) >= low)
            & (F.least(e["lat1"], e["lat2"]) <= high)
            & (F.greatest(e["lon1"], e["lon2"]) >= left)
        )

    return once(cells, {"edges": F.transform("edges", lambda p: F.transform(p, lambda r: F.filter(r, near)))})


def _crosses(e: Column, low_lat: Column, high_lat: Column, low_lon: Column, high_lon: Column) -> Column:
    """A segment meets a box: their bounds overlap and the box's corners are not all on one side of it."""
    dy, dx = e["lat2"] - e["lat1"], e["lon2"] - e["lon1"]
    sides = [dy * (x - e["lon1"]) - dx * (y - e["lat1"]) for y in (low_lat, high_lat) for x in (low_lon, high_lon)]
    overlap = (
        (F.greatest(e["lat1"], e["lat2"]) >= low_lat)
        & (F.least(e["lat1"], e["lat2"]) <= high_lat)
        & (F.greatest(e["lon1"], e["lon2"]) >= low_lon)
        & (F.least(e["lon1"], e["lon2"]) <= high_lon)
    )
    return overlap & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def cell_cover(boundaries: DataFrame, size: float = BUCKET, split: int = 4, steps: int = 1) -> DataFrame:
    """Cells of ``size`` degrees that cover each boundary: _bi, _bj, ``inner`` and, for the others, the edges to test.

    A tree of cells: the coarsest are ``split ** steps`` times as large. A cell that no edge meets is inside or outside as a whole;
    only cells with an edge are split on. An inner cell's points match without a test. Edges of other cells are
    those that a ray from inside the cell can meet.
    """
    coarse = size * split**steps
    held = bucket_index(boundaries, coarse)
    found: list[DataFrame] = []
    for step in range(steps + 1):
        own = size * split ** (steps - step)
        pad = 2 * geo.TOLERANCE
        box = [F.col("_bi") * own - pad, (F.col("_bi") + 1) * own + pad, F.col("_bj") * own - pad, (F.col("_bj") + 1) * own + pad]
        meets = F.exists(F.flatten(F.flatten("edges")), lambda e: _crosses(e, *box))
        centre = geo.contains(F.col("edges"), (F.col("_bi") + 0.5) * own, (F.col("_bj") + 0.5) * own, False)
        held = once(held, {"_meets": meets})
        held = once(held, {"inner": F.when(F.col("_meets"), F.lit(False)).when(centre, F.lit(True))}).filter("inner is not null")
        if step == steps:
            found.append(held)
            break
        parts = split ** (steps - step)

        def children(name: str, n: int) -> Column:
            return F.explode(F.sequence(F.col(name) * n, F.col(name) * n + (n - 1)))

        found.append(held.filter("inner").withColumn("_bi", children("_bi", parts)).withColumn("_bj", children("_bj", parts)))
        held = held.filter("not inner").withColumn("_bi", children("_bi", split)).withColumn("_bj", children("_bj", split))
        finer = size * split ** (steps - step - 1)
        touched = F.col("_bi").between(bucket("min_lat", finer), bucket("max_lat", finer)) & F.col("_bj").between(bucket("min_lon", finer), bucket("max_lon", finer))
        held = _clipped(held.filter(touched), finer)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumn("edges", F.when(~F.col("inner"), F.col("edges"))).drop("_meets", "min_lat", "max_lat", "min_lon", "max_lon")


def bbox_bucket_prefilter(points: DataFrame, boundaries: DataFrame, size: float = BUCKET) -> DataFrame:
    """Candidate (point, boundary) rows: same bucket and inside the bounds. An equi-join, never a nested loop."""
    index = bucket_index(boundaries, size)
    left = points.withColumns({"_bi": bucket("latitude", size), "_bj": bucket("longitude", size)})
    inside = F.col("latitude").between(F.col("min_lat"), F.col("max_lat")) & F.col("longitude").between(F.col("min_lon"), F.col("max_lon"))
    return left.join(index, ["_bi", "_bj"]).filter(inside)


def candidate_counts(points: DataFrame, boundaries: DataFrame, size: float = BUCKET) -> DataFrame:
    """Number of boundaries registered in each point's bucket."""
    index = bucket_index(boundaries, size, clip_edges=False).groupBy("_bi", "_bj").agg(F.count("*").alias("candidate_count"))
    left = points.withColumns({"_bi": bucket("latitude", size), "_bj": bucket("longitude", size)})
    out = left.join(index, ["_bi", "_bj"], "left").drop("_bi", "_bj")
    return out.withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)))


def point_in_polygon_join(points: DataFrame, boundaries: DataFrame, boundary: bool = True, size: float = BUCKET, on: Sequence[str] = ()) -> DataFrame:
    """Points with each boundary that holds them. ``on`` adds equal columns (such as a date) to the join.

    ``boundary`` decides whether points on an edge count as inside.
    """
    index = bucket_index(boundaries, size)
    left = points.withColumns({"_bi": bucket("latitude", size), "_bj": bucket("longitude", size)})
    joined = left.join(index, ["_bi", "_bj", *on])
    inside = F.col("latitude").between(F.col("min_lat"), F.col("max_lat")) & F.col("longitude").between(F.col("min_lon"), F.col("max_lon"))
    hit = inside & geo.contains(F.col("edges"), "latitude", "longitude", boundary)
    return joined.filter(hit).drop("_bi", "_bj", "edges", "min_lat", "max_lat", "min_lon", "max_lon")


def province_lookup(
    points: DataFrame,
    boundaries: DataFrame,
    name: str = "province_name",
    boundary_id: str | None = "boundary_id",
    geometry: str = "geometry",
    fmt: str = "geojson",
    digits: int = 4,
) -> DataFrame:
    """Distinct rounded coordinates with their province or ``unmatched``.

    Two provinces on one coordinate fail the job. Points are reduced to distinct coordinates first.
    """
    coords = round_coordinates(points.select("latitude", "longitude"), digits).dropna().distinct()
    ident = F.col(boundary_id).cast("string") if boundary_id and boundary_id in boundaries.columns else F.lit(None).cast("string")
    areas = boundaries.select(F.lower(text(name)).alias("_name"), ident.alias("_id"), geometry).filter(F.col("_name") != "")
    hits = point_in_polygon_join(coords, boundary_edges(areas, geometry, fmt))
    found = hits.groupBy("latitude", "longitude").agg(
        F.min("_name").alias("_low"), F.max("_name").alias("_high"), F.array_join(F.sort_array(F.collect_set("_id")), ",").alias("_ids")
    )
    one = check(F.col("_low") == F.col("_high"), F.col("_high"), "boundaries overlap: two provinces hold one coordinate")
    out = coords.join(found.select("latitude", "longitude", one.alias(name), "_ids"), ["latitude", "longitude"], "left")
    return out.select(
        "latitude",
        "longitude",
        name,
        F.when(F.col(name).isNull(), "unmatched").otherwise("matched").alias("match_status"),
        F.coalesce("_ids", F.lit("")).alias("matched_boundary_ids"),
    )


def edge_index(boundaries: DataFrame, reach: float) -> DataFrame:
    """One row per edge and cell (_ci, _cj) of ``reach`` degrees that comes within ``reach`` of it, with its boundary's bounds.

    A long border is spread over its cells edge by edge; no row holds more than one edge.
    """
    one = boundaries.select(F.explode(F.flatten(F.flatten("edges"))).alias("_e"), "min_lat", "max_lat", "min_lon", "max_lon")

    def span(a: str, b: str) -> Column:
        low, high = F.least(F.col(f"_e.{a}"), F.col(f"_e.{b}")), F.greatest(F.col(f"_e.{a}"), F.col(f"_e.{b}"))
        return F.explode(F.sequence(bucket(low - reach, reach), bucket(high + reach, reach)))

    cells = one.withColumn("_ci", span("lat1", "lat2")).withColumn("_cj", span("lon1", "lon2"))
    wide = 1.001 * reach
    box = [F.col("_ci") * reach - wide, (F.col("_ci") + 1) * reach + wide, F.col("_cj") * reach - wide, (F.col("_cj") + 1) * reach + wide]
    return cells.filter(_crosses(F.col("_e"), *box))


def nearest_boundary_distance(points: DataFrame, boundaries: DataFrame, cap: float = 0.5, size: float = BUCKET) -> DataFrame:
    """Add ``boundary_gap_degrees``: distance to the nearest candidate boundary, 0 inside.

    Candidates are the boundaries registered in the point's bucket, else in the buckets around it. Edges
    are measured only for boundaries whose bounds are within ``cap``; farther ones give the distance to
    their bounds. Points without candidates look at ever coarser buckets, by bounds alone.

    Bounds decide first: which ring of buckets counts, and the nearest of the far ones. Points inside are found by cell covers.
    The others meet edges in cells of a small reach; only points without an edge in reach go on to a reach four times as large.
    """
    spark = points.sparkSession
    at = ["latitude", "longitude"]
    coords = points.select(*at).distinct()
    bounds = ["min_lat", "max_lat", "min_lon", "max_lon"]
    boxes = boundaries.select(*bounds)
    own = (
        (F.col("_bi").between(bucket("min_lat", size), bucket("max_lat", size)))
        & (F.col("_bj").between(bucket("min_lon", size), bucket("max_lon", size)))
    )
    box = geo.box_distance("latitude", "longitude")
    left = coords.withColumns({"_bi": bucket("latitude", size), "_bj": bucket("longitude", size)})
    around = bucket_index(boxes, size, reach=1, clip_edges=False).withColumn("_ring", F.when(own, 0).otherwise(1))
    seen = left.join(around, ["_bi", "_bj"]).groupBy(*at, "_ring").agg(F.min(F.when(box > cap, box)).alias("_far"), F.bool_or(box <= cap).alias("_near"))
    seen = seen.groupBy(*at).agg(F.min(F.struct("_ring", "_far", "_near")).alias("_s")).select(*at, "_s.*")
    cover = cell_cover(boundaries.select("edges", *bounds), size)
    hit = F.col("inner") | geo.contains(F.col("edges"), "latitude", "longitude")
    inside = left.join(cover, ["_bi", "_bj"]).filter(hit).select(*at).distinct().withColumn("_in", F.lit(True))
    with temporary(spark) as keep:
        seen = cut_lineage(seen.join(inside, at, "left"), "boundary-candidates")
        found = [seen.filter("_in or not _near").select(*at, F.when(F.col("_in"), F.lit(0.0)).otherwise(F.col("_far")).alias("boundary_gap_degrees"))]
        rest, reach = seen.filter("_in is null and _near").select(*at, "_ring", "_far"), cap / 8
        while not rest.isEmpty():
            placed = rest.withColumns({"_ci": bucket("latitude", reach), "_cj": bucket("longitude", reach), "_bi": bucket("latitude", size), "_bj": bucket("longitude", size)})
            met = placed.join(edge_index(boundaries, reach), ["_ci", "_cj"])
            counts = (F.when(own, 0).otherwise(1) == F.col("_ring")) & (box <= cap)
            met = met.filter(counts).groupBy(*at).agg(F.min(geo.segment_distance(F.col("_e"), "latitude", "longitude")).alias("_gap"))
            gap = F.least(F.when(F.col("_gap") <= reach, F.col("_gap")), F.when(F.col("_far") <= reach, F.col("_far")))
            step = cut_lineage(rest.join(met, at, "left").select(*at, "_ring", "_far", gap.alias("boundary_gap_degrees")), "boundary-gaps")
            found.append(step.filter("boundary_gap_degrees is not null").select(*at, "boundary_gap_degrees"))
            rest, reach = step.filter("boundary_gap_degrees is null").drop("boundary_gap_degrees"), 4 * reach
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        for coarse in (64.0, 1024.0):
            none = coords.join(out, at, "left_anti")
            none = none.withColumns({"_bi": bucket("latitude", coarse), "_bj": bucket("longitude", coarse)})
            far = none.join(bucket_index(boxes, coarse, reach=1, clip_edges=False), ["_bi", "_bj"])
            out = out.unionByName(far.groupBy(*at).agg(F.min(box).alias("boundary_gap_degrees")))
        out = keep(out, "boundary-gaps")
    return points.join(out, at, "left")


def circle_cover(events: DataFrame, radius_km: float, size: float = BUCKET, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
    """One row per event and cell (_bi, _bj) that its circle can touch; events without a point have none."""
    dlat = math.degrees(radius_km / 6371.0) * 1.001
    edge = F.least(F.abs(F.col(latitude)) + dlat, F.lit(89.9))
    dlon = F.lit(dlat) / F.cos(F.radians(edge))

    def span(value: str, reach: Column) -> Column:
        return F.sequence(bucket(F.col(value) - reach, size), bucket(F.col(value) + reach, size))

    out = events.filter(F.col(latitude).isNotNull() & F.col(longitude).isNotNull())
    return out.withColumn("_bi", F.explode_outer(span(latitude, F.lit(dlat)))).withColumn("_bj", F.explode_outer(span(longitude, dlon)))


def within_radius_join(points: DataFrame, events: DataFrame, radius_km: float, on: Sequence[str] = ("date",), size: float = 0.5) -> DataFrame:
    """Point and event rows of equal ``on`` columns within a great-circle radius.

    Events are registered in every bucket their circle can touch; the join is by bucket and ``on``, the
    exact distance is its residual test. Event coordinates come as event_latitude and event_longitude.
    """
    centre = events.withColumnsRenamed({"latitude": "event_latitude", "longitude": "event_longitude"})
    right = circle_cover(centre, radius_km, size, "event_latitude", "event_longitude")
    left = points.withColumns({"_bi": bucket("latitude", size), "_bj": bucket("longitude", size)})
    distance = geo.haversine_km("latitude", "longitude", "event_latitude", "event_longitude")
    return left.join(right, ["_bi", "_bj", *on]).withColumn("distance_km", distance).filter(F.col("distance_km") <= radius_km).drop("_bi", "_bj")


def bbox_query(features: DataFrame, box: tuple[float, float, float, float], feature_type: str | None = None) -> DataFrame:
    out = features.filter(F.col("latitude").between(box[0], box[2]) & F.col("longitude").between(box[1], box[3]))
    return out.filter(F.col("feature_type") == feature_type) if feature_type else out
