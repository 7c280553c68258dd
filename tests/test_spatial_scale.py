"""Cell covers, the edge index, as-of ranges and quantile brackets against brute force."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from gridwarden.functions import geometry as geo
from gridwarden.operators import labels as lb
from gridwarden.operators import spatial as sp
from gridwarden.operators import temporal as tm
from gridwarden.operators.quantiles import exact_quantiles


def star(rng, lat, lon, size, corners):
    """A ring with spikes, as (lon, lat) text."""
    points = []
    for i in range(corners):
        angle, reach = 2 * math.pi * i / corners, size * rng.uniform(0.3, 1)
        points.append((lon + reach * math.cos(angle), lat + reach * math.sin(angle)))
    return points + points[:1]


def wkt(*rings):
    return "POLYGON(" + ", ".join("(" + ", ".join(f"{x} {y}" for x, y in r) + ")" for r in rings) + ")"


@pytest.mark.parametrize("steps", [0, 1, 2])
def test_cell_cover_equals_the_plain_test(spark, steps):
    rng = random.Random(steps)
    rows = [(i, wkt(star(rng, rng.uniform(16, 30), rng.uniform(35, 50), rng.choice([0.2, 2, 7]), 9))) for i in range(8)]
    rows.append((8, wkt(star(rng, 22, 44, 9, 30), star(rng, 22, 44, 2, 8))))
    shapes = sp.boundary_edges(spark.createDataFrame(rows, "id int, geometry string"), fmt="wkt")
    points = spark.createDataFrame([(rng.uniform(14, 34), rng.uniform(33, 54)) for _ in range(400)] + [(20.0, 40.0), (21.0, 44.0)], "latitude double, longitude double")
    plain = points.crossJoin(shapes).filter(geo.contains(F.col("edges"), "latitude", "longitude", False)).select("id", "latitude", "longitude")
    cover = sp.cell_cover(shapes, 1.0, 3, steps)
    assert cover.groupBy("id", "_bi", "_bj").count().filter("count > 1").isEmpty()
    assert steps == 0 or cover.filter("inner and edges is null").count() > 20
    met = points.withColumns({"_bi": sp.bucket("latitude"), "_bj": sp.bucket("longitude")}).join(cover, ["_bi", "_bj"])
    got = met.filter(F.col("inner") | geo.contains(F.col("edges"), "latitude", "longitude", False)).select("id", "latitude", "longitude")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_nearest_edge_of_a_long_coast(spark):
    """A coast of 10^5 edges, a square that holds points, and one far away."""
    rng = random.Random(7)
    coast = [(34 + 20 * i / 50_000, 20 + math.sin(i / 700) + rng.uniform(0, 1e-4)) for i in range(50_001)]
    coast += [(x, y - 0.3) for x, y in reversed(coast)]
    rows = [(0, wkt([*coast, coast[0]])), (1, wkt([(40, 25), (42, 25), (42, 27), (40, 27), (40, 25)])), (2, wkt([(100, 60), (101, 60), (101, 61), (100, 60)]))]
    points = [(rng.uniform(18, 27.4), rng.uniform(34.2, 53.8)) for _ in range(300)] + [(26.0, 41.0), (70.0, 120.0)]
    shapes = sp.boundary_edges(spark.createDataFrame(rows, "id int, geometry string"), fmt="wkt")
    df = spark.createDataFrame(points, "latitude double, longitude double")
    got = {(r["latitude"], r["longitude"]): r["boundary_gap_degrees"] for r in sp.nearest_boundary_distance(df, shapes).collect()}
    inside = {(r["latitude"], r["longitude"], r["id"]) for r in sp.point_in_polygon_join(df, shapes).select("latitude", "longitude", "id").collect()}
    import numpy as np

    def distance(ring, y, x):
        a = np.array(ring)
        d, p = a[1:] - a[:-1], np.array([x, y]) - a[:-1]
        t = np.clip((p * d).sum(axis=1) / np.maximum((d * d).sum(axis=1), 1e-300), 0, 1)
        return float(np.hypot(*(p - t[:, None] * d).T).min())

    rings = {0: [*coast, coast[0]], 1: [(40, 25), (42, 25), (42, 27), (40, 27), (40, 25)], 2: [(100, 60), (101, 60), (101, 61), (100, 60)]}
    boxes = {k: (min(y for _, y in r), max(y for _, y in r), min(x for x, _ in r), max(x for x, _ in r)) for k, r in rings.items()}
    for y, x in points:
        best = {}
        for k, (y0, y1, x0, x1) in boxes.items():
            own = math.floor(y0) <= math.floor(y) <= math.floor(y1) and math.floor(x0) <= math.floor(x) <= math.floor(x1)
            by = math.floor(y0) - 1 <= math.floor(y) <= math.floor(y1) + 1 and math.floor(x0) - 1 <= math.floor(x) <= math.floor(x1) + 1
            box = math.hypot(max(y0 - y, y - y1, 0), max(x0 - x, x - x1, 0))
            gap = 0.0 if (y, x, k) in inside else box if box > 0.5 else distance(rings[k], y, x)
            ring = 0 if own else 1 if by else 2
            best[ring] = min(gap if ring < 2 else box, best.get(ring, math.inf))
        assert got[y, x] == pytest.approx(best[min(best)], abs=1e-9)
    index = sp.edge_index(shapes, 0.0625).groupBy("_ci", "_cj").count()
    assert index.agg(F.max("count")).first()[0] < 3_000


def test_nearest_time_of_one_hot_key(spark):
    """One key with all rows, many targets at one instant, null keys; spread over ranges."""
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    series = [("hot", start + dt.timedelta(seconds=rng.randrange(400_000)), float(i)) for i in range(3_000)] + [(None, start, -1.0)]
    targets = [(i, "hot", start + dt.timedelta(seconds=rng.choice([200_000, rng.randrange(400_000)]))) for i in range(2_000)] + [(9_000, None, start), (9_001, "none", start)]
    a, b = spark.createDataFrame(targets, "id int, k string, time timestamp"), spark.createDataFrame(series, "k string, time timestamp, v double")
    got = {r["id"]: r["v"] for r in tm.nearest_time_select(a.repartition(7), b, ["v"], 60, ["k"]).collect()}
    of = {}
    for k, t, v in series:
        of[k, t] = min(v, of.get((k, t), math.inf))
    for i, k, t in targets:
        near = min(((abs((s - t).total_seconds()), -(s - t).total_seconds(), v) for (q, s), v in of.items() if q == k), default=(1e9, 0, None))
        assert got[i] == (near[2] if near[0] <= 60 else None)


@pytest.mark.parametrize("kind", ["spread", "ties", "tiny"])
def test_brackets_hold_the_ranks(spark, kind):
    rng = random.Random(kind)
    draw = {"spread": lambda: rng.lognormvariate(0, 3) * rng.choice([-1, 1]), "ties": lambda: float(rng.randrange(4)), "tiny": lambda: rng.gauss(0, 1)}[kind]
    sizes = {"spread": [40_000, 900, 60], "ties": [30_000, 11], "tiny": list(range(1, 40))}[kind]
    rows = [(g, draw(), draw() if rng.random() < 0.8 else None) for g, n in enumerate(sizes) for _ in range(n)] + [(0, float("nan"), None)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], {"a": [0.1, 0.9], "b": shares}).collect()}
    for g in range(len(sizes)):
        for name, at in (("a", [0.1, 0.9]), ("b", shares)):
            values = sorted(x for k, a, b in rows if k == g and (x := a if name == "a" else b) is not None and x == x)
            for p in at:
                if not values:
                    assert got[g][f"{name}_p{round(p * 100)}"] is None
                    continue
                low = values[math.floor((len(values) - 1) * p)]
                high = values[math.ceil((len(values) - 1) * p)]
                part = (len(values) - 1) * p - math.floor((len(values) - 1) * p)
                assert got[g][f"{name}_p{round(p * 100)}"] == pytest.approx(low + (high - low) * part, abs=1e-9)


def test_flood_provenance(spark):
    square = "POLYGON((39.10 21.40, 39.30 21.40, 39.30 21.60, 39.10 21.60, 39.10 21.40))"
    rows = [("e1", "2022-11-24", "Jeddah", None, None, square), ("e2", "2022-11-24", "Jeddah", 21.5, 39.2, None), ("e3", "2022-11-24", "Hidden", None, None, None)]
    daily = spark.createDataFrame([(*r, "medium", "seed") for r in rows], "event_id string, date string, location_name string, latitude double, longitude double, geometry_wkt string, spatial_confidence string, validation_status string")
    samples = spark.createDataFrame([("2022-11-24", 21.5, 39.2), ("2022-11-25", 21.5, 39.2), ("2022-11-24", None, 39.2)], "date string, latitude double, longitude double")
    got = [json.loads(r["label_provenance"]) for r in lb.label_flash_flood(samples, daily).orderBy("date", F.col("latitude").desc_nulls_last()).collect()]
    assert got[0]["matched_event_ids"] == ["e1", "e2"] and got[0]["mapping_modes"] == ["geometry_wkt", "point_buffer"] and got[0]["matched_geometry_wkts"] == [square]
    assert got[0]["day_event_mapping_modes"] == ["geometry_wkt", "point_buffer", "uncertain"] and got[0]["day_unsupported_event_count"] == 1
    assert got[1]["matched_event_ids"] == [] and got[1]["date"] == "2022-11-24"
    assert got[2]["event_count_for_day"] == 0 and got[2]["day_event_mapping_modes"] == [] and got[2]["day_has_supported_event"] is False
    assert {len(g) for g in got} == {18}
