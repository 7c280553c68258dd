"""Table operators on small frames with exact results, and skew cases against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridwarden.operators import events as ev
from gridwarden.operators import features as ft
from gridwarden.operators import labels as lb
from gridwarden.operators import spatial as sp
from gridwarden.operators import temporal as tm
from gridwarden.operators import training as tr
from gridwarden.operators.quantiles import binned_quantiles, exact_quantiles
from gridwarden.sources import elevation, tables


def events(spark, *rows):
    names = "ingest_seq long, start_date string, location_name string, latitude double, longitude double, geometry_wkt string, source_record_id string, validation_status string"
    return ev.standardize_events(spark.createDataFrame(rows, names), "feed")


def test_daily_precip(spark):
    rows = [(dt.datetime(2025, 1, d, h), 24.0, 46.0, p) for d, h, p in ((1, 0, 10.0), (1, 12, 20.0), (2, 0, 30.0), (2, 12, 25.0))]
    df = spark.createDataFrame(rows, "time timestamp, latitude double, longitude double, precipitation double")
    got = {r["date"].day: (r["daily_precip_total_mm"], r["daily_precip_extreme_flag"]) for r in tm.daily_precip_stats(df).collect()}
    assert got == {1: (30.0, 1.0), 2: (55.0, 2.0)}


def test_merge_rules(spark):
    seed = events(spark, (0, "2022-11-24", "Jeddah", None, None, None, "s", "seed"))
    verified = events(spark, (1, "2022-11-24", "jeddah", 21.5, 39.2, None, "v", "verified"))
    assert [r["validation_status"] for r in ev.merge_event_sources(seed, verified).collect()] == ["verified"]
    drift = events(spark, (0, "2022-11-24", "Jeddah", 21.4858, 39.19, None, "a", "verified"), (1, "2022-11-24", "Jeddah", 21.62, 39.2, None, "b", "verified"))
    assert [r["source_record_id"] for r in ev.merge_event_sources(None, drift).collect()] == ["a"]


def test_merge_fold_across_chunks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ev, "FOLD_CHUNK", 3)
    rng = random.Random(5)
    rows = [(i, "2022-01-01", "one place", *rng.choice([(None, None), (1.0, 2.0)]), None, rng.choice(["", f"r{i}"]), rng.choice(["verified", "draft"])) for i in range(40)]

    def kind(r):
        return (r[7] == "verified", 1 if r[3] is not None else 0, r[6] != "")

    now = rows[0]
    for new in rows[1:]:
        a, b = kind(new), kind(now)
        if (a[0] and not b[0]) or a[1] > b[1] or (a[2] and not b[2]):
            now = new
    # an empty record id falls back to nothing here, as the frame has no other id column
    got = ev.merge_event_sources(None, events(spark, *rows).withColumn("notes", F.col("ingest_seq").cast("string"))).collect()
    assert [r["notes"] for r in got] == [str(now[0])]


def flood_daily(spark, **over):
    row = dict(event_id="e1", date="2022-11-24", location_name="Jeddah", latitude=21.4858, longitude=39.1925, geometry_wkt=None, spatial_confidence="medium", validation_status="seed")
    row |= over
    return spark.createDataFrame([tuple(row.values())], "event_id string, date string, location_name string, latitude double, longitude double, geometry_wkt string, spatial_confidence string, validation_status string")


def test_flood_point_buffer(spark):
    samples = spark.createDataFrame([("2022-11-24", 21.49, 39.20), ("2022-11-24", 24.71, 46.67), ("2022-11-25", 24.71, 46.67)], "date string, latitude double, longitude double")
    got = lb.label_flash_flood(samples, flood_daily(spark), lb.FloodLabelPolicy(event_day_negatives=False)).orderBy("date", "latitude").collect()
    assert [r["label_status"] for r in got] == ["positive", "uncertain", "negative"]


def test_flood_polygon_and_province(spark):
    square = "POLYGON((39.10 21.40, 39.30 21.40, 39.30 21.60, 39.10 21.60, 39.10 21.40))"
    samples = spark.createDataFrame([("2022-11-24", 21.50, 39.20), ("2022-11-24", 24.71, 46.67)], "date string, latitude double, longitude double")
    got = lb.label_flash_flood(samples, flood_daily(spark, geometry_wkt=square)).orderBy("latitude").collect()
    assert [r["label_source_mode"] for r in got] == ["geometry_wkt", "outside_event_footprint"]
    named = spark.createDataFrame([("2022-12-23", "Makkah"), ("2022-12-23", "Riyadh")], "date string, province_name string")
    mecca = flood_daily(spark, date="2022-12-23", location_name="Mecca", latitude=None, longitude=None)
    got = lb.label_flash_flood(named, mecca).orderBy("province_name").collect()
    assert [r["label_source_mode"] for r in got] == ["province_day", "outside_event_footprint"]


def test_dust_labels(spark):
    samples = spark.createDataFrame([("2025-05-04", "Qassim"), ("2025-05-04", "Madinah"), ("2025-05-06", "Madinah")], "date string, region_id string")
    daily = spark.createDataFrame([("d1", "2025-05-04", "Qassim and Riyadh", "verified")], "event_id string, date string, location_name string, validation_status string")
    got = lb.label_dust_storm(samples, daily).orderBy("date", F.desc("region_id")).collect()
    assert [r["label_source_mode"] for r in got] == ["region_day_text", "outside_event_regions", "no_event_day"]


def test_lookup_and_overlap(spark):
    points = spark.createDataFrame([(21.5, 39.2), (21.5, 39.2), (24.71, 46.67), (18.2, 42.5)], "latitude double, longitude double")

    def square(x, y, s):
        return f"POLYGON(({x} {y}, {x + s} {y}, {x + s} {y + s}, {x} {y + s}, {x} {y}))"

    areas = spark.createDataFrame([("m1", "Makkah", square(39.0, 21.3, 0.4)), ("r1", "Riyadh", square(46.5, 24.5, 0.4))], "boundary_id string, province_name string, geometry string")
    got = {r["latitude"]: (r["province_name"], r["match_status"]) for r in sp.province_lookup(points, areas, fmt="wkt").collect()}
    assert got == {21.5: ("makkah", "matched"), 24.71: ("riyadh", "matched"), 18.2: (None, "unmatched")}
    twice = areas.unionByName(spark.createDataFrame([("x", "Asir", square(39.0, 21.3, 0.4))], areas.schema))
    with pytest.raises(Exception, match="overlap"):
        sp.province_lookup(points, twice, fmt="wkt").collect()


def test_conflicting_lookup_fails(spark):
    features = spark.createDataFrame([(21.50004, 39.20004)], "latitude double, longitude double")
    lookup = spark.createDataFrame([(21.5, 39.2, "makkah"), (21.5, 39.2, "riyadh")], "latitude double, longitude double, province_name string")
    with pytest.raises(Exception, match="conflicting"):
        ft.attach_province(features, lookup, 2).collect()
    assert ft.attach_province(features, lookup.limit(1), 2).first()["province_name"] == "makkah"


def test_quantiles_of_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice([rng.gauss(0, 9), 3.0, 0.0])) for _ in range(3000)] + [("small", float(i)) for i in range(7)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {r["k"]: [round(x, 9) for x in r["q"]] for r in df.groupBy("k").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q")).collect()}
    for frame in (binned_quantiles(df, ["k"], {"v": [0.1, 0.5, 0.9]}), exact_quantiles(df, ["k"], {"v": [0.1, 0.5, 0.9]})):
        got = {r["k"]: [round(r[c], 9) for c in ("v_p10", "v_p50", "v_p90")] for r in frame.collect()}
        assert got == want


def test_sampling_and_split_are_exact(spark):
    rows = [(i, "positive" if i < 5 else "negative", "outside_event_region" if i < 12 else "no_event_day") for i in range(400)]
    df = spark.createDataFrame(rows, "id int, label_status string, label_source_mode string")
    got = tr.sample_negatives(df, ["id"], 20).collect()
    assert len(got) == 25 and sum(r["label_source_mode"] == "outside_event_region" and r["id"] >= 5 for r in got) == 7
    split = tr.group_shuffle_split(df.withColumn("g", F.col("id") % 10), "g", 0.2)
    assert split.filter("is_validation").count() == 80
    assert tr.group_shuffle_split(df.withColumn("g", F.lit(1)), "g").filter("is_validation").count() == 0


def test_nearest_time_ties_and_tolerance(spark):
    def at(h, m=0):
        return dt.datetime(2024, 1, 2, h, m)

    series = spark.createDataFrame([(at(0), 1.0), (at(2), 2.0), (at(20), 3.0)], "time timestamp, v double")
    targets = spark.createDataFrame([(1, at(1)), (2, at(0, 30)), (3, at(9))], "id int, time timestamp")
    got = {r["id"]: r["v"] for r in tm.nearest_time_select(targets, series, ["v"], 3 * 3600).collect()}
    assert got == {1: 2.0, 2: 1.0, 3: None}


def test_elevation_tile(spark, tmp_path):
    import zipfile

    import numpy as np

    heights = np.array([[101, 102, 103], [201, 303, 203], [301, 302, 202]], dtype=">i2")
    with zipfile.ZipFile(tmp_path / "N17E042.SRTM.hgt.zip", "w") as archive:
        archive.writestr("N17E042.hgt", heights.tobytes())
    points = spark.createDataFrame([(18.0, 42.0), (17.5, 42.5), (17.0, 43.0), (10.0, 10.0)], "latitude double, longitude double")
    got = {r["latitude"]: r["elevation_m"] for r in elevation.attach_elevation(points, str(tmp_path)).collect()}
    assert got == {18.0: 101.0, 17.5: 303.0, 17.0: 202.0, 10.0: None}


def test_file_dates(spark):
    names = spark.createDataFrame([("days_20240105.parquet",), ("a_20241399.nc4",), ("plain.parquet",)], "n string")
    got = [r["d"] for r in names.select(tables.file_date(F.col("n")).alias("d")).collect()]
    assert got == [dt.date(2024, 1, 5), None, None]


def test_quantiles_of_a_null_key_and_of_missing_values(spark):
    """A hot null key is a group, and a group without values has nulls."""
    rows = [(None, float(i)) for i in range(1001)] + [("a", None), ("b", 1.0), ("b", 2.0), ("b", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    out = {r["k"]: (r["v_p50"], r["v_p90"]) for r in exact_quantiles(df, ["k"], {"v": [0.5, 0.9]}).collect()}
    assert out == {None: (500.0, 900.0), "a": (None, None), "b": (1.5, 1.9)}
