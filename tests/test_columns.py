"""Golden values of the column library."""

import pytest
from pyspark.sql import functions as F

from gridwarden.functions import geometry as geo
from gridwarden.functions import physical as ph
from gridwarden.functions.text import resolve_heat_regions, resolve_provinces, residual_tokens
from gridwarden.operators.risk import RULES, risk_level, scan_risks


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_physical_values(spark):
    assert one(spark, ph.vpd_kpa(30.0, 50.0)) == pytest.approx(2.12, rel=0.03)
    assert one(spark, ph.vpd_kpa(None, 50.0)) is None
    assert one(spark, ph.vpd_kpa(35.0, 0.0)) > 5
    assert one(spark, ph.vpd_kpa(35.0, 100.0)) == 0
    assert 38 < one(spark, ph.heat_index_c(32.0, 70.0)) < 43
    assert one(spark, ph.heat_index_c(20.0, 80.0)) == pytest.approx(20)
    assert one(spark, ph.heat_index_c(50.0, 40.0)) > 60
    assert one(spark, ph.precip_flag(60.0)) == 2
    assert one(spark, ph.speed_shear(20.0, 8.0)) == 12


@pytest.mark.parametrize("p,level", [(0.1, "low"), (0.25, "medium"), (0.5, "high"), (0.75, "extreme")])
def test_levels(spark, p, level):
    assert one(spark, risk_level(F.lit(p))) == level


@pytest.mark.parametrize(
    "text,regions",
    [
        ("Al-Qaisumah", ["eastern_province"]),
        ("Mecca and Hajj sites", ["makkah"]),
        ("Eastern Province and Riyadh", ["eastern_province", "riyadh"]),
        ("Al-Ahsa, Al-Kharj", ["eastern_province", "riyadh"]),
        ("Multiple cities", ["saudi_arabia"]),
    ],
)
def test_heat_regions(spark, text, regions):
    assert one(spark, resolve_heat_regions(F.lit(text))) == regions


def test_provinces_in_order_and_residual(spark):
    assert one(spark, resolve_provinces(F.lit("Riyadh and Jeddah"))) == ["riyadh", "makkah"]
    left = residual_tokens(F.lit("north of Jeddah and the coast"), F.array(F.lit("makkah")))
    assert one(spark, left) == ["north", "of", "coast"]


def test_point_record_gets_five_risks(spark):
    row = dict(temp_c=43.5, rh_percent=62.0, precip_1h_mm=18.0, precip_6h_mm=72.0, precip_24h_mm=96.0, wind_speed_mps=13.0, wind_gust_mps=21.0,
               soil_moisture_frac=0.11, slope_deg=8.0, impervious_frac=0.42, vegetation_index=0.12, pressure_hpa=1005.0, visibility_km=6.0, coastal_distance_km=8.0)
    df = spark.createDataFrame([(1, *row.values())], "id int, " + ", ".join(f"{c} double" for c in row))
    rows = scan_risks(df, ["id"]).collect()
    assert {r["hazard_type"] for r in rows} == set(RULES)
    assert all(0 <= r["risk_probability"] <= 1 and r["contributing_factors"] for r in rows)


def test_wkt_boundary_and_hole(spark):
    wkt = F.lit("MULTIPOLYGON(((0 0, 4 0, 4 4, 0 4, 0 0),(1 1, 2 1, 2 2, 1 2, 1 1)),((10 10, 11 10, 11 11, 10 11, 10 10)))")
    edges = geo.ring_edges(geo.polygons_from_wkt(wkt))

    def inside(lat, lon, boundary=True):
        return one(spark, geo.contains(edges, F.lit(lat), F.lit(lon), boundary))

    assert inside(3.0, 3.0) and inside(10.5, 10.5) and not inside(1.5, 1.5) and not inside(5.0, 5.0)
    assert inside(4.0, 2.0) and inside(1.0, 1.5)
    assert not inside(4.0, 2.0, boundary=False)
    assert one(spark, geo.polygons_from_wkt(F.lit("LINESTRING(0 0, 1 1)"))) is None
