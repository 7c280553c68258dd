"""Registered queries equal their SQL on the smallest tables; names and shapes of the driver contract."""

import pytest

import __spark_entry__ as driver
from tests.compare import database, difference

FOLDER = "/root/testdata/sf0.001"
QUICK = (
    "build_daily_indicators", "heat_index_variants", "derive_forecast_fields", "regrid_bilinear", "deaccumulate_daily", "nearest_time_select", "completeness_missing", "slope_deg", "vapor_integrals",
    "resolve_source", "grounding_issues", "scan_risks", "warning_product", "merge_event_sources", "label_flash_flood_grid", "label_extreme_heat", "point_in_polygon_join", "nearest_boundary_distance",
    "region_day_topk_pool", "supervised_join_dry_heat", "training_target_summary", "audit_labels", "stream_daily_precip", "stream_heatwave_runs", "incremental_upsert", "elevation_from_tiles",
)


@pytest.fixture(scope="module")
def db():
    return database(FOLDER)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, db, name):
    got = driver.queries()[name](spark, FOLDER).toPandas()
    assert len(got) > 0
    assert difference(got, db.execute(driver.oracle_sql()[name]).df()) is None


def test_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).columns
