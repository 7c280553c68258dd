"""Queries of spatial joins, province and season features and lookup audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwarden.operators import audit as au
from gridwarden.operators import events as ev
from gridwarden.operators import features as ft
from gridwarden.operators import spatial as sp
from gridwarden.workload.q_events import HAVERSINE, MERGED, merged
from gridwarden.workload.registry import day, query, r

BOX = """bx AS (SELECT province_name, boundary_id, n_nationkey % 7 = 0 AS holed, lat0 AS y0, ROUND(lat0 + 3, 4) AS y1, lon0 AS x0, ROUND(lon0 + 4, 4) AS x1,
  ROUND(lat0 + 1, 4) AS hy0, ROUND(lat0 + 2, 4) AS hy1, ROUND(lon0 + 1, 4) AS hx0, ROUND(lon0 + 2, 4) AS hx1 FROM boundaries)"""
IN_CLOSED = "{p}.latitude BETWEEN y0 AND y1 AND {p}.longitude BETWEEN x0 AND x1 AND NOT (holed AND {p}.latitude > hy0 AND {p}.latitude < hy1 AND {p}.longitude > hx0 AND {p}.longitude < hx1)"
IN_HALF_OPEN = "{p}.latitude >= y0 AND {p}.latitude < y1 AND {p}.longitude >= x0 AND {p}.longitude < x1 AND NOT (holed AND {p}.latitude >= hy0 AND {p}.latitude < hy1 AND {p}.longitude >= hx0 AND {p}.longitude < hx1)"
COORDS = "pt AS (SELECT DISTINCT latitude, longitude FROM grid_day)"
LOOKUP = f"""{BOX}, {COORDS}, hit AS (SELECT pt.*, max(province_name) AS province_name, string_agg(boundary_id, ',' ORDER BY boundary_id) AS ids FROM pt JOIN bx ON {IN_CLOSED.format(p='pt')} GROUP BY 1, 2),
lk AS (SELECT pt.latitude, pt.longitude, hit.province_name, CASE WHEN hit.ids IS NULL THEN 'unmatched' ELSE 'matched' END AS match_status, coalesce(hit.ids, '') AS ids
  FROM pt LEFT JOIN hit ON hit.latitude = pt.latitude AND hit.longitude = pt.longitude)"""
USES = ("grid_day", "boundaries")


def coords(t):
    return t.grid_day.select("latitude", "longitude").distinct()


def edges(t):
    return sp.boundary_edges(t.boundaries.select("province_name", "boundary_id", "geometry"), fmt="wkt")


def lookup(t):
    return sp.province_lookup(t.grid_day, t.boundaries, fmt="wkt")


@query(
    "parse_boundaries",
    ("boundaries",),
    f"WITH {BOX} SELECT boundary_id, CASE WHEN holed THEN 8 ELSE 4 END AS edges, CASE WHEN holed THEN 2 ELSE 1 END AS rings, y0 AS min_lat, y1 AS max_lat, x0 AS min_lon, x1 AS max_lon FROM bx",
)
def _(t):
    ring = F.transform(F.flatten("edges"), lambda e: F.size(F.filter(e, lambda s: (s["lat1"] != s["lat2"]) | (s["lon1"] != s["lon2"]))))
    count = F.aggregate(ring, F.lit(0), lambda a, b: a + b)
    return edges(t).select("boundary_id", count.alias("edges"), F.size(F.flatten("edges")).alias("rings"), "min_lat", "max_lat", "min_lon", "max_lon")


@query("point_in_polygon_join", USES, f"WITH {BOX}, {COORDS} SELECT pt.latitude, pt.longitude, bx.boundary_id FROM pt JOIN bx ON {IN_CLOSED.format(p='pt')}")
def _(t):
    return sp.point_in_polygon_join(coords(t), edges(t)).select("latitude", "longitude", "boundary_id")


@query("point_in_polygon_strict", USES, f"WITH {BOX}, {COORDS} SELECT pt.latitude, pt.longitude, bx.boundary_id FROM pt JOIN bx ON {IN_HALF_OPEN.format(p='pt')}")
def _(t):
    return sp.point_in_polygon_join(coords(t), edges(t), boundary=False).select("latitude", "longitude", "boundary_id")


@query(
    "bbox_bucket_prefilter",
    USES,
    f"""WITH {BOX}, {COORDS} SELECT pt.latitude, pt.longitude, bx.boundary_id FROM pt JOIN bx ON pt.latitude BETWEEN y0 AND y1 AND pt.longitude BETWEEN x0 AND x1""",
)
def _(t):
    return sp.bbox_bucket_prefilter(coords(t), edges(t)).select("latitude", "longitude", "boundary_id")


@query("province_lookup", USES, f"WITH {LOOKUP} SELECT latitude, longitude, province_name, match_status, ids AS matched_boundary_ids FROM lk")
def _(t):
    return lookup(t)


GAPS = f"""{BOX}, {COORDS}, g AS (SELECT pt.latitude, pt.longitude, sqrt(pow(greatest(y0 - pt.latitude, pt.latitude - y1, 0e0), 2) + pow(greatest(x0 - pt.longitude, pt.longitude - x1, 0e0), 2)) AS box,
  holed AND pt.latitude > hy0 AND pt.latitude < hy1 AND pt.longitude > hx0 AND pt.longitude < hx1 AS in_hole, least(pt.latitude - hy0, hy1 - pt.latitude, pt.longitude - hx0, hx1 - pt.longitude) AS to_hole,
  CASE WHEN floor(pt.latitude) BETWEEN floor(y0) AND floor(y1) AND floor(pt.longitude) BETWEEN floor(x0) AND floor(x1) THEN 0
    WHEN floor(pt.latitude) BETWEEN floor(y0) - 1 AND floor(y1) + 1 AND floor(pt.longitude) BETWEEN floor(x0) - 1 AND floor(x1) + 1 THEN 1 ELSE 2 END AS ring FROM pt CROSS JOIN bx),
gg AS (SELECT latitude, longitude, ring, min(CASE WHEN in_hole THEN to_hole ELSE box END) AS gap FROM g GROUP BY 1, 2, 3),
gap AS (SELECT latitude, longitude, arg_min(gap, ring) AS gap FROM gg GROUP BY 1, 2)"""


@query("nearest_boundary_distance", USES, f"WITH {GAPS} SELECT latitude, longitude, round(gap, 6) AS gap FROM gap")
def _(t):
    out = sp.nearest_boundary_distance(coords(t), edges(t))
    return out.select("latitude", "longitude", r("boundary_gap_degrees").alias("gap"))


@query(
    "within_radius_join",
    ("grid_day", "catalogue"),
    f"""WITH {MERGED}, p AS (SELECT DISTINCT date, latitude, longitude FROM grid_day), e AS (SELECT event_id, date, latitude, longitude FROM daily WHERE latitude IS NOT NULL)
    SELECT CAST(p.date AS STRING) AS date, p.latitude, p.longitude, e.event_id, round({HAVERSINE.format(a='p', b='e')}, 4) AS distance_km FROM p JOIN e ON e.date = p.date
    WHERE {HAVERSINE.format(a='p', b='e')} <= 60""",
)
def _(t):
    events = ev.expand_events_daily(merged(t)).filter("latitude is not null").select("event_id", "date", "latitude", "longitude")
    out = sp.within_radius_join(t.grid_day.select("date", "latitude", "longitude").distinct(), events, 60.0)
    return out.select(day("date").alias("date"), "latitude", "longitude", "event_id", r("distance_km", 4).alias("distance_km"))


@query("bbox_query", ("grid_day",), "SELECT row_id, grid_id FROM grid_day WHERE latitude BETWEEN 18 AND 20 AND longitude BETWEEN 36 AND 40 AND region_id = 'riyadh'")
def _(t):
    rows = t.grid_day.withColumnRenamed("region_id", "feature_type")
    return sp.bbox_query(rows, (18.0, 36.0, 20.0, 40.0), "riyadh").select("row_id", "grid_id")


@query(
    "attach_province",
    USES,
    f"""WITH {LOOKUP} SELECT g.row_id, g.grid_id, coalesce(nullif(lower(g.province_name), ''), lk.province_name) AS kept, lk.province_name AS found
    FROM grid_day g JOIN lk ON lk.latitude = g.latitude AND lk.longitude = g.longitude""",
)
def _(t):
    table = lookup(t)
    kept = ft.attach_province(t.grid_day, table).withColumnRenamed("province_name", "kept")
    out = ft.attach_province(kept, table, province="found")
    return out.select("row_id", "grid_id", "kept", "found")


@query("numeric_feature_columns", ("grid_day",), "SELECT count(*) AS rows, 23 AS features FROM grid_day")
def _(t):
    names = ft.numeric_feature_columns(t.grid_day.drop("row_id", "l_orderkey", "l_linenumber"))
    return t.grid_day.agg(F.count("*").alias("rows")).withColumn("features", F.lit(len(names)))


@query(
    "province_day_mean",
    ("grid_day",),
    """SELECT CAST(date AS STRING) AS date, lower(province_name) AS province_name, count(*) AS grid_cell_count, count(CASE WHEN source_status = 'degraded' THEN 1 END) AS degraded_grid_cell_count,
      round(avg(daily_precip_total), 6) AS daily_precip_total, round(avg(cape), 6) AS cape, round(avg(dust_aod), 6) AS dust_aod, 'flash_flood' AS hazard_type
    FROM grid_day WHERE province_name <> '' GROUP BY 1, 2""",
)
def _(t):
    out = ft.province_day_mean(t.grid_day.drop("l_orderkey", "l_linenumber", "row_id"))
    cols = ("daily_precip_total", "cape", "dust_aod")
    return out.select(day("date").alias("date"), "province_name", "grid_cell_count", "degraded_grid_cell_count", *[r(c).alias(c) for c in cols], "hazard_type")


@query(
    "dust_province_day",
    ("grid_day",),
    """SELECT CAST(date AS STRING) AS date, lower(province_name) AS province_name, CASE lower(province_name) WHEN 'eastern province' THEN 'eastern_province' WHEN 'aseer' THEN 'asir' ELSE lower(province_name) END AS region_id,
      count(*) AS grid_cell_count, round(avg(dust_aod), 6) AS dust_aod, round(avg(dust_surface_mass), 6) AS dust_surface_mass, 'region_day' AS sample_unit FROM grid_day WHERE province_name <> '' GROUP BY 1, 2, 3""",
)
def _(t):
    rows = t.grid_day.select("date", "province_name", "source_status", "dust_aod", "dust_column_mass", "dust_surface_mass")
    out = ft.dust_province_day(rows)
    return out.select(day("date").alias("date"), "province_name", "region_id", "grid_cell_count", r("dust_aod").alias("dust_aod"), r("dust_surface_mass").alias("dust_surface_mass"), "sample_unit")


@query(
    "region_day_topk_pool",
    ("grid_day",),
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY date, region_id ORDER BY heat_index_c DESC, grid_id, latitude, longitude) AS rn FROM grid_day)
    SELECT CAST(date AS STRING) AS date, region_id, count(*) AS grid_cell_count, count(CASE WHEN rn <= 3 THEN 1 END) AS pooled_grid_cell_count,
      count(CASE WHEN source_status = 'degraded' THEN 1 END) AS degraded_grid_cell_count, round(avg(CASE WHEN rn <= 3 THEN temp_c END), 6) AS temp_c,
      round(avg(CASE WHEN rn <= 3 THEN heat_index_c END), 6) AS heat_index_c, max(heat_index_c) AS heat_index_c_max, round(quantile_cont(heat_index_c, 9e-1), 6) AS heat_index_c_p90,
      round(quantile_cont(rh2m, 9e-1), 6) AS relative_humidity_percent_p90, min(rh2m) AS relative_humidity_percent_min, round(avg(heatwave_day_flag), 6) AS heatwave_grid_fraction,
      string_agg(DISTINCT CASE WHEN rn <= 3 THEN grid_id END, ',' ORDER BY CASE WHEN rn <= 3 THEN grid_id END) AS representative_grid_ids FROM k GROUP BY 1, 2""",
)
def _(t):
    out = ft.region_day_topk_pool(t.grid_day, "heat_index_c", 3)
    rounded = ("temp_c", "heat_index_c", "heat_index_c_p90", "relative_humidity_percent_p90", "heatwave_grid_fraction")
    return out.select(
        day("date").alias("date"), "region_id", "grid_cell_count", "pooled_grid_cell_count", "degraded_grid_cell_count", *[r(c).alias(c) for c in rounded], "heat_index_c_max",
        "relative_humidity_percent_min", "representative_grid_ids",
    )


_SEASON = "CASE WHEN month(date) IN (12, 1, 2) THEN 'winter' WHEN month(date) <= 5 THEN 'spring' WHEN month(date) <= 8 THEN 'summer' ELSE 'autumn' END"


@query(
    "region_season_aggregate",
    ("grid_day",),
    f"""SELECT region_id, CAST(year(date) AS INT) AS year, {_SEASON} AS season, CAST(count(*) AS DOUBLE) AS feature_row_count, CAST(min(date) AS STRING) AS aggregation_start_date,
      round(avg(temp_c), 6) AS temp_c, round(quantile_cont(temp_c, 9e-1), 6) AS temp_c_p90, round(quantile_cont(vpd_kpa, 9e-1), 6) AS vpd_kpa_p90,
      CAST(count(CASE WHEN temp_c >= 35 THEN 1 END) AS DOUBLE) AS temp_c_days_ge_35, CAST(count(CASE WHEN tmax_c >= 45 THEN 1 END) AS DOUBLE) AS tmax_c_days_ge_45,
      CAST(count(CASE WHEN vpd_kpa >= 3 THEN 1 END) AS DOUBLE) AS vpd_kpa_days_ge_3, sum(heatwave_day_flag) AS heatwave_day_flag_sum, max(heatwave_duration_days) AS heatwave_duration_days,
      min(t2m_anomaly_c) AS t2m_anomaly_c_min, round(quantile_cont(rh2m, 1e-1), 6) AS relative_humidity_percent_p10 FROM grid_day GROUP BY 1, 2, 3""",
)
def _(t):
    rows = t.grid_day.withColumnsRenamed({"wind10_speed": "wind_speed_mps", "rh2m": "relative_humidity_percent"})
    out = ft.region_season_aggregate(rows, "region-season")
    plain = ("temp_c_days_ge_35", "tmax_c_days_ge_45", "vpd_kpa_days_ge_3", "heatwave_day_flag_sum", "heatwave_duration_days", "t2m_anomaly_c_min")
    rounded = ("temp_c", "temp_c_p90", "vpd_kpa_p90", "relative_humidity_percent_p10")
    return out.select("region_id", "year", "season", "feature_row_count", day("aggregation_start_date").alias("aggregation_start_date"), *[r(c).alias(c) for c in rounded], *plain)


@query("season_of", ("grid_day",), f"SELECT {_SEASON} AS season, CAST(month(date) AS INT) AS month, count(*) AS n FROM grid_day GROUP BY 1, 2")
def _(t):
    return t.grid_day.groupBy(ft.season_of("date").alias("season"), F.month("date").alias("month")).agg(F.count("*").alias("n"))


@query("coordinate_counts", ("grid_day",), "SELECT latitude, longitude, count(*) AS feature_row_count FROM grid_day GROUP BY 1, 2")
def _(t):
    return ft.coordinate_counts(t.grid_day)


_BANDS = "CASE WHEN {0} <= 5e-2 THEN 'within_0_05_degrees' WHEN {0} <= 1e-1 THEN 'within_0_10_degrees' WHEN {0} <= 25e-2 THEN 'within_0_25_degrees' WHEN {0} <= 5e-1 THEN 'within_0_50_degrees' ELSE 'beyond_0_50_degrees' END"
_LOOKUP_AUDIT = f"""{GAPS}, {LOOKUP.split(COORDS + ', ')[1]}, wide AS (SELECT min(y0) AS a, max(y1) AS b, min(x0) AS c, max(x1) AS d FROM bx),
n AS (SELECT latitude, longitude, count(*) AS feature_row_count FROM grid_day GROUP BY 1, 2),
au AS (SELECT lk.latitude, lk.longitude, n.feature_row_count, ROUND(gap.gap - 1e-9, 6) AS gap, lk.latitude BETWEEN a AND b AND lk.longitude BETWEEN c AND d AS inner_box
  FROM lk JOIN gap ON gap.latitude = lk.latitude AND gap.longitude = lk.longitude JOIN n ON n.latitude = lk.latitude AND n.longitude = lk.longitude CROSS JOIN wide WHERE match_status = 'unmatched')"""


def audited(t):
    return au.audit_lookup(lookup(t), t.boundaries, t.grid_day, fmt="wkt")


@query(
    "audit_lookup",
    USES,
    f"""WITH {_LOOKUP_AUDIT} SELECT latitude, longitude, CASE WHEN inner_box THEN 'inside_boundary_bbox_outside_polygon' ELSE 'outside_boundary_bbox' END AS class,
      round(CASE WHEN inner_box THEN gap END, 5) AS gap, feature_row_count FROM au""",
)
def _(t):
    return audited(t).select("latitude", "longitude", F.col("boundary_classification").alias("class"), r("boundary_gap_degrees", 5).alias("gap"), "feature_row_count")


@query(
    "lookup_hotspots",
    USES,
    f"""WITH {_LOOKUP_AUDIT} SELECT floor(latitude) AS lat_bin_start, floor(longitude) AS lon_bin_start, count(*) AS unique_coordinate_rows, CAST(sum(feature_row_count) AS BIGINT) AS feature_row_count
    FROM au GROUP BY 1, 2 ORDER BY 4 DESC, 3 DESC, 1, 2 LIMIT 10""",
)
def _(t):
    return au.lookup_hotspots(audited(t), 10)


@query(
    "lookup_summary",
    USES,
    f"""WITH {LOOKUP} SELECT count(*) AS unique_coordinate_rows, count(province_name) AS matched_coordinate_rows, count(*) - count(province_name) AS unmatched_coordinate_rows,
      min(CASE WHEN province_name IS NULL THEN latitude END) AS min_latitude, max(CASE WHEN province_name IS NULL THEN latitude END) AS max_latitude,
      min(CASE WHEN province_name IS NULL THEN longitude END) AS min_longitude, max(CASE WHEN province_name IS NULL THEN longitude END) AS max_longitude FROM lk""",
)
def _(t):
    return au.lookup_summary(lookup(t))


@query(
    "candidate_stats",
    USES,
    f"""WITH {BOX}, {COORDS}, c AS (SELECT pt.latitude, pt.longitude, count(bx.boundary_id) AS n FROM pt LEFT JOIN bx ON floor(pt.latitude) BETWEEN floor(y0) AND floor(y1)
      AND floor(pt.longitude) BETWEEN floor(x0) AND floor(x1) GROUP BY 1, 2)
    SELECT min(n) AS min, quantile_cont(n, 5e-1) AS p50, quantile_cont(n, 95e-2) AS p95, max(n) AS max, round(avg(n), 6) AS mean FROM c""",
)
def _(t):
    return au.candidate_stats(sp.candidate_counts(coords(t), edges(t))).withColumn("mean", r("mean"))
