"""Queries of grid shaping: cells, crops, regridding, levels, points, slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwarden.operators import grid as g
from gridwarden.workload.registry import day, query, r


@query(
    "standard_grid",
    ("obs",),
    """WITH n AS (SELECT latitude, longitude, count(*) AS rows FROM obs GROUP BY 1, 2),
    y AS (SELECT (160 + i) / 1e1 AS latitude FROM range(161) t(i)), x AS (SELECT (340 + i) / 1e1 AS longitude FROM range(221) t(i))
    SELECT printf('cell_%.1f_%.1f', y.latitude, x.longitude) AS grid_id, y.latitude, x.longitude, coalesce(n.rows, 0) AS rows
    FROM y CROSS JOIN x LEFT JOIN n ON n.latitude = y.latitude AND n.longitude = x.longitude""",
)
def _(t):
    cells = g.standard_grid(t.spark)
    counts = t.obs.groupBy(F.round("latitude", 10).alias("latitude"), F.round("longitude", 10).alias("longitude")).agg(F.count("*").alias("rows"))
    out = cells.join(counts, ["latitude", "longitude"], "left").na.fill(0, ["rows"])
    return out.select("grid_id", "latitude", "longitude", "rows")


@query("crop", ("obs",), "SELECT event_id, latitude, longitude FROM obs WHERE latitude BETWEEN 18 AND 24 AND longitude BETWEEN 36 AND 50")
def _(t):
    return g.crop(t.obs, (18.0, 36.0, 24.0, 50.0)).select("event_id", "latitude", "longitude")


@query("normalize_coords", ("obs",), "SELECT event_id, time, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM obs")
def _(t):
    swapped = t.obs.select("event_id", F.col("time").alias("valid_time"), F.col("longitude").alias("lat"), F.col("latitude").alias("lon"))
    out = g.normalize_coords(swapped)
    return out.select("event_id", "time", r("latitude").alias("latitude"), r("longitude").alias("longitude"))


@query(
    "wrap_longitudes",
    ("obs",),
    """SELECT event_id, round(CASE WHEN longitude * 5 > 180 THEN (longitude * 5 + 180) % 360e0 - 180 ELSE longitude * 5 END, 6) AS signed,
      round(CASE WHEN longitude - 45 < 0 THEN longitude - 45 + 360 ELSE longitude - 45 END, 6) AS positive FROM obs""",
)
def _(t):
    far = g.normalize_coords(t.obs.select("event_id", "latitude", (F.col("longitude") * 5).alias("longitude")), (-90.0, -180.0, 90.0, 180.0))
    west = g.normalize_coords(t.obs.select("event_id", "latitude", (F.col("longitude") - 45).alias("longitude")), (-90.0, -180.0, 90.0, 180.0), "positive")
    return far.select("event_id", r("longitude").alias("signed")).join(west.select("event_id", r("longitude").alias("positive")), "event_id")


@query(
    "regrid_nearest",
    ("field", "obs"),
    """WITH c AS (SELECT DISTINCT latitude, longitude FROM obs)
    SELECT round(c.latitude, 4) AS latitude, round(c.longitude, 4) AS longitude, CAST(f.sheet AS DOUBLE) AS sheet, f.elevation_m FROM c
    JOIN field f ON CAST(ROUND((c.latitude - 16) * 10) AS INT) = CAST(ROUND((f.latitude - 16) * 10) AS INT)
      AND CAST(ROUND((c.longitude - 34) * 10) AS INT) = CAST(ROUND((f.longitude - 34) * 10) AS INT)
    UNION ALL SELECT round(c.latitude, 4), round(c.longitude, 4), NULL, NULL FROM c WHERE NOT EXISTS (SELECT 1 FROM field f
      WHERE CAST(ROUND((c.latitude - 16) * 10) AS INT) = CAST(ROUND((f.latitude - 16) * 10) AS INT)
      AND CAST(ROUND((c.longitude - 34) * 10) AS INT) = CAST(ROUND((f.longitude - 34) * 10) AS INT))""",
)
def _(t):
    cells = t.obs.select("latitude", "longitude").distinct()
    out = g.regrid_nearest(t.field, cells, ["elevation_m"], (16.0, 34.0), 0.1, ["sheet"])
    return out.select(r("latitude", 4).alias("latitude"), r("longitude", 4).alias("longitude"), F.col("sheet").cast("double"), "elevation_m")


_BILINEAR = """
WITH p AS (SELECT sheet, CAST(ROUND((latitude - 16) * 10) AS INT) AS i, CAST(ROUND((longitude - 34) * 10) AS INT) AS j, elevation_m AS z FROM field),
c AS (SELECT sheet, i, j, CAST(i AS DOUBLE) + 3e-1 AS y, CAST(j AS DOUBLE) + 6e-1 AS x FROM p)
SELECT c.sheet, round(16 + c.y / 1e1, 5) AS latitude, round(34 + c.x / 1e1, 5) AS longitude,
  round(28e-2 * a.z + 42e-2 * b.z + 12e-2 * d.z + 18e-2 * e.z, 4) AS elevation_m
FROM c JOIN p a ON a.sheet = c.sheet AND a.i = c.i AND a.j = c.j
LEFT JOIN p b ON b.sheet = c.sheet AND b.i = c.i AND b.j = c.j + 1
LEFT JOIN p d ON d.sheet = c.sheet AND d.i = c.i + 1 AND d.j = c.j
LEFT JOIN p e ON e.sheet = c.sheet AND e.i = c.i + 1 AND e.j = c.j + 1"""


@query("regrid_bilinear", ("field",), _BILINEAR)
def _(t):
    shifted = t.field.select("sheet", (F.col("latitude") + 0.03).alias("latitude"), (F.col("longitude") + 0.06).alias("longitude"))
    out = g.regrid_bilinear(t.field, shifted, ["elevation_m"], (16.0, 34.0), 0.1, ["sheet"])
    return out.select("sheet", r("latitude", 5).alias("latitude"), r("longitude", 5).alias("longitude"), r("elevation_m", 4).alias("elevation_m"))


@query(
    "regrid_patch",
    ("field",),
    """SELECT sheet, round(latitude, 5) AS latitude, round(longitude, 5) AS longitude, round(elevation_m, 4) AS elevation_m,
      159 - CAST(ROUND((latitude - 16) * 10) AS INT) AS lat_index FROM field
    WHERE ROUND((latitude - 16) * 10) < 160 AND ROUND((longitude - 34) * 10) < 220""",
)
def _(t):
    out = g.regrid_patch(t.field, ["elevation_m"], (16.0, 34.0), 0.1, keys=["sheet"])
    return out.select("sheet", r("latitude", 5).alias("latitude"), r("longitude", 5).alias("longitude"), r("elevation_m", 4).alias("elevation_m"), "lat_index")


@query("select_level", ("profiles",), "SELECT profile, q, u, v FROM profiles WHERE level = 850")
def _(t):
    return g.select_level(t.profiles, 850).select("profile", "q", "u", "v")


@query(
    "merge_levels",
    ("profiles",),
    """SELECT profile, level, CASE WHEN level >= 500 THEN q ELSE q * 2 END AS q FROM profiles
    WHERE level >= 500 OR level <= 700""",
)
def _(t):
    primary = t.profiles.filter("level >= 500").select("profile", "level", "q")
    extra = t.profiles.filter("level <= 700").select("profile", "level", (F.col("q") * 2).alias("q"))
    return g.merge_levels(primary, extra, ["profile", "level"], ["q"])


@query(
    "merge_variables",
    ("profiles",),
    """WITH a AS (SELECT profile, q, u FROM profiles WHERE level = 925), b AS (SELECT profile, q * 2 AS q, v FROM profiles WHERE level = 850)
    SELECT coalesce(a.profile, b.profile) AS profile, coalesce(a.q, b.q) AS q, a.u, b.v FROM a FULL JOIN b ON a.profile = b.profile""",
)
def _(t):
    a = t.profiles.filter("level = 925").select("profile", "q", "u")
    b = t.profiles.filter("level = 850").select("profile", (F.col("q") * 2).alias("q"), "v")
    return g.merge_variables(a, b, ["profile"], ["q", "u", "v"])


@query(
    "nearest_point",
    ("obs", "field"),
    """WITH f AS (SELECT CAST(ROUND((latitude - 16) * 10) AS INT) AS i, CAST(ROUND((longitude - 34) * 10) AS INT) AS j, latitude AS y, longitude AS x, max(elevation_m) AS elevation_m FROM field GROUP BY 1, 2, 3, 4)
    SELECT o.event_id, round(f.y, 4) AS cell_latitude, round(f.x, 4) AS cell_longitude, f.elevation_m, CASE WHEN f.y IS NOT NULL THEN printf('cell_%.1f_%.1f', f.y, f.x) END AS grid_id
    FROM obs o LEFT JOIN f ON f.i = least(160, CAST(ROUND((o.latitude + 2e-2 - 16) * 10) AS INT)) AND f.j = least(220, CAST(ROUND((o.longitude - 3e-2 - 34) * 10) AS INT))""",
)
def _(t):
    spots = t.obs.select("event_id", (F.col("latitude") + 0.02).alias("latitude"), (F.col("longitude") - 0.03).alias("longitude"))
    out = g.nearest_point(t.field.groupBy("latitude", "longitude").agg(F.max("elevation_m").alias("elevation_m")), spots, (16.0, 34.0), 0.1, (161, 221))
    return out.select("event_id", r("cell_latitude", 4).alias("cell_latitude"), r("cell_longitude", 4).alias("cell_longitude"), "elevation_m", "grid_id")


@query(
    "hottest_point",
    ("grid_day",),
    """SELECT CAST(date AS STRING) AS date, latitude, longitude, heat_index_c FROM
    (SELECT *, row_number() OVER (PARTITION BY date ORDER BY heat_index_c DESC, latitude, longitude) AS k FROM grid_day) WHERE k = 1""",
)
def _(t):
    return g.hottest_point(t.grid_day, "heat_index_c").select(day("date").alias("date"), "latitude", "longitude", "heat_index_c")


@query(
    "fields_to_grid",
    ("obs",),
    """SELECT CAST(date_trunc('hour', time) AS TIMESTAMP) AS valid_time, latitude, longitude, max(temp_c) AS temp_c, max(pressure_hpa) AS pressure_hpa
    FROM obs GROUP BY 1, 2, 3""",
)
def _(t):
    cell = F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    rows = t.obs.withColumn("valid_time", F.date_trunc("hour", "time"))
    fields = None
    for name, value in (("t2m", "temp_c"), ("msl", "pressure_hpa")):
        part = rows.select("valid_time", F.array(value).alias("values"), F.array(cell).alias("grid"), F.lit(name).alias("variable"))
        fields = part if fields is None else fields.unionByName(part)
    out = g.fields_to_grid(fields, ["temp_c", "pressure_hpa"])
    return out.withColumn("valid_time", F.col("valid_time").cast("timestamp_ntz"))


@query(
    "flatten_daily",
    ("obs",),
    """WITH a AS (SELECT date, latitude, longitude, arg_min(temp_c, time) AS first_temp, max(temp_c) AS max_temp FROM obs GROUP BY 1, 2, 3)
    SELECT CAST(date AS STRING) AS date, latitude, longitude, first_temp, max_temp, printf('cell_%.4f_%.4f', latitude, longitude) AS grid_id FROM a""",
)
def _(t):
    first = g.flatten_daily(t.obs, ["temp_c"]).withColumnRenamed("temp_c", "first_temp")
    high = g.flatten_daily(t.obs, ["temp_c"], "max").withColumnRenamed("temp_c", "max_temp").drop("grid_id")
    return first.join(high, ["date", "latitude", "longitude"]).withColumn("date", day("date"))


@query(
    "first_finite_slice",
    ("obs",),
    """WITH s AS (SELECT station, extract('hour' FROM time) AS slice, CASE WHEN extract('hour' FROM time) < 6 THEN NULL ELSE temp_c END AS v, event_id FROM obs),
    n AS (SELECT station, slice, count(v) AS n FROM s GROUP BY 1, 2),
    c AS (SELECT station, coalesce(min(CASE WHEN n > 0 THEN slice END), min(slice)) AS slice FROM n GROUP BY 1)
    SELECT s.event_id, s.station, CAST(s.slice AS INT) AS slice, s.v FROM s JOIN c ON s.station = c.station AND s.slice = c.slice""",
)
def _(t):
    hour = F.hour("time")
    rows = t.obs.select("event_id", "station", hour.alias("slice"), F.when(hour >= 6, F.col("temp_c")).alias("v"))
    return g.first_finite_slice(rows, "v", "slice", ["station"])
