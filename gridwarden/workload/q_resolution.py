"""Queries of source choice, comparison, fallback, data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwarden.operators import quality as q
from gridwarden.operators import resolution as rs
from gridwarden.operators.grid import require_valid_date
from gridwarden.workload.registry import day, joined, query, r

REGISTRY = [
    ("precip_daily", "view", "primary", 2),
    ("precip_daily", "click", "secondary", 1),
    ("precip_daily", "error", "primary", 3),
    ("sst", "signup", "primary", 1),
    ("sst", "radar", "secondary", 2),
]


def available(t):
    family = F.when(F.col("event_type").isin("view", "click", "error"), "precip_daily").otherwise("sst")
    return t.obs.filter("station % 3 = 0 or event_type <> 'view' or day(date) % 2 = 0").select(family.alias("family"), F.col("event_type").alias("dataset_id"), "date")


_REG = "(VALUES " + ", ".join(f"('{f}', '{d}', '{o}', {k})" for f, d, o, k in REGISTRY) + ") reg(family, dataset_id, role, quality_rank)"


@query(
    "resolve_source",
    ("obs",),
    f"""WITH a AS (SELECT DISTINCT CASE WHEN event_type IN ('view', 'click', 'error') THEN 'precip_daily' ELSE 'sst' END AS family, event_type AS dataset_id, date
      FROM obs WHERE station % 3 = 0 OR event_type <> 'view' OR extract('day' FROM date) % 2 = 0),
    c AS (SELECT d.date, reg.*, a.date IS NOT NULL AS ok FROM (SELECT DISTINCT date FROM a) d CROSS JOIN {_REG}
      LEFT JOIN a ON a.family = reg.family AND a.dataset_id = reg.dataset_id AND a.date = d.date),
    k AS (SELECT *, row_number() OVER (PARTITION BY family, date ORDER BY ok DESC, CASE role WHEN 'primary' THEN 0 ELSE 1 END, quality_rank, dataset_id) AS n FROM c)
    SELECT family, CAST(date AS STRING) AS date, max(CASE WHEN n = 1 AND ok THEN dataset_id END) AS resolved_source, max(CASE WHEN n = 1 AND ok THEN role END) AS resolved_role,
      string_agg(concat(dataset_id, ':', CASE WHEN ok THEN 'available' ELSE 'missing' END), ',' ORDER BY quality_rank, dataset_id) AS chain,
      coalesce(string_agg(CASE WHEN n > 1 AND ok THEN dataset_id END, ',' ORDER BY n), '') AS secondary FROM k GROUP BY family, date""",
)
def _(t):
    out = rs.resolve_source(available(t), REGISTRY)
    chain = F.transform("fallback_chain", lambda s: F.concat(s["dataset_id"], F.lit(":"), s["status"]))
    return out.select("family", day("date").alias("date"), "resolved_source", "resolved_role", joined(chain).alias("chain"), joined("secondary_sources").alias("secondary"))


_AB = """a AS (SELECT date, latitude, longitude, avg(temp_c) AS v FROM obs WHERE event_type IN ('view', 'click') GROUP BY 1, 2, 3),
b AS (SELECT date, latitude, longitude, avg(CASE WHEN event_id % 4 > 0 THEN temp_c END) AS v FROM obs WHERE event_type NOT IN ('view', 'click') GROUP BY 1, 2, 3)"""


def two_sources(t):
    keys = ["date", "latitude", "longitude"]
    a = t.obs.filter("event_type in ('view', 'click')").groupBy(*keys).agg(F.avg("temp_c").alias("v"))
    b = t.obs.filter("event_type not in ('view', 'click')").groupBy(*keys).agg(F.avg(F.when(F.col("event_id") % 4 > 0, F.col("temp_c"))).alias("v"))
    return a, b


@query(
    "compare_sources",
    ("obs",),
    f"""WITH {_AB} SELECT CAST(a.date AS STRING) AS date, round(avg(abs(b.v - a.v)), 6) AS mean_abs_diff, round(max(abs(b.v - a.v)), 6) AS max_abs_diff,
      round(avg(b.v - a.v), 6) AS mean_bias, round(count(b.v) / CAST(count(*) AS DOUBLE), 6) AS overlap_fraction
    FROM a JOIN b ON a.date = b.date AND a.latitude = b.latitude AND a.longitude = b.longitude GROUP BY a.date""",
)
def _(t):
    out = rs.compare_sources(*two_sources(t), "v", by=["date"])
    return out.select(day("date").alias("date"), *[r(c).alias(c) for c in ("mean_abs_diff", "max_abs_diff", "mean_bias", "overlap_fraction")])


@query(
    "fallback_field",
    ("obs",),
    f"""WITH {_AB}, s AS (SELECT * FROM b WHERE extract('day' FROM date) % 3 > 0), d AS (SELECT DISTINCT date FROM s)
    SELECT CAST(a.date AS STRING) AS date, a.latitude, a.longitude, round(CASE WHEN d.date IS NOT NULL THEN s.v ELSE a.v END, 6) AS used,
      CASE WHEN d.date IS NOT NULL THEN 'compared' ELSE 'degraded_primary_missing' END AS status
    FROM a LEFT JOIN d ON d.date = a.date LEFT JOIN s ON s.date = a.date AND s.latitude = a.latitude AND s.longitude = a.longitude""",
)
def _(t):
    a, b = two_sources(t)
    out = rs.fallback_field(a, b.filter("day(date) % 3 > 0"), "v", "v", "used")
    return out.select(day("date").alias("date"), "latitude", "longitude", r("used").alias("used"), F.col("used_status").alias("status"))


_PAIR = "daily_precip_total AS reanalysis, ivt / 1e1 AS satellite"


@query(
    "precip_cross_check",
    ("grid_day",),
    f"""WITH p AS (SELECT row_id, grid_id, {_PAIR} FROM grid_day)
    SELECT row_id, grid_id, round(satellite - reanalysis, 6) AS diff, round(CASE WHEN reanalysis > 1e-1 THEN satellite / reanalysis END, 6) AS ratio,
      CASE WHEN satellite >= 10 AND reanalysis >= 10 THEN 1 ELSE 0 END AS overlap FROM p""",
)
def _(t):
    rows = t.grid_day.select("row_id", "grid_id", F.col("daily_precip_total"), (F.col("ivt") / 10).alias("gpm_daily_precip"))
    out = rs.precip_cross_check(rows)
    return out.select(
        "row_id", "grid_id", r("gpm_era5_precip_diff").alias("diff"), r("gpm_era5_precip_ratio").alias("ratio"), F.col("gpm_era5_heavy_rain_overlap").cast("int").alias("overlap")
    )


_ISSUE = "SELECT row_id, grid_id, CASE WHEN dust_aod IS NULL THEN NULL ELSE ivt / 1e1 - daily_precip_total END AS gap, CASE region_id WHEN 'asir' THEN 'missing' ELSE 'available' END AS state, CASE region_id WHEN 'tabuk' THEN 'heuristic_proxy_fallback' WHEN 'riyadh' THEN 'same_source_residual' ELSE '' END AS split FROM grid_day"


@query(
    "grounding_issues",
    ("grid_day",),
    f"""WITH p AS ({_ISSUE})
    SELECT row_id, grid_id, trim(concat(CASE WHEN abs(gap) >= 10 THEN 'precip_daily:threshold_exceeded' WHEN gap IS NULL AND state = 'missing' THEN 'precip_daily:missing' ELSE '' END,
      CASE WHEN split = 'heuristic_proxy_fallback' THEN ' flash_flood_precipitation_partition:heuristic_proxy_fallback' ELSE '' END)) AS issues FROM p""",
)
def _(t):
    rows = t.grid_day.select(
        "row_id",
        "grid_id",
        F.when(F.col("dust_aod").isNotNull(), F.col("ivt") / 10 - F.col("daily_precip_total")).alias("gap"),
        F.when(F.col("region_id") == "asir", "missing").otherwise("available").alias("state"),
        F.when(F.col("region_id") == "tabuk", "heuristic_proxy_fallback").when(F.col("region_id") == "riyadh", "same_source_residual").otherwise("").alias("split"),
    )
    out = rs.grounding_issues(rows, "gap", "state", "split")
    return out.select("row_id", "grid_id", joined(F.transform("issues", lambda i: F.concat_ws(":", i["family"], i["status"])), " ").alias("issues"))


@query(
    "source_ids",
    ("obs",),
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'rain_src' END AS primary_id,
      CASE WHEN event_id % 3 = 0 THEN 'rain_src' WHEN event_id % 3 = 1 THEN event_type ELSE '' END AS secondary FROM obs""",
)
def _(t):
    rain = F.lit('"rain": {"resolved_source": "rain_src", "role": "secondary"}')
    own = F.concat(F.lit('"sst": {"dataset_id": "'), F.col("event_type"), F.when(F.col("event_id") % 3 == 0, '", "role": "primary"}').otherwise('"}'))
    meta = F.concat(F.lit("{"), rain, F.when(F.col("event_id") % 3 < 2, F.concat(F.lit(", "), own)).otherwise(""), F.lit("}"))
    out = rs.source_ids(t.obs.select("event_id", meta.alias("meta")), "meta")
    return out.select("event_id", F.col("primary_source_id").alias("primary_id"), joined("secondary_source_ids").alias("secondary"))


@query(
    "missing_report",
    ("points",),
    """SELECT row_id, grid_id, 'rh_percent' AS field FROM points WHERE rh_percent IS NULL
    UNION ALL SELECT row_id, grid_id, 'wind_gust_mps' FROM points WHERE wind_gust_mps IS NULL UNION ALL SELECT row_id, grid_id, 'absent' FROM points""",
)
def _(t):
    rows = t.points.withColumn("k", F.struct("row_id", "grid_id"))
    return q.missing_report(rows, ["temp_c", "rh_percent", "wind_gust_mps", "absent"], "k").select("k.row_id", "k.grid_id", "field")


@query("missing_summary", ("points",), "SELECT count(*) - count(rh_percent) + count(*) - count(wind_gust_mps) AS missing_count, count(*) = count(rh_percent) AND count(*) = count(wind_gust_mps) AS ok FROM points")
def _(t):
    return q.missing_summary(t.points, ["temp_c", "rh_percent", "wind_gust_mps"])


@query(
    "validate_units",
    ("obs",),
    """WITH u AS (SELECT CASE event_type WHEN 'view' THEN 'temp_c' WHEN 'click' THEN 'rh_percent' WHEN 'error' THEN 'pressure_hpa' ELSE event_type END AS field,
      CASE event_type WHEN 'view' THEN 'K' WHEN 'click' THEN '%' ELSE 'hPa' END AS unit FROM obs GROUP BY 1, 2)
    SELECT w.field, w.expected, u.unit AS actual, CASE WHEN u.unit IS NULL THEN 'missing' ELSE 'mismatch' END AS problem
    FROM (VALUES ('temp_c', 'degC'), ('rh_percent', '%'), ('pressure_hpa', 'hPa'), ('cape_j_kg', 'J/kg')) w(field, expected) LEFT JOIN u ON u.field = w.field
    WHERE u.unit IS NULL OR u.unit <> w.expected""",
)
def _(t):
    kind = F.col("event_type")
    field = F.when(kind == "view", "temp_c").when(kind == "click", "rh_percent").when(kind == "error", "pressure_hpa").otherwise(kind)
    unit = F.when(kind == "view", "K").when(kind == "click", "%").otherwise("hPa")
    return q.validate_units(t.obs.select(field.alias("field"), unit.alias("unit")), {"temp_c": "degC", "rh_percent": "%", "pressure_hpa": "hPa", "cape_j_kg": "J/kg"})


@query("validate_time", ("obs",), "SELECT event_id FROM obs WHERE event_id % 7 = 0")
def _(t):
    rows = t.obs.select("event_id", F.when(F.col("event_id") % 7 == 0, "not a time").otherwise(F.col("time").cast("string")).alias("valid_time"))
    return q.validate_time(rows).select("event_id")


@query("require_daily", ("grid_day",), "SELECT row_id, grid_id, CAST(date AS STRING) AS date FROM grid_day")
def _(t):
    rows = t.grid_day.select("row_id", "grid_id", F.concat(F.col("date").cast("string"), F.lit(" 00:00:00")).alias("valid_time"))
    return require_valid_date(q.require_daily(rows)).select("row_id", "grid_id", day("date").alias("date"))


@query(
    "summary_stats",
    ("points",),
    """SELECT 'temp_c' AS field, min(temp_c) AS minimum, max(temp_c) AS maximum, round(avg(temp_c), 6) AS mean FROM points
    UNION ALL SELECT 'rh_percent', min(rh_percent), max(rh_percent), round(avg(rh_percent), 6) FROM points
    UNION ALL SELECT 'wind_gust_mps', min(wind_gust_mps), max(wind_gust_mps), round(avg(wind_gust_mps), 6) FROM points""",
)
def _(t):
    return q.summary_stats(t.points, ["temp_c", "rh_percent", "wind_gust_mps"]).withColumn("mean", r("mean"))


@query(
    "dust_feature_coverage",
    ("grid_day",),
    """SELECT count(*) AS rows, count(dust_aod) AS finite_dust_aod, count(dust_column_mass) AS finite_dust_column_mass, count(dust_surface_mass) AS finite_dust_surface_mass,
      count(CASE WHEN dust_aod IS NOT NULL AND dust_surface_mass IS NOT NULL THEN 1 END) AS finite_rows, count(*) AS rows_with_any,
      count(DISTINCT CASE WHEN dust_aod IS NOT NULL AND dust_surface_mass IS NOT NULL THEN date END) AS dates_with_all, count(DISTINCT date) AS dates_with_any,
      round(count(CASE WHEN dust_aod IS NOT NULL AND dust_surface_mass IS NOT NULL THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS finite_row_fraction,
      'partial' AS coverage_status FROM grid_day""",
)
def _(t):
    return q.dust_feature_coverage(t.grid_day).withColumn("finite_row_fraction", r("finite_row_fraction"))


@query("value_counts", ("grid_day",), "SELECT province_name AS value, count(*) AS rows FROM grid_day GROUP BY 1")
def _(t):
    return q.value_counts(t.grid_day, "province_name")
