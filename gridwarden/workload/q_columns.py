"""Queries of the column library: physical indicators, scores, ranges, units."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwarden.functions import basic as b
from gridwarden.functions import physical as ph
from gridwarden.functions import text as tx
from gridwarden.operators import indicators, quality, risk
from gridwarden.operators.grid import normalize_variable, sanitize
from gridwarden.workload.registry import joined, query, r

ES = "(6108e-4 * exp(1727e-2 * ({0}) / (({0}) + 2373e-1)))"


def es(x: str) -> str:
    return ES.format(x)


def held(x: str, low: str = "0e0", high: str = "1e0") -> str:
    return f"greatest({low}, least({high}, {x}))"


def vpd(t: str, h: str) -> str:
    return f"greatest(0e0, {es(t)} * (1e0 - {held(h, '0e0', '1e2')} / 1e2))"


def hot_f(f: str, h: str) -> str:
    return (
        f"(-42379e-3 + 204901523e-8 * {f} + 1014333127e-8 * {h} - 22475541e-8 * {f} * {h} - 683783e-8 * {f} * {f} - 5481717e-8 * {h} * {h}"
        f" + 122874e-8 * {f} * {f} * {h} + 85282e-8 * {f} * {h} * {h} - 199e-8 * {f} * {f} * {h} * {h})"
    )


def heat_index(t: str, h: str, cutoff: str) -> str:
    f = f"(({t}) * 18e-1 + 32e0)"
    return f"CASE WHEN {cutoff} THEN {t} ELSE ({hot_f(f, h)} - 32e0) / 18e-1 END"


def cols(t, **named):
    return t.obs.select("event_id", *[c.alias(n) for n, c in named.items()])


@query("sat_vapor_pressure_kpa", ("obs",), f"SELECT event_id, round({es('temp_c')}, 6) AS es_kpa FROM obs")
def _(t):
    return cols(t, es_kpa=r(ph.sat_vapor_pressure_kpa("temp_c")))


@query(
    "rh_from_dewpoint",
    ("obs",),
    f"""SELECT event_id, round({held(f"1e2 * {es('dewpoint_c')} / {es('temp_c')}", '0e0', '1e2')}, 6) AS rh,
      round({held("1e2 * exp(17625e-3 * dewpoint_c / (24304e-2 + dewpoint_c)) / exp(17625e-3 * temp_c / (24304e-2 + temp_c))", '0e0', '1e2')}, 6) AS rh_magnus
    FROM obs""",
)
def _(t):
    return cols(t, rh=r(ph.rh_from_dewpoint("temp_c", "dewpoint_c")), rh_magnus=r(ph.rh_from_dewpoint("temp_c", "dewpoint_c", ph.MAGNUS)))


@query("vpd_kpa", ("obs",), f"SELECT event_id, round({vpd('temp_c', 'rh_percent')}, 6) AS vpd_kpa FROM obs")
def _(t):
    return cols(t, vpd_kpa=r(ph.vpd_kpa("temp_c", "rh_percent")))


_ADJUST = f"""
WITH f AS (SELECT event_id, temp_c, rh_percent AS h, temp_c * 18e-1 + 32e0 AS f FROM obs),
g AS (SELECT *, {hot_f('f', 'h')} AS raw FROM f)
SELECT event_id, round({heat_index('temp_c', 'h', 'f < 80')}, 6) AS daily,
  round({heat_index('temp_c', 'h', 'temp_c < 267e-1')}, 6) AS screening,
  round(CASE WHEN f < 80 THEN temp_c
    WHEN h < 13 AND f <= 112 THEN (raw - (13 - h) / 4e0 * sqrt(greatest(17 - abs(f - 95), 0e0) / 17e0) - 32) / 18e-1
    WHEN h > 85 AND f <= 87 THEN (raw + (h - 85) / 1e1 * ((87 - f) / 5e0) - 32) / 18e-1
    ELSE (raw - 32) / 18e-1 END, 6) AS adjusted FROM g"""


@query("heat_index_variants", ("obs",), _ADJUST)
def _(t):
    return cols(t, **{v: r(ph.heat_index_c("temp_c", "rh_percent", v)) for v in ("daily", "screening", "adjusted")})


@query(
    "apparent_temperature",
    ("obs",),
    """SELECT event_id, round(temp_c + 33e-2 * (rh_percent / 1e2 * 6105e-3 * exp(1727e-2 * temp_c / (2377e-1 + temp_c)))
      - 7e-1 * sqrt(u10 * u10 + v10 * v10) - 4, 6) AS apparent_temp_c FROM obs""",
)
def _(t):
    return cols(t, apparent_temp_c=r(ph.apparent_temperature_c("temp_c", "rh_percent", ph.wind_speed("u10", "v10"))))


@query(
    "wet_bulb",
    ("obs",),
    """SELECT event_id, round(temp_c * atan(151977e-6 * sqrt(rh_percent + 8313659e-6)) + atan(temp_c + rh_percent) - atan(rh_percent - 1676331e-6)
      + 391838e-8 * rh_percent * sqrt(rh_percent) * atan(23101e-6 * rh_percent) - 4686035e-6, 6) AS wet_bulb_c FROM obs""",
)
def _(t):
    return cols(t, wet_bulb_c=r(ph.wet_bulb_c("temp_c", "rh_percent")))


@query("dewpoint_depression", ("obs",), "SELECT event_id, round(temp_c - dewpoint_c, 6) AS depression FROM obs")
def _(t):
    return cols(t, depression=r(ph.dewpoint_depression("temp_c", "dewpoint_c")))


PWAT = "greatest(0e0, 18e-2 * (temp_c + 5) * (rh_percent / 1e2) * " + held("(pressure_hpa - 7e2) / 35e1", "5e-1", "12e-1") + ")"


@query("pwat_proxy", ("obs",), f"SELECT event_id, round({PWAT}, 6) AS pwat FROM obs")
def _(t):
    return cols(t, pwat=r(ph.pwat_proxy("temp_c", "rh_percent", "pressure_hpa")))


@query("ivt_proxy", ("obs",), f"SELECT event_id, round(25e-1 * sqrt(u10 * u10 + v10 * v10) * {PWAT}, 6) AS ivt FROM obs")
def _(t):
    return cols(t, ivt=r(ph.ivt_proxy(ph.wind_speed("u10", "v10"), ph.pwat_proxy("temp_c", "rh_percent", "pressure_hpa"))))


@query("cape_proxy", ("obs",), "SELECT event_id, round(6 * greatest(0e0, temp_c - 28) * greatest(0e0, rh_percent - 35), 6) AS cape FROM obs")
def _(t):
    return cols(t, cape=r(ph.cape_proxy("temp_c", "rh_percent")))


@query(
    "bowen_proxy",
    ("obs",),
    f"SELECT event_id, round(greatest(0e0, 3e-1 + 22e-1 * (1 - {held('rh_percent / 1e2')}) + {held('(temp_c - 25) / 25e0', '0e0', '15e-1')}), 6) AS bowen FROM obs",
)
def _(t):
    return cols(t, bowen=r(ph.bowen_proxy("temp_c", "rh_percent")))


@query("net_radiation", ("obs",), "SELECT event_id, round(77e-2 * pressure_hpa + coalesce(-precip_1h_mm, -80e0), 6) AS net FROM obs")
def _(t):
    return cols(t, net=r(ph.net_radiation("pressure_hpa", -F.col("precip_1h_mm"))))


@query("precip_anomaly", ("obs",), "SELECT event_id, round(precip_1h_mm - 5, 6) AS anomaly FROM obs")
def _(t):
    return cols(t, anomaly=r(ph.precip_anomaly("precip_1h_mm", 5.0)))


@query(
    "precip_flag",
    ("obs",),
    "SELECT event_id, CASE WHEN precip_1h_mm >= 20 THEN 2e0 WHEN precip_1h_mm >= 10 THEN 1e0 WHEN precip_1h_mm IS NOT NULL THEN 0e0 END AS flag FROM obs",
)
def _(t):
    return cols(t, flag=ph.precip_flag("precip_1h_mm", 10.0, 20.0))


@query("wind_speed", ("obs",), "SELECT event_id, round(sqrt(u10 * u10 + v10 * v10), 6) AS speed FROM obs")
def _(t):
    return cols(t, speed=r(ph.wind_speed("u10", "v10")))


@query(
    "wind_shear",
    ("obs",),
    """SELECT event_id, round(abs(u10 - v10), 6) AS speed_shear,
      round(sqrt((v10 - u10) * (v10 - u10) + (2 * u10 - v10) * (2 * u10 - v10)), 6) AS vector_shear FROM obs""",
)
def _(t):
    return cols(t, speed_shear=r(ph.speed_shear("u10", "v10")), vector_shear=r(ph.vector_shear("u10", "v10", "v10", F.col("u10") * 2)))


@query("safe_ratio", ("obs",), "SELECT event_id, round(CASE WHEN abs(u10) > 1e-6 THEN v10 / u10 END, 6) + 0e0 AS ratio FROM obs")
def _(t):
    return cols(t, ratio=r(b.safe_ratio("v10", "u10")))


@query(
    "convective_ratio",
    ("obs",),
    f"""SELECT event_id, round(CASE WHEN precip_1h_mm > 1e-1 THEN {held('v10 / precip_1h_mm')} END, 6) AS masked,
      round(CASE WHEN precip_1h_mm IS NOT NULL THEN {held('v10 / (precip_1h_mm + 1e-6)')} END, 6) AS padded FROM obs""",
)
def _(t):
    return cols(t, masked=r(ph.convective_ratio("v10", "precip_1h_mm")), padded=r(ph.convective_ratio("v10", "precip_1h_mm", "epsilon")))


@query(
    "threshold_flag",
    ("obs",),
    """SELECT event_id, CASE WHEN precip_1h_mm >= 5 THEN 1 ELSE 0 END AS ge, CASE WHEN precip_1h_mm > 5 THEN 1 ELSE 0 END AS gt,
      CASE WHEN precip_1h_mm <= 5 THEN 1 ELSE 0 END AS le, CASE WHEN precip_1h_mm < 5 THEN 1 ELSE 0 END AS lt FROM obs""",
)
def _(t):
    names = {"ge": ">=", "gt": ">", "le": "<=", "lt": "<"}
    return cols(t, **{n: b.flag("precip_1h_mm", 5.0, op).cast("int") for n, op in names.items()})


@query("coriolis", ("obs",), "SELECT event_id, round(1e6 * 2 * 72921159e-12 * sin(radians(latitude)), 6) AS f FROM obs")
def _(t):
    return cols(t, f=r(ph.coriolis("latitude") * 1.0e6))


FLOOD = (
    "{h}(75e-2 * greatest(coalesce(precip_1h_mm, 0) / 35e0, coalesce(precip_6h_mm, 0) / 8e1, coalesce(precip_24h_mm, 0) / 14e1)"
    " + 2e-1 * {h}(coalesce(slope_deg, 5) / 25e0) + 2e-1 * {h}(coalesce(soil_moisture_frac, 25e-2)) + 15e-2 * {h}(coalesce(impervious_frac, 15e-2)))"
)


def _expand(sql: str) -> str:
    """Write out {h}(...) as a clamp to 0..1."""
    while "{h}(" in sql:
        start = sql.rindex("{h}(")
        depth, i = 0, start + 3
        while True:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            if depth == 0:
                break
            i += 1
        sql = sql[:start] + "greatest(0e0, least(1e0, " + sql[start + 4 : i] + "))" + sql[i + 1 :]
    return sql


FLOOD = _expand(FLOOD)
DUST = _expand(
    "{h}(65e-2 * greatest(wind_speed_mps / 16e0, coalesce(wind_gust_mps, wind_speed_mps) / 22e0) + 35e-2 * (1 - {h}(soil_moisture_frac / 35e-2))"
    " + 25e-2 * (1 - {h}(vegetation_index / 45e-2)) + 2e-1 * (1 - {h}(visibility_km / 1e1)))"
)
DRY = _expand(
    "CASE WHEN rh_percent IS NULL THEN 0e0 ELSE {h}(45e-2 * {h}((temp_c - 35) / 12e0) + 45e-2 * {h}("
    + vpd("temp_c", "rh_percent")
    + " / 5e0) + 15e-2 * {h}(wind_speed_mps / 1e1) + 15e-2 * (1 - {h}(vegetation_index / 5e-1))) END"
)


@query("flash_flood_score", ("points",), f"SELECT row_id, grid_id, round({FLOOD}, 6) AS score FROM points")
def _(t):
    args = ("precip_1h_mm", "precip_6h_mm", "precip_24h_mm", "slope_deg", "soil_moisture_frac", "impervious_frac")
    return t.points.select("row_id", "grid_id", r(ph.flash_flood_score(*args)).alias("score"))


@query("dust_score", ("points",), f"SELECT row_id, grid_id, round({DUST}, 6) AS score FROM points")
def _(t):
    args = ("wind_speed_mps", "wind_gust_mps", "soil_moisture_frac", "vegetation_index", "visibility_km")
    return t.points.select("row_id", "grid_id", r(ph.dust_score(*args)).alias("score"))


@query("dry_heat_score", ("points",), f"SELECT row_id, grid_id, round({DRY}, 6) AS score FROM points")
def _(t):
    args = ("temp_c", "rh_percent", "wind_speed_mps", "vegetation_index")
    return t.points.select("row_id", "grid_id", r(ph.dry_heat_score(*args)).alias("score"))


@query(
    "dust_risk_proxy",
    ("grid_day",),
    """SELECT row_id, grid_id, round(least(1e0, CASE WHEN wind10_speed >= 8 THEN 4e-1 ELSE 0e0 END + CASE WHEN dust_aod >= 3e-1 THEN 3e-1 ELSE 0e0 END
      + CASE WHEN dust_surface_mass >= 5e-4 THEN 3e-1 ELSE 0e0 END), 6) AS proxy FROM grid_day""",
)
def _(t):
    return t.grid_day.select("row_id", "grid_id", r(ph.dust_risk_proxy("wind10_speed", "dust_aod", "dust_surface_mass")).alias("proxy"))


@query(
    "derive_indicators",
    ("obs",),
    f"""WITH d AS (SELECT event_id, temp_c, dewpoint_c, pressure_hpa, u10, v10, {held(f"1e2 * {es('dewpoint_c')} / {es('temp_c')}", '0e0', '1e2')} AS rh_percent FROM obs)
    SELECT event_id, round(rh_percent, 5) AS rh_percent, round(temp_c - dewpoint_c, 5) AS dewpoint_depression_c, round({vpd('temp_c', 'rh_percent')}, 5) AS vpd_kpa,
      round({heat_index('temp_c', 'rh_percent', 'temp_c < 267e-1')}, 5) AS heat_index_c, round({PWAT}, 5) AS pwat_mm,
      round(sqrt(u10 * u10 + v10 * v10), 5) AS wind_speed_mps, round(25e-1 * sqrt(u10 * u10 + v10 * v10) * {PWAT}, 5) AS ivt_kg_m_s FROM d""",
)
def _(t):
    names = ("rh_percent", "dewpoint_depression_c", "vpd_kpa", "heat_index_c", "pwat_mm", "wind_speed_mps", "ivt_kg_m_s")
    rows = indicators.derive_indicators(t.obs.drop("rh_percent"), {"u_wind_mps": "u10", "v_wind_mps": "v10"})
    return rows.select("event_id", *[r(n, 5).alias(n) for n in names])


_FIELDS = f"""
WITH a AS (SELECT event_id, temp_c, rh_percent, pressure_hpa, precip_1h_mm AS p1, cape_j_kg AS cape, sqrt(u10 * u10 + v10 * v10) AS w, {PWAT} AS pwat,
    {heat_index('temp_c', 'rh_percent', 'temp_c < 267e-1')} AS hi FROM obs),
b AS (SELECT *, 24 * p1 AS day, least(85e-2, greatest(35e-2, 35e-2 + cape / 25e2)) AS share FROM a)
SELECT event_id, round(hi, 5) AS heat_index_c, round(pwat, 5) AS pwat, round(25e-1 * w * pwat, 5) AS ivt, round(day, 5) AS daily_precip_total,
  round(day * share, 5) AS daily_convective_precip, round(day - day * share, 5) AS daily_large_scale_precip, round(115e-2 * w, 5) AS wind850_speed,
  round(115e-2 * w * 45e-2 + least(20e0, cape / 2e2), 5) AS wind_shear_850_200,
  round(CASE WHEN p1 IS NOT NULL THEN least(1e0, 75e-2 * greatest(p1 / 35e0, least(6 * p1, day) / 8e1, day / 14e1) + 4e-2 + 5e-2 + 225e-4) END, 5) AS flash_flood_risk,
  CASE WHEN temp_c >= 40 OR hi >= 40 THEN 1e0 ELSE 0e0 END AS heatwave_day_flag"""


def _forecast(t):
    rows = t.obs.select("event_id", "temp_c", "rh_percent", "pressure_hpa", "precip_1h_mm", "cape_j_kg", ph.wind_speed("u10", "v10").alias("wind_speed_mps"))
    return indicators.derive_forecast_fields(rows)


@query("derive_forecast_fields", ("obs",), _FIELDS + " FROM b")
def _(t):
    names = ("heat_index_c", "pwat", "ivt", "daily_precip_total", "daily_convective_precip", "daily_large_scale_precip")
    names += ("wind850_speed", "wind_shear_850_200", "flash_flood_risk")
    return _forecast(t).select("event_id", *[r(n, 5).alias(n) for n in names], "heatwave_day_flag")


@query(
    "runtime_degradation",
    ("obs",),
    "SELECT event_id, 'degraded' AS effective_source_status, 'direct_precip_partition_unavailable' AS fallback_reason FROM obs",
)
def _(t):
    return indicators.runtime_degradation(_forecast(t)).select("event_id", "effective_source_status", "fallback_reason")


@query(
    "feature_status_report",
    ("obs",),
    """SELECT event_type, 'daily_precip_total,daily_convective_precip,daily_large_scale_precip,pwat,ivt,wind850_speed,wind_shear_850_200' AS proxies, '' AS unavailable,
      'heatwave_day_flag,heatwave_duration_days' AS context, 'proxy_present' AS flood_status, 'context_only' AS heat_status, 'heuristic_proxy_fallback' AS split,
      count(*) AS n FROM obs GROUP BY event_type""",
)
def _(t):
    rows = t.obs.select("event_type", "temp_c", "rh_percent", "pressure_hpa", "precip_1h_mm", "cape_j_kg", ph.wind_speed("u10", "v10").alias("wind_speed_mps"))
    out = indicators.feature_status_report(indicators.derive_forecast_fields(rows)).select(
        "event_type",
        joined("proxy_features").alias("proxies"),
        joined("unavailable_features").alias("unavailable"),
        joined("context_only_features").alias("context"),
        "flood_status",
        "heat_status",
        F.col("precip_partition").alias("split"),
    )
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


@query(
    "mean_present",
    ("points",),
    """SELECT row_id, grid_id, round((temp_c + coalesce(rh_percent, 0) + coalesce(coastal_distance_km, 0)) /
      (1e0 + CASE WHEN rh_percent IS NULL THEN 0 ELSE 1 END + CASE WHEN coastal_distance_km IS NULL THEN 0 ELSE 1 END), 6) AS mean FROM points""",
)
def _(t):
    return t.points.select("row_id", "grid_id", r(b.mean_present("temp_c", "rh_percent", "coastal_distance_km")).alias("mean"))


@query(
    "clip_features",
    ("grid_day",),
    """SELECT row_id, grid_id, least(rh2m, 100) AS relative_humidity_percent, CASE WHEN temp_c * 3 <= 80 THEN temp_c * 3 END AS temp_c,
      CASE WHEN wind10_speed * 10 <= 120 THEN wind10_speed * 10 END AS wind_speed_mps, CASE WHEN ivt * 10 <= 2000 THEN ivt * 10 END AS ivt FROM grid_day""",
)
def _(t):
    rows = t.grid_day.select(
        "row_id",
        "grid_id",
        F.col("rh2m").alias("relative_humidity_percent"),
        (F.col("temp_c") * 3).alias("temp_c"),
        (F.col("wind10_speed") * 10).alias("wind_speed_mps"),
        (F.col("ivt") * 10).alias("ivt"),
    )
    return quality.clip_features(rows)


@query("sanitize", ("obs",), "SELECT event_id, CASE WHEN temp_raw <> -9999 THEN temp_raw END AS temp_raw FROM obs")
def _(t):
    return sanitize(t.obs.select("event_id", "temp_raw"))


@query("mask_range", ("obs",), "SELECT event_id, CASE WHEN temp_c BETWEEN 20 AND 40 THEN temp_c END AS temp_c FROM obs")
def _(t):
    return cols(t, temp_c=b.mask_range("temp_c", 20.0, 40.0))


@query(
    "to_unit",
    ("obs",),
    "SELECT event_id, round(temp_c - 27315e-2, 6) AS degc, round(pressure_hpa / 1e2, 6) AS hpa, round(precipitation * 1e3, 6) AS mm, temp_c AS same FROM obs",
)
def _(t):
    return cols(
        t,
        degc=r(b.to_unit("temp_c", "K", "degC")),
        hpa=r(b.to_unit("pressure_hpa", "Pa", "hPa")),
        mm=r(b.to_unit("precipitation", "m", "mm")),
        same=b.to_unit("temp_c", "degC", "degC"),
    )


@query(
    "normalize_variables",
    ("obs",),
    """SELECT event_type, CASE event_type WHEN 'view' THEN 'temp_c' WHEN 'click' THEN 'pressure_hpa' ELSE event_type END AS variable, count(*) AS n
    FROM obs GROUP BY 1, 2""",
)
def _(t):
    raw = F.when(F.col("event_type") == "view", "t2m").when(F.col("event_type") == "click", "msl").otherwise(F.col("event_type"))
    return t.obs.select("event_type", normalize_variable(raw).alias("variable")).groupBy("event_type", "variable").agg(F.count("*").alias("n"))


@query(
    "risk_levels",
    ("points",),
    f"""WITH s AS (SELECT row_id, grid_id, {FLOOD} AS p FROM points)
    SELECT row_id, grid_id, CASE WHEN p >= 75e-2 THEN 'extreme' WHEN p >= 5e-1 THEN 'high' WHEN p >= 25e-2 THEN 'medium' ELSE 'low' END AS level,
      CASE WHEN p >= 75e-2 THEN 3 WHEN p >= 5e-1 THEN 2 WHEN p >= 2e-1 THEN 1 ELSE 0 END AS field_level FROM s""",
)
def _(t):
    args = ("precip_1h_mm", "precip_6h_mm", "precip_24h_mm", "slope_deg", "soil_moisture_frac", "impervious_frac")
    p = ph.flash_flood_score(*args)
    return t.points.select("row_id", "grid_id", risk.risk_level(p).alias("level"), risk.risk_level_grid(p).cast("int").alias("field_level"))


@query(
    "canonical_text",
    ("catalogue",),
    "SELECT event_id, trim(regexp_replace(lower(concat(location_name, ' (', source_name, ')')), '[^a-z0-9]+', ' ', 'g')) AS canonical FROM catalogue",
)
def _(t):
    raw = F.concat("location_name", F.lit(" ("), "source_name", F.lit(")"))
    return t.catalogue.select("event_id", tx.canonical_text(raw).alias("canonical"))


_PROVINCE_OF = """CASE location_name WHEN 'Jeddah' THEN 'makkah' WHEN 'Mecca' THEN 'makkah' WHEN 'Riyadh' THEN 'riyadh' WHEN 'Dammam' THEN 'eastern province'
  WHEN 'Medina' THEN 'madinah' WHEN 'Tabuk' THEN 'tabuk' WHEN 'Abha' THEN 'asir' WHEN 'Hail region' THEN 'hail' WHEN 'Hidden valley' THEN ''
  WHEN 'Makkah and Riyadh' THEN 'makkah,riyadh' WHEN 'Najran' THEN 'najran' ELSE 'jazan' END"""


@query(
    "resolve_regions",
    ("catalogue",),
    f"""SELECT event_id, {_PROVINCE_OF} AS provinces, replace({_PROVINCE_OF}, ' ', '_') AS heat_regions,
      CASE location_name WHEN 'Hidden valley' THEN 'hidden_valley'
        ELSE replace({_PROVINCE_OF}, ' ', '_') END AS dust_regions FROM catalogue""",
)
def _(t):
    return t.catalogue.select(
        "event_id",
        joined(tx.resolve_provinces("location_name")).alias("provinces"),
        joined(tx.resolve_heat_regions("location_name")).alias("heat_regions"),
        joined(tx.resolve_dust_regions("location_name")).alias("dust_regions"),
    )
