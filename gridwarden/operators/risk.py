"""Rule scores, risk levels, evidence checks, ensemble and batch summaries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwarden.constants import FACTOR_TEXT, FEATURES
from gridwarden.functions import physical as ph
from gridwarden.functions.basic import Value, clamp, col, lit, pick

# Lower bounds of medium, high and extreme for rule results and for model fields.
RULE_BOUNDS = (0.25, 0.5, 0.75)
FIELD_BOUNDS = (0.20, 0.50, 0.75)


def risk_level(probability: Value, bounds: Sequence[float] = RULE_BOUNDS) -> Column:
    p = col(probability)
    return F.when(p >= bounds[2], "extreme").when(p >= bounds[1], "high").when(p >= bounds[0], "medium").otherwise("low")


def thresholds_from(payload: Mapping | None) -> tuple[float, float, float]:
    """Lower bounds from a mapping level -> [low, high] or {min, max}."""
    out = dict(zip(("medium", "high", "extreme"), RULE_BOUNDS))
    for level in out:
        item = (payload or {}).get(level)
        if isinstance(item, Mapping):
            out[level] = float(item.get("min", 0.0))
        elif isinstance(item, (list, tuple)) and len(item) == 2:
            out[level] = float(item[0])
    return out["medium"], out["high"], out["extreme"]


def risk_level_grid(probability: Value) -> Column:
    """0..3 scale of gridded model fields; its first bound is 0.20."""
    p = col(probability)
    return F.when(p >= FIELD_BOUNDS[2], 3).when(p >= FIELD_BOUNDS[1], 2).when(p >= FIELD_BOUNDS[0], 1).otherwise(0).cast("tinyint")


def _factors(*tests: tuple[Column, str]) -> Column:
    """Texts of the tests that hold, else the text for none: plain concatenation, which stays in generated code."""
    hits = [F.coalesce(t, F.lit(False)) for t, _ in tests]
    empty = F.array().cast("array<string>")
    parts = [F.when(h, F.array(F.lit(FACTOR_TEXT[k]))).otherwise(empty) for h, (_, k) in zip(hits, tests)]
    anything = hits[0]
    for h in hits[1:]:
        anything = anything | h
    return F.when(anything, F.concat(*parts)).otherwise(F.array(F.lit(FACTOR_TEXT["none"])))


def _evidence(df: DataFrame, names: Sequence[str]) -> Column:
    have = [n for n in names if n in df.columns]
    if not have:
        return F.create_map().cast("map<string,double>")
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).cast("double").alias("v")) for n in have])
    return F.map_from_entries(pairs)


def standard_indicator_values(df: DataFrame) -> dict[str, Column]:
    """Canonical indicators from the first existing alias; VPD and heat index are computed where missing."""
    temp, rh = pick(df, "t2m_c", "temp_c"), pick(df, "rh2m", "rh_percent")
    return {
        "temp_c": temp,
        "tmax_c": pick(df, "tmax_c"),
        "tmin_c": pick(df, "tmin_c"),
        "vpd_kpa": F.coalesce(pick(df, "vpd_kpa"), ph.vpd_kpa(temp, rh)),
        "heat_index_c": F.coalesce(pick(df, "heat_index_c"), ph.heat_index_c(temp, rh, "screening")),
        "wind_speed_mps": pick(df, "wind10_speed", "wind_speed_mps"),
        "relative_humidity_percent": rh,
        "sst_celsius": pick(df, "sst_celsius"),
        "daily_precip_total": pick(df, "daily_precip_total"),
        "daily_convective_precip": pick(df, "daily_convective_precip"),
        "daily_large_scale_precip": pick(df, "daily_large_scale_precip"),
        "cape": pick(df, "cape"),
        "pwat": pick(df, "pwat", "pwat_mm"),
        "ivt": pick(df, "ivt", "ivt_kg_m_s"),
        "wind850_speed": pick(df, "wind850_speed"),
        "wind_shear_850_200": pick(df, "wind_shear_850_200"),
        "flash_flood_risk": pick(df, "flash_flood_risk"),
        "daily_precip_anomaly": pick(df, "daily_precip_anomaly"),
        "t2m_anomaly_c": pick(df, "t2m_anomaly_c"),
        "tmax_anomaly_c": pick(df, "tmax_anomaly_c"),
        "heatwave_day_flag": pick(df, "heatwave_day_flag"),
        "heatwave_duration_days": pick(df, "heatwave_duration_days"),
    }


def _flash_flood(df: DataFrame) -> tuple[Column, Column, Column]:
    p1 = pick(df, "ds10_max_1h", "precip_1h_mm")
    p6 = pick(df, "ds10_max_6h", "precip_6h", "precip_6h_mm")
    p24 = pick(df, "daily_precip_total", "gpm_daily_precip", "precip_24h_mm")
    slope, soil, hard = pick(df, "slope_deg"), pick(df, "soil_moisture_frac"), pick(df, "impervious_frac")
    factors = _factors((p1 >= 25, "flood_rain_1h"), (p6 >= 60, "flood_rain_6h"), (slope >= 12, "flood_slope"), (hard >= 0.35, "flood_impervious"))
    evidence = _evidence(df, ("ds10_max_1h", "ds10_max_6h", "daily_precip_total", "gpm_daily_precip", "slope_deg"))
    return ph.flash_flood_score(p1, p6, p24, slope, soil, hard), factors, evidence


def _extreme_heat(df: DataFrame) -> tuple[Column, Column, Column]:
    temp, rh = pick(df, "t2m_c", "temp_c"), pick(df, "rh2m", "rh_percent")
    t = F.coalesce(temp, lit(0.0))
    h = F.coalesce(F.col("_hi"), t)
    p = F.greatest((t - 38.0) / 12.0, (h - 41.0) / 12.0) + F.when(t >= 45, lit(0.2)).otherwise(lit(0.0))
    factors = _factors((t >= 42, "heat_temp"), (h >= 45, "heat_index"), (rh >= 55, "heat_humidity"))
    return clamp(p), factors, _evidence(df, ("t2m_c", "rh2m", "heat_index_c", "tmax_c", "hot_day_flag", "hot_night_flag"))


def _dry_heat(df: DataFrame) -> tuple[Column, Column, Column]:
    temp, rh = pick(df, "t2m_c", "temp_c"), pick(df, "rh2m", "rh_percent")
    wind, vegetation = pick(df, "wind10_speed", "wind_speed_mps"), pick(df, "vegetation_index")
    factors = _factors((F.col("_vpd") >= 4, "dry_vpd"), (temp >= 40, "dry_temp"), (wind >= 8, "dry_wind"))
    return ph.dry_heat_score(temp, rh, wind, vegetation), factors, _evidence(df, ("t2m_c", "rh2m", "vpd_kpa", "wind10_speed", "bowen_ratio"))


def _dust(df: DataFrame) -> tuple[Column, Column, Column]:
    wind, gust = pick(df, "wind10_speed", "wind_speed_mps"), pick(df, "wind_gust_mps")
    soil, vegetation, sight = pick(df, "soil_moisture_frac"), pick(df, "vegetation_index"), pick(df, "visibility_km")
    score = clamp(F.greatest(ph.dust_score(wind, gust, soil, vegetation, sight), pick(df, "dust_risk_proxy")))
    factors = _factors((wind >= 12, "dust_wind"), (gust >= 18, "dust_gust"), (soil <= 0.12, "dust_soil"), (sight <= 5, "dust_visibility"))
    return score, factors, _evidence(df, ("wind10_speed", "strong_wind_flag", "dust_aod", "dust_surface_mass", "dust_risk_proxy"))


def _coastal_humid_heat(df: DataFrame) -> tuple[Column, Column, Column]:
    rh = pick(df, "rh2m", "rh_percent")
    wind = F.coalesce(pick(df, "wind10_speed", "wind_speed_mps"), lit(0.0))
    pwat, hi = F.col("_pwat"), F.col("_hi")
    ivt = F.coalesce(pick(df, "ivt", "ivt_kg_m_s"), ph.ivt_proxy(wind, pwat))
    distance = pick(df, "coastal_distance_km", default=120.0)
    p = (
        0.35 * clamp((F.coalesce(rh, lit(0.0)) - 55.0) / 35.0)
        + 0.30 * clamp((hi - 38.0) / 12.0)
        + 0.20 * clamp((pwat - 35.0) / 25.0)
        + 0.15 * (1.0 - clamp((F.coalesce(distance, lit(120.0)) - 20.0) / 180.0))
    )
    factors = _factors((distance <= 80, "coast_distance"), (rh >= 65, "coast_humidity"), (ivt >= 250, "coast_ivt"))
    return clamp(p), factors, _evidence(df, ("rh2m", "heat_index_c", "pwat", "ivt", "sst_celsius"))


RULES = {
    "flash_flood": _flash_flood,
    "extreme_heat": _extreme_heat,
    "dry_heat_agriculture": _dry_heat,
    "dust_potential": _dust,
    "coastal_humid_heat": _coastal_humid_heat,
}


def _scored(df: DataFrame, hazards: Sequence[str], bounds: Sequence[float]) -> tuple[DataFrame, Callable[[str], dict[str, Column]]]:
    """Rows with one probability column per hazard, and the fields of a hazard's entry as columns on them.

    Shared inputs and probabilities are columns of their own projection, so none is written out twice and
    the generated code stays small.
    """
    temp, rh = pick(df, "t2m_c", "temp_c"), pick(df, "rh2m", "rh_percent")
    pressure = pick(df, "surface_pressure", "pressure_hpa")
    pressure = F.when(pressure > 2000, pressure / 100.0).otherwise(pressure)
    rows = df.withColumns(
        {
            "_hi": F.coalesce(pick(df, "heat_index_c"), ph.heat_index_c(temp, rh, "screening")),
            "_vpd": F.coalesce(pick(df, "vpd_kpa"), ph.vpd_kpa(temp, rh)),
            "_pwat": F.coalesce(pick(df, "pwat", "pwat_mm"), ph.pwat_proxy(temp, rh, pressure)),
        }
    )
    rules = {h: RULES[h](df) for h in hazards}
    rows = rows.withColumns({f"_p_{h}": p for h, (p, _, _) in rules.items()})
    status = F.coalesce(F.col("source_status"), F.lit("normal")) if "source_status" in df.columns else F.lit("normal")

    def entry(h: str) -> dict[str, Column]:
        return {
            "risk_probability": F.col(f"_p_{h}"),
            "risk_level": risk_level(f"_p_{h}", bounds),
            "contributing_factors": rules[h][1],
            "indicator_evidence": rules[h][2],
            "model_family": F.lit("rule"),
            "model_name": F.lit("rule_screening_v1"),
            "model_version": F.lit("v1"),
            "inference_mode": F.lit("rule"),
            "source_status": status,
        }

    return rows, entry


def with_rule_scores(df: DataFrame, hazards: Sequence[str] = tuple(RULES), bounds: Sequence[float] = RULE_BOUNDS) -> DataFrame:
    """Add one struct column ``_risk_<hazard>`` per hazard."""
    rows, entry = _scored(df, hazards, bounds)
    made = {f"_risk_{h}": F.struct(F.lit(h).alias("hazard_type"), *[c.alias(n) for n, c in entry(h).items()]) for h in hazards}
    return rows.withColumns(made).drop("_hi", "_vpd", "_pwat", *[f"_p_{h}" for h in hazards])


def with_risks(df: DataFrame, hazards: Sequence[str] = tuple(RULES), bounds: Sequence[float] = RULE_BOUNDS) -> DataFrame:
    """Add the array ``risks``, one entry per hazard: a pure projection of the input row."""
    names = [f"_risk_{h}" for h in hazards]
    return with_rule_scores(df, hazards, bounds).withColumn("risks", F.array(*names)).drop(*names)


def scan_risks(
    df: DataFrame, keep: Sequence[str], hazards: Sequence[str] = tuple(RULES), bounds: Sequence[float] = RULE_BOUNDS
) -> DataFrame:
    """All hazards of all rows in long form, from one scan."""
    rows, entry = _scored(df, hazards, bounds)
    fields = {h: entry(h) for h in hazards}
    hazard = F.col("hazard_type")

    def chosen(name: str) -> Column:
        value = F.when(hazard == hazards[0], fields[hazards[0]][name])
        for h in hazards[1:]:
            value = value.when(hazard == h, fields[h][name])
        return value

    # the hazard comes before the fields, so fields that nobody reads are not computed
    long = rows.withColumn("hazard_type", F.explode(F.array(*[F.lit(h) for h in hazards])))
    same = ("model_family", "model_name", "model_version", "inference_mode", "source_status")
    own = {n: chosen(n) for n in ("risk_probability", "contributing_factors", "indicator_evidence")} | {n: fields[hazards[0]][n] for n in same}
    own["risk_level"] = risk_level(chosen("risk_probability"), bounds)
    return long.select(*keep, hazard, *[own[n].alias(n) for n in fields[hazards[0]]])


def score_single(df: DataFrame, hazard: str, bounds: Sequence[float] = RULE_BOUNDS) -> DataFrame:
    """Columns of one hazard's rule next to the input."""
    name = f"_risk_{hazard}"
    fields = ("risk_probability", "risk_level", "contributing_factors")
    return with_rule_scores(df, [hazard], bounds).select(*df.columns, *[f"{name}.{f}" for f in fields])


def evidence_check(risks: DataFrame, indicators: Sequence[str] = ()) -> DataFrame:
    """Completeness flags per risk, and per row whether all required indicators are present."""
    high = F.col("risk_level").isin("high", "extreme")
    has_factors = F.size("contributing_factors") > 0
    complete = F.lit(True)
    for name in indicators:
        complete = complete & (F.col(name).isNotNull() if name in risks.columns else F.lit(False))
    return risks.withColumns(
        {
            "has_model_version": F.length("model_version") > 0,
            "has_contributing_factors": has_factors,
            "has_indicator_evidence": F.size("indicator_evidence") > 0,
            "high_risk_requires_factors_ok": ~high | has_factors,
            "physical_indicators_complete": complete,
        }
    )


def review_required(risks: DataFrame, area: Sequence[str]) -> DataFrame:
    """Per area whether any hazard is high or extreme."""
    out = risks.groupBy(*area).agg(F.bool_or(F.col("risk_level").isin("high", "extreme")).alias("human_review_required"))
    return out.withColumn("status", F.when(F.col("human_review_required"), "pending").otherwise("not_required"))


def ensemble_stats(members: DataFrame, value: str, threshold: float, keys: Sequence[str]) -> DataFrame:
    x = col(value)
    return members.groupBy(*keys).agg(
        F.count(x).alias("member_count"),
        F.avg(x).alias("ensemble_mean"),
        F.stddev_pop(x).alias("ensemble_spread"),
        F.avg((x >= threshold).cast("double")).alias("exceedance_probability"),
    )


def risk_summary(risks: DataFrame) -> DataFrame:
    return risks.groupBy("hazard_type").agg(
        F.count("*").alias("rows"),
        F.min("risk_probability").alias("min_probability"),
        F.max("risk_probability").alias("max_probability"),
        F.avg("risk_probability").alias("mean_probability"),
    )


def top_areas(risks: DataFrame, area: Sequence[str], k: int) -> DataFrame:
    """The k highest areas per hazard; areas are reduced first and the rank filter is applied before the shuffle."""
    best = risks.groupBy("hazard_type", *area).agg(F.max("risk_probability").alias("risk_probability"))
    order = Window.partitionBy("hazard_type").orderBy(F.col("risk_probability").desc(), *area)
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def feature_names(hazard: str, evidence: bool = False) -> tuple[str, ...]:
    required, optional, extra = FEATURES[hazard]
    return required + optional + (extra if evidence else ())
