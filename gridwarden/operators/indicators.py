"""Operators that add indicator columns from whichever inputs a table has."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwarden.constants import FEATURES
from gridwarden.functions import physical as ph
from gridwarden.functions.basic import clip, lit
from gridwarden.operators.temporal import heatwave_flag

_SOURCE_COLUMNS = ("temp_c", "dewpoint_c", "rh_percent", "pressure_hpa", "wind_speed_mps", "u_wind_mps", "v_wind_mps")


def derive_indicators(df: DataFrame, variable_map: Mapping[str, str] | None = None) -> DataFrame:
    """Add humidity, dewpoint depression, VPD, heat index, PWAT, wind and IVT where inputs allow."""
    names = {n: (variable_map or {}).get(n, n) for n in _SOURCE_COLUMNS}
    have = {n: F.col(actual) for n, actual in names.items() if actual in df.columns}
    out: dict[str, Column] = {}
    if "rh_percent" not in have and {"temp_c", "dewpoint_c"} <= have.keys():
        have["rh_percent"] = out["rh_percent"] = ph.rh_from_dewpoint(have["temp_c"], have["dewpoint_c"])
    if {"temp_c", "dewpoint_c"} <= have.keys():
        out["dewpoint_depression_c"] = ph.dewpoint_depression(have["temp_c"], have["dewpoint_c"])
    if {"temp_c", "rh_percent"} <= have.keys():
        t, r = have["temp_c"], have["rh_percent"]
        out["vpd_kpa"] = ph.vpd_kpa(t, r)
        out["heat_index_c"] = ph.heat_index_c(t, r, "screening")
        out["pwat_mm"] = ph.pwat_proxy(t, r, have.get("pressure_hpa", 1010.0))
    if "wind_speed_mps" not in have and {"u_wind_mps", "v_wind_mps"} <= have.keys():
        have["wind_speed_mps"] = out["wind_speed_mps"] = ph.wind_speed(have["u_wind_mps"], have["v_wind_mps"])
    if "wind_speed_mps" in have and "pwat_mm" in out:
        out["ivt_kg_m_s"] = ph.ivt_proxy(have["wind_speed_mps"], out["pwat_mm"])
    return df.withColumns(out)


def derive_forecast_fields(df: DataFrame) -> DataFrame:
    """Fill missing forecast features by formula or proxy and record how each was obtained.

    The plan is chosen from the columns present. The map column ``feature_status`` holds, per feature,
    direct, derived, proxy or derived_context_only. Anomalies come from ``climatology_anomaly``.
    """
    have = {c: F.col(c) for c in df.columns}
    out: dict[str, Column] = {}
    status: dict[str, str] = {}

    def source(name: str) -> Column | None:
        return have.get(name, out.get(name))

    def add(name: str, value: Column, kind: str, always: bool = False) -> None:
        if always or name not in have:
            out[name] = value
            status[name] = kind

    for name in ("pwat", "ivt", "wind850_speed", "wind_shear_850_200", "daily_convective_precip"):
        if name in have:
            status[name] = "direct"
    if "daily_large_scale_precip" in have:
        status["daily_large_scale_precip"] = "derived"
    for name in ("temp_c", "tmax_c", "tmin_c", "heat_index_c", "vpd_kpa", "daily_precip_total", "relative_humidity_percent"):
        if name in have:
            status[name] = "direct"
    if {"temp_c", "rh_percent"} <= have.keys():
        t, r = have["temp_c"], have["rh_percent"]
        add("relative_humidity_percent", clip(r, 0.0, 100.0), "derived")
        add("heat_index_c", ph.heat_index_c(t, r, "screening"), "derived")
        add("vpd_kpa", ph.vpd_kpa(t, r), "derived")
        add("pwat", ph.pwat_proxy(t, r, have.get("pressure_hpa")), "proxy")
        if "cape_j_kg" not in have:
            add("cape", ph.cape_proxy(t, r), "proxy", always=True)
        flag = heatwave_flag(t, have.get("tmax_c", lit(0.0) * F.lit(None)), source("heat_index_c"))
        add("heatwave_day_flag", flag, "derived_context_only")
        add("heatwave_duration_days", source("heatwave_day_flag"), "derived_context_only")
    if "cape_j_kg" in have:
        add("cape", have["cape_j_kg"], "direct", always=True)
    wind = have.get("wind_speed_mps")
    if wind is not None:
        status["wind_speed_mps"] = "direct"
    hour, day = have.get("precip_1h_mm"), have.get("precip_24h_mm")
    if day is None and hour is not None:
        day = hour * 24.0
        status["daily_precip_total"] = "proxy"
    cape = source("cape")
    if day is not None:
        total = clip(day, 0.0)
        if "daily_precip_total" not in have:
            out["daily_precip_total"] = total
            status.setdefault("daily_precip_total", "direct")
        convective_given = "daily_convective_precip" in have
        if not convective_given:
            share = clip(0.35 + cape / 2500.0, 0.35, 0.85) if cape is not None else lit(0.55)
            add("daily_convective_precip", total * share, "proxy")
        rest = clip(total - source("daily_convective_precip"), 0.0)
        add("daily_large_scale_precip", rest, "derived" if convective_given else "proxy")
    pwat = source("pwat")
    if pwat is not None and wind is not None:
        add("ivt", ph.ivt_proxy(wind, pwat), "proxy")
        low = clip(wind * 1.15, 0.0)
        shear = clip(low * 0.45, 0.0)
        if cape is not None:
            shear = shear + clip(cape / 200.0, 0.0, 20.0)
        add("wind850_speed", low, "proxy")
        add("wind_shear_850_200", shear, "proxy")
    if day is not None:
        p1 = hour if hour is not None else day / 24.0
        p6 = F.when(day.isNotNull() & p1.isNotNull(), F.least(F.greatest(p1 * 6.0, lit(0.0)), day))
        known = p1.isNotNull() & day.isNotNull()
        add("flash_flood_risk", F.when(known, ph.flash_flood_score(p1, p6, day)), "derived", always=True)
    items: list[Column] = []
    for name, kind in status.items():
        items += [F.lit(name), F.lit(kind)]
    return df.withColumns({**out, "feature_status": F.create_map(*items)})


def runtime_degradation(df: DataFrame, status: str = "feature_status", source_status: str | None = None) -> DataFrame:
    """Mark a row degraded when its convective split is a proxy."""
    proxy = F.coalesce(F.try_element_at(F.col(status), F.lit("daily_convective_precip")) == "proxy", F.lit(False))
    given = F.coalesce(F.col(source_status), F.lit("normal")) if source_status else F.lit("normal")
    return df.withColumns(
        {
            "effective_source_status": F.when(proxy, F.lit("degraded")).otherwise(given),
            "fallback_reason": F.when(proxy, F.lit("direct_precip_partition_unavailable")),
        }
    )


def feature_status_report(df: DataFrame, status: str = "feature_status") -> DataFrame:
    """Lists of proxy, unavailable and context-only features and the overall states drawn from them."""
    flood = list(FEATURES["flash_flood"][0])
    heat = ["temp_c", "tmax_c", "tmin_c", "heat_index_c", "vpd_kpa", "relative_humidity_percent"]
    heat += ["t2m_anomaly_c", "tmax_anomaly_c", "heatwave_day_flag", "heatwave_duration_days"]
    m = F.col(status)

    def with_status(names: list[str], kind: str) -> Column:
        return F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.coalesce(F.try_element_at(m, n) == kind, F.lit(False)))

    def of(name: str) -> Column:
        return F.coalesce(F.try_element_at(m, F.lit(name)), F.lit("missing"))

    conv, large = of("daily_convective_precip"), of("daily_large_scale_precip")
    split = (
        F.when(conv == "proxy", "heuristic_proxy_fallback")
        .when((conv == "direct") & (large == "derived"), "same_source_residual")
        .when((conv == "direct") & (large == "direct"), "direct_partition")
        .otherwise("unavailable")
    )
    proxies, absent = with_status(flood, "proxy"), with_status(heat, "unavailable")
    compared = (of("t2m_anomaly_c") == "derived") | (of("tmax_anomaly_c") == "derived")
    return df.withColumns(
        {
            "proxy_features": proxies,
            "unavailable_features": absent,
            "context_only_features": with_status(heat, "derived_context_only"),
            "flood_status": F.when(F.size(proxies) > 0, "proxy_present").otherwise("direct_only"),
            "heat_status": F.when(F.size(absent) > 0, "comparison_not_available")
            .when(compared, "comparison_available")
            .otherwise("context_only"),
            "precip_partition": split,
        }
    )
