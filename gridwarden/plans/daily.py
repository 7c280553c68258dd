"""The daily indicator build: hourly surface and pressure fields to one wide row per (date, cell)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwarden.functions import physical as ph
from gridwarden.functions.basic import clip, flag, lit, mask_range, safe_ratio, to_unit
from gridwarden.operators.resolution import fallback_field, precip_cross_check
from gridwarden.operators.stencil import air_columns, flux_divergence, level_indicators, slope_deg, vorticity, wind_picks
from gridwarden.operators.temporal import monthly_to_daily, rolling_totals

CELL = ("latitude", "longitude")
KEYS = ("date", *CELL)


def surface_days(single: DataFrame, temperature: str = "K", depth: str = "m") -> DataFrame:
    """All surface indicators in one pass: hourly physics, rain increases and daily reductions.

    Physics is computed per hour and then reduced, never from daily means. The increase window and the
    aggregate share the partitioning (date, cell), so the hourly rows are shuffled once. Each day stands
    alone: its first step has no increase. ``temperature`` and ``depth`` are the units of temperatures and of rain;
    values already in degC and mm pass as they are, so a value on a limit stays there.
    """
    t = mask_range(to_unit("t2m", temperature, "degC"), -40.0, 65.0)
    d = mask_range(to_unit("d2m", temperature, "degC"), -60.0, 45.0)
    hourly = single.withColumns({"date": F.to_date("time"), "_t": t, "_d": d})
    hourly = hourly.withColumns(
        {"_rh": mask_range(ph.rh_from_dewpoint("_t", "_d"), 0.0, 100.0), "_w": mask_range(ph.wind_speed("u10", "v10"), 0.0, 80.0)}
    )
    rh = F.col("_rh")
    hourly = hourly.withColumns(
        {
            "_vpd": mask_range(ph.sat_vapor_pressure_kpa("_t") * (1.0 - rh / 100.0), 0.0, 15.0),
            "_hi": ph.heat_index_c("_t", "_rh"),
            "_at": mask_range(ph.apparent_temperature_c("_t", "_rh", "_w"), -40.0, 75.0),
            "_wb": mask_range(ph.wet_bulb_c("_t", "_rh"), -40.0, 45.0),
        }
    )
    day = Window.partitionBy("date", *CELL).orderBy("time")
    second = F.row_number().over(day) > 1

    def increase(v: str) -> Column:
        mm = to_unit(v, depth, "mm")
        return F.when(second, F.when(F.hour("time") == 0, clip(mm, 0.0)).otherwise(clip(mm - F.lag(mm).over(day), 0.0)))

    hourly = hourly.withColumns({"_tp": increase("tp"), "_cp": increase("cp")})
    out = hourly.groupBy(*KEYS).agg(
        F.avg("_t").alias("t2m_c"),
        F.avg("_d").alias("d2m_c"),
        F.avg("_rh").alias("rh2m"),
        F.avg(F.col("_t") - F.col("_d")).alias("dewpoint_depression_c"),
        F.avg("_vpd").alias("vpd_kpa"),
        F.avg("_hi").alias("heat_index_c"),
        F.avg("_at").alias("apparent_temp_c"),
        F.avg("_wb").alias("wet_bulb_proxy_c"),
        F.avg("_w").alias("wind10_speed"),
        to_unit(F.max("mx2t"), temperature, "degC").alias("tmax_c"),
        to_unit(F.min("mn2t"), temperature, "degC").alias("tmin_c"),
        *[(F.avg(v) * 100.0).alias(n) for v, n in (("tcc", "total_cloud_cover"), ("lcc", "low_cloud_cover"), ("mcc", "middle_cloud_cover"), ("hcc", "high_cloud_cover"))],
        F.coalesce(F.sum("_tp"), lit(0.0)).alias("daily_precip_total"),
        F.coalesce(F.sum("_cp"), lit(0.0)).alias("daily_convective_precip"),
        F.avg("ssrd").alias("sw_net"),
        F.avg("strd").alias("lw_net"),
        F.avg("sshf").alias("_sensible"),
        F.avg("slhf").alias("_latent"),
        F.max("cape").alias("cape"),
        F.min("cin").alias("cin"),
        F.avg("sp").alias("surface_pressure"),
    )
    rain = F.col("daily_precip_total")
    return out.withColumns(
        {
            "diurnal_temp_range_c": F.col("tmax_c") - F.col("tmin_c"),
            "hot_day_flag": flag("tmax_c", 45.0),
            "hot_night_flag": flag("tmin_c", 30.0),
            "compound_heat_flag": (flag("heat_index_c", 41.0) * flag("vpd_kpa", 3.0)).cast("tinyint"),
            "daily_large_scale_precip": clip(rain - F.col("daily_convective_precip"), 0.0),
            "convective_precip_ratio": ph.convective_ratio("daily_convective_precip", rain),
            "net_radiation": F.col("sw_net") + F.col("lw_net"),
            "bowen_ratio": safe_ratio("_sensible", "_latent"),
            "radiative_heat_load": 2.0 * F.col("sw_net") + F.col("lw_net"),
            "heavy_rain_flag": flag(rain, 25.0),
            "extreme_rain_flag": flag(rain, 50.0),
            "strong_wind_flag": flag("wind10_speed", 10.0),
        }
    ).drop("_sensible", "_latent")


def pressure_days(pressure: DataFrame) -> DataFrame:
    """Moisture transport, winds, shear and vorticity from the first timestamp of each day."""
    rows = pressure.withColumn("date", F.to_date("time"))
    first = rows.groupBy("date").agg(F.min("time").alias("time"))
    rows = rows.join(first, ["date", "time"], "left_semi").drop("time")
    extra = {"divergence850": ("d", 850), "omega700": ("w", 700), "omega500": ("w", 500), "relative_humidity850": ("r", 850)}
    present = {n: v for n, v in extra.items() if v[0] in rows.columns}
    out = level_indicators(air_columns(rows, KEYS, wind_picks(rows.columns) | present))
    out = flux_divergence(vorticity(out, keys=("date",)), keys=("date",))
    for name in extra:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("double"))
    return out.drop(*[f"{w}{lev}" for lev in (925, 850, 300, 200) for w in ("u", "v")], "q925", "q850", "z500")


def build_daily_indicators(
    single: DataFrame,
    pressure: DataFrame,
    elevation: DataFrame,
    satellite: DataFrame | None = None,
    dust: DataFrame | None = None,
    sst: DataFrame | None = None,
    monthly: DataFrame | None = None,
    temperature: str = "K",
    depth: str = "m",
) -> DataFrame:
    """One lazy plan over the whole date range; the date filter of the caller is a partition filter.

    All inputs are on the standard grid. ``satellite`` has (date, cell, precipitation), ``dust`` (date,
    cell, DUEXTTAU, DUCMASS, DUSMASS), ``sst`` (date, cell, sst_celsius), ``monthly`` (month, cell, precip).
    ``temperature`` and ``depth`` are the units of the temperatures and the rain in ``single``.
    """
    out = surface_days(single, temperature, depth).join(pressure_days(pressure), list(KEYS), "left")
    out = rolling_totals(out, "daily_precip_total", cell=CELL)  # one row per (date, cell) by now
    if satellite is None:
        out = out.withColumns(
            {"gpm_daily_precip": F.col("daily_precip_total"), "gpm_daily_precip_status": F.lit("degraded_primary_missing")}
        )
    else:
        out = fallback_field(out, satellite, "precipitation", "daily_precip_total", "gpm_daily_precip", KEYS)
    out = precip_cross_check(out)
    names = {"DUEXTTAU": "dust_aod", "DUCMASS": "dust_column_mass", "DUSMASS": "dust_surface_mass"}
    if dust is None:
        out = out.withColumns({n: F.lit(None).cast("double") for n in names.values()})
    else:
        out = out.join(dust.select(*KEYS, *[F.col(v).alias(n) for v, n in names.items()]), list(KEYS), "left")
    if sst is None:
        out = out.withColumn("sst_celsius", F.lit(None).cast("double"))
    else:
        out = out.join(sst.select(*KEYS, "sst_celsius"), list(KEYS), "left")
    ground = slope_deg(elevation.select(*CELL, "elevation_m")).withColumnRenamed("elevation_m", "orography")
    out = out.join(ground, list(CELL), "left")
    out = out.withColumns(
        {
            "dust_risk_proxy": ph.dust_risk_proxy("wind10_speed", "dust_aod", "dust_surface_mass"),
            "dust_emission_flag": (flag("wind10_speed", 8.0) * flag("dust_surface_mass", 5.0e-4)).cast("tinyint"),
            "flash_flood_risk": ph.flash_flood_score("daily_precip_total", "daily_precip_total", "gpm_daily_precip", "slope_deg", 0.15, 0.05),
        }
    )
    if monthly is not None:
        out = monthly_to_daily(out, monthly, "precip").withColumnsRenamed(
            {"monthly_precip_total": "monthly_chirps_precip_total", "monthly_precip_mmday": "monthly_chirps_precip_mmday"}
        )
    return out
