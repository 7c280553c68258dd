"""Joins and aggregations on feature tables: provinces, province days, region pools, seasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwarden.constants import FEATURES, FEATURE_NAMES
from gridwarden.functions.basic import Value, check, col, date_of, first_existing, numeric_columns, text, usable
from gridwarden.functions.text import dust_region
from gridwarden.operators.quantiles import exact_quantiles
from gridwarden.session import cut_lineage

# Numeric columns that are coordinates or file provenance, not features.
NOT_FEATURES = ("latitude", "longitude", "source_mtime_ns", "source_mtime_us", "source_size_bytes")
SEASON_FEATURES = (
    "temp_c",
    "tmax_c",
    "heat_index_c",
    "vpd_kpa",
    "wind_speed_mps",
    "relative_humidity_percent",
    "t2m_anomaly_c",
    "heatwave_day_flag",
    "heatwave_duration_days",
)


def attach_province(
    features: DataFrame,
    lookup: DataFrame,
    digits: int = 4,
    province: str = "province_name",
    lookup_province: str = "province_name",
    overwrite: bool = False,
) -> DataFrame:
    """Left join a province by rounded coordinates.

    The lookup is first reduced to one row per coordinate; two provinces on one coordinate fail the job.
    A non-blank province already present is kept unless ``overwrite``. The lookup grows with the grid,
    so no broadcast is forced: adaptive execution decides from its real size.
    """

    def key(name: str) -> Column:
        return F.bround(F.col(name).try_cast("double"), digits)

    found = lookup.select(key("latitude").alias("_la"), key("longitude").alias("_lo"), F.lower(text(lookup_province)).alias("_p"))
    found = found.filter(F.col("_la").isNotNull() & F.col("_lo").isNotNull() & (F.col("_p") != ""))
    found = found.groupBy("_la", "_lo").agg(F.min("_p").alias("_low"), F.max("_p").alias("_p"))
    found = found.withColumn("_p", check(F.col("_low") == F.col("_p"), F.col("_p"), "conflicting provinces for one coordinate")).drop("_low")
    out = features.withColumns({"_la": key("latitude"), "_lo": key("longitude")}).join(found, ["_la", "_lo"], "left")
    value = F.col("_p")
    if province in features.columns and not overwrite:
        value = F.coalesce(F.nullif(F.lower(text(province)), F.lit("")), F.col("_p"))
    return out.withColumn(province, value).drop("_la", "_lo", "_p")


def numeric_feature_columns(df: DataFrame) -> list[str]:
    return [c for c in numeric_columns(df) if c not in NOT_FEATURES]


def _of_hazard(df: DataFrame, hazard: str) -> DataFrame:
    return df.filter(F.lower(F.col("hazard_type")) == hazard) if "hazard_type" in df.columns else df


def province_day_mean(df: DataFrame, province: str = "province_name", hazard: str = "flash_flood", extra_keys: Sequence[str] = ()) -> DataFrame:
    """Mean of every numeric feature with cell counts per (date, province): one aggregate, combined map-side."""
    rows = _of_hazard(df, hazard).withColumns({province: F.lower(text(province))})
    rows = rows.filter(F.col(province) != "")
    names = [c for c in numeric_feature_columns(df) if c not in extra_keys]
    day = date_of("date")
    keyed = rows.withColumn("date", check(day.isNotNull(), day, "feature table contains invalid dates"))
    aggs = [F.count("*").alias("grid_cell_count")]
    if "source_status" in df.columns:
        aggs.append(F.count(F.when(F.lower("source_status") == "degraded", 1)).alias("degraded_grid_cell_count"))
    aggs += [F.avg(c).alias(c) for c in names]
    out = keyed.groupBy("date", province, *extra_keys).agg(*aggs)
    return out.withColumn("hazard_type", F.lit(hazard))


def dust_province_day(df: DataFrame, province: str = "province_name") -> DataFrame:
    """Province-day means of a dust table with region ids."""
    rows = df.withColumn("region_id", F.nullif(dust_region(province), F.lit("unknown"))).filter(F.coalesce("region_id", F.lit("")) != "")
    return province_day_mean(rows, province, "dust_storm", ("region_id",)).withColumn("sample_unit", F.lit("region_day"))


def _source_column(df: DataFrame, feature: str) -> str | None:
    return first_existing(df.columns, FEATURE_NAMES.get(feature, (feature,)))


#: Lots into which the rows of a group are dealt, for each row wanted, to find a value that the wanted rows reach.
_LOTS = 4


def _reaching(rows: DataFrame, keys: Sequence[str], value: str, lot: Sequence[str], k: int) -> DataFrame:
    """Rows that can be among the k with the largest ``value`` of their group: all of these and few more.

    Rows are dealt into lots and each lot gives its largest value, so k lots stand for k different rows, and the k-th of
    the lots' values is one that the k-th row reaches. A group with values in fewer lots keeps all its rows.
    """
    dealt = rows.groupBy(*keys, F.pmod(F.xxhash64(*[F.col(c) for c in lot]), F.lit(_LOTS * k)).alias("_lot")).agg(F.max(value).alias("_top"))
    best = F.sort_array(F.collect_list("_top"), asc=False)
    least = cut_lineage(dealt.groupBy(*keys).agg(best.alias("_tops")).filter(F.size("_tops") >= k).select(*keys, F.element_at("_tops", k).alias("_least")), "least")
    return rows.join(least, list(keys), "left").filter(F.coalesce(F.col(value) >= F.col("_least"), F.col("_least").isNull())).drop("_least")


def region_day_topk_pool(df: DataFrame, variable: str = "heat_index_c", k: int = 3, statistics: bool = True) -> DataFrame:
    """Per (date, region): features averaged over the k cells with the largest ``variable``, and group statistics.

    Only rows that can be among the k best cells of their group are ordered, and only these cells pass the shuffle; group
    statistics are combined map-side; the 0.9 quantile is exact without gathering a group. Without ``statistics`` the
    features' maxima, minima and quantiles over the group are left out, for tables that drop them.
    """
    keys = ["date", "region_id"]
    required, optional, extra = FEATURES["extreme_heat"]
    features = {f: s for f in required + optional + extra if (s := _source_column(df, f))}
    rows = df.filter(F.coalesce(text("region_id"), F.lit("")) != "")
    rows = rows.withColumns({"_sel": usable(variable), **{f"_f_{f}": usable(s) for f, s in features.items()}})
    tie = [c for c in ("grid_id", "latitude", "longitude") if c in df.columns]
    order = Window.partitionBy(*keys).orderBy(F.col("_sel").desc_nulls_last(), *tie)
    likely = _reaching(rows, keys, "_sel", ["_sel", *tie], k)
    top = likely.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= k)
    best = Window.partitionBy(*keys)
    top = top.withColumn("_valid", F.count("_sel").over(best)).filter(F.col("_sel").isNotNull() | (F.col("_valid") == 0))

    def pooled(f: str) -> Column:
        return (F.max if f == "heatwave_duration_days" else F.avg)(f"_f_{f}").alias(f)

    aggs = [F.count("*").alias("pooled_grid_cell_count"), *[pooled(f) for f in features]]
    if "grid_id" in df.columns:
        aggs.append(F.array_join(F.sort_array(F.collect_set(F.nullif(text("grid_id"), F.lit("")))), ",").alias("representative_grid_ids"))
    pool = top.groupBy(*keys).agg(*aggs)
    stats = [F.count("*").alias("grid_cell_count")]
    degraded = F.lower("source_status") == "degraded" if "source_status" in df.columns else F.lit(False)
    stats.append(F.count(F.when(degraded, 1)).alias("degraded_grid_cell_count"))
    if statistics:
        stats += [F.max(f"_f_{f}").alias(f"{f}_max") for f in features]
        if "relative_humidity_percent" in features:
            stats.append(F.min("_f_relative_humidity_percent").alias("relative_humidity_percent_min"))
        if "heatwave_day_flag" in features:
            stats.append(F.avg("_f_heatwave_day_flag").alias("heatwave_grid_fraction"))
    out = rows.groupBy(*keys).agg(*stats).join(pool, keys)
    if statistics:
        high = exact_quantiles(rows.select(*keys, *[F.col(f"_f_{f}").alias(f) for f in features]), keys, {f: [0.9] for f in features})
        out = out.join(high, keys, "left")
    return out.withColumns(
        {
            "hazard_type": F.lit("extreme_heat"),
            "sample_unit": F.lit("region_day"),
            "aggregation_mode": F.lit(f"topk_mean:{variable}"),
            "source_status": F.when(F.col("degraded_grid_cell_count") > 0, "degraded").otherwise("normal"),
        }
    )


def season_of(value: Value) -> Column:
    """Season of a date; December keeps its own year."""
    month = F.month(col(value))
    return F.when(month.isin(12, 1, 2), "winter").when(month <= 5, "spring").when(month <= 8, "summer").otherwise("autumn")


# Which extra statistics a season feature gets and its day-count thresholds.
_WITH_P90 = ("temp_c", "tmax_c", "heat_index_c", "vpd_kpa")
_DAY_COUNTS = {"temp_c": (35, 40), "tmax_c": (40, 45), "heat_index_c": (40,), "vpd_kpa": (2, 3)}


def season_keys(unit: str, region: str = "region_id") -> list[str]:
    if unit not in ("region-year", "region-season"):
        raise ValueError(f"unsupported sample unit: {unit}")
    return [region, "year", "season"] if unit == "region-season" else [region, "year"]


def region_season_aggregate(df: DataFrame, unit: str = "region-year", region: str = "region_id") -> DataFrame:
    """Daily regional features to one row per (region, year[, season])."""
    keys = season_keys(unit, region)
    day = date_of("date")
    rows = df.withColumn("date", check(day.isNotNull(), day, "feature table contains invalid dates")).withColumn(region, F.trim(region))
    rows = rows.withColumn("year", F.year("date"))
    if unit == "region-season":
        rows = rows.withColumn("season", F.lower(F.trim("season")) if "season" in df.columns else season_of("date"))
    features = [f for f in SEASON_FEATURES if f in df.columns]
    rows = rows.withColumns({f: usable(f) for f in features})
    aggs = [
        F.count("*").cast("double").alias("feature_row_count"),
        F.min("date").alias("aggregation_start_date"),
        F.max("date").alias("aggregation_end_date"),
    ]
    for f in features:
        aggs += [F.avg(f).alias(f"{f}_mean"), F.max(f).alias(f"{f}_max")]
        aggs.append((F.max if f == "heatwave_duration_days" else F.avg)(f).alias(f))
        aggs += [F.count(F.when(F.col(f) >= t, 1)).cast("double").alias(f"{f}_days_ge_{t}") for t in _DAY_COUNTS.get(f, ())]
        if f in ("relative_humidity_percent", "t2m_anomaly_c"):
            aggs.append(F.min(f).alias(f"{f}_min"))
        if f in ("heatwave_day_flag", "heatwave_duration_days"):
            aggs.append(F.sum(f).alias(f"{f}_sum"))
    out = rows.groupBy(*keys).agg(*aggs)
    wanted = {f: [0.9] for f in features if f in _WITH_P90}
    if "relative_humidity_percent" in features:
        wanted["relative_humidity_percent"] = [0.1]
    if wanted:
        high = exact_quantiles(rows, keys, wanted)
        group = F.struct(*keys).alias("_g")  # structs with equal nulls are equal
        out = out.select("*", group).join(high.select(group, *[c for c in high.columns if c not in keys]), "_g", "left").drop("_g")
    return out.withColumn("sample_unit", F.lit(unit))


def coordinate_counts(df: DataFrame, digits: int = 4) -> DataFrame:
    """Rows per rounded coordinate."""
    lat, lon = [F.bround(F.col(c).try_cast("double"), digits).alias(c) for c in ("latitude", "longitude")]
    return df.groupBy(lat, lon).agg(F.count("*").alias("feature_row_count"))
