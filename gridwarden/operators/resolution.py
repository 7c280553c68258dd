"""Choosing between data sources, comparing them and falling back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwarden.functions.basic import col, flag, safe_ratio

CELL_DAY = ("date", "latitude", "longitude")


def registry(entries: Sequence[tuple[str, str, str, int]]) -> Column:
    """Source registry (family, dataset_id, role, quality_rank) as a literal array: a config table, not data."""
    return F.array(
        *[
            F.struct(F.lit(f).alias("family"), F.lit(d).alias("dataset_id"), F.lit(r).alias("role"), F.lit(q).alias("quality_rank"))
            for f, d, r, q in entries
        ]
    )


def resolve_source(available: DataFrame, entries: Sequence[tuple[str, str, str, int]]) -> DataFrame:
    """Per family and day the source to use: primary role first, then quality rank, then id.

    ``available`` has (family, dataset_id, date). It is reduced to one row per key before anything else,
    and a group then holds at most one row per registry entry.
    """
    have = available.select("family", "dataset_id", "date").distinct().withColumn("_ok", F.lit(True))
    days = have.select("date").distinct()
    candidates = days.select("date", F.explode(registry(entries)).alias("_r")).select("date", "_r.*")
    joined = candidates.join(have, ["family", "dataset_id", "date"], "left").withColumn("_ok", F.coalesce("_ok", F.lit(False)))
    role = F.when(F.col("role") == "primary", 0).otherwise(1)
    order = F.struct(role.alias("a"), F.col("quality_rank").alias("b"), F.col("dataset_id").alias("dataset_id"), F.col("role").alias("role"))
    step = F.struct(
        F.col("quality_rank").alias("quality_rank"),
        F.col("dataset_id").alias("dataset_id"),
        F.col("role").alias("role"),
        F.when(F.col("_ok"), "available").otherwise("missing").alias("status"),
    )
    out = joined.groupBy("family", "date").agg(
        F.min(F.when(F.col("_ok"), order)).alias("_best"),
        F.sort_array(F.collect_list(step)).alias("fallback_chain"),
        F.sort_array(F.collect_list(F.when(F.col("_ok"), order))).alias("_usable"),
    )
    return out.select(
        "family",
        "date",
        F.col("_best.dataset_id").alias("resolved_source"),
        F.col("_best.role").alias("resolved_role"),
        "fallback_chain",
        F.transform(F.slice("_usable", 2, F.greatest(F.size("_usable") - 1, F.lit(0))), lambda s: s["dataset_id"]).alias("secondary_sources"),
        F.when(F.col("_best").isNull(), "missing").when(F.size("_usable") > 1, "compared").otherwise("primary_only").alias("validation_status"),
    )


def compare_sources(
    primary: DataFrame, secondary: DataFrame, value: str, keys: Sequence[str] = CELL_DAY, by: Sequence[str] = ()
) -> DataFrame:
    """Mean and largest absolute difference, bias and overlap of two sources on their common cells."""
    joined = primary.select(*keys, F.col(value).alias("_a")).join(secondary.select(*keys, F.col(value).alias("_b")), list(keys))
    diff = F.col("_b") - F.col("_a")
    return joined.groupBy(*by).agg(
        F.avg(F.abs(diff)).alias("mean_abs_diff"),
        F.max(F.abs(diff)).alias("max_abs_diff"),
        F.avg(diff).alias("mean_bias"),
        F.coalesce(F.try_divide(F.count(diff).cast("double"), F.count("*").cast("double")), F.lit(0.0)).alias("overlap_fraction"),
    )


def fallback_field(
    base: DataFrame, other: DataFrame, value: str, fallback: str | None, alias: str, keys: Sequence[str] = CELL_DAY, by: Sequence[str] = ("date",)
) -> DataFrame:
    """Values of ``other`` where its source exists for the day, else the fallback column (or NULL) with a status.

    Falling back is decided per day (``by``), as a source is a file per day, not per cell.
    """
    days = other.select(*by).distinct().withColumn("_has", F.lit(True))
    out = base.join(other.select(*keys, F.col(value).alias("_v")), list(keys), "left").join(days, list(by), "left")
    replacement = F.col(fallback) if fallback else F.lit(None).cast("double")
    return out.withColumns(
        {
            alias: F.when(F.col("_has"), F.col("_v")).otherwise(replacement),
            f"{alias}_status": F.when(F.col("_has"), "compared").otherwise("degraded_primary_missing"),
        }
    ).drop("_v", "_has")


def precip_cross_check(df: DataFrame, satellite: str = "gpm_daily_precip", reanalysis: str = "daily_precip_total") -> DataFrame:
    s, r = col(satellite), col(reanalysis)
    return df.withColumns(
        {
            "gpm_era5_precip_diff": s - r,
            "gpm_era5_precip_ratio": safe_ratio(s, F.when(r > 0.1, r)),
            "gpm_era5_heavy_rain_overlap": (flag(s, 10.0) * flag(r, 10.0)).cast("tinyint"),
        }
    )


def grounding_issues(
    df: DataFrame,
    difference: str = "gpm_era5_precip_diff",
    status: str = "comparison_status",
    partition: str = "precip_partition",
    threshold: float = 10.0,
    note_missing: bool = True,
) -> DataFrame:
    """Array of (family, status, absolute_difference) per row: large gap, missing comparison, indirect rain split."""
    gap = F.abs(col(difference))

    def issue(family: str, kind: Column, size: Column) -> Column:
        return F.struct(F.lit(family).alias("family"), kind.alias("status"), size.alias("absolute_difference"))

    none = F.lit(None).cast("double")
    state, split = F.lower(F.trim(F.coalesce(col(status), F.lit("unknown")))), F.lower(F.trim(F.coalesce(col(partition), F.lit(""))))
    rain = F.when(gap >= threshold, issue("precip_daily", F.lit("threshold_exceeded"), gap))
    if note_missing:
        rain = rain.when(gap.isNull() & state.isin("missing", "not_run", "unavailable"), issue("precip_daily", state, none))
    indirect = F.when(
        ~split.isin("", "same_source_residual", "available"), issue("flash_flood_precipitation_partition", split, none)
    )
    return df.withColumn("issues", F.array_compact(F.array(rain, indirect))).withColumn("has_material_issue", F.size("issues") > 0)


def source_ids(df: DataFrame, metadata: str) -> DataFrame:
    """Primary and secondary source ids from a JSON map family -> {dataset_id, resolved_source, role}.

    The first source with role primary leads; without one the first secondary is promoted.
    """
    entry = "map<string, struct<dataset_id:string, resolved_source:string, role:string>>"
    families = F.map_entries(F.from_json(col(metadata), entry))

    def named(e: Column) -> Column:
        v = e["value"]
        return F.struct(
            F.coalesce(v["dataset_id"], v["resolved_source"], e["key"]).alias("id"), F.coalesce(v["role"], F.lit("secondary")).alias("role")
        )

    out = df.withColumn("_all", F.coalesce(F.transform(families, named), F.array()))
    lead = F.array_position(F.transform("_all", lambda s: s["role"]), "primary")
    out = out.withColumn("_lead", F.when(lead > 0, lead).otherwise(F.lit(1)).cast("int"))
    return out.withColumns(
        {
            "primary_source_id": F.get(F.col("_all"), F.col("_lead") - 1)["id"],
            "secondary_source_ids": F.transform(
                F.filter("_all", lambda s, i: i != F.col("_lead") - 1), lambda s: s["id"]
            ),
        }
    ).drop("_all", "_lead")
