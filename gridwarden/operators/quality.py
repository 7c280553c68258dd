"""Data-quality checks and feature ranges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwarden.constants import FEATURE_RANGES, FEATURE_UNITS
from gridwarden.functions.basic import Value, check, clip, col, date_of, first_existing, mask_range, usable

REQUIRED_FIELDS = ("temp_c", "rh_percent", "wind_speed_mps", "precip_1h_mm")


def missing_report(df: DataFrame, fields: Sequence[str] = REQUIRED_FIELDS, row_id: str = "grid_id") -> DataFrame:
    """One row per missing required value; a field without a column is missing everywhere."""
    present = [F.col(f).isNotNull() if f in df.columns else F.lit(False) for f in fields]
    gaps = F.array_compact(F.array(*[F.when(~ok, F.lit(f)) for f, ok in zip(fields, present)]))
    return df.select(row_id, F.explode(gaps).alias("field"))


def missing_summary(df: DataFrame, fields: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    gaps = [F.count("*") - (F.count(f) if f in df.columns else F.lit(0)) for f in fields]
    total = gaps[0]
    for g in gaps[1:]:
        total = total + g
    return df.agg(total.alias("missing_count")).withColumn("ok", F.col("missing_count") == 0)


def validate_units(units: DataFrame, expected: Mapping[str, str] = FEATURE_UNITS) -> DataFrame:
    """Fields whose unit differs from the expected one or is absent. ``units`` has (field, unit)."""
    wanted = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(u).alias("expected")) for f, u in expected.items()])
    have = units.groupBy("field").agg(F.max("unit").alias("actual"))
    table = units.sparkSession.range(1).select(F.explode(wanted).alias("_w")).select("_w.*")
    out = table.join(have, "field", "left")
    problem = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("expected"), "mismatch")
    return out.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def validate_time(df: DataFrame, time: str = "valid_time") -> DataFrame:
    """Rows whose time cannot be read."""
    return df.filter(F.try_to_timestamp(F.col(time).cast("string")).isNull())


def require_daily(df: DataFrame) -> DataFrame:
    """Add a DATE column from date, time or valid_time; unreadable or sub-daily values fail the job."""
    name = first_existing(df.columns, ("date", "time", "valid_time"))
    if name is None:
        raise KeyError("daily tables require a 'date', 'time' or 'valid_time' column")
    if isinstance(df.schema[name].dataType, T.DateType):
        return df.withColumn("date", F.col(name))
    stamp = F.try_to_timestamp(F.col(name).cast("string"))
    whole = stamp == F.date_trunc("day", stamp)
    return df.withColumn("date", check(stamp.isNotNull() & whole, date_of(name), "daily data needs readable dates without a time of day"))


def in_range(value: Value, feature: str) -> Column:
    """Value of a named feature held to its valid range."""
    return usable_in_range(usable(value), feature)


def usable_in_range(x: Column, feature: str) -> Column:
    """The same for a value that ``usable`` has seen, as a column of its own projection."""
    rule = FEATURE_RANGES.get(feature)
    if rule is None:
        return x
    kind, low, high = rule
    return clip(x, low, high) if kind == "clip" else mask_range(x, low, high)


def clip_features(df: DataFrame) -> DataFrame:
    return df.withColumns({c: in_range(c, c) for c in df.columns if c in FEATURE_RANGES})


def summary_stats(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Minimum, maximum and mean of the non-missing values, one row per field."""
    aggs = [F.struct(F.min(col(f)).alias("minimum"), F.max(col(f)).alias("maximum"), F.avg(col(f)).alias("mean")).alias(f) for f in fields]
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}.minimum"), F.col(f"{f}.maximum"), F.col(f"{f}.mean")) for f in fields])
    return df.agg(*aggs).select(F.explode(rows).alias("_r")).select("_r.*")


def dust_feature_coverage(df: DataFrame, features: Sequence[str] = ("dust_aod", "dust_column_mass", "dust_surface_mass")) -> DataFrame:
    """How much of a dust table has usable values, in one aggregate."""
    present = [f for f in features if f in df.columns]
    every, some = F.lit(bool(present)), F.lit(False)
    for f in present:
        ok = usable(f).isNotNull()
        every, some = every & ok, some | ok
    day = date_of("date") if "date" in df.columns else F.lit(None).cast("date")
    aggs = [F.count("*").alias("rows")]
    aggs += [F.count(usable(f)).alias(f"finite_{f}") if f in present else F.lit(0).cast("long").alias(f"finite_{f}") for f in features]
    aggs += [
        F.count(F.when(every, 1)).alias("finite_rows"),
        F.count(F.when(some, 1)).alias("rows_with_any"),
        F.count_distinct(F.when(every, day)).alias("dates_with_all"),
        F.count_distinct(F.when(some, day)).alias("dates_with_any"),
    ]
    out = df.agg(*aggs)
    status = F.when((F.col("rows") == 0) | F.lit(not present), "missing").when(F.col("finite_rows") == F.col("rows"), "complete").otherwise("partial")
    return out.withColumns(
        {
            "finite_row_fraction": F.coalesce(F.try_divide(F.col("finite_rows").cast("double"), F.col("rows").cast("double")), F.lit(0.0)),
            "coverage_status": status,
        }
    )


def value_counts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(name).cast("string"), F.lit("")).alias("value")).agg(F.count("*").alias("rows"))
