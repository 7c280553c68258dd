"""Daily reductions, de-accumulation, rolling totals, climatology, nearest-time selection, audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwarden.functions.basic import clip, col, lit
from gridwarden.functions.physical import precip_flag, wind_speed
from gridwarden.session import cut_lineage

CELL = ("latitude", "longitude")


def daily_reduce(
    df: DataFrame,
    mean: Sequence[str] = (),
    maximum: Sequence[str] = (),
    minimum: Sequence[str] = (),
    total: Sequence[str] = (),
    cell: Sequence[str] = CELL,
) -> DataFrame:
    """All calendar-day reductions of all variables in one aggregate, missing values skipped."""
    aggs = [F.avg(v).alias(f"{v}_mean") for v in mean]
    aggs += [F.max(v).alias(f"{v}_max") for v in maximum]
    aggs += [F.min(v).alias(f"{v}_min") for v in minimum]
    aggs += [F.sum(v).alias(f"{v}_sum") for v in total]
    return df.groupBy(F.to_date("time").alias("date"), *cell).agg(*aggs)


def deaccumulate_daily(
    df: DataFrame, values: Sequence[str], cell: Sequence[str] = CELL, across_days: bool = True, scale: float = 1.0
) -> DataFrame:
    """Daily sums of step-to-step increases of running totals.

    The first step has no increase; at hour 0 the raw value is taken as a reset; both are clipped at 0.
    The window is partitioned by (cell, day), so no single cell history lands in one task. With
    ``across_days`` the last value of the previous day with data is carried in from a table with one row
    per (cell, day); without it each day stands alone and loses its first step.
    """
    steps = df.select(*cell, "time", F.to_date("time").alias("date"), *[(col(v) * scale).alias(v) for v in values])
    day = Window.partitionBy(*cell, "date").orderBy("time")
    first = F.row_number().over(day) == 1
    prior = {f"_p_{v}": F.lag(v).over(day) for v in values}
    steps = steps.withColumns({"_first": first, **prior})
    if across_days:
        ends = df.groupBy(*cell, F.to_date("time").alias("date")).agg(
            F.max_by(F.struct(*[(col(v) * scale).alias(v) for v in values]), "time").alias("_end")
        )
        ends = ends.withColumn("_end", F.lag("_end").over(Window.partitionBy(*cell).orderBy("date")))
        has_prior = ~F.col("_first") | F.col("_end").isNotNull()
        steps = steps.join(ends, [*cell, "date"], "left")
        steps = steps.withColumns(
            {f"_p_{v}": F.when(F.col("_first"), F.col(f"_end.{v}")).otherwise(F.col(f"_p_{v}")) for v in values}
        ).withColumn("_has_prior", has_prior)
    else:
        steps = steps.withColumn("_has_prior", ~F.col("_first"))

    def increase(v: str) -> Column:
        reset = clip(v, 0.0)
        return F.when(F.col("_has_prior"), F.when(F.hour("time") == 0, reset).otherwise(clip(F.col(v) - F.col(f"_p_{v}"), 0.0)))

    out = steps.groupBy("date", *cell).agg(
        F.max("_has_prior").alias("_any"), *[F.sum(increase(v)).alias(f"{v}_daily") for v in values]
    )
    out = out.filter("_any").drop("_any")
    return out.withColumns({f"{v}_daily": F.coalesce(clip(f"{v}_daily", 0.0), lit(0.0)) for v in values})


def rolling_precip(daily: DataFrame, value: str, days: Sequence[int] = (3, 7), cell: Sequence[str] = CELL) -> DataFrame:
    """Totals over the last N calendar days, missing days skipped.

    Input is first made one row per (cell, day), so a cell's window holds at most one row per day.
    """
    return rolling_totals(daily.groupBy(*cell, "date").agg(F.sum(value).alias(value)), value, days, cell)


def rolling_totals(per_day: DataFrame, value: str, days: Sequence[int] = (3, 7), cell: Sequence[str] = CELL) -> DataFrame:
    """The same on rows that are already one per (cell, day); other columns stay."""
    over = Window.partitionBy(*cell).orderBy(F.unix_date("date"))
    return per_day.withColumns(
        {f"precip_{n}day": F.coalesce(F.sum(value).over(over.rangeBetween(-(n - 1), 0)), lit(0.0)) for n in days}
    )


def daily_precip_stats(df: DataFrame, value: str = "precipitation", heavy: float = 25.0, extreme: float = 50.0, cell: Sequence[str] = CELL) -> DataFrame:
    """Daily total, largest step and 0/1/2 flag."""
    out = df.groupBy(F.to_date("time").alias("date"), *cell).agg(
        F.coalesce(F.sum(value), lit(0.0)).alias("daily_precip_total_mm"), F.max(value).alias("daily_precip_max_step_mm")
    )
    return out.withColumn("daily_precip_extreme_flag", precip_flag("daily_precip_total_mm", heavy, extreme))


def hourly_max_wind(df: DataFrame, u: str = "u10", v: str = "v10", cell: Sequence[str] = CELL) -> DataFrame:
    return df.groupBy(*cell, F.date_trunc("hour", "time").alias("hour")).agg(F.max(wind_speed(u, v)).alias("hourly_max_wind10_m_s"))


def day_of_year_climatology(df: DataFrame, variables: Sequence[str] = ("temp_c", "tmax_c")) -> DataFrame:
    """Sum, count and mean per day of year, and over all days (row with NULL day): at most 367 rows."""
    sums = [F.sum(v).alias(f"{v}_sum") for v in variables] + [F.count(v).alias(f"{v}_count") for v in variables]
    out = df.groupingSets([[F.dayofyear("date")], []], F.dayofyear("date")).agg(*sums)
    out = out.withColumnRenamed(out.columns[0], "day_of_year")
    return out.withColumns({f"{v}_mean": F.try_divide(f"{v}_sum", F.col(f"{v}_count").cast("double")) for v in variables})


def climatology_anomaly(df: DataFrame, climatology: DataFrame, variable: str, alias: str) -> DataFrame:
    """Value minus the day-of-year mean, else minus the overall mean, with the method used.

    The climatology has at most 367 rows by construction, so broadcasting it is safe at any scale.
    """
    clim = climatology.select(F.col("day_of_year").alias("_doy"), F.col(f"{variable}_mean").alias("_mean"))
    by_day = F.broadcast(clim.filter("_doy is not null"))
    overall = F.broadcast(clim.filter("_doy is null").select(F.lit(1).alias("_one"), F.col("_mean").alias("_all")))
    out = df.withColumns({"_doy": F.dayofyear("date"), "_one": F.lit(1)}).join(by_day, "_doy", "left").join(overall, "_one", "left")
    out = out.withColumns(
        {
            alias: F.col(variable) - F.coalesce("_mean", "_all"),
            f"{alias}_method": F.when(F.col("_mean").isNotNull(), "day_of_year_archive_mean")
            .when(F.col("_all").isNotNull(), "historical_indicator_archive_mean_fallback")
            .otherwise("climatology_comparison_unavailable"),
        }
    )
    return out.drop("_doy", "_one", "_mean", "_all")


def nearest_time_select(
    targets: DataFrame, series: DataFrame, values: Sequence[str], tolerance_seconds: int, keys: Sequence[str] = (), strict: bool = False
) -> DataFrame:
    """For each target time the series row nearest in time within a tolerance; ties go to the later row,
    and of several rows of one time to the smallest values.

    An as-of join without pairs: targets and series rows together are dealt to ranges of (key, time) of much the same
    size, so a key that holds most rows is spread over many ranges, and targets of one time are, too. Each range is merged by
    one window; its last and first series rows go to the ranges after and before it through a table of one row per
    range and key. ``strict`` fails the job when a target has no row near enough.
    """
    width = int(tolerance_seconds)

    def stamped(df: DataFrame) -> DataFrame:
        return df.withColumns({"_s": F.unix_micros(F.col("time").cast("timestamp")), "_k": F.struct(*keys) if keys else F.lit(0)})

    points = stamped(series).groupBy("_k", "_s").agg(F.min(F.struct(*values)).alias("_v"))
    points = points.select("_k", "_s", F.struct(F.col("_s").alias("s"), *[F.col(f"_v.{v}").alias(v) for v in values]).alias("_row"))
    carry_cols = [c for c in targets.columns if c not in keys]
    wanted = stamped(targets).select("_k", "_s", F.struct(*carry_cols).alias("_t"), F.xxhash64("_s", *[c for c in carry_cols if targets.schema[c].dataType.typeName() != "map"]).alias("_spread"))
    mixed = wanted.unionByName(points, allowMissingColumns=True)
    # stored, as the bounds of the ranges come from a sample
    mixed = cut_lineage(mixed.repartitionByRange("_k", "_s", F.col("_row").isNull(), "_spread").drop("_spread").withColumn("_range", F.spark_partition_id()), "ranges")
    edges = mixed.groupBy("_range", "_k").agg(F.max_by("_row", F.when(F.col("_row").isNotNull(), F.col("_s"))).alias("_last"), F.min_by("_row", F.when(F.col("_row").isNotNull(), F.col("_s"))).alias("_head"))
    over = Window.partitionBy("_k").orderBy("_range")
    carried = edges.select(
        "_range",
        "_k",
        F.last("_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_from_before"),
        F.first("_head", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_from_after"),
    )
    order = Window.partitionBy("_range", "_k").orderBy("_s", F.col("_row").isNull())
    back = Window.partitionBy("_range", "_k").orderBy(F.col("_s").desc(), F.col("_row").isNull())
    mixed = mixed.withColumns(
        {
            "_before": F.last("_row", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "_after": F.last("_row", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)),
        }
    ).filter(F.col("_t").isNotNull())
    mixed = mixed.join(carried, ["_range", "_k"], "left")
    mixed = mixed.withColumns({"_before": F.coalesce("_before", "_from_before"), "_after": F.coalesce("_after", "_from_after")})
    gap_before, gap_after = F.col("_s") - F.col("_before.s"), F.col("_after.s") - F.col("_s")
    near = F.when(F.col("_after").isNull() | (gap_before < gap_after), F.col("_before")).otherwise(F.col("_after"))
    out = mixed.withColumn("_near", near)
    gap = F.abs(F.col("_near.s") - F.col("_s"))
    hit = gap <= width * 1_000_000
    if strict:
        hit = F.coalesce(hit, F.lit(False)) | F.raise_error(F.lit("no time within tolerance")).cast("boolean")
    out = out.withColumn("_hit", F.when(hit, F.col("_near")))
    return out.select(
        *[F.col(f"_k.{k}").alias(k) for k in keys], "_t.*", *[F.col(f"_hit.{v}").alias(v) for v in values], F.timestamp_micros("_hit.s").alias("selected_time")
    )


def monthly_to_daily(days: DataFrame, monthly: DataFrame, value: str, cell: Sequence[str] = CELL) -> DataFrame:
    """Month totals and their per-day share on the days of the month."""
    month = monthly.select(F.trunc("month", "MM").alias("_month"), *cell, F.col(value).alias("monthly_precip_total"))
    out = days.withColumn("_month", F.trunc("date", "MM")).join(month, ["_month", *cell], "left").drop("_month")
    return out.withColumn("monthly_precip_mmday", F.col("monthly_precip_total") / F.day(F.last_day("date")))


def lead_schedule(fields: DataFrame, leads: Sequence[int]) -> DataFrame:
    """One row per lead hour with the valid time and the key ``variable:+Nh``."""
    out = fields.withColumn("lead_hours", F.explode(F.array(*[F.lit(int(h)) for h in leads])))
    return out.withColumns(
        {
            "valid_time": F.col("issue_time") + F.make_dt_interval(hours="lead_hours"),
            "field_key": F.format_string("%s:+%dh", F.col("variable"), F.col("lead_hours")),
        }
    )


def heatwave_flag(temp: str = "temp_c", tmax: str = "tmax_c", heat_index: str = "heat_index_c") -> Column:
    """1 if any threshold is met, 0 if not, NULL if all three values are missing."""
    tests = [F.coalesce(col(temp) >= 40.0, F.lit(False)), F.coalesce(col(tmax) >= 45.0, F.lit(False)), F.coalesce(col(heat_index) >= 40.0, F.lit(False))]
    known = col(temp).isNotNull() | col(tmax).isNotNull() | col(heat_index).isNotNull()
    return F.when(known, (tests[0] | tests[1] | tests[2]).cast("double"))


def heatwave_runs(daily: DataFrame, flag: str = "heatwave_day_flag", cell: Sequence[str] = CELL) -> DataFrame:
    """Runs of consecutive flagged days per cell with their length.

    Flags are first made one row per (cell, day), so a cell's window is bounded by the calendar.
    """
    days = daily.groupBy(*cell, "date").agg(F.max(flag).alias("_f")).filter("_f = 1")
    run = F.date_sub("date", F.row_number().over(Window.partitionBy(*cell).orderBy("date")))
    return (
        days.withColumn("_run", run)
        .groupBy(*cell, "_run")
        .agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("duration_days"))
        .drop("_run")
    )


def expected_hours(cadence_hours: int) -> list[int]:
    if cadence_hours <= 0 or 24 % cadence_hours:
        raise ValueError(f"cadence must divide 24 hours: {cadence_hours}")
    return list(range(0, 24, cadence_hours))


def completeness_audit(
    df: DataFrame, variables: Sequence[str], cadence_hours: int, start: str | None = None, end: str | None = None, levels: Mapping[str, Sequence[int]] | None = None
) -> dict[str, DataFrame]:
    """Compare (time, variable) rows with a calendar of days x hours x variables.

    Present keys are reduced before anything is joined. The calendar covers the given days or, by
    default, the span of the data. Returns missing keys, unexpected hours, hour counts per day and range.

    With ``levels`` rows have a ``level`` too: variables named there are expected at each of their levels, all
    others without one. Hours are then judged apart for rows with and without a level (``on_levels``), and days outside
    the given ones are listed as ``extra_days``.
    """
    if levels is not None:
        return _completeness_of_levels(df, variables, expected_hours(cadence_hours), levels, start, end)
    hours = expected_hours(cadence_hours)
    present = df.select(F.to_date("time").alias("date"), F.hour("time").alias("hour"), "variable").distinct()
    span = present.agg(
        F.coalesce(F.to_date(F.lit(start)), F.min("date")).alias("a"), F.coalesce(F.to_date(F.lit(end)), F.max("date")).alias("b")
    )
    days = span.select(F.explode(F.sequence("a", "b")).alias("date"))
    expected = days.withColumn("hour", F.explode(F.array(*[F.lit(h) for h in hours]))).withColumn(
        "variable", F.explode(F.array(*[F.lit(v) for v in variables]))
    )
    per_day = present.groupBy("date").agg(F.count_distinct("hour").alias("hours"))
    return {
        "missing": expected.join(present, ["date", "hour", "variable"], "left_anti"),
        "missing_days": days.join(present.select("date").distinct(), "date", "left_anti"),
        "unexpected_hours": present.filter(~F.col("hour").isin(hours)).select("date", "hour").distinct(),
        "hour_counts": per_day.groupBy("hours").agg(F.count("*").alias("days")),
        "range": df.agg(F.min("time").alias("start"), F.max("time").alias("end")),
    }


def _completeness_of_levels(
    df: DataFrame, variables: Sequence[str], hours: Sequence[int], levels: Mapping[str, Sequence[int]], start: str | None, end: str | None
) -> dict[str, DataFrame]:
    """The audit of variables on levels and at the surface; a day counts as present if it has both kinds."""
    level = F.col("level").cast("int")
    present = df.select(F.to_date("time").alias("date"), F.hour("time").alias("hour"), "variable", F.coalesce(level, F.lit(-1)).alias("level")).distinct()
    kind = (F.col("level") >= 0).alias("on_levels")
    span = present.agg(F.coalesce(F.to_date(F.lit(start)), F.min("date")).alias("a"), F.coalesce(F.to_date(F.lit(end)), F.max("date")).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("date"))
    wanted = [(v, n) for v in variables for n in levels.get(v, (-1,))]
    fields = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.lit(n).alias("level")) for v, n in wanted])).alias("_f")
    expected = days.select("date", F.explode(F.array(*[F.lit(h) for h in hours])).alias("hour")).select("date", "hour", fields).select("date", "hour", "_f.*")
    kinds = {v in levels for v in variables}
    seen = present.select("date", "hour", kind).distinct()
    whole = seen.groupBy("date").agg(F.count_distinct("on_levels").alias("_kinds")).filter(F.col("_kinds") >= len(kinds))
    # days without one of the kinds are missing as a whole and not listed field by field
    missing = expected.join(whole.select("date"), "date", "left_semi").join(present, ["date", "hour", "variable", "level"], "left_anti")
    per_day = seen.join(days, "date", "left_semi").groupBy("date", "on_levels").agg(F.count("*").alias("hours"))
    ranges = df.groupBy(level.isNotNull().alias("on_levels")).agg(F.min("time").alias("start"), F.max("time").alias("end"))
    return {
        "missing": missing.withColumn("level", F.nullif("level", F.lit(-1))),
        "missing_days": days.join(whole, "date", "left_anti"),
        "extra_days": seen.select("date", "on_levels").distinct().join(days, "date", "left_anti"),
        "unexpected_hours": seen.filter(~F.col("hour").isin(*hours)),
        "hour_counts": per_day.groupBy("on_levels", "hours").agg(F.count("*").alias("days")),
        "range": ranges,
    }


def stats_window_check(recorded: DataFrame, step_hours: int) -> DataFrame:
    """Recorded sample counts against the count a window ``[start, end]`` at a step must hold."""
    seconds = F.unix_timestamp(F.col("end").cast("timestamp")) - F.unix_timestamp(F.col("start").cast("timestamp"))
    expected = F.greatest(F.floor(seconds / (step_hours * 3600)) + 1, F.lit(0))
    return recorded.withColumn("expected_count", expected.cast("long")).withColumns(
        {
            "valid": F.col("count") == F.col("expected_count"),
            "reason": F.when(F.col("count") != F.col("expected_count"), "count_mismatch"),
        }
    )


def channel_stats(df: DataFrame, variable: str = "variable", level: str = "level", value: str = "value") -> DataFrame:
    """Count, mean and population deviation per (variable, level), with a NULL-level row per variable overall."""
    grouped = df.groupingSets([[col(variable), col(level)], [col(variable)]], col(variable), col(level))
    return grouped.agg(
        F.grouping_id().alias("is_overall"),
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
    )


def merge_channel_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Stack the samples of several sources for joint statistics."""
    frames = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
