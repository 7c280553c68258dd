"""Audits of labels and province lookups, as small aggregate tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwarden.functions.basic import first_existing, text
from gridwarden.functions.text import residual_tokens
from gridwarden.operators.features import coordinate_counts
from gridwarden.operators.labels import PROVINCE_COLUMNS, FloodLabelPolicy, flood_events
from gridwarden.operators.quantiles import exact_quantiles
from gridwarden.session import cut_lineage
from gridwarden.operators.spatial import boundary_edges, nearest_boundary_distance, point_in_polygon_join, round_coordinates

# Names of the evidence a positive label may rest on.
EXPLICIT_SOURCES = ("source_geometry", "derived_point_buffer", "geometry_wkt")
BOUNDARY_SOURCES = ("province_boundary",)
GAP_BANDS = ((0.05, "within_0_05_degrees"), (0.1, "within_0_10_degrees"), (0.25, "within_0_25_degrees"), (0.5, "within_0_50_degrees"))
_PROVENANCE = "matched_geometry_sources array<string>, matched_geometry_wkts array<string>, event_count_for_day long, day_event_mapping_modes array<string>"


def _provenance() -> Column:
    return F.from_json(F.coalesce(F.col("label_provenance"), F.lit("")), _PROVENANCE)


def _filled(values: Column) -> Column:
    return F.filter(F.coalesce(F.transform(values, lambda s: F.trim(s)), F.array().cast("array<string>")), lambda v: v != "")


def _evidence(labels: DataFrame) -> DataFrame:
    """Positive rows with flags: backed by geometry, by a boundary, by explicit geometry."""
    rows = labels.filter("label_status = 'positive'")
    p = _provenance()
    rows = rows.withColumns({"_sources": _filled(p["matched_geometry_sources"]), "_wkts": _filled(p["matched_geometry_wkts"])})
    modes = F.transform(F.split("label_source_mode", ","), lambda s: F.trim(s))
    has = (F.size("_sources") > 0) | (F.size("_wkts") > 0)

    def any_of(values: Column, names: Sequence[str]) -> Column:
        return F.arrays_overlap(values, F.array(*[F.lit(n) for n in names]))

    return rows.withColumns(
        {
            "_backed": has,
            "_geometry_mode": F.col("label_source_mode") == "geometry_wkt",
            "_boundary": F.when(has, any_of(F.col("_sources"), BOUNDARY_SOURCES)).otherwise(F.array_contains(modes, "province_day")),
            "_explicit": F.when(has, any_of(F.col("_sources"), EXPLICIT_SOURCES)).otherwise(any_of(modes, ("geometry_wkt", "point_buffer"))),
        }
    )


def positive_evidence_counts(labels: DataFrame) -> DataFrame:
    """Positive rows, and how many rest on geometry, on boundaries and on explicit geometry; the sample's own part of the provenance is enough."""
    out = _evidence(labels).agg(
        F.count("*").alias("positive_rows"),
        F.greatest(F.count(F.when(F.col("_backed"), 1)), F.count(F.when(F.col("_geometry_mode"), 1))).alias("geometry_positive_rows"),
        F.count(F.when(F.col("_boundary"), 1)).alias("boundary_grounded_positive_rows"),
        F.count(F.when(F.col("_explicit"), 1)).alias("explicit_geometry_positive_rows"),
    )
    return out


def positive_source_counts(labels: DataFrame) -> DataFrame:
    """Positive rows per evidence source; a row counts once per source."""
    rows = _evidence(labels).select(F.explode(F.array_distinct("_sources")).alias("source"))
    return rows.groupBy("source").agg(F.count("*").alias("rows"))


def supervision_quality(summary: DataFrame) -> DataFrame:
    """Fractions, warnings and an overall status from a one-row summary.

    Optional columns event_group_count and rows_using_fallback_date_groups add their warnings.
    """

    def n(name: str) -> Column:
        return F.greatest(F.coalesce(F.col(name), F.lit(0)), F.lit(0)) if name in summary.columns else F.lit(0)

    def part(a: Column, b: Column) -> Column:
        return F.try_divide(a.cast("double"), b.cast("double"))

    total, positive, uncertain = n("rows"), n("positive_rows"), n("uncertain_rows")
    matched, backed, grounded = n("rows_with_matched_event_ids"), n("geometry_positive_rows"), n("boundary_grounded_positive_rows")
    tests = [
        (total <= 0, "no_rows"),
        (positive <= 0, "no_positive_labels"),
        (matched <= 0, "no_matched_event_rows"),
        ((positive > 0) & (backed <= 0), "no_geometry_backed_positives"),
        ((positive > 0) & (grounded > 0) & (part(grounded, positive) > 0.9), "boundary_grounding_dominates"),
        ((total > 0) & (part(uncertain, total) > 0.25), "high_uncertain_fraction"),
    ]
    if "event_group_count" in summary.columns:
        tests.append((F.col("event_group_count").between(1, 4), "few_event_groups"))
    if "rows_using_fallback_date_groups" in summary.columns:
        tests.append(((total > 0) & (part(n("rows_using_fallback_date_groups"), total) > 0.5), "fallback_date_groups_dominate"))
    warnings = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(w)) for t, w in tests]))
    fatal = F.arrays_overlap(F.col("warnings"), F.array(*[F.lit(w) for w in ("no_rows", "no_positive_labels", "no_matched_event_rows")]))
    out = summary.withColumn("warnings", warnings)
    return out.withColumns(
        {
            "status": F.when(fatal, "insufficient").when(F.size("warnings") > 0, "warning").otherwise("ok"),
            "positive_fraction": part(positive, total),
            "negative_fraction": part(n("negative_rows"), total),
            "uncertain_fraction": part(uncertain, total),
            "matched_event_fraction": part(matched, total),
            "geometry_positive_fraction_of_positives": part(backed, positive),
            "boundary_grounded_positive_fraction_of_positives": part(grounded, positive),
            "explicit_geometry_positive_fraction_of_positives": part(n("explicit_geometry_positive_rows"), positive),
            "outside_event_footprint_negative_fraction_of_negatives": part(n("outside_event_footprint_negative_rows"), n("negative_rows")),
        }
    )


def label_summary(labels: DataFrame) -> DataFrame:
    """Row counts of a label or training table, in one aggregate."""

    def rows(test: Column, name: str) -> Column:
        return F.count(F.when(test, 1)).alias(name)

    status, mode = F.col("label_status"), F.col("label_source_mode")
    out = [
        F.count("*").alias("rows"),
        rows(status == "positive", "positive_rows"),
        rows(status == "negative", "negative_rows"),
        rows(status == "uncertain", "uncertain_rows"),
        rows(mode == "outside_event_footprint", "outside_event_footprint_negative_rows"),
        rows(mode == "event_day_unresolved", "event_day_unresolved_rows"),
        rows(text("matched_event_ids") != "", "rows_with_matched_event_ids"),
    ]
    if "is_labeled" in labels.columns:
        out.append(rows(F.col("is_labeled"), "labeled_rows"))
    return labels.agg(*out)


def source_label_audit(labels: DataFrame) -> DataFrame:
    """Rows per (status, mode) of a label input, with how many name events."""
    return labels.groupBy("label_status", "label_source_mode").agg(
        F.count("*").alias("rows"), F.count(F.when(text("matched_event_ids") != "", 1)).alias("rows_with_matched_event_ids")
    )


def audit_labels(labels: DataFrame, events: DataFrame | None = None, top: int = 10, policy: FloodLabelPolicy = FloodLabelPolicy()) -> dict[str, DataFrame]:
    """Tables on what stayed unresolved and what was matched.

    Top lists are reduced to one row per key before they are ordered and cut.
    """
    open_rows = labels.filter("label_source_mode = 'event_day_unresolved'")
    hits = labels.filter("label_status = 'positive'")

    def most(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy(key).agg(F.count("*").alias("rows")).orderBy(F.col("rows").desc(), key).limit(top)

    ids = hits.select(F.explode(F.filter(F.transform(F.split("matched_event_ids", ","), lambda s: F.trim(s)), lambda t: t != "")).alias("event_id"))
    modes = open_rows.select(F.explode(_filled(_provenance()["day_event_mapping_modes"])).alias("mode"))
    counts = labels.agg(
        F.count("*").alias("rows"),
        F.count(F.when(F.col("label_status") == "positive", 1)).alias("positive_rows"),
        F.count(F.when(F.col("label_status") == "uncertain", 1)).alias("uncertain_rows"),
        F.count(F.when(F.col("label_source_mode") == "event_day_unresolved", 1)).alias("unresolved_rows"),
        F.count_distinct(F.when(F.col("label_source_mode") == "event_day_unresolved", F.col("date"))).alias("unresolved_date_count"),
    )
    counts = counts.withColumn("unresolved_fraction", F.try_divide(F.col("unresolved_rows").cast("double"), F.col("rows").cast("double")))
    out = {
        "summary": counts,
        "mode_counts": modes.groupBy("mode").agg(F.count("*").alias("rows")),
        "top_unresolved_dates": most(open_rows, "date"),
        "top_positive_event_ids": most(ids, "event_id"),
    }
    province = first_existing(labels.columns, PROVINCE_COLUMNS)
    if province:
        out["top_unresolved_provinces"] = most(open_rows.filter(text(province) != ""), province)
        out["top_positive_provinces"] = most(hits.filter(text(province) != ""), province)
    if events is not None:
        candidates = unresolved_candidates(open_rows, events, policy)
        order = [F.col("unresolved_rows").desc(), F.col("unresolved_date_count").desc(), "event_id"]
        rank = F.row_number().over(Window.partitionBy("unresolved_bucket").orderBy(*order))
        out["candidates"] = candidates
        out["bucket_counts"] = candidates.groupBy("unresolved_bucket").agg(F.sum("event_days").alias("rows"))
        out["top_candidates"] = candidates.orderBy(*order).limit(top)
        out["top_candidates_by_bucket"] = candidates.withColumn("rank", rank).filter(F.col("rank") <= top)
    return out


def unresolved_candidates(open_rows: DataFrame, events: DataFrame, policy: FloodLabelPolicy = FloodLabelPolicy()) -> DataFrame:
    """Events on days with unresolved rows, bucketed by why they did not resolve."""
    per_day = open_rows.groupBy("date").agg(F.count("*").alias("_open"))
    daily = cut_lineage(flood_events(events, policy).join(per_day, "date"), "unresolved-days")  # read for the days and for their events
    supported = F.col("_mode").isin("geometry_wkt", "point_buffer", "province_day")
    days = daily.groupBy("date").agg(F.count(F.when(supported, 1)).alias("_good"), F.count(F.when(~supported, 1)).alias("_bad"))
    daily = daily.join(days, "date")
    left = residual_tokens("location_name", F.col("_provinces"))
    named = F.size("_provinces") > 0
    bucket = (
        F.when((F.col("_good") > 0) & (F.col("_bad") > 0), "mixed_supported_and_unsupported")
        .when(F.col("_mode").isin("point_buffer", "geometry_wkt"), "policy_conservative")
        .when((F.col("_mode") == "uncertain") & ~named, "source_too_vague")
        .when((F.col("_mode") == "province_day") & named & (F.size(left) > 0), "manual_annotation_candidate")
        .when((F.col("_mode") == "province_day") & named, "policy_conservative")
        .otherwise("source_too_vague")
    )
    rows = daily.select(
        "event_id",
        "location_name",
        F.col("_mode").alias("mapping_mode"),
        F.array_join("_provinces", ",").alias("resolved_province_name"),
        bucket.alias("unresolved_bucket"),
        F.when(bucket == "manual_annotation_candidate", F.array_join(left, ",")).otherwise("").alias("residual_tokens"),
        "date",
        "_open",
    )
    keys = ["event_id", "location_name", "mapping_mode", "resolved_province_name", "unresolved_bucket"]
    return rows.groupBy(*keys).agg(
        F.sum("_open").alias("unresolved_rows"),
        F.count("*").alias("event_days"),
        F.count_distinct("date").alias("unresolved_date_count"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.max("residual_tokens").alias("residual_tokens"),
    )


def gap_band(distance: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for limit, name in GAP_BANDS:
        out = out.when(distance <= limit, name)
    return F.when(distance.isNotNull(), out.otherwise("beyond_0_50_degrees"))


def audit_lookup(
    lookup: DataFrame, boundaries: DataFrame, features: DataFrame | None = None, geometry: str = "geometry", fmt: str = "geojson", digits: int = 4
) -> DataFrame:
    """Unmatched coordinates with their class, distance to a boundary, band, 1-degree bin and feature rows."""
    rows = round_coordinates(lookup, digits).filter(F.lower("match_status") != "matched").select("latitude", "longitude").distinct()
    rows = cut_lineage(rows, "unmatched")
    edges = cut_lineage(boundary_edges(boundaries.select(geometry), geometry, fmt), "boundaries")
    box = edges.agg(F.min("min_lat").alias("a"), F.max("max_lat").alias("b"), F.min("min_lon").alias("c"), F.max("max_lon").alias("d"))
    rows = rows.withColumn("_one", F.lit(1)).join(F.broadcast(box.withColumn("_one", F.lit(1))), "_one").drop("_one")
    rows = rows.withColumn("_in_box", F.col("latitude").between(F.col("a"), F.col("b")) & F.col("longitude").between(F.col("c"), F.col("d")))
    rows = rows.drop("a", "b", "c", "d")
    inner = rows.filter("_in_box").select("latitude", "longitude")
    inside = point_in_polygon_join(inner, edges).select("latitude", "longitude").distinct().withColumn("_inside", F.lit(True))
    gaps = nearest_boundary_distance(inner.join(inside, ["latitude", "longitude"], "left_anti"), edges)
    out = rows.join(inside, ["latitude", "longitude"], "left").join(gaps, ["latitude", "longitude"], "left")
    kind = (
        F.when(~F.col("_in_box"), "outside_boundary_bbox")
        .when(F.col("_inside"), "inside_polygon_but_unmatched")
        .otherwise("inside_boundary_bbox_outside_polygon")
    )
    gap = F.when(F.col("_inside"), F.lit(0.0)).otherwise(F.col("boundary_gap_degrees"))
    out = out.withColumns({"boundary_classification": kind, "boundary_gap_degrees": gap}).withColumns(
        {
            "boundary_gap_band": gap_band(F.col("boundary_gap_degrees")),
            "lat_bin_start": F.floor("latitude").cast("double"),
            "lon_bin_start": F.floor("longitude").cast("double"),
        }
    )
    out = out.drop("_in_box", "_inside")
    if features is None:
        return out
    counts = features if "feature_row_count" in features.columns else coordinate_counts(features, digits)
    out = out.join(counts.select("latitude", "longitude", "feature_row_count"), ["latitude", "longitude"], "left")
    return out.withColumn("feature_row_count", F.coalesce("feature_row_count", F.lit(0)))


def lookup_hotspots(audited: DataFrame, top: int = 10) -> DataFrame:
    """1-degree bins with the most feature rows among unmatched coordinates."""
    bins = audited.groupBy("lat_bin_start", "lon_bin_start").agg(
        F.count("*").alias("unique_coordinate_rows"), F.sum("feature_row_count").alias("feature_row_count")
    )
    return bins.orderBy(F.col("feature_row_count").desc(), F.col("unique_coordinate_rows").desc(), "lat_bin_start", "lon_bin_start").limit(top)


def lookup_summary(lookup: DataFrame) -> DataFrame:
    miss = F.lower("match_status") != "matched"
    return lookup.agg(
        F.count("*").alias("unique_coordinate_rows"),
        F.count(F.when(~miss, 1)).alias("matched_coordinate_rows"),
        F.count(F.when(miss, 1)).alias("unmatched_coordinate_rows"),
        F.min(F.when(miss, F.col("latitude"))).alias("min_latitude"),
        F.max(F.when(miss, F.col("latitude"))).alias("max_latitude"),
        F.min(F.when(miss, F.col("longitude"))).alias("min_longitude"),
        F.max(F.when(miss, F.col("longitude"))).alias("max_longitude"),
    )


def candidate_stats(counts: DataFrame, value: str = "candidate_count") -> DataFrame:
    """Minimum, median, 95th percentile, maximum and mean of candidate counts."""
    base = counts.agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean")).withColumn("_one", F.lit(1))
    high = exact_quantiles(counts.withColumn("_one", F.lit(1)), ["_one"], {value: [0.5, 0.95]})
    return base.join(high, "_one", "left").select("min", F.col(f"{value}_p50").alias("p50"), F.col(f"{value}_p95").alias("p95"), "max", "mean")


