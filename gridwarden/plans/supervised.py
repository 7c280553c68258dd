"""Supervised tables composed from labels, pooling, sampling and feature preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwarden.operators.features import region_day_topk_pool
from gridwarden.operators.grid import hottest_point
from gridwarden.operators.labels import label_extreme_heat, label_point_day
from gridwarden.operators.risk import feature_names
from gridwarden.operators.training import prepare_features, sample_negatives
from gridwarden.session import cut_lineage

UNITS = ("single_point_day", "region_day")
LABELS = ("label", "label_status", "label_source_mode", "matched_event_ids", "sample_unit")


def labeled_extreme_heat(rows: DataFrame, events: DataFrame, unit: str = "region_day", variable: str = "heat_index_c", k: int = 3, statistics: bool = True) -> DataFrame:
    """Labeled samples before negative sampling, shared by all sampling variants.

    ``statistics`` of a region's whole day come with region days; what trains a model does not read them.
    """
    if unit not in UNITS:
        raise ValueError(f"unsupported sample unit: {unit}")
    if unit == "region_day":
        if k <= 0:
            raise ValueError("k must be positive")
        return label_extreme_heat(region_day_topk_pool(rows, variable, k, statistics), events)
    return label_point_day(hottest_point(rows, variable), events)


def supervised_extreme_heat(
    rows: DataFrame, events: DataFrame, unit: str = "region_day", variable: str = "heat_index_c", k: int = 3, n: int | None = None, seed: int = 42
) -> DataFrame:
    """Labels, n negatives (default: as many as positives) and prepared features."""
    keys = ["date", "region_id"] if unit == "region_day" else ["date"]
    # sampling reads the labeled rows several times: they are built once
    labeled = cut_lineage(labeled_extreme_heat(rows, events, unit, variable, k, statistics=False), "labeled")
    sampled = sample_negatives(labeled, keys, n, seed)
    kept = [c for c in (*keys, *LABELS) if c in sampled.columns]
    out = prepare_features(sampled, "extreme_heat", keep=kept)
    return out.withColumns({"training_join_key": F.concat_ws("|", *[F.col(c).cast("string") for c in keys]), "is_labeled": F.lit(True)}).select(
        *kept, *feature_names("extreme_heat"), "training_join_key", "is_labeled"
    )
