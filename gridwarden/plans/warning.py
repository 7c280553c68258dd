"""The warning chain: features to checked, explained, publishable products in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwarden.operators.graph import hazard_impacts, rule_table, seed_triples, semantic_evidence
from gridwarden.operators.indicators import derive_indicators
from gridwarden.operators.products import warning_product
from gridwarden.operators.quality import REQUIRED_FIELDS
from gridwarden.operators.risk import evidence_check, scan_risks, with_risks


def warning_products(features: DataFrame, area: str, keep: Sequence[str]) -> DataFrame:
    """Data check, derived indicators, all hazards, briefings and review flag per record; no shuffle."""
    gaps = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) if c in features.columns else F.lit(c) for c in REQUIRED_FIELDS]))
    rows = derive_indicators(features.withColumn("missing_fields", gaps))
    return warning_product(with_risks(rows), area, [*keep, "missing_fields"])


def explained_risks(features: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Long risks with evidence flags and the exposures, actions and departments of their hazard."""
    rows = derive_indicators(features)
    risks = evidence_check(scan_risks(rows, [*keep, "vpd_kpa", "heat_index_c"]), ("vpd_kpa", "heat_index_c"))
    impacts = hazard_impacts(seed_triples(rule_table(features.sparkSession)))
    return semantic_evidence(risks, impacts)
