"""Texts of briefings and warning products."""

import pytest
from pyspark.sql import functions as F

from gridwarden.operators import products as pr
from gridwarden.operators import risk as rk
from gridwarden.workload import QUERIES
from gridwarden.workload.standin import Tables

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "id long, risks array<struct<hazard_type string, risk_level string, risk_probability double, contributing_factors array<string>, source_status string, inference_mode string>>"


def risk(hazard, level, p, factors, status="normal"):
    return (hazard, level, p, factors, status, "rule")


def test_texts_are_generated_code(spark):
    """No function over array elements is left, as those are interpreted."""
    risks = rk.with_risks(Tables(spark, FOLDER).points)
    for out in (pr.warning_product(risks, "grid_id", ["grid_id"]), pr.industry_briefings(risks, ["grid_id"])):
        plan = out.drop("human_review_required", "review_status")._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan


def test_records_of_several_lengths(spark):
    rows = [
        (1, [risk("a", "low", 0.1, ["x"]), risk("b", "high", 0.505, ["z", "y", "w"]), risk("c", "medium", 0.285, None, "degraded")]),
        (2, [risk("a", "low", 0.0, ["x"]), risk("b", "low", 1.0, ["x"])]),
        (3, []),
        (4, [risk("a", "extreme", 1.5, []), risk("b", "medium", None, ["q"])]),
    ]
    out = pr.industry_briefings(spark.createDataFrame(rows, SCHEMA), ["id"]).filter("industry = 'port'")
    got = {r["id"]: (r["en"].split("hazards=")[1], r["zh"].split("主要依据：")[1].split("。")[0], r["zh"].endswith(pr.DEGRADED_NOTE), r["hazards"]) for r in out.collect()}
    assert got == {
        1: ("b:high(0.51)；c:medium(0.29).", "y；z", True, ["b", "c"]),
        2: ("a:low(0.00)；b:low(1.00).", "x", False, ["a", "b"]),
        3: (".", pr.NO_FACTOR_TEXT, False, []),
        4: ("a:extreme(1.50)；b:medium(nu).", "q", False, ["a", "b"]),  # a missing number, cut to two characters by the format
    }
    with pytest.raises(Exception, match="more than 1 risks"):
        pr.industry_briefings(spark.createDataFrame(rows, SCHEMA), ["id"], 1).collect()


def test_shown_probabilities_are_formatted_ones(spark):
    rows = spark.range(0, 20001).select((F.col("id") / 20000).alias("p"))
    assert rows.filter(pr._shown(F.col("p")) != F.format_string("(%.2f)", "p")).count() == 0


def test_briefings_are_counted_where_they_are_made(spark):
    plan = QUERIES["industry_briefings"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
