"""Evidence triples of risks."""

import re

import pytest
from pyspark.sql import functions as F

from gridwarden.workload import ORACLES, QUERIES
from gridwarden.workload import q_risk as q
from tests.compare import database, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["risk_triples", "risk_evidence_triples"])
def test_triples_equal_sql(spark, monkeypatch, name):
    seen, real = [], q.gr.risk_triples
    monkeypatch.setattr(q.gr, "risk_triples", lambda risks: seen.append(risks) or real(risks))
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert difference(got, database(FOLDER).execute(ORACLES[name]).df()) is None
    assert all(risks.filter(F.size("indicator_evidence") > 0).count() for risks in seen) and seen


def test_fields_nobody_reads_are_not_computed(spark):
    from gridwarden.operators.risk import scan_risks
    from gridwarden.workload.standin import Tables

    plan = scan_risks(Tables(spark, FOLDER).points, ["grid_id"]).select("grid_id", "hazard_type", "model_name")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_extendedprice" not in plan.split("Relation")[0]


def test_statements_are_the_triples(spark):
    """Copies, names that become one when cleaned and missing names: each triple once in the one, all of them in the other."""
    from pyspark.sql import Row

    same = dict(latitude=1.0, longitude=2.0, valid_time="t", hazard_type="flash_flood", risk_level="low", risk_probability=0.5, model_family="rule", model_name="m")
    same |= dict(model_version="v", inference_mode="rule", source_status="normal", contributing_factors=["a", "b"], indicator_evidence={"slope_deg": 3.0})
    rows = spark.createDataFrame([Row(grid_id=g, **same) for g in ("a-b", "a-b", "a_b", "-", "")] + [Row(grid_id="a-b", **(same | {"risk_level": "high"}))])
    once, many = q.gr.risk_triples(rows), q.gr.risk_statements(rows)
    assert once.count() == once.distinct().count() < many.count()
    assert set(map(tuple, once.collect())) == set(map(tuple, many.collect()))


def text_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return [line for line in text_of(df).splitlines() if "Exchange hashpartitioning" in line]


def branches_that_read(df):
    return [b for b in re.split(r"\n[\s:+-]+(?=\S* ?Project \[\S+ AS (?:subject|predicate))", text_of(df)) if "FileScan" in b]


def stored_by(monkeypatch):
    stored, cut = [], q.cut_lineage
    monkeypatch.setattr(q, "cut_lineage", lambda df, *args: stored.append(df) or cut(df, *args))
    return stored


def test_lookups_read_the_graph_once(spark, monkeypatch):
    stored = stored_by(monkeypatch)
    out = QUERIES["graph_lookups"](spark, FOLDER)
    assert difference(out.toPandas(), database(FOLDER).execute(ORACLES["graph_lookups"]).df()) is None
    (impacts,) = stored
    plan = text_of(impacts)
    assert "lineitem" not in text_of(out) and plan.count("FileScan") == 1
    # predicates are filtered in a generated stage of their own, before any point is scored
    assert plan.index("explode([flash_flood") < plan.index("Coalesce") < plan.index("explode([[0,")
    assert "Filter" in plan[plan.index("Coalesce") : plan.index("explode([[0,")]


ODD = dict(latitude=1.0, longitude=None, valid_time="t", hazard_type="h", risk_level=None, risk_probability=0.5, model_family="rule", model_name="m", model_version="v", inference_mode=None)
ODD |= dict(source_status="s", contributing_factors=["a", "a", "a-", None], indicator_evidence={"k": None, "k-": 2.0})


def test_statements_are_the_triples_of_odd_rows(spark):
    from pyspark.sql import Row

    changes = [{}, {"valid_time": None}, {"model_name": None}, {"grid_id": None}, {"hazard_type": None}, {"contributing_factors": None}, {"contributing_factors": []}, {"indicator_evidence": None}]
    changes += [{"indicator_evidence": {}}, {"contributing_factors": ["a_", "b"], "latitude": 2.0}, {"risk_probability": 0.5000000001, "source_status": "t"}]
    rows = spark.createDataFrame([Row(**({"grid_id": "g"} | ODD | c)) for c in changes], "grid_id string, latitude double, longitude double, valid_time string, hazard_type string, risk_level string, risk_probability double, model_family string, model_name string, model_version string, inference_mode string, source_status string, contributing_factors array<string>, indicator_evidence map<string,double>")
    once, open_, many = q.gr.risk_triples(rows), q.gr.risk_triples(rows, once=False), q.gr.risk_statements(rows)
    assert set(map(tuple, once.collect())) == set(map(tuple, many.collect())) == set(map(tuple, open_.collect()))
    named = once.filter("subject IS NOT NULL")
    assert named.count() == named.distinct().count()
    assert "hashpartitioning(grid_id" not in text_of(open_) and set(map(tuple, q.gr.risk_statements(q.gr.with_predicates(rows)).collect())) == set(map(tuple, many.collect()))


def test_classes_are_read_once_and_without_names(spark, monkeypatch):
    stored = stored_by(monkeypatch)
    out = QUERIES["validate_graph"](spark, FOLDER)
    assert difference(out.toPandas(), database(FOLDER).execute(ORACLES["validate_graph"]).df()) is None
    (classes,) = stored
    assert "lineitem" not in text_of(out)
    # one branch for each of the seven forms that tell a class, none of which makes a name
    read = branches_that_read(classes)
    assert len(read) == 7 and not [b for b in read if "sha1" in b or "regexp_replace" in b]


def test_typed_triples_shuffle_short_keys(spark):
    """Only branches of types that are counted are read; what is shuffled are hazards, places and times, never names or lists."""
    out = QUERIES["risk_triples"](spark, FOLDER)
    plan = text_of(out)
    assert plan.count("FileScan") == 5
    assert [line for line in exchanges(out) if "subject" in line or "_e#" in line or "_r#" in line or "_l#" in line] == []
    assert not [line for line in plan.splitlines() if "sha1" in line and "concat_ws(|" not in line]


def test_evidence_triples_shuffle_measured_rows_alone(spark):
    """Branches of other triples are not read, and rows are opened to their measurements before they are shuffled."""
    out = QUERIES["risk_evidence_triples"](spark, FOLDER)
    plan = text_of(out)
    assert "format_string" not in plan and "DisasterEvent" not in plan
    (dealt,) = [line for line in exchanges(out) if "hashpartitioning(grid_id" in line]
    below = plan[plan.index(dealt) :]
    assert below.index("explode(indicator_evidence") < below.index("FileScan")
