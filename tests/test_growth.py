"""Steps whose cost must not grow faster than their input: what their plans and files look like, with exact results."""

import datetime as dt
import json

from pyspark.sql import functions as F

from gridwarden.operators import features as ft
from gridwarden.operators import audit as au
from gridwarden.operators import graph as gr
from gridwarden.operators import grid as g
from gridwarden.operators import labels as lb
from gridwarden.operators import training as tr
from gridwarden.operators.quantiles import exact_quantiles
from gridwarden.plans import modelling as ml
from gridwarden.sources import store, tables
from gridwarden.streaming import streams as ss
from gridwarden.workload import QUERIES
from gridwarden.workload import q_training as q

HEAT = ("temp_c", "tmax_c", "tmin_c", "heat_index_c", "vpd_kpa", "wind_speed_mps", "relative_humidity_percent")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_training_tables_explode_names_alone(spark):
    days = [(dt.date(2025, 1, 1), 20.0, 40.0, 30.0, 35.0, 25.0, 31.0, 2.0, 5.0, 120.0, None, 0.1, 0.2), (dt.date(2025, 1, 2), 20.0, 40.0, None, 35.0, 25.0, 31.0, 2.0, 5.0, 50.0, 0.3, 0.1, None)]
    names = ", ".join(f"{n} double" for n in ("latitude", "longitude", *HEAT, "dust_aod", "dust_column_mass", "dust_surface_mass"))
    out = tr.hazard_training_tables(spark.createDataFrame(days, f"date date, {names}"), ["extreme_heat", "dust_storm"])
    explodes = [line for line in plan_of(out).splitlines() if "Generate explode" in line]
    assert explodes and not any(n in line.split("explode(")[1].split("), [")[0] for line in explodes for n in HEAT)
    rows = {(r["date"].day, r["hazard_type"]): r["features"] for r in out.collect()}
    # the second day has no temperature, and neither day has all dust values
    assert list(rows) == [(1, "extreme_heat")]
    assert rows[1, "extreme_heat"]["relative_humidity_percent"] == 100.0 and rows[1, "extreme_heat"]["sst_celsius"] is None
    assert len(rows[1, "extreme_heat"]) == 12


def test_incremental_source_is_written_by_the_tasks_that_read_it(spark, tmp_path, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(q, "shared_dir", lambda spark, purpose: str(tmp_path / purpose))
    got = QUERIES["hazard_training_tables_incremental"](spark, str(tmp_path)).collect()
    n = rows.count()
    assert {(r["hazard_type"], r["n"], r["rewritten"]) for r in got} >= {("extreme_heat", n, 1), ("flash_flood", n, 1)}
    files = [[f for f in (tmp_path / "source").rglob("*.parquet") if f.parent.name == f"line={k}"] for k in range(1, 8)]
    assert min(len(f) for f in files) == 3
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0") == "0"


def test_hottest_point_sorts_no_rows_before_they_are_one_cell(spark):
    d, nan = dt.date(2025, 1, 1), float("nan")
    rows = [(d, 2.0, 5.0, 7.0, "a"), (d, 1.0, 6.0, 7.0, "b"), (d, 1.0, 5.0, 7.0, "c"), (d, 0.0, 0.0, 6.0, "d"), (None, 3.0, 3.0, None, "e"), (None, 2.0, 3.0, None, "f"), (dt.date(2025, 1, 2), 4.0, 4.0, nan, "g"), (dt.date(2025, 1, 2), 1.0, 1.0, 9.0, "h"), (dt.date(2025, 1, 3), None, None, 1.0, "i")]
    out = g.hottest_point(spark.createDataFrame(rows, "date date, latitude double, longitude double, v double, name string"), "v")
    assert {r["date"]: r["name"] for r in out.collect()} == {d: "c", None: "f", dt.date(2025, 1, 2): "g", dt.date(2025, 1, 3): "i"}
    # what is gathered whole has met the cells found before
    plan = plan_of(out)
    assert "max_by" not in plan and "Join" in plan[plan.index("Aggregate"):]


def test_features_json_is_compressed(spark, tmp_path):
    rows = spark.range(2000).selectExpr("cast(id as string) grid_id", "1.5D latitude", "2.5D longitude", "cast(id as double) temp_c", "timestamp'2025-01-01' valid_time")
    store.write_features_json(rows, str(tmp_path / "f"))
    files = [f for f in (tmp_path / "f").iterdir() if f.name.startswith("part-")]
    assert files and all(f.name.endswith(".json.gz") for f in files)
    back = tables.read_features_json(spark, str(tmp_path / "f"), lines=True)
    assert back.agg(F.count("*"), F.sum("temp_c"), F.min("latitude")).first()[:] == (2000, 1999000.0, 1.5)


def test_pool_orders_few_rows_and_skips_statistics(spark):
    d = dt.date(2025, 1, 1)
    rows = [(d, "a", float(i % 50), 1.0 * i, 2.0) for i in range(3000)] + [(d, "b", None, 1.0 * i, 2.0) for i in range(40)] + [(d, "c", 5.0, 1.0, 2.0), (d, "c", None, 0.0, 2.0)]
    df = spark.createDataFrame(rows, "date date, region_id string, heat_index_c double, latitude double, longitude double").withColumns({n: F.lit(1.0) for n in HEAT if n != "heat_index_c"})
    with_all = {r["region_id"]: r for r in ft.region_day_topk_pool(df).collect()}
    lean = ft.region_day_topk_pool(df, statistics=False)
    assert not [c for c in lean.columns if c.endswith(("_p90", "_max", "_min"))]
    for r in lean.collect():
        assert all(r[c] == with_all[r["region_id"]][c] for c in lean.columns)
    assert [(with_all[k]["heat_index_c"], with_all[k]["pooled_grid_cell_count"], with_all[k]["grid_cell_count"]) for k in "abc"] == [(49.0, 3, 3000), (None, 3, 40), (5.0, 1, 2)]
    keys = ["date", "region_id"]
    kept = ft._reaching(df, keys, "heat_index_c", ["latitude"], 3).groupBy("region_id").count()
    assert {r["region_id"]: r["count"] for r in kept.collect()} == {"a": 60, "b": 40, "c": 2}


def test_quantile_pass_explodes_columns_alone(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "cast(id as double) as v", "if(id % 2 = 0, null, cast(id as double)) as w")
    out = exact_quantiles(df, ["k"], {"v": [0.9], "w": [0.1]})
    assert "lambda" not in plan_of(out)
    assert {r["k"]: (r["v_p90"], r["w_p10"]) for r in out.collect()} == {r["k"]: (r["v"], r["w"]) for r in df.groupBy("k").agg(F.percentile("v", 0.9).alias("v"), F.percentile("w", 0.1).alias("w")).collect()}


def test_training_tasks_hold_a_bounded_number_of_rows(spark, monkeypatch):
    seen = {}
    fitted = ml._fitted

    def instead(rows, *args):
        seen["rows"] = [len(part) for part in rows.rdd.glom().collect()]
        return fitted(rows, *args)

    monkeypatch.setattr(ml, "_fitted", instead)
    monkeypatch.setattr(ml, "TASK_ROWS", 100)
    names = ml.feature_names("extreme_heat")
    df = spark.range(1000).select(F.col("id").alias("date"), *[(F.col("id") % 7).cast("double").alias(n) for n in names], (F.col("id") % 7 / 10).alias("target"))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    model = ml.train_hazard_model(df, "extreme_heat", group="date", rounds=2)
    assert max(seen["rows"]) <= 100 and sum(seen["rows"]) == 1000
    assert model.summary["train_rows"] + model.summary["validation_rows"] == 1000
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before


def flood_case(spark):
    events = [("e1", "2022-11-24", "Jeddah", None, None, "POLYGON((39.10 21.40, 39.30 21.40, 39.30 21.60, 39.10 21.60, 39.10 21.40))"), ("e2", "2022-11-24", "Riyadh", 21.5, 39.2, None), ("e3", "2022-11-24", "Hidden", None, None, None), ("e4", "2022-11-26", "Mecca", None, None, None)]
    events = spark.createDataFrame([(*r, "medium", "seed") for r in events], "event_id string, date string, location_name string, latitude double, longitude double, geometry_wkt string, spatial_confidence string, validation_status string")
    samples = [("a", "2022-11-24", 21.5, 39.2, "makkah"), ("b", "2022-11-25", 21.5, 39.2, ""), ("c", "2022-11-24", None, 39.2, "riyadh"), ("d", "2022-11-26", 30.0, 45.0, "makkah")]
    return events, spark.createDataFrame(samples, "k string, date string, latitude double, longitude double, province_name string")


def test_flood_labels_leave_the_day_to_the_days(spark):
    events, samples = flood_case(spark)
    whole = {r["k"]: r for r in lb.label_flash_flood(samples, events).collect()}
    catalogue = lb.FloodCatalogue(events)
    labels = catalogue.label(samples, whole=False)
    days = catalogue.day_provenance()
    assert days.count() == 2
    own = {r["k"]: json.loads(r["label_provenance"]) for r in labels.collect()}
    assert own["a"]["matched_event_ids"] == ["e1", "e2"] and not [f for o in own.values() for f in o if f.startswith("day_") or f == "event_count_for_day"]
    assert {r["k"]: r for r in lb.with_day_provenance(labels, days).collect()} == whole


def test_positive_evidence_needs_no_lists_of_the_day(spark):
    events, samples = flood_case(spark)
    lean = au.positive_evidence_counts(lb.FloodCatalogue(events).label(samples, whole=False))
    assert "_day_text" not in plan_of(lean)
    assert lean.first() == au.positive_evidence_counts(lb.label_flash_flood(samples, events)).first()
    assert lean.first()[:] == (3, 3, 1, 2)


def test_streamed_labels_store_a_day_once(spark, tmp_path):
    events, samples = flood_case(spark)
    for k in range(2):
        samples.filter(F.col("k").isin(["ab", "cd"][k][0], ["ab", "cd"][k][1])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "out")
    ss.stream_label(live, events, path, f"{path}-state").awaitTermination()
    stored = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    assert stored.filter(F.col("label_provenance").contains("day_event_mapping_modes")).count() == 0
    assert spark.read.parquet(f"{path}/days").count() == 3  # one day of the first batch has events, two of the second
    want = {r["k"]: r for r in lb.label_flash_flood(samples, events).collect()}
    assert {r["k"]: r for r in ss.stream_labels(spark, path).collect()} == want


def test_unresolved_candidates_merge_the_catalogue_once(spark, monkeypatch):
    merged, calls = q.qe.merged, []
    monkeypatch.setattr(q.qe, "merged", lambda t: calls.append(t) or merged(t))
    out = QUERIES["unresolved_candidates"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1 and plan_of(out).count("unresolved-days") == plan_of(out).count("FileScan")
    assert out.count() > 0


def test_late_parts_are_one_batch_each(spark, tmp_path, monkeypatch):
    folder = "/root/testdata/sf0.001"
    spark.read.parquet(f"{folder}/lineitem.parquet").repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    (tmp_path / "nation.parquet").symlink_to(f"{folder}/nation.parquet")
    compact, stored = ss.compact, []
    monkeypatch.setattr(ss, "compact", lambda spark, path, *args: stored.append(ss._numbers(spark, path, "batch=")) or compact(spark, path, *args))
    got = QUERIES["stream_province_day_late"](spark, str(tmp_path))
    assert stored == [[0, 1, 2, 3]]
    want = QUERIES["stream_province_day"](spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_grounding_triples_are_filtered_before_they_are_made(spark):
    gaps = [("g1", "t1", "flash_flood", "m", "rain", "available", "mm", ["a", "b"], 1.0)] * 2 + [("g1", "t1", "flash_flood", "m", "rain", "available", "mm", ["a", "b"], 2.0), ("g2", "t1", "flash_flood", "m", "rain", None, "mm", ["a", "a"], None)]
    gaps = spark.createDataFrame(gaps, "grid_id string, valid_time string, hazard_type string, model_name string, family string, status string, units string, source_pair array<string>, delta double")
    out = gr.grounding_triples(gaps)
    count = {r["predicate"].rsplit(":", 1)[-1]: r["n"] for r in out.groupBy("predicate").agg(F.count("*").alias("n")).collect()}
    assert count == {"type": 3, "label": 3, "groundingPayload": 3, "hasGroundingGap": 3, "comparisonStatus": 2, "units": 3, "delta": 2, "sourcePair": 5}
    assert out.count() == out.distinct().count()
    # what is shuffled are rows of gaps, never triples
    assert [line for line in plan_of(out).splitlines() if "Exchange hashpartitioning" in line and "_n" not in line.split("hashpartitioning(")[1].split(",")[0]] == []


def test_triples_are_written_compressed(spark, tmp_path):
    triples = spark.range(3000).selectExpr("concat('urn:gridwarden:event_', id) subject", "'rdfs:label' predicate", "if(id % 2 = 0, 'a \"b\"', 'c') object")
    store.write_triples(triples, str(tmp_path / "t"))
    files = [f for f in (tmp_path / "t").iterdir() if f.name.startswith("part-")]
    assert files and all(f.name.endswith(".txt.gz") for f in files) and sum(f.stat().st_size for f in files) < 3000 * 15
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "t")).collect())
    assert lines == sorted(r["value"] for r in gr.ntriples_lines(triples).collect()) and lines[0] == '<urn:gridwarden:event_0> <rdfs:label> "a \\"b\\"" .'
