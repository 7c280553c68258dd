"""Queries of training tables, models and label audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwarden.functions.basic import once
from gridwarden.functions.text import residual_tokens, resolve_provinces
from gridwarden.operators import audit as au
from gridwarden.operators import events as ev
from gridwarden.operators import features as ft
from gridwarden.operators import labels as lb
from gridwarden.operators import training as tr
from gridwarden.plans import modelling as ml
from gridwarden.plans import supervised as sv
from gridwarden.session import cut_lineage, shared_dir
from gridwarden.sources import snapshots as sn
from gridwarden.sources.store import unsorted_writes
from gridwarden.workload import q_events as qe
from gridwarden.workload.registry import day, joined, query, r
from gridwarden.workload.q_risk import KEEP, RISKS, _LEVEL

PS = f"WITH {qe.PROVINCE_SAMPLES}, {qe.flood_label_sql('ps', qe.PROVINCE_MATCH, False)}"
USES = ("grid_day", "catalogue")


def province_features(t):
    return ft.province_day_mean(t.grid_day.select("date", "province_name", "source_status", "daily_precip_total", "cape"))


_FEATURES = "f AS (SELECT date, lower(province_name) AS province_name, avg(daily_precip_total) AS rain, avg(cape) AS cape FROM grid_day WHERE province_name <> '' GROUP BY 1, 2)"


@query(
    "supervised_join_flash_flood",
    USES,
    f"""{PS}, {_FEATURES} SELECT CAST(f.date AS STRING) AS date, f.province_name, round(f.rain, 6) AS daily_precip_total, l.label, l.label_status, 'province_day:province_name' AS training_join_mode,
      concat(CAST(f.date AS STRING), '|', CASE f.province_name WHEN 'aseer' THEN 'asir' ELSE f.province_name END) AS training_join_key
    FROM f JOIN labels l ON l.date = f.date AND lower(l.province_name) = f.province_name WHERE l.label_status <> 'uncertain'""",
)
def _(t):
    out = tr.supervised_join_flash_flood(province_features(t), qe.province_labels(t))
    return out.select(day("date").alias("date"), "province_name", r("daily_precip_total").alias("daily_precip_total"), "label", "label_status", "training_join_mode", "training_join_key")


@query(
    "positive_alignment",
    USES,
    f"""{PS} SELECT count(*) AS label_positive_rows, count(*) - count(CASE WHEN province_name = 'makkah' THEN 1 END) AS supervised_positive_rows,
      count(CASE WHEN province_name = 'makkah' THEN 1 END) AS missing_positive_rows, 0 AS extra_positive_rows, count(CASE WHEN province_name = 'makkah' THEN 1 END) AS missing_positive_key_count,
      CASE WHEN count(CASE WHEN province_name = 'makkah' THEN 1 END) = 0 THEN 'ok' ELSE 'mismatch' END AS status FROM labels WHERE label_status = 'positive'""",
)
def _(t):
    labels = qe.province_labels(t)
    joined_rows = tr.supervised_join_flash_flood(province_features(t).filter("province_name <> 'makkah'"), labels)
    return tr.alignment_summary(tr.positive_alignment(labels, joined_rows)).drop("extra_positive_key_count")


@query(
    "supervised_join_dust",
    USES,
    f"""WITH {qe.MERGED}, e AS (SELECT *, string_split({qe._DUST_REGION}, ',') AS regions FROM daily WHERE validation_status = 'verified'), d AS (SELECT DISTINCT date FROM e),
    s AS (SELECT date, region_id, avg(dust_column_mass) AS mass FROM grid_day GROUP BY 1, 2), h AS (SELECT DISTINCT s.date, s.region_id FROM s JOIN e ON e.date = s.date AND list_contains(e.regions, s.region_id))
    SELECT CAST(s.date AS STRING) AS date, s.region_id, round(1e3 * s.mass, 6) AS mass, CASE WHEN h.date IS NOT NULL THEN 1e0 ELSE 0e0 END AS label,
      concat(CAST(s.date AS STRING), '|', s.region_id) AS training_join_key FROM s LEFT JOIN h ON h.date = s.date AND h.region_id = s.region_id""",
)
def _(t):
    features = t.grid_day.groupBy("date", "region_id").agg(F.avg("dust_column_mass").alias("mass"))
    labels = lb.label_dust_storm(t.grid_day.select("date", "region_id").distinct(), ev.expand_events_daily(qe.merged(t)))
    out = tr.supervised_join_dust(features, labels)
    return out.select(day("date").alias("date"), "region_id", r(F.col("mass") * 1e3).alias("mass"), "label", "training_join_key")


@query(
    "supervised_join_dry_heat",
    ("grid_day",),
    """WITH a AS (SELECT region_id, year(date) AS y, avg(temp_c) AS temp_c, quantile_cont(temp_c, 9e-1) AS p90 FROM grid_day GROUP BY 1, 2),
    l AS (SELECT region_id, year(date) AS y, source_status AS crop, avg(vpd_kpa) AS yield FROM grid_day GROUP BY 1, 2, 3)
    SELECT a.region_id, CAST(a.y AS INT) AS year, l.crop AS crop_type, round(a.temp_c, 6) AS temp_c, round(a.p90, 6) AS temp_c_p90, round(l.yield, 6) AS yield_value,
      concat(a.region_id, '|', CAST(a.y AS STRING)) AS training_join_key FROM a JOIN l ON l.region_id = a.region_id AND l.y = a.y WHERE a.y <> 1999 OR l.crop <> 'normal'""",
)
def _(t):
    outcome = t.grid_day.groupBy("region_id", F.year("date").alias("year"), F.upper("source_status").alias("crop_type")).agg(F.avg("vpd_kpa").alias("yield_value"))
    rejected = (F.col("year") == 1999) & (F.col("crop_type") == "NORMAL")
    outcome = outcome.withColumn("validation_status", F.when(rejected, "Rejected").otherwise("verified"))
    out = tr.supervised_join_dry_heat(t.grid_day.select("date", "region_id", "temp_c"), outcome)
    return out.select("region_id", "year", "crop_type", *[r(c).alias(c) for c in ("temp_c", "temp_c_p90", "yield_value")], "training_join_key")


@query(
    "supervised_extreme_heat",
    USES,
    f"""WITH {qe.HEAT_LABELS}, kq AS (SELECT *, row_number() OVER (PARTITION BY date, region_id ORDER BY heat_index_c DESC, grid_id, latitude, longitude) AS rn FROM grid_day),
    p AS (SELECT date, region_id, avg(temp_c) AS temp_c, avg(sst_celsius) AS sst FROM kq WHERE rn <= 3 GROUP BY 1, 2)
    SELECT CAST(p.date AS STRING) AS date, p.region_id, l.label, l.label_source_mode, round(p.temp_c, 6) AS temp_c, round(p.sst, 6) AS sst_celsius FROM p JOIN hl l ON l.date = p.date AND l.region_id = p.region_id
    WHERE l.label_status <> 'uncertain'""",
)
def _(t):
    out = sv.supervised_extreme_heat(t.grid_day, qe.heat_events(t), n=10**12)
    return out.select(day("date").alias("date"), "region_id", "label", "label_source_mode", r("temp_c").alias("temp_c"), r("sst_celsius").alias("sst_celsius"))


@query(
    "sample_negatives",
    USES,
    f"""WITH {qe.HEAT_LABELS}, c AS (SELECT count(CASE WHEN label_status = 'positive' THEN 1 END) AS p, count(CASE WHEN label_source_mode = 'outside_event_region' THEN 1 END) AS i,
      count(CASE WHEN label_source_mode = 'no_event_day' THEN 1 END) AS b FROM hl)
    SELECT 'positive' AS kind, p AS n FROM c UNION ALL SELECT 'outside_event_region', least(i, p + 100) FROM c UNION ALL SELECT 'no_event_day', least(b, p + 100 - least(i, p + 100)) FROM c
      WHERE least(b, p + 100 - least(i, p + 100)) > 0""",
)
def _(t):
    labeled = lb.label_extreme_heat(t.grid_day.select("date", "region_id").distinct(), qe.heat_events(t))
    n = labeled.filter("label_status = 'positive'").count() + 100
    out = tr.sample_negatives(labeled, ["date", "region_id"], n)
    kind = F.when(F.col("label_status") == "positive", "positive").otherwise(F.col("label_source_mode"))
    return out.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


#: Kinds and numbers of a sample with as many negatives as positives, from rows ``hl``: near misses before background.
_BALANCED = """, c AS (SELECT count(CASE WHEN label_status = 'positive' THEN 1 END) AS p, count(CASE WHEN label_source_mode = 'outside_event_region' THEN 1 END) AS i,
      count(CASE WHEN label_source_mode = 'no_event_day' THEN 1 END) AS b FROM hl)
    SELECT 'positive' AS kind, p AS n FROM c UNION ALL SELECT 'outside_event_region', least(i, p) FROM c WHERE least(i, p) > 0 UNION ALL SELECT 'no_event_day', least(b, p - least(i, p)) FROM c WHERE least(b, p - least(i, p)) > 0"""


def _kinds(rows):
    kind = F.when(F.col("label_status") == "positive", "positive").otherwise(F.col("label_source_mode"))
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("sample_negatives_balanced", USES, f"WITH {qe.HEAT_LABELS}{_BALANCED}")
def _(t):
    """As many negatives as positives: the operator counts them itself."""
    labeled = lb.label_extreme_heat(t.grid_day.select("date", "region_id").distinct(), qe.heat_events(t))
    return _kinds(tr.sample_negatives(labeled, ["date", "region_id"]))


@query("supervised_extreme_heat_sampled", USES, f"WITH {qe.HEAT_LABELS}{_BALANCED}")
def _(t):
    """The supervised table with its sampling at work."""
    return _kinds(sv.supervised_extreme_heat(t.grid_day, qe.heat_events(t)))


@query(
    "prepare_features",
    ("grid_day",),
    """SELECT row_id, grid_id, dust_aod, dust_column_mass, dust_surface_mass FROM grid_day WHERE dust_aod IS NOT NULL AND dust_surface_mass IS NOT NULL""",
)
def _(t):
    return tr.prepare_features(t.grid_day, "dust_storm", keep=["row_id", "grid_id"])


@query(
    "build_daily_features",
    ("grid_day",),
    """SELECT row_id, grid_id, temp_c, round(daily_precip_total, 6) AS daily_precip_total, round(daily_convective_precip, 6) AS daily_convective_precip,
      round(greatest(0e0, daily_precip_total - daily_convective_precip), 6) AS daily_large_scale_precip, round(abs(wind10_speed - wind850_speed), 6) AS wind_shear_850_200,
      round(greatest(0e0, 18e-2 * (temp_c + 5) * (rh2m / 1e2) * 88571428571428571e-17), 5) AS pwat,
      round(25e-1 * wind850_speed * greatest(0e0, 18e-2 * (temp_c + 5) * (rh2m / 1e2) * 88571428571428571e-17), 4) AS ivt FROM grid_day""",
)
def _(t):
    g = t.grid_day
    raw = g.select(
        "row_id", "grid_id", F.col("date").cast("string").alias("time"), (F.col("temp_c") + 273.15).alias("t2m"), "rh2m", (F.col("daily_precip_total") / 1000).alias("tp"),
        (F.col("daily_convective_precip") / 1000).alias("cp"), "wind850_speed", F.col("wind10_speed").alias("jet200_speed"), "latitude", "longitude",
    )
    flood = tr.build_daily_features(raw.withColumnRenamed("row_id", "label").withColumnRenamed("grid_id", "label_status"), "flash_flood")
    heat = tr.build_daily_features(raw.withColumn("wind10_speed", F.lit(1.0)).withColumnRenamed("row_id", "label").withColumnRenamed("grid_id", "label_status"), "extreme_heat")
    keys = [F.col("label").alias("row_id"), F.col("label_status").alias("grid_id"), "latitude", "date"]
    temp = heat.groupBy(*keys).agg(F.max(F.round("temp_c", 6)).alias("temp_c"))
    names = ("daily_precip_total", "daily_convective_precip", "daily_large_scale_precip", "wind_shear_850_200")
    out = flood.select(*keys, *[r(c).alias(c) for c in names], r("pwat", 5).alias("pwat"), r("ivt", 4).alias("ivt"))
    return out.join(temp, ["row_id", "grid_id", "latitude", "date"]).drop("latitude", "date")


@query(
    "explicit_targets",
    ("grid_day",),
    """SELECT row_id, grid_id, vpd_kpa AS target FROM grid_day WHERE source_status <> 'degraded' AND l_linenumber <> 3""",
)
def _(t):
    rows = t.grid_day.select(
        "row_id", "grid_id", F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("vpd_kpa").cast("string")).alias("yield_anomaly"),
        F.when(F.col("source_status") == "degraded", "Rejected").otherwise("verified").alias("validation_status"),
    )
    return tr.explicit_targets(rows, "dry_heat_agriculture").select("row_id", "grid_id", "target")


@query("infer_sample_unit", ("grid_day",), "SELECT 'grid-day' AS flood, 'region_day' AS heat, 'custom' AS given, count(*) AS n FROM grid_day")
def _(t):
    flood = tr.infer_sample_unit(t.grid_day, "flash_flood").withColumnRenamed("sample_unit", "flood")
    heat = tr.infer_sample_unit(t.grid_day, "extreme_heat").withColumnRenamed("sample_unit", "heat")
    given = tr.infer_sample_unit(t.grid_day.withColumn("sample_unit", F.when(F.col("temp_c") > 10, " custom ").otherwise("")), "dust_storm").withColumnRenamed("sample_unit", "given")
    count = t.grid_day.agg(F.count("*").alias("n"))
    out = None
    for part in (flood, heat, given, count):
        part = part.withColumn("_one", F.lit(1))
        out = part if out is None else out.join(part, "_one")
    return out.drop("_one")


_GROUP = "CASE WHEN matched_event_ids <> '' THEN matched_event_ids ELSE concat('date:', CAST(date AS STRING)) END"


@query("split_groups", USES, f"{PS} SELECT {_GROUP} AS grp, count(*) AS n FROM labels GROUP BY 1")
def _(t):
    return qe.province_labels(t).groupBy(tr.split_group().alias("grp")).agg(F.count("*").alias("n"))


@query("group_shuffle_split", ("grid_day",), "SELECT count(*) AS rows, 0 AS broken_groups, true AS reached, true AS both_sides FROM grid_day")
def _(t):
    out = tr.group_shuffle_split(t.grid_day, "date", 0.2)
    groups = out.groupBy("date").agg(F.count("*").alias("n"), F.min("is_validation").alias("a"), F.max("is_validation").alias("b"))
    valid = F.sum(F.when(F.col("b"), F.col("n")).otherwise(0))
    return groups.agg(
        F.sum("n").alias("rows"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("broken_groups"), (valid >= F.floor(F.sum("n") * 0.2)).alias("reached"),
        ((valid > 0) & (valid < F.sum("n"))).alias("both_sides"),
    )


@query(
    "training_target_summary",
    USES,
    f"""{PS}, x AS (SELECT *, {_GROUP} AS grp FROM labels WHERE label_status <> 'uncertain')
    SELECT count(*) AS rows_with_explicit_label, count(CASE WHEN label > 5e-1 THEN 1 END) AS positive_labels, count(CASE WHEN label <= 5e-1 THEN 1 END) AS negative_labels, min(label) AS target_min,
      max(label) AS target_max, round(avg(label), 6) AS target_mean, count(DISTINCT grp) AS split_group_count, count(DISTINCT CASE WHEN matched_event_ids <> '' THEN grp END) AS event_group_count,
      count(DISTINCT CASE WHEN matched_event_ids = '' THEN grp END) AS fallback_date_group_count, count(nullif(matched_event_ids, '')) AS rows_with_matched_event_ids,
      count(*) - count(nullif(matched_event_ids, '')) AS rows_using_fallback_date_groups, count(CASE WHEN contains(matched_event_ids, ',') THEN 1 END) AS rows_with_multi_event_groups,
      'explicit_label' AS target_source FROM x""",
)
def _(t):
    return tr.training_target_summary(qe.province_labels(t), "flash_flood").withColumn("target_mean", r("target_mean"))


@query(
    "hazard_training_tables",
    ("grid_day",),
    """SELECT 'extreme_heat' AS hazard_type, count(*) AS n, round(avg(least(rh2m, 100)), 5) AS humidity, NULL AS aod FROM grid_day
    UNION ALL SELECT 'dust_storm', count(*), NULL, round(avg(dust_aod), 5) FROM grid_day WHERE dust_aod IS NOT NULL AND dust_surface_mass IS NOT NULL
    UNION ALL SELECT 'flash_flood', count(*), NULL, NULL FROM grid_day""",
)
def _(t):
    out = tr.hazard_training_tables(t.grid_day, ["extreme_heat", "dust_storm", "flash_flood"])
    f = F.col("features")
    return out.groupBy("hazard_type").agg(
        F.count("*").alias("n"), r(F.avg(F.try_element_at(f, F.lit("relative_humidity_percent"))), 5).alias("humidity"), r(F.avg(F.try_element_at(f, F.lit("dust_aod"))), 5).alias("aod")
    )


@query(
    "hazard_training_tables_incremental",
    ("grid_day",),
    """SELECT 'extreme_heat' AS hazard_type, count(*) AS n, round(avg(least(rh2m, 100)), 5) AS humidity, NULL AS aod, 1 AS rewritten FROM grid_day
    UNION ALL SELECT 'dust_storm', count(*), NULL, round(avg(dust_aod), 5), 1 FROM grid_day WHERE dust_aod IS NOT NULL AND dust_surface_mass IS NOT NULL
    UNION ALL SELECT 'flash_flood', count(*), NULL, NULL, 1 FROM grid_day""",
)
def _(t):
    """The table as files, one of them first with other values: the second run rewrites that file's part alone.

    All other files are written in one pass by the tasks that read the rows. The file that changes holds a fixed share of line 3.
    """
    source, path = shared_dir(t.spark, "source"), shared_dir(t.spark, "snapshots")
    days = t.grid_day.drop("row_id", "l_orderkey", "source_file")
    schema = days.schema
    changing = F.coalesce((F.col("l_linenumber") == 3) & (F.pmod(F.xxhash64("date", "latitude", "longitude"), F.lit(64)) == 0), F.lit(False))

    def write(rows):
        # the filter runs where the rows are; only its result is brought into one file
        rows.filter(changing).repartition(1).write.mode("overwrite").parquet(f"{source}/changing")

    with unsorted_writes(t.spark):
        days.filter(~changing).withColumn("line", F.col("l_linenumber")).write.partitionBy("line").parquet(f"{source}/lines")
    write(days.withColumn("rh2m", F.col("rh2m") + 1))
    build = lambda rows: tr.hazard_training_tables(rows, ["extreme_heat", "dust_storm", "flash_flood"], ["date", "latitude", "longitude", "source_file"])
    sn.update_from_files(t.spark, path, source, build, schema)
    write(days)
    version = sn.update_from_files(t.spark, path, source, build, schema)["version"]
    # the old file's part goes, the new file's part comes
    rewritten = sn.parts_of(t.spark, path, version).exceptAll(sn.parts_of(t.spark, path, version - 1)).agg(F.count("*").cast("int").alias("rewritten"))
    f = F.col("features")
    out = sn.read_snapshot(t.spark, path).groupBy("hazard_type").agg(
        F.count("*").alias("n"), r(F.avg(F.try_element_at(f, F.lit("relative_humidity_percent"))), 5).alias("humidity"), r(F.avg(F.try_element_at(f, F.lit("dust_aod"))), 5).alias("aod")
    )
    return out.withColumn("_one", F.lit(1)).join(F.broadcast(rewritten.withColumn("_one", F.lit(1))), "_one").drop("_one")


@query(
    "label_passthrough",
    USES,
    f"""{PS} SELECT concat(CAST(date AS STRING), '|', province_name) AS training_join_key, 'province_day:province_name' AS training_join_mode, label FROM labels WHERE label_status <> 'uncertain'""",
)
def _(t):
    return tr.label_passthrough(qe.province_labels(t)).select("training_join_key", "training_join_mode", "label")


@query("evenly_spaced", ("grid_day",), """WITH d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM grid_day))
SELECT CAST(date AS STRING) AS date FROM d WHERE i IN (SELECT CAST(round_even(j * (n - 1) / 9e0, 0) AS BIGINT) FROM range(10) x(j), (SELECT max(n) AS n FROM d))""")
def _(t):
    return tr.evenly_spaced(t.grid_day, "date", 10).select(day("date").alias("date"))


@query(
    "positive_evidence_counts",
    USES,
    f"""WITH {qe.GRID_SAMPLES}, {qe.flood_label_sql('gs', qe.GRID_MATCH, True)}
    SELECT count(*) AS positive_rows, count(*) AS geometry_positive_rows, (SELECT count(DISTINCT m.k) FROM m JOIN e USING (event_id) WHERE m.mode = 'province_day' AND e.geometry_wkt IS NULL AND e.latitude IS NULL) AS boundary_grounded_positive_rows,
      (SELECT count(DISTINCT m.k) FROM m JOIN e USING (event_id) WHERE e.geometry_wkt IS NOT NULL OR e.latitude IS NOT NULL) AS explicit_geometry_positive_rows FROM labels WHERE label_status = 'positive'""",
)
def _(t):
    return au.positive_evidence_counts(qe.flood_catalogue(t).label(qe.grid_samples(t), whole=False))


@query(
    "positive_source_counts",
    USES,
    f"""{PS}, x AS (SELECT DISTINCT m.k, CASE WHEN e.geometry_wkt IS NOT NULL THEN 'source_geometry' WHEN e.latitude IS NOT NULL THEN 'derived_point_buffer' ELSE 'province_boundary' END AS source FROM m JOIN e USING (event_id))
    SELECT source, count(*) AS rows FROM x GROUP BY 1""",
)
def _(t):
    return au.positive_source_counts(qe.province_labels(t))


_COUNTS = """count(*) AS rows, count(CASE WHEN label_status = 'positive' THEN 1 END) AS positive_rows, count(CASE WHEN label_status = 'negative' THEN 1 END) AS negative_rows,
count(CASE WHEN label_status = 'uncertain' THEN 1 END) AS uncertain_rows, count(CASE WHEN label_source_mode = 'outside_event_footprint' THEN 1 END) AS outside_event_footprint_negative_rows,
count(CASE WHEN label_source_mode = 'event_day_unresolved' THEN 1 END) AS event_day_unresolved_rows, count(nullif(matched_event_ids, '')) AS rows_with_matched_event_ids"""


@query("label_summary", USES, f"{PS} SELECT {_COUNTS} FROM labels")
def _(t):
    return au.label_summary(qe.province_labels(t))


@query(
    "supervision_quality",
    USES,
    f"""{PS}, c AS (SELECT province_name, {_COUNTS} FROM labels GROUP BY 1)
    SELECT province_name, concat_ws(',', CASE WHEN positive_rows = 0 THEN 'no_positive_labels' END, CASE WHEN rows_with_matched_event_ids = 0 THEN 'no_matched_event_rows' END,
        CASE WHEN positive_rows > 0 THEN 'no_geometry_backed_positives' END, CASE WHEN uncertain_rows / CAST(rows AS DOUBLE) > 25e-2 THEN 'high_uncertain_fraction' END) AS warnings,
      CASE WHEN positive_rows = 0 THEN 'insufficient' ELSE 'warning' END AS status, round(positive_rows / CAST(rows AS DOUBLE), 6) AS positive_fraction,
      round(outside_event_footprint_negative_rows / CAST(nullif(negative_rows, 0) AS DOUBLE), 6) AS outside FROM c""",
)
def _(t):
    labels = qe.province_labels(t)
    s, m = F.col("label_status"), F.col("label_source_mode")
    rows = labels.groupBy("province_name").agg(
        F.count("*").alias("rows"),
        *[F.count(F.when(s == v, 1)).alias(f"{v}_rows") for v in ("positive", "negative", "uncertain")],
        F.count(F.when(m == "outside_event_footprint", 1)).alias("outside_event_footprint_negative_rows"),
        F.count(F.when(F.col("matched_event_ids") != "", 1)).alias("rows_with_matched_event_ids"),
    )
    out = au.supervision_quality(rows)
    return out.select(
        "province_name", joined("warnings").alias("warnings"), "status", r("positive_fraction").alias("positive_fraction"), r("outside_event_footprint_negative_fraction_of_negatives").alias("outside")
    )


@query(
    "source_label_audit",
    USES,
    f"{PS} SELECT label_status, label_source_mode, count(*) AS rows, count(nullif(matched_event_ids, '')) AS rows_with_matched_event_ids FROM labels GROUP BY 1, 2",
)
def _(t):
    return au.source_label_audit(qe.province_labels(t))


@query(
    "audit_labels",
    USES,
    f"""{PS}, ids AS (SELECT unnest(string_split(matched_event_ids, ',')) AS id FROM labels WHERE label_status = 'positive')
    SELECT * FROM (SELECT 'event' AS kind, id AS name, count(*) AS rows FROM ids GROUP BY id ORDER BY 3 DESC, 2 LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'province' AS kind, province_name AS name, count(*) AS rows FROM labels WHERE label_status = 'positive' GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
    UNION ALL SELECT 'unresolved', '', count(*) FROM labels WHERE label_source_mode = 'event_day_unresolved'""",
)
def _(t):
    tables = au.audit_labels(qe.province_labels(t))
    top = tables["top_positive_event_ids"].select(F.lit("event").alias("kind"), F.col("event_id").alias("name"), "rows")
    provinces = tables["top_positive_provinces"].select(F.lit("province").alias("kind"), F.col("province_name").alias("name"), "rows")
    rest = tables["summary"].select(F.lit("unresolved").alias("kind"), F.lit("").alias("name"), F.col("unresolved_rows").alias("rows"))
    return top.unionByName(provinces).unionByName(rest)


@query(
    "unresolved_candidates",
    USES,
    f"""{PS}, o AS (SELECT date, count(*) AS n FROM labels WHERE label_status = 'negative' AND label_source_mode <> 'no_event_day' GROUP BY 1),
    g AS (SELECT date, count(CASE WHEN mode IN ('geometry_wkt', 'point_buffer', 'province_day') THEN 1 END) AS good, count(CASE WHEN mode NOT IN ('geometry_wkt', 'point_buffer', 'province_day') THEN 1 END) AS bad FROM e GROUP BY 1),
    c AS (SELECT e.event_id, o.n, CASE WHEN g.good > 0 AND g.bad > 0 THEN 'mixed_supported_and_unsupported' WHEN e.mode IN ('point_buffer', 'geometry_wkt') THEN 'policy_conservative'
      WHEN e.mode = 'province_day' THEN 'policy_conservative' ELSE 'source_too_vague' END AS bucket FROM e JOIN o ON o.date = e.date JOIN g ON g.date = e.date)
    SELECT bucket, CAST(sum(n) AS BIGINT) AS unresolved_rows, count(*) AS event_days FROM c GROUP BY 1""",
)
def _(t):
    events = cut_lineage(ev.expand_events_daily(qe.merged(t)), "daily-events")  # merged once, for the labels and for the candidates
    rows = lb.FloodCatalogue(events).label(qe.province_samples(t)).filter("label_status = 'negative' and label_source_mode <> 'no_event_day'")
    out = au.unresolved_candidates(rows, events)
    return out.groupBy(F.col("unresolved_bucket").alias("bucket")).agg(F.sum("unresolved_rows").alias("unresolved_rows"), F.sum("event_days").alias("event_days"))


@query(
    "residual_tokens",
    ("catalogue",),
    """SELECT event_id, CASE location_name WHEN 'Hidden valley' THEN 'north,of,hidden,valley,coast' ELSE 'north,of,coast' END AS left_over FROM catalogue""",
)
def _(t):
    name = F.concat(F.lit("north of "), F.col("location_name"), F.lit(" and the coast"))
    rows = once(t.catalogue.select("event_id", name.alias("name")), {"provinces": resolve_provinces("name")})
    return rows.select("event_id", joined(residual_tokens("name", F.col("provinces"))).alias("left_over"))


@query(
    "score_without_model",
    ("points",),
    f"""WITH {RISKS} SELECT row_id, grid_id, round(p, 5) AS p, {_LEVEL.format(p='p')} AS level, 'degraded_rule_fallback' AS mode, 'missing_model_file' AS reason FROM risks WHERE hazard_type = 'extreme_heat'""",
)
def _(t):
    out = ml.score_with_model(t.points, "extreme_heat", None, KEEP)
    return out.select("row_id", "grid_id", r("risk_probability", 5).alias("p"), F.col("risk_level").alias("level"), F.col("inference_mode").alias("mode"), F.col("fallback_reason").alias("reason"))


def heat_samples(t):
    rows = tr.build_daily_features(t.grid_day, "extreme_heat")
    return tr.supervised_features(rows.drop("label"), "extreme_heat", keep=["date"])


@query("train_hazard_model")
def _(t):
    """One row per trained hazard model with its split, rounds and validation error."""
    model = ml.train_hazard_model(heat_samples(t), "extreme_heat", group="date")
    s = model.summary
    row = (s["hazard_type"], s["objective"], s["train_rows"], s["validation_rows"], s["metric"], float(s["validation_metric"]))
    return t.spark.createDataFrame([row], "hazard_type string, objective string, train_rows long, validation_rows long, metric string, validation_metric double")


@query("evaluate_model", ("grid_day",), "SELECT 'extreme_heat' AS hazard_type, 'rmse' AS metric, count(*) AS rows, true AS finite, true AS below_spread FROM grid_day")
def _(t):
    """The error of a trained model over all samples, against the spread of their targets (what the mean alone would give)."""
    samples = heat_samples(t)
    metric, value = ml.evaluate_model(ml.train_hazard_model(samples, "extreme_heat", group="date"), samples)
    spread = samples.agg(F.count("*").alias("rows"), F.stddev("target").alias("spread"))
    return spread.select(F.lit("extreme_heat").alias("hazard_type"), F.lit(metric).alias("metric"), "rows", (F.lit(value) < float("inf")).alias("finite"), (F.lit(value) < F.col("spread")).alias("below_spread"))


@query("score_with_model")
def _(t):
    model = ml.train_hazard_model(heat_samples(t), "extreme_heat", group="date")
    out = ml.score_with_model(t.grid_day, "extreme_heat", model, ["row_id", "grid_id"])
    return out.groupBy("risk_level", "inference_mode").agg(F.count("*").alias("n"))


@query("predict_risk_fields")
def _(t):
    model = ml.train_hazard_model(heat_samples(t), "extreme_heat", group="date")
    out, _ = ml.predict_risk_fields(t.grid_day, {"extreme_heat": model}, ["row_id", "grid_id"])
    return out


@query("compare_variants")
def _(t):
    """Two ranking variables, two pool sizes and two negative sizes: eight models ranked by validation error."""
    pools = [(v, k) for v in ("heat_index_c", "tmax_c") for k in (1, 3)]
    events = cut_lineage(qe.heat_events(t), "heat-events")
    tables = {f"region_day_{v}_top{k}": sv.labeled_extreme_heat(t.grid_day, events, "region_day", v, k, statistics=False) for v, k in pools}
    return ml.compare_variants(tables, [None, 1000], ["date", "region_id"])


@query(
    "explain_top_features",
    ("grid_day",),
    """WITH n AS MATERIALIZED (SELECT *, row_number() OVER () AS latitude_n FROM grid_day), c AS (SELECT row_id, grid_id, latitude_n AS latitude, 'temp_c' AS f, 3e-1 * temp_c AS v FROM n UNION ALL SELECT row_id, grid_id, latitude_n, 'rh2m', -2e-1 * rh2m FROM n
      UNION ALL SELECT row_id, grid_id, latitude_n, 'wind10_speed', 1e0 * wind10_speed FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY row_id, grid_id, latitude ORDER BY abs(v) DESC, f DESC) AS n FROM c)
    SELECT row_id, grid_id, string_agg(concat(f, CASE WHEN v >= 0 THEN ':raises' ELSE ':lowers' END), ',' ORDER BY n) AS top FROM k WHERE n <= 2 GROUP BY row_id, grid_id, latitude""",
)
def _(t):
    out = ml.explain_top_features(t.grid_day, {"temp_c": 0.3, "rh2m": -0.2, "wind10_speed": 1.0}, ["row_id", "grid_id"], 2)
    return out.select("row_id", "grid_id", joined(F.transform("top_features", lambda f: F.concat_ws(":", f["feature"], f["direction"]))).alias("top"))


@query("fit_linear_calibration")
def _(t):
    fit = ml.fit_linear_calibration(t.obs, "temp_c")
    rows = [(name, value, fit["rmse"], fit["sample_count"]) for name, value in {"intercept": fit["intercept"], **fit["coefficients"]}.items()]
    return t.spark.createDataFrame(rows, "term string, coefficient double, rmse double, sample_count long")
