"""Queries of rule risks, checks, ensembles, products and the warning chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwarden.constants import DEGRADED_NOTE
from gridwarden.operators import graph as gr
from gridwarden.operators import products as pr
from gridwarden.operators import risk as rk
from gridwarden.plans import warning
from gridwarden.session import cut_lineage
from gridwarden.workload.q_columns import DRY, DUST, FLOOD, PWAT, _expand, heat_index
from gridwarden.workload.registry import joined, query, r

HI = heat_index("temp_c", "rh_percent", "temp_c < 267e-1")
_LEVEL = "CASE WHEN {p} >= 75e-2 THEN 'extreme' WHEN {p} >= 5e-1 THEN 'high' WHEN {p} >= 25e-2 THEN 'medium' ELSE 'low' END"


def _texts(*tests: tuple[str, str]) -> str:
    parts = ", ".join(f"CASE WHEN {test} THEN '{text}' END" for test, text in tests)
    return f"coalesce(nullif(concat_ws('；', {parts}), ''), '未触发显著阈值')"


HEAT_P = _expand("{h}(greatest((temp_c - 38) / 12e0, (coalesce(hi, temp_c) - 41) / 12e0) + CASE WHEN temp_c >= 45 THEN 2e-1 ELSE 0e0 END)")
COAST_P = _expand(
    "{h}(35e-2 * {h}((coalesce(rh_percent, 0) - 55) / 35e0) + 3e-1 * CASE WHEN hi IS NULL THEN 0e0 ELSE {h}((hi - 38) / 12e0) END"
    " + 2e-1 * CASE WHEN pwat IS NULL THEN 0e0 ELSE {h}((pwat - 35) / 25e0) END + 15e-2 * (1 - {h}((coalesce(coastal_distance_km, 120) - 20) / 18e1)))"
)
VPD = "(CASE WHEN rh_percent IS NOT NULL THEN 6108e-4 * exp(1727e-2 * temp_c / (temp_c + 2373e-1)) * (1 - least(1e0, greatest(0e0, rh_percent / 1e2))) END)"
BASE = f"b AS (SELECT *, CASE WHEN rh_percent IS NOT NULL THEN {HI} END AS hi, CASE WHEN rh_percent IS NULL THEN NULL ELSE {PWAT} END AS pwat, {VPD} AS vpd FROM points)"
FACTORS = {
    "flash_flood": _texts(
        ("precip_1h_mm >= 25", "1小时强降水超过山洪初筛阈值"), ("precip_6h_mm >= 60", "6小时累计降水偏高"), ("slope_deg >= 12", "地形坡度提高汇流速度"),
        ("impervious_frac >= 35e-2", "不透水面比例较高"),
    ),
    "extreme_heat": _texts(("temp_c >= 42", "气温达到极端高温关注阈值"), ("coalesce(hi, temp_c) >= 45", "热指数显示人体热负荷显著升高"), ("rh_percent >= 55", "湿度提高体感热风险")),
    "dry_heat_agriculture": _texts(("vpd >= 4", "VPD偏高，作物蒸散胁迫增强"), ("temp_c >= 40", "高温增加干热胁迫"), ("wind_speed_mps >= 8", "较大风速增强蒸发")),
    "dust_potential": _texts(
        ("wind_speed_mps >= 12", "近地面风速达到起沙关注阈值"), ("wind_gust_mps >= 18", "阵风增强扬沙潜势"), ("soil_moisture_frac <= 12e-2", "土壤干燥利于起沙"),
        ("visibility_km <= 5", "能见度下降提示沙尘影响"),
    ),
    "coastal_humid_heat": _texts(
        ("coastal_distance_km <= 80", "靠近红海或海湾沿岸，湿热暴露较高"), ("rh_percent >= 65", "相对湿度较高"), ("25e-1 * wind_speed_mps * pwat >= 250", "水汽输送占位指标偏强")
    ),
}
PROBABILITY = {"flash_flood": FLOOD, "extreme_heat": HEAT_P, "dry_heat_agriculture": DRY, "dust_potential": DUST, "coastal_humid_heat": COAST_P}
_LONG = " UNION ALL ".join(
    f"SELECT row_id, grid_id, valid_time, latitude, longitude, source_status, '{h}' AS hazard_type, {PROBABILITY[h]} AS p, {FACTORS[h]} AS factors FROM b" for h in PROBABILITY
)
RISKS = f"{BASE}, risks AS ({_LONG})"


def _single(hazard: str, name: str) -> None:
    sql = f"WITH {BASE}, s AS (SELECT row_id, grid_id, {PROBABILITY[hazard]} AS p, {FACTORS[hazard]} AS factors FROM b) SELECT row_id, grid_id, round(p, 5) AS p, {_LEVEL.format(p='p')} AS level, factors FROM s"

    @query(name, ("points",), sql)
    def _(t):
        out = rk.score_single(t.points, hazard)
        return out.select("row_id", "grid_id", r("risk_probability", 5).alias("p"), F.col("risk_level").alias("level"), joined("contributing_factors", "；").alias("factors"))


for _hazard, _name in (
    ("flash_flood", "risk_flash_flood"),
    ("extreme_heat", "risk_extreme_heat"),
    ("dry_heat_agriculture", "risk_dry_heat"),
    ("dust_potential", "risk_dust"),
    ("coastal_humid_heat", "risk_coastal_humid_heat"),
):
    _single(_hazard, _name)

KEEP = ["row_id", "grid_id", "valid_time", "latitude", "longitude"]


@query("scan_risks", ("points",), f"WITH {RISKS} SELECT row_id, grid_id, hazard_type, round(p, 5) AS p, {_LEVEL.format(p='p')} AS level, factors FROM risks")
def _(t):
    out = rk.scan_risks(t.points, KEEP)
    return out.select("row_id", "grid_id", "hazard_type", r("risk_probability", 5).alias("p"), F.col("risk_level").alias("level"), joined("contributing_factors", "；").alias("factors"))


@query(
    "standard_indicator_values",
    ("points",),
    f"WITH {BASE} SELECT row_id, grid_id, temp_c, rh_percent AS relative_humidity_percent, round(vpd, 5) AS vpd_kpa, round(hi, 5) AS heat_index_c, wind_speed_mps, CAST(NULL AS DOUBLE) AS cape FROM b",
)
def _(t):
    v = rk.standard_indicator_values(t.points)
    out = t.points.select("row_id", "grid_id", *[v[n].alias(n) for n in ("temp_c", "relative_humidity_percent", "vpd_kpa", "heat_index_c", "wind_speed_mps", "cape")])
    return out.withColumns({c: r(c, 5) for c in ("vpd_kpa", "heat_index_c")})


@query(
    "evidence_check",
    ("points",),
    f"""WITH {RISKS} SELECT hazard_type, true AS has_version, true AS factors_ok, temp IS NOT NULL AS complete, count(*) AS n
    FROM (SELECT r.*, p.rh_percent AS temp FROM risks r JOIN points p ON p.row_id = r.row_id AND p.grid_id = r.grid_id AND p.valid_time = r.valid_time AND p.latitude = r.latitude AND p.longitude = r.longitude) GROUP BY 1, 4""",
)
def _(t):
    out = rk.evidence_check(rk.scan_risks(t.points, [*KEEP, "temp_c", "rh_percent"]), ["temp_c", "rh_percent"])
    return out.groupBy(
        "hazard_type", F.col("has_model_version").alias("has_version"), F.col("high_risk_requires_factors_ok").alias("factors_ok"), F.col("physical_indicators_complete").alias("complete")
    ).agg(F.count("*").alias("n"))


@query("review_required", ("points",), f"WITH {RISKS} SELECT latitude, longitude, bool_or(p >= 5e-1) AS needed FROM risks GROUP BY 1, 2")
def _(t):
    out = rk.review_required(rk.scan_risks(t.points, KEEP), ["latitude", "longitude"])
    return out.select("latitude", "longitude", F.col("human_review_required").alias("needed"))


@query(
    "ensemble_stats",
    ("grid_day",),
    """SELECT latitude, CAST(date AS STRING) AS date, count(daily_precip_total) AS members, round(avg(daily_precip_total), 6) AS mean, round(stddev_pop(daily_precip_total), 6) AS spread,
      round(avg(CASE WHEN daily_precip_total >= 25 THEN 1e0 ELSE 0e0 END), 6) AS exceedance FROM grid_day GROUP BY 1, 2""",
)
def _(t):
    out = rk.ensemble_stats(t.grid_day, "daily_precip_total", 25.0, ["latitude", "date"])
    return out.select(
        "latitude", F.col("date").cast("string").alias("date"), F.col("member_count").alias("members"), r("ensemble_mean").alias("mean"), r("ensemble_spread").alias("spread"),
        r("exceedance_probability").alias("exceedance"),
    )


@query("risk_summary", ("points",), f"WITH {RISKS} SELECT hazard_type, count(*) AS n, round(min(p), 5) AS low, round(max(p), 5) AS high, round(avg(p), 5) AS mean FROM risks GROUP BY 1")
def _(t):
    out = rk.risk_summary(rk.scan_risks(t.points, KEEP))
    return out.select("hazard_type", F.col("rows").alias("n"), r("min_probability", 5).alias("low"), r("max_probability", 5).alias("high"), r("mean_probability", 5).alias("mean"))


@query(
    "top_areas",
    ("points",),
    f"""WITH {RISKS}, a AS (SELECT hazard_type, latitude, longitude, max(round(p, 5)) AS p FROM risks GROUP BY 1, 2, 3)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hazard_type ORDER BY p DESC, latitude, longitude) AS rank FROM a) WHERE rank <= 10""",
)
def _(t):
    scored = rk.scan_risks(t.points, KEEP).withColumn("risk_probability", r("risk_probability", 5))
    out = rk.top_areas(scored, ["latitude", "longitude"], 10)
    return out.select("hazard_type", "latitude", "longitude", F.col("risk_probability").alias("p"), "rank")


_SUMMARY = f"""WITH {RISKS}, l AS (SELECT *, {_LEVEL.format(p='p')} AS level, CASE hazard_type WHEN 'flash_flood' THEN 1 WHEN 'extreme_heat' THEN 2 WHEN 'dry_heat_agriculture' THEN 3 WHEN 'dust_potential' THEN 4 ELSE 5 END AS k FROM risks),
s AS (SELECT row_id, grid_id, valid_time, latitude, longitude, bool_or(p >= 25e-2) AS some, bool_or(p >= 5e-1) AS review, max(source_status) AS source_status FROM l GROUP BY 1, 2, 3, 4, 5)
SELECT s.row_id, s.grid_id, {{cols}} FROM s JOIN l ON l.row_id = s.row_id AND l.grid_id = s.grid_id AND l.valid_time = s.valid_time AND l.latitude = s.latitude AND l.longitude = s.longitude
WHERE NOT s.some OR l.level <> 'low' GROUP BY s.row_id, s.grid_id, s.valid_time, s.latitude, s.longitude"""
_HAZARDS = "string_agg(concat(l.hazard_type, ':', l.level), '；' ORDER BY l.k)"


def _listed(text):
    """The risks in a briefing's text, with their probabilities: the same for all industries of a record."""
    mark = "hazards="
    return F.substr(text, F.locate(mark, text) + len(mark))


def _named(listed):
    """The same without probabilities and full stop."""
    return F.regexp_replace(listed, r"\([0-9.)]+", "")


@query("industry_briefings", ("points",), _SUMMARY.format(cols=f"{_HAZARDS} AS hazards, 6 AS industries, max(s.source_status) = 'degraded' AS degraded"))
def _(t):
    # records are dealt while they are small, so their rows are counted where they are made
    out = pr.industry_briefings(rk.with_risks(t.points.repartition("row_id")), [*KEEP, "risks"])
    rows = out.select("row_id", "grid_id", "valid_time", "latitude", "longitude", _listed(F.col("en")).alias("listed"), F.col("zh").endswith(DEGRADED_NOTE).alias("degraded"), "industry")
    rows = rows.groupBy("row_id", "grid_id", "valid_time", "latitude", "longitude", "listed", "degraded").agg(F.count("industry").alias("industries"))
    return rows.select("row_id", "grid_id", _named("listed").alias("hazards"), "degraded", "industries")


@query("warning_product", ("points",), _SUMMARY.format(cols=f"bool_or(s.review) AS review, CASE WHEN bool_or(s.review) THEN 'pending' ELSE 'not_required' END AS review_status, 5 AS risks, 6 AS briefings, {_HAZARDS} AS hazards"))
def _(t):
    out = pr.warning_product(rk.with_risks(t.points), "grid_id", KEEP)
    named = _named(_listed(F.col("briefings")[0]["en"]))
    return out.select("row_id", "grid_id", F.col("human_review_required").alias("review"), "review_status", F.size("risks").alias("risks"), F.size("briefings").alias("briefings"), named.alias("hazards"))


@query("warning_chain", ("points",), f"WITH {RISKS}, g AS (SELECT row_id, grid_id, valid_time, latitude, longitude, bool_or(p >= 5e-1) AS review FROM risks GROUP BY 1, 2, 3, 4, 5) SELECT g.row_id, g.grid_id, g.review, CASE WHEN pt.rh_percent IS NULL THEN 'rh_percent' ELSE '' END AS missing FROM g JOIN points pt ON pt.row_id = g.row_id AND pt.grid_id = g.grid_id AND pt.valid_time = g.valid_time AND pt.latitude = g.latitude AND pt.longitude = g.longitude")
def _(t):
    out = warning.warning_products(t.points, "grid_id", KEEP)
    return out.select("row_id", "grid_id", F.col("human_review_required").alias("review"), joined("missing_fields").alias("missing"))


def _rules_sql() -> str:
    from gridwarden.constants import RESPONSE_RULES

    rows = [f"('{h}', '{k}', '{n}')" for h, rule in RESPONSE_RULES.items() for k in gr.RULE_LINKS for n in rule[k]]
    return "rules AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") x(hazard_type, kind, name))"


@query(
    "semantic_evidence",
    ("points",),
    f"""WITH {RISKS}, {_rules_sql()}, i AS (SELECT hazard_type, string_agg(CASE WHEN kind = 'exposures' THEN name END, ',' ORDER BY name) AS exposures,
      string_agg(CASE WHEN kind = 'actions' THEN name END, ',' ORDER BY name) AS actions, string_agg(CASE WHEN kind = 'departments' THEN name END, ',' ORDER BY name) AS departments FROM rules GROUP BY 1)
    SELECT r.row_id, r.grid_id, r.hazard_type, i.exposures, i.actions, i.departments FROM risks r JOIN i ON i.hazard_type = r.hazard_type""",
)
def _(t):
    out = warning.explained_risks(t.points, KEEP)
    lists = [joined(c).alias(c) for c in ("exposures", "actions", "departments")]
    return out.select("row_id", "grid_id", "hazard_type", *lists)


# Evidence columns that the points table has, by hazard.
EVIDENCE = {"flash_flood": ("slope_deg",)}


def risks_of(t):
    return rk.scan_risks(gr.with_cells(t.points), [*KEEP, "_cell"])


@query(
    "seed_triples",
    ("points",),
    f"""WITH {RISKS}, {_rules_sql()}, n AS (SELECT hazard_type, count(*) AS risks FROM risks GROUP BY 1)
    SELECT r.hazard_type, CASE kind WHEN 'exposures' THEN 'affectsExposure' WHEN 'actions' THEN 'requiresAction' WHEN 'departments' THEN 'servedByDepartment' ELSE 'hasWarningProduct' END AS predicate,
      r.name AS object, n.risks FROM rules r JOIN n ON n.hazard_type = r.hazard_type""",
)
def _(t):
    base = gr.Vocabulary().base
    short = [F.replace(c, F.lit(base), F.lit("")).alias(c) for c in ("subject", "predicate", "object")]
    triples = gr.seed_triples(gr.rule_table(t.spark)).select(*short).filter(F.col("predicate").isin([link for link, _ in gr.RULE_LINKS.values()]))
    counts = risks_of(t).groupBy("hazard_type").agg(F.count("*").alias("risks"))
    return triples.withColumnRenamed("subject", "hazard_type").join(counts, "hazard_type")


@query(
    "risk_triples",
    ("points",),
    f"""WITH {RISKS}, c AS (SELECT DISTINCT hazard_type, grid_id, valid_time FROM risks)
    SELECT 'DisasterEvent' AS kind, count(*) AS n FROM c UNION ALL SELECT 'Location', count(DISTINCT grid_id) FROM risks
    UNION ALL SELECT 'WarningProduct', count(DISTINCT (hazard_type, grid_id)) FROM risks
    UNION ALL SELECT 'MeteorologicalIndicator', count(DISTINCT (hazard_type, x)) FROM (SELECT hazard_type, unnest(string_split(factors, '；')) AS x FROM risks)""",
)
def _(t):
    triples = gr.risk_triples(risks_of(t))
    kind = F.regexp_extract("object", "([A-Za-z]+)$", 1)
    typed = triples.filter("predicate = 'rdf:type'").filter(kind.isin("DisasterEvent", "Location", "WarningProduct", "MeteorologicalIndicator"))
    # the indicators of this query's SQL are those of factors, named by a digest; risk_evidence_triples has the measured ones
    typed = typed.filter((kind != "MeteorologicalIndicator") | F.col("subject").rlike("indicator_[0-9a-f]{12}$"))
    return typed.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(
    "risk_evidence_triples",
    ("points",),
    """WITH e AS (SELECT DISTINCT grid_id, valid_time, slope_deg FROM points), v AS (SELECT DISTINCT slope_deg FROM e WHERE slope_deg IS NOT NULL)
    SELECT 'rdf:type' AS predicate, CAST(1 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS total UNION ALL SELECT 'rdfs:label', 1, NULL
    UNION ALL SELECT 'hasIndicatorEvidence', count(DISTINCT grid_id), NULL FROM e
    UNION ALL SELECT 'hasIndicatorValue', count(*), sum(slope_deg) FROM v
    UNION ALL SELECT 'hasClimateParameterMeasurement', count(*), NULL FROM (SELECT DISTINCT grid_id, valid_time FROM e)
    UNION ALL SELECT 'hasValue', count(*), sum(slope_deg) FROM e WHERE slope_deg IS NOT NULL""",
)
def _(t):
    """The six triple forms of measured evidence; of the rules' evidence columns the points table has the slope of flash floods."""
    v = gr.Vocabulary()
    nodes = [f"{v.base}indicator_{h}_{n}" for h, names in EVIDENCE.items() for n in names]
    forms = [v.base + "hasIndicatorEvidence", v.base + "hasIndicatorValue", v.event + "hasClimateParameterMeasurement", v.event + "hasValue"]
    # the class and the label of a node are tested first: they are constants or plain columns, so no other name is made to be compared
    named = (F.col("predicate") == gr.TYPE) & (F.col("object") == v.base + "MeteorologicalIndicator")
    named = named | ((F.col("predicate") == gr.LABEL) & F.col("object").isin([n for names in EVIDENCE.values() for n in names]))
    found = gr.risk_triples(risks_of(t)).filter(F.col("predicate").isin(*forms, gr.TYPE, gr.LABEL)).filter(F.col("predicate").isin(forms) | (named & F.col("subject").isin(nodes)))
    short = F.regexp_extract("predicate", "(rdfs?:[a-z]+|[A-Za-z]+)$", 1)
    value = F.when(F.lower("predicate").endswith("value"), F.expr("try_cast(object AS double)"))
    return found.groupBy(short.alias("predicate")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


@query(
    "risk_event_uris",
    ("points",),
    f"""WITH {RISKS} SELECT DISTINCT concat('urn:gridwarden:event_', hazard_type, '_', grid_id, '_', substr(sha1(concat('{{"grid_id": "', grid_id, '", "hazard_type": "', hazard_type,
      '", "model_name": "rule_screening_v1", "valid_time": "', CAST(valid_time AS STRING), '"}}')), 1, 12)) AS subject,
      hazard_type, CAST(valid_time AS STRING) AS valid_time FROM risks""",
)
def _(t):
    return risks_of(t).select(gr.event_uri().alias("subject"), "hazard_type", F.col("valid_time").cast("string").alias("valid_time")).distinct()


@query(
    "provenance_triples",
    ("points",),
    """WITH p AS (SELECT DISTINCT concat('provider ', CAST(slope_deg AS INT) % 3) AS provider, source_status FROM points)
    SELECT 'rdfs:label' AS predicate, provider AS object, count(*) AS n FROM p GROUP BY 2 UNION ALL SELECT 'source_status', source_status, count(*) FROM p GROUP BY 2
    UNION ALL SELECT 'rdf:type', 'ForecastSource', count(*) FROM p""",
)
def _(t):
    runs = t.points.select(F.concat(F.lit("provider "), (F.col("slope_deg").cast("int") % 3).cast("string")).alias("provider"), "source_status").distinct()
    base = F.lit(gr.Vocabulary().base)
    triples = gr.provenance_triples(runs).select("subject", F.replace("predicate", base, F.lit("")).alias("predicate"), F.replace("object", base, F.lit("")).alias("object"))
    return triples.filter("predicate <> 'provenancePayload'").groupBy("predicate", "object").agg(F.count("*").alias("n"))


@query(
    "grounding_triples",
    ("points",),
    """WITH g AS (SELECT DISTINCT grid_id, valid_time, CASE WHEN precip_24h_mm >= 50 THEN 'threshold_exceeded' ELSE 'available' END AS status, ROUND(precip_24h_mm) AS delta FROM points)
    SELECT 'comparisonStatus' AS predicate, status AS object, count(*) AS n FROM g GROUP BY 2 UNION ALL SELECT 'sourcePair', 'era5', count(*) FROM g UNION ALL SELECT 'sourcePair', 'imerg', count(*) FROM g
    UNION ALL SELECT 'units', 'mm', count(*) FROM g UNION ALL SELECT 'rdf:type', 'GroundingGap', count(*) FROM g""",
)
def _(t):
    gaps = t.points.select(
        "grid_id", "valid_time", F.lit("flash_flood").alias("hazard_type"), F.lit("rule_screening_v1").alias("model_name"), F.lit("precip_daily").alias("family"),
        F.when(F.col("precip_24h_mm") >= 50, "threshold_exceeded").otherwise("available").alias("status"), F.lit("mm").alias("units"),
        F.array(F.lit("era5"), F.lit("imerg")).alias("source_pair"), F.round("precip_24h_mm").alias("delta"),
    )
    base = F.lit(gr.Vocabulary().base)
    triples = gr.grounding_triples(gaps).select(F.replace("predicate", base, F.lit("")).alias("predicate"), F.replace("object", base, F.lit("")).alias("object"))
    return triples.filter(F.col("predicate").isin("comparisonStatus", "sourcePair", "units", "rdf:type")).groupBy("predicate", "object").agg(F.count("*").alias("n"))


def graph_of(t):
    """Rule triples and risk triples of the whole table in one graph; lookups read sets, so a triple may come again."""
    # predicates come before points are scored, so a lookup scores only what it may need
    risks = rk.scan_risks(gr.with_predicates(t.points), [*KEEP, "_f"])
    return gr.seed_triples(gr.rule_table(t.spark)).unionByName(gr.risk_statements(risks))


@query(
    "hazard_impacts",
    ("points",),
    f"""WITH {_rules_sql()} SELECT hazard_type, string_agg(CASE WHEN kind = 'exposures' THEN name END, ',' ORDER BY name) AS exposures,
      string_agg(CASE WHEN kind = 'actions' THEN name END, ',' ORDER BY name) AS actions, string_agg(CASE WHEN kind = 'departments' THEN name END, ',' ORDER BY name) AS departments FROM rules GROUP BY 1""",
)
def _(t):
    return gr.hazard_impacts(graph_of(t)).select("hazard_type", *[joined(c).alias(c) for c in ("exposures", "actions", "departments")])


@query(
    "graph_lookups",
    ("points",),
    f"""WITH {_rules_sql()}, d AS (SELECT DISTINCT hazard_type, name FROM rules WHERE kind = 'departments')
    SELECT 'action' AS kind, hazard_type AS key, name AS value FROM rules WHERE kind = 'actions'
    UNION ALL SELECT 'department', d.name, string_agg(DISTINCT r.name, ',' ORDER BY r.name) FROM d JOIN rules r ON r.hazard_type = d.hazard_type AND r.kind = 'warning_products' GROUP BY d.name
    UNION ALL SELECT 'exposure', name, string_agg(DISTINCT hazard_type, ',' ORDER BY hazard_type) FROM rules WHERE kind = 'exposures' GROUP BY name""",
)
def _(t):
    # one row per hazard kind: stored, as each lookup would read the whole graph again
    impacts = cut_lineage(gr.hazard_impacts(graph_of(t)), "impacts")
    actions = gr.actions_by_hazard(impacts).select(F.lit("action").alias("kind"), F.col("hazard_type").alias("key"), F.col("action").alias("value"))
    products = gr.products_by_department(impacts).select(F.lit("department").alias("kind"), F.col("department").alias("key"), joined("warning_products").alias("value"))
    exposures = gr.hazards_by_exposure(impacts).select(F.lit("exposure").alias("kind"), F.col("exposure").alias("key"), joined("hazards").alias("value"))
    return actions.unionByName(products).unionByName(exposures)


@query("validate_graph", ("points",), "SELECT 'HazardScenario' AS class_name, count(*) > 0 AS has_risks FROM points UNION ALL SELECT 'ExposureObject', count(*) > 0 FROM points UNION ALL SELECT 'ResponseAction', count(*) > 0 FROM points UNION ALL SELECT 'ServiceDepartment', count(*) > 0 FROM points")
def _(t):
    # one row per class: stored, as each of the two checks would read the whole graph again
    classes = cut_lineage(gr.risk_triples(risks_of(t), once=False).filter(F.col("predicate") == gr.TYPE).select("predicate", "object").distinct(), "classes")
    present = classes.filter(F.col("object").endswith("WarningProduct")).agg((F.count("*") > 0).alias("has_risks")).withColumn("_one", F.lit(1))
    return gr.validate_graph(classes).withColumn("_one", F.lit(1)).join(present, "_one").drop("_one")
