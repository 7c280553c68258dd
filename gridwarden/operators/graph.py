"""Hazard knowledge as a three-column triple table, and lookups on it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwarden.constants import RESPONSE_RULES


@dataclass(frozen=True)
class Vocabulary:
    """Name prefixes of the triples."""

    base: str = "urn:gridwarden:"
    event: str = "urn:gridwarden:event:"
    feature: str = "http://www.opengis.net/ont/geosparql#Feature"


TYPE, LABEL = "rdf:type", "rdfs:label"
CLASSES = ("MeteorologicalIndicator", "HazardScenario", "ExposureObject", "ServiceDepartment", "WarningProduct", "ResponseAction")
REQUIRED_CLASSES = ("HazardScenario", "ExposureObject", "ResponseAction", "ServiceDepartment")
# Predicate and class of each kind of rule entry.
RULE_LINKS = {
    "exposures": ("affectsExposure", "ExposureObject"),
    "actions": ("requiresAction", "ResponseAction"),
    "departments": ("servedByDepartment", "ServiceDepartment"),
    "warning_products": ("hasWarningProduct", "WarningProduct"),
}


def _t(s: Column, p: Column | str, o: Column | str) -> Column:
    p, o = (F.lit(v) if isinstance(v, str) else v for v in (p, o))
    return F.struct(s.alias("subject"), p.alias("predicate"), o.alias("object"))


def _open(df: DataFrame, *parts: Column) -> DataFrame:
    """Open arrays of triple structs to distinct rows.

    The outer form keeps the optimizer from inferring a not-empty filter, which would copy the whole
    triple expression below every projection under it.
    """
    return df.select(F.explode_outer(F.concat(*parts)).alias("_t")).select("_t.*").filter(F.col("object").isNotNull()).distinct()


def clean_name(value: Column) -> Column:
    """Letters, digits and underscores; anything else becomes one underscore."""
    name = F.btrim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("unknown")), "[^A-Za-z0-9_]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown"))


def with_cells(df: DataFrame) -> DataFrame:
    """Add ``_cell``, the clean name of the grid id: made on rows that are opened later, it is made once for all of their risks."""
    return df.withColumn("_cell", clean_name(F.col("grid_id")))


def digest(value: Column) -> Column:
    return F.substring(F.sha1(value), 1, 12)


def rule_table(spark: SparkSession, rules: Mapping[str, Mapping] = RESPONSE_RULES) -> DataFrame:
    """The rule set as (hazard_type, label, kind, name): a short configuration table."""
    rows = [(h, r["label"], kind, n) for h, r in rules.items() for kind in RULE_LINKS for n in r.get(kind, [])]
    return spark.createDataFrame(rows, "hazard_type string, label string, kind string, name string")


def seed_triples(rules: DataFrame, v: Vocabulary = Vocabulary()) -> DataFrame:
    """Triples that link hazards to exposures, actions, departments and products."""
    b = F.lit(v.base)
    hazard, name = F.concat(b, F.col("hazard_type")), F.concat(b, F.col("name"))
    predicate, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for key, (link, cls) in RULE_LINKS.items():
        predicate = F.when(F.col("kind") == key, v.base + link).otherwise(predicate)
        kind = F.when(F.col("kind") == key, v.base + cls).otherwise(kind)
    classes = F.array(*[_t(F.lit(v.base + c), TYPE, "owl:Class") for c in CLASSES])
    links = F.array(_t(hazard, TYPE, v.base + "HazardScenario"), _t(hazard, LABEL, F.col("label")), _t(hazard, predicate, name), _t(name, TYPE, kind))
    return _open(rules, links, classes)


def event_uri(v: Vocabulary = Vocabulary(), cell: Column | None = None) -> Column:
    """Stable identity of a risk from hazard, cell, time and model; ``cell`` is the clean name of the grid id, if at hand."""
    cell = clean_name(F.col("grid_id")) if cell is None else cell
    key = F.concat(
        F.lit('{"grid_id": "'), cell, F.lit('", "hazard_type": "'), F.col("hazard_type"), F.lit('", "model_name": "'), F.col("model_name"),
        F.lit('", "valid_time": "'), F.col("valid_time").cast("string"), F.lit('"}'),
    )
    return F.concat(F.lit(v.base + "event_"), clean_name(F.col("hazard_type")), F.lit("_"), cell, F.lit("_"), digest(key))


def _numbered(rows: DataFrame, predicates: Sequence[str]) -> DataFrame:
    """Rows once per predicate, with its number and name in ``_f``."""
    return rows.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("number"), F.lit(p).alias("predicate")) for i, p in enumerate(predicates)])).alias("_f"))


def _say(rows: DataFrame, forms: Sequence[tuple[Column, str, Column | str]], *each: Column, by: Sequence[str] = ()) -> DataFrame:
    """Triples of the rows, one per form (subject, predicate, object) and entry of the generator ``each``, beside the columns ``by``.

    The predicate comes first, as a plain list opened per row (or has come already, if there is ``_f``): a filter on it acts
    before any entry is opened or any subject or object is made.
    """

    def chosen(k: int) -> Column:
        value, places = F.lit(None).cast("string"), {}
        for i, form in enumerate(forms):
            places.setdefault(form[k] if isinstance(form[k], str) else id(form[k]), []).append(i)
        for same in places.values():
            own = forms[same[0]][k]
            value = F.when(F.col("_f.number").isin(same), F.lit(own) if isinstance(own, str) else own).otherwise(value)
        return value

    spread = rows if "_f" in rows.columns else _numbered(rows, [p for _, p, _ in forms])
    for generator in each:
        spread = spread.select("*", generator)
    out = spread.select(*by, chosen(0).alias("subject"), F.col("_f.predicate").alias("predicate"), chosen(2).alias("object"))
    return out.filter(F.col("object").isNotNull())


# Predicates and columns of what an event tells of its risk.
EVENT_COLUMNS = {"riskLevel": "risk_level", "modelFamily": "model_family", "modelName": "model_name", "modelVersion": "model_version", "inferenceMode": "inference_mode", "sourceStatus": "source_status"}


@dataclass(frozen=True)
class _Names:
    """Names of a risk and its parts, from columns of its row; ``cell`` is the clean name of the grid id, ``i`` and ``x`` are place and text
    of a factor, ``k`` is the name of an indicator, ``c`` the clean name of either."""

    v: Vocabulary
    cell: Column
    i: Column
    x: Column
    c: Column
    k: Column

    def own(self, name: str) -> str:
        return self.v.base + name

    @property
    def hazard(self) -> Column:
        return F.concat(F.lit(self.v.base), F.col("hazard_type"))

    @property
    def risk(self) -> Column:
        return F.concat(F.lit(self.own("risk_")), F.col("hazard_type"), F.lit("_"), F.col("grid_id"))

    @property
    def event(self) -> Column:
        return event_uri(self.v, self.cell)

    @property
    def location(self) -> Column:
        return F.concat(F.lit(self.own("location_")), self.cell)

    @property
    def cause(self) -> Column:
        return F.concat(F.lit(self.own("indicator_")), digest(F.concat_ws("|", F.col("hazard_type"), self.x)))

    @property
    def node(self) -> Column:
        return F.concat(F.lit(self.own("indicator_")), F.col("hazard_type"), F.lit("_"), self.k)

    @property
    def factor(self) -> Column:
        return F.concat(self.event, F.lit("/factor/"), self.i.cast("string"), F.lit("_"), self.c)

    @property
    def measured(self) -> Column:
        return F.concat(self.event, F.lit("/indicator/"), self.c)


def _triple(rows: DataFrame, s: Column, p: str, o: Column | str) -> DataFrame:
    return rows.select(_t(s, p, o).alias("_t")).select("_t.*")


def _values(rows: DataFrame, subject: str, values: Mapping[str, Column]) -> DataFrame:
    """Triples (subject, predicate, value) of rows.

    The predicates are a table of constants, so a filter on them is settled before anything runs: a filter that leaves none
    leaves nothing to be read.
    """
    quoted = [p.replace("\\", "\\\\").replace("'", "\\'") for p in values]
    listed = ", ".join(f"({i}, '{p}')" for i, p in enumerate(quoted))
    forms = rows.sparkSession.sql(f"SELECT * FROM VALUES {listed} AS forms(_f, predicate)")
    object_ = F.lit(None).cast("string")
    for i, value in enumerate(values.values()):
        object_ = F.when(F.col("_f") == i, value).otherwise(object_)
    out = rows.crossJoin(F.broadcast(forms)).select(subject, "predicate", object_.alias("object")).filter(F.col("object").isNotNull())
    return out.withColumnRenamed(subject, "subject")


def risk_triples(risks: DataFrame, v: Vocabulary = Vocabulary(), once: bool = True) -> DataFrame:
    """Event, location, indicator and factor triples of a long risk table, each once; without ``once`` nothing is shuffled and a triple may come again.

    Needs grid_id, latitude, longitude and valid_time next to the risk columns; takes ``_cell`` of ``with_cells`` if it is there.

    Each kind of triple is a branch of its own that names its predicate as a constant, so a filter on predicates (or on constant objects) takes
    whole branches away before anything is read. What tells a branch's triples apart are a few short columns: only those are shuffled, they are
    made distinct, and names are made of what is left. Rows are dealt by place (and time), so hazards of a point lie side by side when they are compressed.
    """
    rows = risks if "_cell" in risks.columns else with_cells(risks)
    rows = rows.withColumn("valid_time", F.col("valid_time").cast("string"))
    n = _Names(v, F.col("_cell"), F.col("_i"), F.col("_x"), F.col("_c"), F.col("_k"))
    key = ["hazard_type", "_cell", "model_name", "valid_time"]
    # the outer form keeps the optimizer from inferring a not-empty filter, which would make every list of factors three times
    factors = rows.select("*", F.posexplode_outer("contributing_factors").alias("_i", "_x")).filter("_i IS NOT NULL").withColumn("_c", clean_name(F.col("_x")))
    # few different lists: they are made distinct before they are opened
    causes = rows.select("hazard_type", "contributing_factors").distinct()
    causes = causes.select("hazard_type", F.posexplode_outer("contributing_factors").alias("_i", "_x")).filter("_i IS NOT NULL")
    measures = rows.select("*", F.explode("indicator_evidence").alias("_k", "_v")).withColumns({"_c": clean_name(F.col("_k")), "_v": F.col("_v").cast("string")})

    def distinct(df: DataFrame) -> DataFrame:
        return df.distinct() if once else df

    def dealt(df: DataFrame, *by: str) -> DataFrame:
        # a fixed number, which adaptive execution leaves alone: in memory, distinct rows are many times larger than these compressed ones
        return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by) if once else df

    def values(df: DataFrame, subject: str, columns: Mapping[str, Column]) -> DataFrame:
        return distinct(_values(dealt(df, subject), subject, columns))

    def apart(df: DataFrame, columns: Sequence[str], *by: str) -> DataFrame:
        df = df.select(*columns)
        return distinct(dealt(df, *by) if by else df)

    def at_events(df: DataFrame, *more: str) -> DataFrame:
        return apart(df, [*key, *more], "_cell", "model_name", "valid_time")

    named = F.col("hazard_type").isNotNull() & F.col("model_name").isNotNull() & F.col("valid_time").isNotNull()
    about_risks = rows.select(n.risk.alias("_r"), "hazard_type", "risk_level")
    about_events = rows.select(n.event.alias("_e"), "_cell", "valid_time", "risk_probability", *EVENT_COLUMNS.values())
    about_places = rows.select(n.location.alias("_l"), "latitude", "longitude")
    event_values = {v.event + "startDate": F.col("valid_time"), n.own("riskProbability"): F.format_string("%.6f", F.col("risk_probability"))}
    event_values |= {n.own(p): F.col(c) for p, c in EVENT_COLUMNS.items()} | {v.event + "hasLocation": n.location}
    branches = [
        _triple(apart(rows, ["hazard_type", "grid_id"], "grid_id"), n.risk, TYPE, n.own("WarningProduct")),
        values(about_risks, "_r", {n.own("warnsAbout"): n.hazard, n.own("hasRiskLevel"): F.col("risk_level")}),
        _triple(apart(factors, ["hazard_type", "grid_id", "_x"], "grid_id"), n.risk, n.own("hasContributingFactor"), n.cause),
        _triple(apart(measures, ["hazard_type", "grid_id", "_k"], "grid_id").filter("hazard_type IS NOT NULL"), n.risk, n.own("hasIndicatorEvidence"), n.node),
        _triple(at_events(rows), n.event, TYPE, v.event + "DisasterEvent"),
        values(about_events, "_e", event_values),
        _triple(at_events(factors, "_i", "_c"), n.factor, TYPE, n.own("ModelExplanationFactor")),
        _triple(at_events(factors, "_i", "_c", "_x").filter("_x IS NOT NULL"), n.factor, LABEL, n.x),
        _triple(at_events(factors, "_i", "_c").filter(named), n.event, n.own("hasModelExplanationFactor"), n.factor),
        _triple(at_events(measures, "_c").filter(named), n.event, v.event + "hasClimateParameterMeasurement", n.measured),
        _triple(at_events(measures, "_c", "_v").filter("_v IS NOT NULL"), n.measured, v.event + "hasValue", F.col("_v")),
        _triple(apart(rows, ["_cell"]), n.location, TYPE, v.event + "Location"),
        _triple(apart(rows, ["_cell"]), n.location, TYPE, v.feature),
        _triple(apart(rows, ["_cell", "grid_id"]).filter("grid_id IS NOT NULL"), n.location, LABEL, F.col("grid_id")),
        values(distinct(about_places), "_l", {n.own(c): F.col(c).cast("string") for c in ("latitude", "longitude")}),
        _triple(apart(causes, ["hazard_type", "_x"]), n.cause, TYPE, n.own("MeteorologicalIndicator")),
        _triple(apart(causes, ["hazard_type", "_x"]).filter("_x IS NOT NULL"), n.cause, LABEL, n.x),
        _triple(apart(measures, ["hazard_type", "_k"]), n.node, TYPE, n.own("MeteorologicalIndicator")),
        _triple(apart(measures, ["hazard_type", "_k"]), n.node, LABEL, n.k),
        _triple(apart(measures, ["hazard_type", "_k", "_v"]).filter("_v IS NOT NULL"), n.node, n.own("hasIndicatorValue"), F.col("_v")),
    ]
    out = branches[0]
    for branch in branches[1:]:
        out = out.unionByName(branch)
    return out


def with_predicates(df: DataFrame, v: Vocabulary = Vocabulary()) -> DataFrame:
    """Rows once per predicate of ``risk_statements``, for rows that are scored and opened afterwards: a filter on predicates acts before that.

    The coalesce keeps every part as it is. It ends the generated stage, which is compiled without the scores: together they are too
    large to be, and each row would be opened by an interpreter.
    """
    return _numbered(df, [p for _, p, _ in _statement_forms(v)[0]]).coalesce(2**31 - 1)


def risk_statements(risks: DataFrame, v: Vocabulary = Vocabulary()) -> DataFrame:
    """The triples of ``risk_triples`` from a projection alone, where it does not matter how often one comes; one scan of the risks makes all.

    Takes the predicates of ``with_predicates`` if the risks have them.
    """
    forms, entries = _statement_forms(v)
    return _say(risks, forms, F.posexplode(entries).alias("_i", "_x"))


def _statement_forms(v: Vocabulary) -> tuple[list[tuple[Column, str, Column | str]], Column]:
    """All forms of triples, and the entries of form ``_f``: factors, names of measured indicators, or one that is nothing."""
    n = _Names(v, clean_name(F.col("grid_id")), F.col("_i"), F.col("_x"), clean_name(F.col("_x")), F.col("_x"))
    e, r, loc, cause, node, factor, measured = n.event, n.risk, n.location, n.cause, n.node, n.factor, n.measured
    value = F.col("indicator_evidence")[F.col("_x")].cast("string")
    plain = [
        (r, TYPE, n.own("WarningProduct")),
        (r, n.own("warnsAbout"), n.hazard),
        (r, n.own("hasRiskLevel"), F.col("risk_level")),
        (e, TYPE, v.event + "DisasterEvent"),
        (e, v.event + "startDate", F.col("valid_time").cast("string")),
        (e, n.own("riskProbability"), F.format_string("%.6f", F.col("risk_probability"))),
        *[(e, n.own(p), F.col(c)) for p, c in EVENT_COLUMNS.items()],
        (e, v.event + "hasLocation", loc),
        (loc, TYPE, v.event + "Location"),
        (loc, TYPE, v.feature),
        (loc, LABEL, F.col("grid_id")),
        (loc, n.own("latitude"), F.col("latitude").cast("string")),
        (loc, n.own("longitude"), F.col("longitude").cast("string")),
    ]
    of_factors = [
        (r, n.own("hasContributingFactor"), cause),
        (factor, TYPE, n.own("ModelExplanationFactor")),
        (factor, LABEL, n.x),
        (e, n.own("hasModelExplanationFactor"), factor),
        (cause, TYPE, n.own("MeteorologicalIndicator")),
        (cause, LABEL, n.x),
    ]
    of_measures = [
        (r, n.own("hasIndicatorEvidence"), node),
        (e, v.event + "hasClimateParameterMeasurement", measured),
        (measured, v.event + "hasValue", value),
        (node, TYPE, n.own("MeteorologicalIndicator")),
        (node, LABEL, n.k),
        (node, n.own("hasIndicatorValue"), value),
    ]
    number, first, second = F.col("_f.number"), len(plain), len(plain) + len(of_factors)
    entries = F.when(number < first, F.array(F.lit(None).cast("string"))).when(number < second, F.col("contributing_factors"))
    return [*plain, *of_factors, *of_measures], entries.otherwise(F.map_keys("indicator_evidence"))


def provenance_triples(runs: DataFrame, v: Vocabulary = Vocabulary()) -> DataFrame:
    """Forecast-source triples of rows with a provider; other present columns become properties."""
    names = [c for c in ("provider_role", "provider_status", "source_status", "forecast_model", "model_version") if c in runs.columns]
    payload = F.to_json(F.struct("provider", *names))
    node = F.concat(F.lit(v.base + "forecast_source_"), clean_name(F.col("provider")), F.lit("_"), digest(payload))
    rows = runs.filter(F.col("provider").isNotNull()).withColumns({"_n": node, "_p": payload})
    n = F.col("_n")
    items = [_t(n, TYPE, v.base + "ForecastSource"), _t(n, LABEL, F.col("provider").cast("string")), _t(n, v.base + "provenancePayload", F.col("_p"))]
    items += [_t(n, v.base + c, F.col(c).cast("string")) for c in names]
    return _open(rows, F.array(*items))


def grounding_triples(gaps: DataFrame, v: Vocabulary = Vocabulary()) -> DataFrame:
    """Triples of source comparisons. ``gaps`` holds an event's columns plus family, status, units, source_pair, delta."""
    payload = F.to_json(F.struct("family", "status", "units", "source_pair", "delta"))
    rows = gaps.withColumns({"_e": event_uri(v), "_p": payload})
    rows = rows.withColumn("_n", F.concat("_e", F.lit("/grounding/"), clean_name(F.col("family")), F.lit("_"), digest(F.col("_p"))))
    rows = rows.select("_n", "_e", "_p", *[F.col(c).cast("string").alias(c) for c in ("family", "status", "units", "delta")], "source_pair")
    # rows of a gap are brought together before they are opened, and triples are made distinct in place
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_n")
    n = F.col("_n")
    forms = [
        (n, TYPE, v.base + "GroundingGap"),
        (n, LABEL, F.col("family")),
        (n, v.base + "groundingPayload", F.col("_p")),
        (F.col("_e"), v.base + "hasGroundingGap", n),
        (n, v.base + "comparisonStatus", F.col("status")),
        (n, v.base + "units", F.col("units")),
        (n, v.base + "delta", F.col("delta")),
        (n, v.base + "sourcePair", F.col("_s")),
    ]
    sources = F.when(F.col("_f.number") == len(forms) - 1, F.col("source_pair")).otherwise(F.array(F.lit(None).cast("string")))
    return _say(rows, forms, F.explode(sources).alias("_s"), by=["_n"]).distinct().select("subject", "predicate", "object")


def _names(kind: str) -> Column:
    return F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("name"))))


def hazard_impacts(triples: DataFrame, v: Vocabulary = Vocabulary()) -> DataFrame:
    """Exposures, actions, departments and products per hazard, read back from triples."""
    kind = F.lit(None).cast("string")
    for key, (link, _) in RULE_LINKS.items():
        kind = F.when(F.col("predicate") == v.base + link, key).otherwise(kind)
    rows = triples.withColumns({"kind": kind, "name": F.replace("object", F.lit(v.base), F.lit(""))}).filter(F.col("kind").isNotNull())
    out = rows.groupBy(F.replace("subject", F.lit(v.base), F.lit("")).alias("hazard_type"))
    return out.agg(*[_names(k).alias(k) for k in RULE_LINKS])


def actions_by_hazard(impacts: DataFrame) -> DataFrame:
    return impacts.select("hazard_type", F.explode("actions").alias("action"))


def products_by_department(impacts: DataFrame) -> DataFrame:
    """Hazards served and products of each department."""
    rows = impacts.select(F.explode("departments").alias("department"), "hazard_type", F.explode_outer("warning_products").alias("product"))
    return rows.groupBy("department").agg(
        F.sort_array(F.collect_set("hazard_type")).alias("hazards"), F.sort_array(F.collect_set("product")).alias("warning_products")
    )


def hazards_by_exposure(impacts: DataFrame) -> DataFrame:
    rows = impacts.select(F.explode("exposures").alias("exposure"), "hazard_type")
    return rows.groupBy("exposure").agg(F.sort_array(F.collect_set("hazard_type")).alias("hazards"))


def semantic_evidence(risks: DataFrame, impacts: DataFrame, v: Vocabulary = Vocabulary()) -> DataFrame:
    """Risk rows with what they affect. The impact table has one row per hazard kind, so it is broadcast."""
    out = risks.join(F.broadcast(impacts), "hazard_type", "left")
    return out.withColumns({"event_uri": event_uri(v), "risk_probability": F.round("risk_probability", 6)})


def validate_graph(triples: DataFrame, required: Sequence[str] = REQUIRED_CLASSES, v: Vocabulary = Vocabulary()) -> DataFrame:
    """Required classes without any instance."""
    wanted = triples.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in required])).alias("class_name"))
    present = triples.filter(F.col("predicate") == TYPE).select(F.replace("object", F.lit(v.base), F.lit("")).alias("class_name")).distinct()
    return wanted.join(present, "class_name", "left_anti")


def ntriples_lines(triples: DataFrame) -> DataFrame:
    """One text line per triple: names in angle brackets, other objects quoted."""

    def term(c: str) -> Column:
        value = F.col(c)
        is_name = value.startswith("urn:") | value.startswith("http") | value.startswith("rdf:") | value.startswith("rdfs:") | value.startswith("owl:")
        quoted = F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        return F.when(is_name, F.concat(F.lit("<"), value, F.lit(">"))).otherwise(quoted)

    return triples.select(F.concat_ws(" ", term("subject"), term("predicate"), term("object"), F.lit(".")).alias("value"))
