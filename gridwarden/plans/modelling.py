"""Training and scoring with Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwarden.constants import FEATURES, FEATURE_NAMES
from gridwarden.functions.basic import col, first_existing, lit
from gridwarden.operators.quality import in_range
from gridwarden.operators.risk import RULE_BOUNDS, feature_names, risk_level, risk_level_grid, standard_indicator_values, with_rule_scores
from gridwarden.session import cut_lineage, file_by_file
from gridwarden.operators.training import group_shuffle_split, sample_negatives, supervised_features

# A missing optional feature enters the trees as this value, outside every valid range.
MISSING = -9999.0

#: Training rows that a task holds at most: trees keep a row in memory at many times its size in the file.
TASK_ROWS = 1_000_000


@dataclass
class TrainedModel:
    """A fitted pipeline with what is needed to use and report it."""

    hazard: str
    pipeline: PipelineModel
    features: tuple[str, ...]
    binary: bool
    summary: dict

    def probability(self) -> Column:
        if self.binary:
            return vector_to_array("probability")[1]
        return F.greatest(lit(0.0), F.least(lit(1.0), F.col("prediction")))


def is_binary(df: DataFrame, target: str = "target") -> bool:
    """Whether all targets are 0 or 1 (one small aggregate)."""
    row = df.agg(F.bool_and(F.col(target).isin(0.0, 1.0)).alias("b")).first()
    return bool(row["b"])


def _filled(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: F.coalesce(col(n).cast("double"), lit(MISSING)) for n in names})


def train_hazard_model(
    df: DataFrame,
    hazard: str,
    group: str | None = None,
    fraction: float = 0.2,
    seed: int = 42,
    rounds: int = 100,
    depth: int = 5,
    step: float = 0.05,
    key: Sequence[str] = (),
) -> TrainedModel:
    """Boosted trees on prepared features with column ``target``.

    Groups, when given, go whole to training or validation; otherwise rows are split by a hash of
    ``key``. Boosting stops early when the validation error no longer falls. The prepared rows are stored
    in the shared folder first, as every round reads them.
    """
    names = feature_names(hazard)
    rows = _filled(df, names)
    if group:
        rows = group_shuffle_split(rows, group, fraction, seed)
    else:
        share = min(max(fraction, 0.05), 0.5)
        h = F.pmod(F.xxhash64(*[F.col(k) for k in (key or names)], F.lit(seed)), F.lit(10000))
        rows = rows.withColumn("is_validation", h < int(share * 10000))
    rows = cut_lineage(rows, "training-rows", maxRecordsPerFile=str(TASK_ROWS))
    with file_by_file(df.sparkSession):
        return _fitted(rows, hazard, names, "group_shuffle" if group else "row_hash", seed, rounds, depth, step)


def _fitted(rows: DataFrame, hazard: str, names: Sequence[str], split: str, seed: int, rounds: int, depth: int, step: float) -> TrainedModel:
    """Trees fitted to stored rows that say which of them validate."""
    binary = is_binary(rows)
    common = dict(featuresCol="features", labelCol="target", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed, validationIndicatorCol="is_validation", validationTol=0.001, subsamplingRate=0.9, featureSubsetStrategy="all")
    trees = GBTClassifier(**common) if binary else GBTRegressor(**common)
    from pyspark.ml import Pipeline

    pipeline = Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="features"), trees]).fit(rows)
    counts = rows.groupBy("is_validation").count().collect()
    sizes = {bool(r["is_validation"]): r["count"] for r in counts}
    model = TrainedModel(hazard, pipeline, names, binary, {})
    model.summary = {
        "hazard_type": hazard,
        "objective": "binary" if binary else "regression",
        "best_iteration": pipeline.stages[-1].getNumTrees,
        "train_rows": sizes.get(False, 0),
        "validation_rows": sizes.get(True, 0),
        "split_strategy": split,
    }
    held = rows.filter("is_validation")
    metric, value = evaluate_model(model, held) if sizes.get(True) else (None, None)
    model.summary |= {"metric": metric, "validation_metric": value}
    return model


def evaluate_model(model: TrainedModel, df: DataFrame) -> tuple[str, float]:
    """Log loss of a classifier, root mean square error of a regressor."""
    scored = model.pipeline.transform(_filled(df, model.features).drop("features"))
    if model.binary:
        return "binary_logloss", MulticlassClassificationEvaluator(labelCol="target", metricName="logLoss").evaluate(scored)
    return "rmse", RegressionEvaluator(labelCol="target", metricName="rmse").evaluate(scored)


def _model_inputs(df: DataFrame, hazard: str) -> tuple[dict[str, Column], Column]:
    """Canonical features of a hazard and whether all required ones are present in the row."""
    values = standard_indicator_values(df)
    required, optional, _ = FEATURES[hazard]
    inputs = {n: values[n] if n in values else F.lit(None).cast("double") for n in required + optional}
    complete = F.lit(True)
    for n in required:
        complete = complete & inputs[n].isNotNull()
    return inputs, complete


def score_with_model(df: DataFrame, hazard: str, model: TrainedModel | None, keep: Sequence[str], bounds: Sequence[float] = RULE_BOUNDS) -> DataFrame:
    """Model probability where the feature vector is complete, else the rule with the reason it was used.

    All rows take one pass; incomplete ones are scored too and their score is discarded, which is cheaper
    than splitting and joining the table.
    """
    inputs, complete = _model_inputs(df, hazard)
    rows = with_rule_scores(df, [hazard], bounds).select(*keep, F.col(f"_risk_{hazard}").alias("_rule"), complete.alias("_ok"), *[F.coalesce(c, lit(MISSING)).alias(n) for n, c in inputs.items() if n not in keep])
    if model is None:
        usable, p, reason = F.lit(False), F.col("_rule.risk_probability"), F.lit("missing_model_file")
    else:
        rows = model.pipeline.transform(rows)
        usable, p = F.col("_ok"), F.when(F.col("_ok"), model.probability()).otherwise(F.col("_rule.risk_probability"))
        reason = F.when(~F.col("_ok"), "incomplete_ml_features")
    status = F.lit("degraded") if model is None else F.col("_rule.source_status")
    return rows.select(
        *keep,
        F.lit(hazard).alias("hazard_type"),
        p.alias("risk_probability"),
        risk_level(p, bounds).alias("risk_level"),
        F.col("_rule.contributing_factors").alias("contributing_factors"),
        F.lit("gradient_boosting").alias("model_family"),
        F.when(usable, "gradient_boosting").otherwise("degraded_rule_fallback").alias("inference_mode"),
        status.alias("source_status"),
        reason.alias("fallback_reason"),
    )


# Output names of the model fields.
FIELD_NAMES = {"extreme_heat": "ExtremeHeat_Risk", "dry_heat_agriculture": "DryHeatStress_Risk", "flash_flood": "FlashFlood_Risk"}


def predict_risk_fields(df: DataFrame, models: Mapping[str, TrainedModel], keep: Sequence[str]) -> tuple[DataFrame, list[dict]]:
    """Probability and level columns per hazard; hazards whose inputs are absent are listed, not scored."""
    out, skipped = df, []
    for hazard, model in models.items():
        required, optional, _ = FEATURES[hazard]
        sources = {n: first_existing(df.columns, FEATURE_NAMES.get(n, (n,))) for n in required + optional}
        missing = [n for n in required if sources[n] is None]
        if missing:
            skipped.append({"hazard_type": hazard, "reason": f"missing features: {missing}"})
            continue
        values = {n: in_range(s, n) if s else lit(MISSING) for n, s in sources.items()}
        complete = F.lit(True)
        for n in required:
            complete = complete & values[n].isNotNull()
        before = out.columns
        vector = {f"_in_{n}": F.coalesce(v, lit(MISSING)) for n, v in values.items()}
        rows = out.withColumns({**vector, "_ok": complete})
        assembler = VectorAssembler(inputCols=list(vector), outputCol="features")
        scored = model.pipeline.stages[-1].transform(assembler.transform(rows))
        name = FIELD_NAMES.get(hazard, hazard)
        p = F.when(F.col("_ok"), model.probability())
        out = scored.select(*before, p.alias(f"{name}_Prob"), risk_level_grid(p).alias(f"{name}_Level"))
    fields = [c for c in out.columns if c not in df.columns]
    return out.select(*keep, *fields), skipped


def fit_linear(df: DataFrame, features: Sequence[str], target: str, ridge: float = 0.0):
    """Least-squares model on assembled columns; returns the fitted Spark ML model."""
    rows = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)
    return LinearRegression(featuresCol="features", labelCol=target, regParam=ridge, solver="normal").fit(rows)


def explain_top_features(df: DataFrame, coefficients: Mapping[str, float], keep: Sequence[str], k: int = 3) -> DataFrame:
    """The k largest contributions (coefficient times value) per row with their direction."""
    parts = F.array(
        *[F.struct(F.abs(col(n) * c).alias("size"), F.lit(n).alias("feature"), (col(n) * c).alias("contribution")) for n, c in coefficients.items()]
    )
    best = F.slice(F.sort_array(F.filter(parts, lambda p: p["size"].isNotNull()), asc=False), 1, k)
    item = F.transform(
        best,
        lambda p: F.struct(p["feature"].alias("feature"), p["contribution"].alias("contribution"), F.when(p["contribution"] >= 0, "raises").otherwise("lowers").alias("direction")),
    )
    return df.select(*keep, item.alias("top_features"))


def tree_importances(model: TrainedModel) -> dict[str, float]:
    """Global importances of a tree model."""
    return dict(zip(model.features, (float(v) for v in model.pipeline.stages[-1].featureImportances)))


# Corners used to normalize coordinates in the calibration basis.
LAT_START, LAT_END, LON_START, LON_END = 31.9, 16.0, 34.0, 55.9
BASIS = ("lead_days", "lead_days2", "sin_hour", "cos_hour", "sin_season", "cos_season", "lat_norm", "lon_norm", "lat_lon")


def calibration_basis(df: DataFrame, base_time: Column) -> DataFrame:
    """Lead, daily and seasonal cycle, and position terms of each row."""
    stamp, base = F.col("time").cast("timestamp"), base_time.cast("timestamp")
    lead = F.greatest(F.lit(0), F.bround((F.unix_timestamp(stamp) - F.unix_timestamp(base)) / 3600.0, 0)) / 24.0
    two_pi = 2.0 * 3.141592653589793
    hour, season = F.hour(stamp) + F.minute(stamp) / 60.0, F.dayofyear(stamp) / 365.25
    lat, lon = (LAT_START - F.col("latitude")) / (LAT_START - LAT_END), (F.col("longitude") - LON_START) / (LON_END - LON_START)
    return df.withColumns(
        {
            "lead_days": lead.cast("double"),
            "lead_days2": (lead * lead).cast("double"),
            "sin_hour": F.sin(two_pi * hour / 24.0),
            "cos_hour": F.cos(two_pi * hour / 24.0),
            "sin_season": F.sin(two_pi * season),
            "cos_season": F.cos(two_pi * season),
            "lat_norm": lat,
            "lon_norm": lon,
            "lat_lon": lat * lon,
        }
    )


def fit_linear_calibration(df: DataFrame, variable: str, sample_step: int = 1) -> dict:
    """Least squares of a variable on the calibration basis; coefficients, error and sample count.

    ``sample_step`` n keeps every n-th time and every n-th grid line of a 0.1-degree grid.
    """
    start = df.agg(F.min("time").alias("t"), F.min("latitude").alias("a"), F.min("longitude").alias("b")).first()
    rows = df
    if sample_step > 1:

        def nth(value: str, origin: float) -> Column:
            return F.pmod(F.round((F.col(value) - origin) * 10.0).cast("long"), F.lit(sample_step)) == 0

        hours = F.floor((F.unix_timestamp(F.col("time").cast("timestamp")) - F.unix_timestamp(F.lit(start["t"]).cast("timestamp"))) / 3600)
        rows = rows.filter(nth("latitude", start["a"]) & nth("longitude", start["b"]) & (F.pmod(hours, F.lit(sample_step)) == 0))
    model = fit_linear(calibration_basis(rows, F.lit(start["t"])), BASIS, variable)
    return {
        "variable": variable,
        "intercept": float(model.intercept),
        "coefficients": dict(zip(BASIS, (float(c) for c in model.coefficients))),
        "rmse": float(model.summary.rootMeanSquaredError),
        "sample_count": int(model.summary.numInstances),
    }


def compare_variants(tables: Mapping[str, DataFrame], sizes: Sequence[int | None], keys: Sequence[str], hazard: str = "extreme_heat", **options) -> DataFrame:
    """Train one model per (table, negatives) variant and rank by validation error.

    ``tables`` maps a variant name to its un-sampled labeled table, shared by all its sample sizes. The
    loop is over a handful of models; each of them trains on the cluster.
    """
    rows = []
    for name, table in tables.items():
        shared = cut_lineage(table, "variant")
        for n in sizes:
            sample = supervised_features(sample_negatives(shared, keys, n), hazard, keep=list(keys))
            model = train_hazard_model(sample, hazard, key=keys, **options)
            s = model.summary
            rows.append((f"{name}_{'balanced' if n is None else f'neg{n}'}", s["train_rows"], s["validation_rows"], s["validation_metric"], s["best_iteration"]))
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame(rows, "variant string, train_rows long, validation_rows long, validation_metric double, best_iteration int")
    return out.orderBy(F.col("validation_metric").asc_nulls_last(), "variant")
