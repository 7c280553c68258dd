"""Supervised training tables: joins, alignment, sampling, feature preparation, grouped splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwarden.constants import FEATURE_NAMES, FEATURES, SUPERVISION
from gridwarden.functions import physical as ph
from gridwarden.functions.basic import check, clip, col, date_of, first_existing, lit, text, usable
from gridwarden.functions.text import dust_region, province_alias
from gridwarden.operators.features import region_season_aggregate, season_keys
from gridwarden.operators.labels import LABEL_COLUMNS, LOCATION_COLUMNS, PROVINCE_COLUMNS
from gridwarden.operators.ordering import hash_bin, running_bins
from gridwarden.operators.quality import in_range, require_daily, usable_in_range

JOIN_KEYS = ("_k1", "_k2", "_k3")


def _hazard_is(df: DataFrame, hazard: str) -> DataFrame:
    if "hazard_type" not in df.columns:
        return df
    return df.filter(F.regexp_replace(F.lower(F.trim("hazard_type")), "[ -]", "_") == hazard)


def _join_keys(features: DataFrame, labels: DataFrame, names: Sequence[str], canonical, digits: int):
    """Add equal string keys to both tables: grid day if both have coordinates, else the first shared name column."""

    def day() -> Column:
        d = date_of("date")
        return check(d.isNotNull(), d, "table contains invalid 'date' values").cast("string")

    def grid(c: str) -> Column:
        return F.bround(F.col(c).try_cast("double"), digits).cast("string")

    both = set(features.columns) & set(labels.columns)
    if {"latitude", "longitude"} <= both:
        keys = {"_k1": day(), "_k2": grid("latitude"), "_k3": grid("longitude")}
        return features.withColumns(keys), labels.withColumns(keys), "grid_day"
    shared = first_existing([c for c in names if c in both], names)
    if shared is None:
        raise KeyError(f"join needs shared coordinates or one of {tuple(names)}")
    keys = {"_k1": day(), "_k2": canonical(shared), "_k3": F.lit("")}
    return features.withColumns(keys), labels.withColumns(keys), shared


def _supervised_join(features, labels, hazard, names, canonical, prefix, drop_uncertain, digits, order, need_name) -> DataFrame:
    missing = [c for c in LABEL_COLUMNS if c not in labels.columns]
    if missing:
        raise KeyError(f"label table is missing columns: {missing}")
    left, right, mode = _join_keys(_hazard_is(features, hazard), _hazard_is(labels, hazard), names, canonical, digits)
    if mode != "grid_day" and need_name:
        left, right = left.filter(F.col("_k2") != ""), right.filter(F.col("_k2") != "")
    seq = F.col(order) if order else F.struct(*LABEL_COLUMNS)
    last = right.groupBy(*JOIN_KEYS).agg(F.max_by(F.struct(*LABEL_COLUMNS), seq).alias("_l"))
    out = left.drop(*[c for c in (*LABEL_COLUMNS, "hazard_type") if c in left.columns]).join(last, list(JOIN_KEYS), "left")
    parts = JOIN_KEYS if mode == "grid_day" else JOIN_KEYS[:2]
    out = out.select(
        *[c for c in features.columns if c not in (*LABEL_COLUMNS, "hazard_type")],
        *[F.col(f"_l.{c}").alias(c) for c in LABEL_COLUMNS],
        F.lit(hazard).alias("hazard_type"),
        F.lit(mode if mode == "grid_day" else f"{prefix}:{mode}").alias("training_join_mode"),
        F.concat_ws("|", *parts).alias("training_join_key"),
    )
    if drop_uncertain:
        return out.filter(F.col("label_status").isin("positive", "negative")).withColumn("is_labeled", F.lit(True))
    return out.withColumn("is_labeled", F.col("label").isNotNull())


def supervised_join_flash_flood(
    features: DataFrame, labels: DataFrame, drop_uncertain: bool = True, digits: int = 4, order: str | None = None
) -> DataFrame:
    """Features with the last label per key (``order`` says which is last); uncertain rows dropped."""
    return _supervised_join(features, labels, "flash_flood", PROVINCE_COLUMNS, province_alias, "province_day", drop_uncertain, digits, order, False)


def supervised_join_dust(
    features: DataFrame, labels: DataFrame, drop_uncertain: bool = True, digits: int = 4, order: str | None = None
) -> DataFrame:
    """As the flash-flood join, on region text; rows without a region are dropped."""
    return _supervised_join(features, labels, "dust_storm", LOCATION_COLUMNS, dust_region, "region_day", drop_uncertain, digits, order, True)


def positive_alignment(labels: DataFrame, joined: DataFrame, digits: int = 4) -> DataFrame:
    """Positive keys whose row counts differ between the labels and the joined table.

    Counting before the full outer join makes it a multiset difference without pairing rows.
    """
    left, right, _ = _join_keys(_hazard_is(labels, "flash_flood"), joined, PROVINCE_COLUMNS, province_alias, digits)

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.filter("label_status = 'positive'").groupBy(*JOIN_KEYS).agg(F.count("*").alias(name))

    both = counts(left, "_a").join(counts(right, "_b"), list(JOIN_KEYS), "full").na.fill(0, ["_a", "_b"])
    return both.select(
        F.concat_ws("|", "_k1", "_k2", F.nullif("_k3", F.lit(""))).alias("join_key"),
        F.col("_a").alias("label_rows"),
        F.col("_b").alias("supervised_rows"),
        F.greatest(F.col("_a") - F.col("_b"), F.lit(0)).alias("missing_rows"),
        F.greatest(F.col("_b") - F.col("_a"), F.lit(0)).alias("extra_rows"),
    )


def alignment_summary(alignment: DataFrame, strict: bool = False) -> DataFrame:
    """Totals of ``positive_alignment``; ``strict`` fails the job on a mismatch."""
    out = alignment.agg(
        F.coalesce(F.sum("label_rows"), F.lit(0)).alias("label_positive_rows"),
        F.coalesce(F.sum("supervised_rows"), F.lit(0)).alias("supervised_positive_rows"),
        F.coalesce(F.sum("missing_rows"), F.lit(0)).alias("missing_positive_rows"),
        F.coalesce(F.sum("extra_rows"), F.lit(0)).alias("extra_positive_rows"),
        F.count(F.when(F.col("missing_rows") > 0, 1)).alias("missing_positive_key_count"),
        F.count(F.when(F.col("extra_rows") > 0, 1)).alias("extra_positive_key_count"),
    )
    ok = (F.col("missing_positive_rows") == 0) & (F.col("extra_positive_rows") == 0)
    status = F.when(ok, "ok").otherwise("mismatch")
    return out.withColumn("status", check(ok, status, "positive labels and supervised rows do not align") if strict else status)


def supervised_join_dry_heat(
    features: DataFrame, labels: DataFrame, unit: str = "region-year", region: str = "region_id", drop_unmatched: bool = True
) -> DataFrame:
    """Season features joined one-to-many to crop outcomes; duplicate outcome keys fail the job."""
    keys = season_keys(unit, region)
    rows = labels.withColumns({region: F.trim(region), "year": F.col("year").try_cast("int")})
    if "season" in labels.columns:
        rows = rows.withColumn("season", F.lower(F.trim("season")))
    if "validation_status" in labels.columns:
        rows = rows.filter(~F.coalesce(F.lower(F.trim("validation_status")), F.lit("")).isin("rejected", "invalid"))
    outcome = list(keys)
    if "crop_type" in labels.columns:
        rows = rows.withColumn("crop_type", F.lower(F.trim("crop_type")))
        outcome.append("crop_type")
    others = [c for c in rows.columns if c not in outcome]
    single = rows.groupBy(*outcome).agg(F.count("*").alias("_n"), F.max(F.struct(*others)).alias("_v"))
    single = single.select(*outcome, check(F.col("_n") == 1, F.col("_v"), "duplicate supervision rows for one key").alias("_v"))
    single = single.select(*outcome, *[F.col(f"_v.{c}").alias(c) for c in others if c not in ("sample_unit",)])
    out = region_season_aggregate(features, unit, region).join(single, keys, "left")
    labeled = F.lit(False)
    for name in ("yield_anomaly", "yield_value", "label"):
        if name in out.columns:
            labeled = labeled | F.col(name).isNotNull()
    out = out.withColumns(
        {
            "hazard_type": F.lit("dry_heat_agriculture"),
            "training_join_key": F.concat_ws("|", *[F.col(k).cast("string") for k in keys]),
            "is_labeled": labeled,
        }
    )
    return out.filter("is_labeled") if drop_unmatched else out


def sample_negatives(df: DataFrame, keys: Sequence[str], n: int | None = None, seed: int = 42) -> DataFrame:
    """All positives and n negatives (default: as many as positives), near misses before background.

    Order within a class is by a hash of the keys, so the choice is the same on every run. The cut is
    found on a table of at most 3 x 4096 bins.
    """
    rank = (
        F.when(F.col("label_status") == "positive", 0)
        .when((F.col("label_status") == "negative") & (F.col("label_source_mode") == "outside_event_region"), 1)
        .when(F.col("label_status") == "negative", 2)
    )
    h = F.xxhash64(*[F.col(k).cast("string") for k in keys], F.lit(seed))
    rows = df.withColumns({"_class": rank, "_h": h}).filter(F.col("_class").isNotNull()).withColumn("_bin", hash_bin(F.col("_h")))
    return _take(rows, list(keys), n).drop("_class", "_h", "_bin")


def _take(rows: DataFrame, keys: list[str], n: int | None) -> DataFrame:
    table = running_bins(rows, ["_class", "_bin"], F.lit(1))
    everything = Window.partitionBy()
    positives = F.coalesce(F.sum(F.when(F.col("_class") == 0, F.col("_weight"))).over(everything), F.lit(0))
    target = positives + (positives if n is None else F.lit(n))
    cut = table.withColumn("_left", target - F.col("_before")).filter((F.col("_class") == 0) | (F.col("_left") > 0))
    cut = F.broadcast(cut.select("_class", "_bin", "_left", (F.col("_left") < F.col("_weight")).alias("_edge")))
    kept = rows.join(cut, ["_class", "_bin"])
    whole = kept.filter((F.col("_class") == 0) | ~F.col("_edge")).drop("_left", "_edge")
    order = Window.partitionBy("_class", "_bin").orderBy("_h", *keys)
    edge = kept.filter((F.col("_class") > 0) & F.col("_edge")).withColumn("_n", F.row_number().over(order))
    return whole.unionByName(edge.filter(F.col("_n") <= F.col("_left")).drop("_left", "_edge", "_n"))


def prepare_features(df: DataFrame, hazard: str, evidence: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Canonical feature columns held to their ranges; rows lacking a required feature are dropped."""
    required, optional, extra = FEATURES[hazard]
    out: list[Column] = [F.col(c) for c in keep]
    for name in required + optional + (extra if evidence else ()):
        source = first_existing(df.columns, FEATURE_NAMES.get(name, (name,)))
        if source is None and name in required:
            raise KeyError(f"{hazard} features need column {name}")
        out.append((in_range(source, name) if source else F.lit(None).cast("double")).alias(name))
    return df.select(*out).dropna(subset=list(required))


def _first(df: DataFrame, *names: str, scale: float = 1.0, shift: float = 0.0) -> Column | None:
    name = first_existing(df.columns, names)
    return None if name is None else F.col(name).try_cast("double") * scale + shift


def _need(name: str, *options: Column | None) -> Column:
    for option in options:
        if option is not None:
            return option
    raise KeyError(name)


PASS_THROUGH = (
    "latitude",
    "longitude",
    *LABEL_COLUMNS,
    "hazard_type",
    "sst_celsius",
    "t2m_anomaly_c",
    "tmax_anomaly_c",
    "heatwave_day_flag",
    "heatwave_duration_days",
    "daily_precip_anomaly",
)


def build_daily_features(df: DataFrame, hazard: str) -> DataFrame:
    """Resolve every feature from whichever raw columns exist; the choice is made while planning."""
    rows = require_daily(df)
    data: dict[str, Column] = {"date": F.col("date")}
    data |= {c: F.col(c) for c in PASS_THROUGH if c in rows.columns}

    def temperature() -> Column:
        return _need("t2m_c", _first(rows, "t2m_c", "temp_c"), _first(rows, "t2m", shift=-273.15))

    def humidity(t: Column) -> Column:
        direct = _first(rows, "rh2m", "relative_humidity_percent", "rh_percent")
        if direct is not None:
            return direct
        return ph.rh_from_dewpoint(t, _need("rh2m", _first(rows, "d2m_c", "dewpoint_c"), _first(rows, "d2m", shift=-273.15)))

    def speed(direct: Column | None, u: Column | None, v: Column | None, name: str) -> Column:
        return _need(name, direct, ph.wind_speed(u, v) if u is not None and v is not None else None)

    if hazard in ("extreme_heat", "dry_heat_agriculture"):
        t = temperature()
        r = humidity(t)
        wind = speed(_first(rows, "wind10_speed", "wind_speed_mps"), _first(rows, "u10", "u10m"), _first(rows, "v10", "v10m"), "wind10_speed")
        data |= {
            "temp_c": t,
            "tmax_c": _need("tmax_c", _first(rows, "tmax_c", "mx2t_c"), _first(rows, "mx2t", shift=-273.15), t),
            "tmin_c": _need("tmin_c", _first(rows, "tmin_c", "mn2t_c"), _first(rows, "mn2t", shift=-273.15), t),
            "relative_humidity_percent": r,
            "vpd_kpa": _need("vpd_kpa", _first(rows, "vpd_kpa"), ph.vpd_kpa(t, r)),
            "heat_index_c": _need("heat_index_c", _first(rows, "heat_index_c"), ph.heat_index_c(t, r, "adjusted")),
            "wind_speed_mps": wind,
        }
    elif hazard == "flash_flood":
        total = _need("daily_precip_total", _first(rows, "daily_precip_total", "gpm_daily_precip"), _first(rows, "tp", scale=1000.0))
        rest = _first(rows, "daily_large_scale_precip")
        convective = _need(
            "daily_convective_precip",
            _first(rows, "daily_convective_precip"),
            _first(rows, "cp", scale=1000.0),
            clip(total - rest, 0.0) if rest is not None else None,
        )
        low = speed(_first(rows, "wind850_speed"), _first(rows, "u850"), _first(rows, "v850"), "wind850_speed")
        winds = [_first(rows, c) for c in ("u850", "v850", "u200", "v200")]
        high = _first(rows, "wind200_speed", "jet200_speed")
        shear = _need(
            "wind_shear_850_200",
            _first(rows, "wind_shear_850_200"),
            ph.vector_shear(*winds) if all(w is not None for w in winds) else None,
            ph.speed_shear(high, low) if high is not None else None,
        )
        cape, pwat = _first(rows, "cape"), _first(rows, "pwat", "pwat_mm")
        if cape is None or pwat is None:
            t = temperature()
            r = humidity(t)
            pressure = _first(rows, "surface_pressure_hpa")
            pressure = pressure if pressure is not None else _first(rows, "surface_pressure", "sp", scale=0.01)
            cape = cape if cape is not None else ph.cape_proxy(t, r)
            pwat = pwat if pwat is not None else ph.pwat_proxy(t, r, pressure if pressure is not None else 1010.0)
        score = ph.flash_flood_score(
            None, None, total, _first(rows, "slope", "slope_deg"), _first(rows, "soil_moisture_frac"), _first(rows, "impervious_frac")
        )
        data |= {
            "daily_precip_total": total,
            "daily_convective_precip": convective,
            "daily_large_scale_precip": rest if rest is not None else clip(total - convective, 0.0),
            "cape": cape,
            "pwat": pwat,
            "ivt": _need("ivt", _first(rows, "ivt", "ivt_kg_m_s"), ph.ivt_proxy(low, pwat)),
            "wind850_speed": low,
            "wind_shear_850_200": shear,
            "flash_flood_risk": _need("flash_flood_risk", _first(rows, "flash_flood_risk"), score),
        }
    elif hazard == "dust_storm":
        data |= {n: _need(n, _first(rows, *FEATURE_NAMES[n])) for n in FEATURES["dust_storm"][0]}
    return rows.select(*[c.alias(n) for n, c in data.items()])


def target_column(df: DataFrame, hazard: str) -> str | None:
    return first_existing(df.columns, SUPERVISION[hazard][1])


def explicit_targets(df: DataFrame, hazard: str) -> DataFrame:
    """Rows with a usable target in ``target``; rejected rows and unlabeled states dropped."""
    name = target_column(df, hazard)
    if name is None:
        raise KeyError(f"no target column for {hazard}")
    out = df
    if "label_status" in df.columns:
        out = out.filter(F.lower("label_status").isin("positive", "negative"))
    if "validation_status" in df.columns and "validation_status" in SUPERVISION[hazard][2]:
        out = out.filter(~F.coalesce(F.lower("validation_status"), F.lit("")).isin("rejected", "invalid"))
    target = F.col(name).try_cast("double")
    return out.withColumn("target", F.when(~F.isnan(target), target)).filter(F.col("target").isNotNull())


def infer_sample_unit(df: DataFrame, hazard: str) -> DataFrame:
    """One row with the sample unit: the first non-blank value of the column, else from the columns present."""
    have = set(df.columns)
    guess = SUPERVISION[hazard][0]
    if hazard == "flash_flood" and "date" in have:
        guess = "grid-day" if {"latitude", "longitude"} <= have else "province-day"
    elif hazard in ("extreme_heat", "dust_storm") and {"date", "region_id"} <= have:
        guess = "region_day"
    elif hazard == "dry_heat_agriculture" and {"region_id", "year"} <= have:
        guess = "region-season" if "season" in have else "region-year"
    named = F.nullif(text("sample_unit"), F.lit("")) if "sample_unit" in have else F.lit(None).cast("string")
    return df.agg(F.coalesce(F.first(named, ignorenulls=True), F.lit(guess)).alias("sample_unit"))


def split_group() -> Column:
    """Split group of a row: its matched events, else its date."""
    ids = F.trim(F.coalesce(F.col("matched_event_ids"), F.lit("")))
    return F.when((ids != "") & (F.lower(ids) != "nan"), ids).otherwise(F.concat(F.lit("date:"), F.col("date").cast("string")))


def group_shuffle_split(df: DataFrame, group: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_validation``: whole groups in hash order until the fraction of rows is reached, never all rows.

    Rows are counted per group with partial sums; the running totals are taken over hash bins, then
    within a bin, so neither rows nor groups pass through one task. With a single group all rows train.
    """
    share = min(max(fraction, 0.05), 0.5)
    groups = df.groupBy(group).agg(F.count("*").alias("_rows"))
    groups = groups.withColumn("_h", F.xxhash64(F.col(group).cast("string"), F.lit(seed))).withColumn("_bin", hash_bin(F.col("_h")))
    bins = F.broadcast(running_bins(groups, ["_bin"], F.col("_rows")))
    within = Window.partitionBy("_bin").orderBy("_h", group).rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.join(bins, "_bin").withColumn("_from", F.col("_before") + F.coalesce(F.sum("_rows").over(within), F.lit(0)))
    target = F.greatest(F.lit(1), F.least(F.col("_sum") - 1, F.floor(F.col("_sum") * share)))
    chosen = (F.col("_from") < target) & (F.col("_from") + F.col("_rows") < F.col("_sum"))
    flags = placed.select(F.col(group).alias("_g"), chosen.alias("is_validation"))
    return df.join(flags, df[group].eqNullSafe(flags["_g"]), "left").drop("_g")


def training_target_summary(df: DataFrame, hazard: str) -> DataFrame:
    """Rows, label counts, target range and, with event ids, the group audit: one aggregate."""
    if target_column(df, hazard) is None:
        return df.agg(F.count("*").alias("input_rows")).withColumns(
            {"target_source": F.lit("pseudo_target"), "sample_unit": F.lit(SUPERVISION[hazard][0])}
        )
    rows = explicit_targets(df, hazard)
    aggs = [
        F.count("*").alias("rows_with_explicit_label"),
        F.count(F.when(F.col("target") > 0.5, 1)).alias("positive_labels"),
        F.count(F.when(F.col("target") <= 0.5, 1)).alias("negative_labels"),
        F.min("target").alias("target_min"),
        F.max("target").alias("target_max"),
        F.avg("target").alias("target_mean"),
    ]
    if {"matched_event_ids", "date"} <= set(df.columns):
        aggs += group_audit_columns()
    return rows.agg(*aggs).withColumn("target_source", F.lit("explicit_label"))


def group_audit_columns() -> list[Column]:
    group = split_group()
    fallback = group.startswith("date:")
    return [
        F.count_distinct(group).alias("split_group_count"),
        F.count_distinct(F.when(~fallback, group)).alias("event_group_count"),
        F.count_distinct(F.when(fallback, group)).alias("fallback_date_group_count"),
        F.count(F.when(~fallback, 1)).alias("rows_with_matched_event_ids"),
        F.count(F.when(fallback, 1)).alias("rows_using_fallback_date_groups"),
        F.count(F.when(~fallback & group.contains(","), 1)).alias("rows_with_multi_event_groups"),
    ]


def label_passthrough(labels: DataFrame, drop_uncertain: bool = True, digits: int = 4) -> DataFrame:
    """A label table that already holds the features: filter and key it, without a join."""
    out = _hazard_is(labels, "flash_flood")
    if drop_uncertain:
        out = out.filter(F.col("label_status").isin("positive", "negative"))
    day = date_of("date").cast("string")
    province = first_existing(labels.columns, PROVINCE_COLUMNS)
    if {"latitude", "longitude"} <= set(labels.columns):
        mode = "grid_day"
        key = F.concat_ws("|", day, *[F.bround(F.col(c).try_cast("double"), digits).cast("string") for c in ("latitude", "longitude")])
    elif province:
        mode, key = f"province_day:{province}", F.concat_ws("|", day, F.col(province).cast("string"))
    else:
        mode, key = "label_table_passthrough", day
    return out.withColumns({"is_labeled": F.col("label").isNotNull(), "training_join_mode": F.lit(mode), "training_join_key": key})


def hazard_training_tables(days: DataFrame, hazards: Sequence[str], keep: Sequence[str] = ("date", "latitude", "longitude")) -> DataFrame:
    """Feature rows of several hazards from one scan, as (hazard_type, keys, features map).

    Values are columns of their own projections and the hazard comes before the map: nothing but names is exploded, as
    Spark interprets what an explode holds once a stage is too large for one compiled method.
    """
    needed = {h: [name for part in FEATURES[h] for name in part] for h in hazards}
    names = list(dict.fromkeys(n for h in hazards for n in needed[h]))
    source = {n: first_existing(days.columns, FEATURE_NAMES.get(n, (n,))) for n in names}
    for h in hazards:
        for name in FEATURES[h][0]:
            if source[name] is None:
                raise KeyError(f"{h} features need column {name}")
    rows = days.select(*keep, *[usable(c).alias(f"_u_{c}") for c in dict.fromkeys(source.values()) if c])
    rows = rows.select(*keep, *[(usable_in_range(F.col(f"_u_{c}"), n) if c else F.lit(None).cast("double")).alias(f"_v_{n}") for n, c in source.items()])
    out = rows.withColumn("hazard_type", F.explode(F.array(*[F.lit(h) for h in hazards])))
    complete, features = F.lit(False), F.lit(None)
    for h in hazards:
        own = F.col("hazard_type") == h
        whole = own
        for name in FEATURES[h][0]:
            whole = whole & F.col(f"_v_{name}").isNotNull()
        complete = complete | whole
        features = F.when(own, F.create_map(*[c for n in needed[h] for c in (F.lit(n), F.col(f"_v_{n}"))])).otherwise(features)
    return out.filter(complete).select(*keep, "hazard_type", features.alias("features"))


def evenly_spaced(df: DataFrame, key: str, n: int) -> DataFrame:
    """n values of a short ordered key column, evenly spaced with both ends kept (a calendar of days, say)."""
    values = df.select(key).distinct()
    order = Window.orderBy(key)
    ranked = values.withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count("*").over(Window.partitionBy())})
    if n == 1:
        return ranked.filter(F.col("_i") == F.floor(F.col("_n") / 2)).select(key)
    last = F.col("_n") - 1
    step = last / F.lit(float(n - 1))
    slots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.bround(j * step, 0))
    hit = (F.col("_n") <= n) | F.array_contains(slots, F.col("_i").cast("double"))
    return ranked.filter(hit).select(key)


FLOAT = T.FloatType()


def model_vector(df: DataFrame, hazard: str) -> DataFrame:
    """Cast the model features to FLOAT, as they cross into a model."""
    required, optional, _ = FEATURES[hazard]
    return df.withColumns({c: col(c).cast(FLOAT) for c in required + optional})


def supervised_features(df: DataFrame, hazard: str, keep: Sequence[str] = ()) -> DataFrame:
    """Targets (explicit, else the formula) next to prepared features."""
    from gridwarden.operators.labels import pseudo_target

    if target_column(df, hazard) is not None:
        return prepare_features(explicit_targets(df, hazard), hazard, keep=[*keep, "target"])
    out = prepare_features(df, hazard, keep=keep)
    return out.withColumn("target", F.coalesce(pseudo_target(out, hazard), lit(0.0)))
