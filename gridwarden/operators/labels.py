"""Labels from an event catalogue: positive, negative or uncertain, never guessed.

Events are gathered per day, per day and place name, and per day and cell of their footprint from the merged catalogue,
which has one row per place and date range. These tables are stored; samples meet them by equal keys. The part
of the provenance that all samples of a day have in common is written once a day, as text; flood labels can leave it there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwarden.functions import physical as ph
from gridwarden.functions.basic import check, clip, date_of, first_existing, lit, once, pick, text
from gridwarden.functions.geometry import contains, haversine_km, polygons_from_wkt
from gridwarden.functions.text import NATIONWIDE, dust_region, province_alias, resolve_dust_regions, resolve_heat_regions, resolve_provinces
from gridwarden.operators.events import event_mapping_mode
from gridwarden.session import cut_lineage
from gridwarden.operators.spatial import boundary_edges, bucket, cell_cover, circle_cover

PROVINCE_COLUMNS = ("province_name", "admin1_name", "region_name", "location_name")
LOCATION_COLUMNS = ("region_id", *PROVINCE_COLUMNS)
LABEL_COLUMNS = ("label", "label_status", "label_source_mode", "matched_event_ids", "label_provenance")


@dataclass(frozen=True)
class FloodLabelPolicy:
    """Defaults of the flash-flood label rules."""

    point_buffer_km: float = 25.0
    province_fallback: bool = True
    event_day_negatives: bool = True
    min_spatial_confidence: str = "medium"
    statuses: tuple[str, ...] = ("seed", "verified")


def _dated(df: DataFrame, what: str) -> DataFrame:
    day = date_of("date")
    return df.withColumn("date", check(day.isNotNull(), day, f"{what} contains invalid 'date' values"))


def _keep_labels(df: DataFrame, samples: DataFrame, hazard: str) -> DataFrame:
    kept = [c for c in samples.columns if c not in LABEL_COLUMNS and c != "hazard_type"]
    return df.select(*kept, F.lit(hazard).alias("hazard_type"), *LABEL_COLUMNS)


def _once_per_value(df: DataFrame, inputs: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that depend on ``inputs`` alone, evaluated once per distinct value of these: a name or a shape lasts many days."""
    key = F.struct(*[F.col(c) for c in inputs])  # structs with equal nulls are equal
    known = once(df.select(*inputs).distinct(), columns).select(key.alias("_value"), *columns)
    return df.withColumn("_value", key).join(known, "_value", "left").drop("_value")


def flood_events(events: DataFrame, policy: FloodLabelPolicy = FloodLabelPolicy()) -> DataFrame:
    """Daily events with mapping mode, provinces and the source of their geometry."""
    wkt = F.nullif(text("geometry_wkt"), F.lit(""))
    given = F.lower(text("geometry_source")) if "geometry_source" in events.columns else F.lit("")
    point = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    named = [c for c in PROVINCE_COLUMNS if c in events.columns]
    out = _dated(events, "event table")
    out = _once_per_value(out, named, {"_provinces": resolve_provinces(*named)})
    out = _once_per_value(out, ["geometry_wkt"], {"_wkt_ok": polygons_from_wkt(wkt).isNotNull()})
    shaped = F.col("_wkt_ok")
    source = F.when(given != "", given).when(shaped, "source_geometry").when(wkt.isNull() & point, "derived_point_buffer").otherwise("")
    return out.withColumns(
        {
            "_mode": event_mapping_mode(policy.statuses, policy.min_spatial_confidence, policy.province_fallback, F.col("_provinces"), shaped),
            "_source": source,
            "_shaped": shaped | (wkt.isNull() & ((given != "") | point)),
            "_point": point,
        }
    ).drop("_wkt_ok")


#: Modes in which an event can decide samples.
SUPPORTED_MODES = ("geometry_wkt", "point_buffer", "province_day")


def _with_day_text(own: Column, day: Column) -> Column:
    """One JSON object of a sample's own keys and those of its day's text."""
    return F.concat(F.substring(own, 1, F.length(own) - 1), F.lit(","), F.substring(day, 2, F.length(day)))


class FloodCatalogue:
    """A daily catalogue as tables that samples meet by equal keys; each is stored once, whatever is labelled against it.

    Footprints are cut into cells once per shape, and the events of a cell and day, of a province and day, and of a day
    become one row each. ``order`` gives the order in which matches are listed.
    """

    def __init__(self, events: DataFrame, policy: FloodLabelPolicy = FloodLabelPolicy(), order: str = "event_id"):
        self.policy = policy
        info = F.struct(
            F.col(order).alias("o"), F.col("event_id").alias("id"), F.col("location_name").alias("place"), F.col("_source").alias("source"), F.col("geometry_wkt").alias("wkt")
        )
        needed = ["date", "_info", "_mode", "_provinces", "_shaped", "_point", "latitude", "longitude", "geometry_wkt"]
        self.daily = cut_lineage(flood_events(events, policy).withColumn("_info", info).select(*needed), "flood-events")
        self.days = _flood_days(self.daily)

    @cached_property
    def cells(self) -> DataFrame:
        return cut_lineage(_flood_cells(self.daily, self.policy), "flood-cells")

    @cached_property
    def provinces(self) -> DataFrame:
        return cut_lineage(_flood_provinces(self.daily), "flood-provinces")

    def day_provenance(self) -> DataFrame:
        """(date, day_provenance): the part of the provenance that all samples of a day have in common, for days with events."""
        return self.days.select("date", F.col("_day_text").alias("day_provenance"))

    def label(self, samples: DataFrame, whole: bool = True) -> DataFrame:
        """Labels of grid-day or province-day samples; see ``label_flash_flood``.

        Not ``whole``, ``label_provenance`` is the sample's own part alone: the list of a day's events is not written out
        for each sample of the day. ``with_day_provenance`` makes it whole.
        """
        return _flood_labels(samples, self, whole)


def with_day_provenance(labels: DataFrame, days: DataFrame, on: Sequence[str] = ("date",)) -> DataFrame:
    """Flood labels with the sample's own part of the provenance, and those of their days, to labels with whole provenance."""
    whole = _with_day_text(F.col("label_provenance"), F.coalesce("day_provenance", _no_flood_day()))
    return labels.join(days, list(on), "left").withColumn("label_provenance", whole).select(*labels.columns)


def label_flash_flood(
    samples: DataFrame, events: DataFrame, policy: FloodLabelPolicy = FloodLabelPolicy(), order: str = "event_id"
) -> DataFrame:
    """Attach flash-flood labels to grid-day or province-day samples.

    ``events`` is a daily catalogue; ``order`` gives the order in which matches are listed. A sample meets each of the three
    stored tables of ``FloodCatalogue`` once, by equal keys: no key is matched apart and joined back.
    """
    return FloodCatalogue(events, policy, order).label(samples)


def _flood_labels(samples: DataFrame, catalogue: FloodCatalogue, whole: bool) -> DataFrame:
    policy = catalogue.policy
    rows = _dated(samples, "sample table")
    has_grid = {"latitude", "longitude"} <= set(samples.columns)
    province = first_existing(samples.columns, PROVINCE_COLUMNS)
    matched = has_grid or province is not None
    key = {
        "_lat": F.col("latitude").try_cast("double") if has_grid else F.lit(None).cast("double"),
        "_lon": F.col("longitude").try_cast("double") if has_grid else F.lit(None).cast("double"),
        "_prov": F.nullif(province_alias(province), F.lit("")) if province else F.lit(None).cast("string"),
    }
    rows = rows.withColumns(key)
    labeled = rows.join(catalogue.days, "date", "left")
    hits: list[Column] = []
    if has_grid:
        labeled = labeled.withColumns({"_bi": bucket(F.col("_lat")), "_bj": bucket(F.col("_lon"))})
        labeled = labeled.join(catalogue.cells, ["date", "_bi", "_bj"], "left")

        def holds(e: Column) -> Column:
            near = haversine_km("_lat", "_lon", e["lat"], e["lon"]) <= policy.point_buffer_km
            return F.when(e["inner"], F.lit(True)).when(e["edges"].isNotNull(), contains(e["edges"], "_lat", "_lon", False)).otherwise(F.coalesce(near, F.lit(False)))

        hits.append(F.transform(F.filter("_cell_events", holds), lambda e: F.struct(e["info"].alias("info"), e["mode"].alias("mode"))))
    if province:
        labeled = labeled.join(catalogue.provinces, ["date", "_prov"], "left")
        no_point = F.col("_lat").isNull() | F.col("_lon").isNull()
        named = F.filter("_province_events", lambda e: (e["mode"] == "province_day") | no_point)
        hits.append(F.transform(named, lambda e: F.struct(e["info"].alias("info"), F.lit("province_day").alias("mode"))))
    if matched:
        none = F.array().cast(f"array<struct<info:{catalogue.daily.schema['_info'].dataType.simpleString()},mode:string>>")
        labeled = once(labeled, {"_hits": F.sort_array(F.concat(*[F.coalesce(h, none) for h in hits]))})
    else:
        labeled = labeled.withColumn("_hits", F.array())
    found = F.size("_hits") > 0
    negative_ok = F.lit(False)
    if policy.event_day_negatives and has_grid:
        negative_ok = negative_ok | F.col("_grid_ok")
    if policy.event_day_negatives and province:
        negative_ok = negative_ok | F.col("_province_ok")
    no_event = F.col("_events").isNull()

    def choose(hit, none, outside, unresolved) -> Column:
        return F.when(found, hit).when(no_event, none).when(negative_ok, outside).otherwise(unresolved)

    hits = F.col("_hits")
    labeled = labeled.withColumns(
        {
            "label": choose(lit(1.0), lit(0.0), lit(0.0), F.lit(None).cast("double")),
            "label_status": choose(F.lit("positive"), F.lit("negative"), F.lit("negative"), F.lit("uncertain")),
            "label_source_mode": choose(
                F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["mode"]))), ",") if matched else F.lit(""),
                F.lit("no_event_day"),
                F.lit("outside_event_footprint"),
                F.lit("event_day_unresolved"),
            ),
            "matched_event_ids": F.when(found, F.array_join(F.transform(hits, lambda h: h["info"]["id"]), ",")).otherwise("") if matched else F.lit(""),
            "label_provenance": _flood_provenance(policy, matched, whole),
        }
    )
    return _keep_labels(labeled, samples, "flash_flood")


def _flood_days(daily: DataFrame) -> DataFrame:
    """One stored row a day: what decides labels, and the day's part of the provenance as text, written once."""
    supported = F.col("_mode").isin(*SUPPORTED_MODES)
    days = daily.groupBy("date").agg(
        F.count("*").alias("_events"),
        F.count_if(supported).alias("_supported"),
        F.transform(F.sort_array(F.collect_list(F.struct("_info", "_mode"))), lambda e: e["_mode"]).alias("_modes"),
        F.count_if("_shaped").alias("_shaped_events"),
        F.count_if("_point").alias("_point_events"),
        F.bool_or(F.col("_mode").isin("point_buffer", "geometry_wkt")).alias("_grid_ok"),
        F.bool_or(F.col("_mode").isin("point_buffer", "province_day")).alias("_province_ok"),
    )
    return cut_lineage(days.select("date", "_events", "_grid_ok", "_province_ok", _flood_day_text(F.col("_events"), F.col("_supported"), F.col("_modes"), F.col("_shaped_events"), F.col("_point_events")).alias("_day_text")), "flood-days")


def _flood_day_text(events: Column, supported: Column, modes: Column, shaped: Column, points: Column) -> Column:
    return F.to_json(
        F.struct(
            events.alias("event_count_for_day"),
            modes.alias("day_event_mapping_modes"),
            shaped.alias("day_geometry_event_count"),
            (supported > 0).alias("day_has_supported_event"),
            points.alias("day_point_event_count"),
            supported.alias("day_supported_event_count"),
            F.filter(modes, lambda m: m.isin(*SUPPORTED_MODES)).alias("day_supported_event_mapping_modes"),
            (events - supported).alias("day_unsupported_event_count"),
            F.filter(modes, lambda m: ~m.isin(*SUPPORTED_MODES)).alias("day_unsupported_event_mapping_modes"),
        )
    )


def _flood_cells(daily: DataFrame, policy: FloodLabelPolicy) -> DataFrame:
    """(date, _bi, _bj, _cell_events): the events whose footprint touches a cell on a day; shapes are cut once, whatever their days."""
    shapes = daily.filter("_mode = 'geometry_wkt'").select("date", "_info", "geometry_wkt")
    covers = shapes.select("geometry_wkt", F.col("geometry_wkt").alias("_shape")).distinct()
    covers = cell_cover(boundary_edges(covers, "geometry_wkt", "wkt", strict=False))
    shaped = shapes.join(covers, shapes["geometry_wkt"] == covers["_shape"])
    points = daily.filter("_mode = 'point_buffer'").select("date", "_info", "latitude", "longitude")
    circles = circle_cover(points, policy.point_buffer_km)
    absent = F.lit(None).cast("double")
    kind = covers.schema["edges"].dataType.simpleString()

    def event(mode: str, inner: Column, lat: Column, lon: Column, edges: Column) -> Column:
        return F.struct(F.col("_info").alias("info"), F.lit(mode).alias("mode"), inner.alias("inner"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), edges.alias("edges")).alias("_e")

    both = shaped.select("date", "_bi", "_bj", event("geometry_wkt", F.col("inner"), absent, absent, F.col("edges"))).unionByName(
        circles.select("date", "_bi", "_bj", event("point_buffer", F.lit(False), F.col("latitude"), F.col("longitude"), F.lit(None).cast(kind)))
    )
    return both.groupBy("date", "_bi", "_bj").agg(F.collect_list("_e").alias("_cell_events"))


def _flood_provinces(daily: DataFrame) -> DataFrame:
    """(date, _prov, _province_events): events that name a province on a day."""
    named = daily.filter("_mode in ('province_day', 'point_buffer')").select("date", F.explode("_provinces").alias("_prov"), F.struct(F.col("_info").alias("info"), F.col("_mode").alias("mode")).alias("_e"))
    return named.groupBy("date", "_prov").agg(F.collect_list("_e").alias("_province_events"))


def _no_flood_day() -> Column:
    """The day's part of the provenance where no event is known."""
    return _flood_day_text(F.lit(0), F.lit(0), F.array().cast("array<string>"), F.lit(0), F.lit(0))


def _flood_provenance(policy: FloodLabelPolicy, matched: bool, whole: bool) -> Column:
    none = F.array().cast("array<string>")
    hits = F.col("_hits")

    def of_hits(value) -> Column:
        return F.transform(hits, value) if matched else none

    def geometry_source(h: Column) -> Column:
        return F.when(h["info"]["source"] != "", h["info"]["source"]).when(h["mode"] == "province_day", "province_boundary").otherwise("")

    own = F.to_json(
        F.struct(
            F.col("date").cast("string").alias("date"),
            F.lit(policy.event_day_negatives).alias("emit_event_day_negatives"),
            F.array_sort(F.array_distinct(of_hits(lambda h: h["mode"]))).alias("mapping_modes"),
            of_hits(lambda h: h["info"]["id"]).alias("matched_event_ids"),
            F.filter(of_hits(geometry_source), lambda s: s != "").alias("matched_geometry_sources"),
            F.filter(of_hits(lambda h: F.coalesce(F.trim(h["info"]["wkt"]), F.lit(""))), lambda s: s != "").alias("matched_geometry_wkts"),
            of_hits(lambda h: h["info"]["place"]).alias("matched_location_names"),
            lit(policy.point_buffer_km).alias("point_buffer_km"),
            F.lit(policy.province_fallback).alias("province_fallback_enabled"),
        )
    )
    return _with_day_text(own, F.coalesce("_day_text", _no_flood_day())) if whole else own


def label_dust_storm(
    samples: DataFrame, events: DataFrame, statuses: Sequence[str] = ("verified",), event_day_negatives: bool = True, order: str = "event_id"
) -> DataFrame:
    """Region-day labels by region text; negatives only on days whose events are all resolved."""
    columns = [c for c in LOCATION_COLUMNS if c in samples.columns]
    if not columns:
        raise KeyError(f"dust labels require one location column from {LOCATION_COLUMNS}")
    rows = _dated(samples, "sample table")
    region, used = F.lit(""), F.lit("")
    for c in reversed(columns):
        named = F.lower(text(c)) != ""
        region, used = F.when(named, dust_region(c)).otherwise(region), F.when(named, F.lit(c)).otherwise(used)
    rows = once(rows, {"_region": region, "_column": used})
    daily = _dated(events, "event table").filter(F.lower("validation_status").isin(*statuses))
    daily = once(daily, {"_regions": resolve_dust_regions("location_name")})
    each = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("event_id").alias("id"), F.col("_regions").alias("regions"))))
    days = daily.groupBy("date").agg(F.count("*").alias("_events"), F.bool_or(F.size("_regions") == 0).alias("_open"), each.alias("_all"))
    # the day's part of the provenance is written here, once a day
    day_text = lambda n, listed: F.to_json(F.struct(n.alias("event_count_for_day"), listed.alias("resolved_event_regions")))
    listed = F.transform("_all", lambda e: F.struct(e["id"].alias("id"), e["regions"].alias("regions")))
    days = cut_lineage(days.select("date", "_events", "_open", day_text(F.col("_events"), listed).alias("_day_text")), "dust-days")
    hits = daily.select("date", F.explode("_regions").alias("_region"), F.struct(F.col(order).alias("o"), F.col("event_id").alias("id"), F.col("location_name").alias("place")).alias("_h"))
    hits = hits.groupBy("date", "_region").agg(F.sort_array(F.collect_list("_h")).alias("_hits"))
    out = rows.join(days, "date", "left").join(hits, ["date", "_region"], "left")
    found = (F.col("_region") != "") & F.col("_hits").isNotNull()
    outside = (F.col("_region") != "") & ~F.col("_open") & F.lit(event_day_negatives)

    def choose(*values) -> Column:
        return F.when(found, values[0]).when(F.col("_events").isNull(), values[1]).when(outside, values[2]).otherwise(values[3])

    none = F.array().cast("array<string>")
    out = out.withColumns(
        {
            "label": choose(lit(1.0), lit(0.0), lit(0.0), F.lit(None).cast("double")),
            "label_status": choose(*[F.lit(s) for s in ("positive", "negative", "negative", "uncertain")]),
            "label_source_mode": choose(*[F.lit(s) for s in ("region_day_text", "no_event_day", "outside_event_regions", "event_day_unresolved")]),
            "matched_event_ids": F.when(found, F.array_join(F.transform("_hits", lambda h: h["id"]), ",")).otherwise(""),
            "label_provenance": _with_day_text(
                F.to_json(
                    F.struct(
                        F.col("date").cast("string").alias("date"),
                        F.lit(event_day_negatives).alias("emit_event_day_negatives"),
                        F.when(found, F.transform("_hits", lambda h: h["id"])).otherwise(none).alias("matched_event_ids"),
                        F.when(found, F.transform("_hits", lambda h: h["place"])).otherwise(none).alias("matched_location_names"),
                        F.col("_column").alias("sample_location_column"),
                        F.col("_region").alias("sample_region_id"),
                    )
                ),
                F.coalesce("_day_text", day_text(F.lit(0), none)),
            ),
        }
    )
    return _keep_labels(out, samples, "dust_storm")


def heat_event_days(events: DataFrame) -> DataFrame:
    """Extreme-heat events, one row per day, with regions and whether they cover the whole country."""
    rows = events
    if "hazard_type" in events.columns:
        rows = rows.filter(F.regexp_replace(F.lower(F.trim("hazard_type")), "[ -]", "_") == "extreme_heat")
    ident = [F.nullif(text(c), F.lit("")) for c in ("event_id", "record_id") if c in events.columns]
    rows = rows.select(F.coalesce(*ident, F.lit("unknown_event")).alias("_id"), date_of("start_date").alias("_a"), date_of("end_date").alias("_b"), "location_name")
    rows = once(rows, {"_regions": resolve_heat_regions("location_name")})
    rows = rows.filter(F.col("_b") >= F.col("_a")).withColumn("date", F.explode(F.sequence("_a", "_b")))
    return rows.select(
        "date",
        "_id",
        F.array_contains("_regions", NATIONWIDE).alias("_nationwide"),
        F.filter("_regions", lambda r: r != NATIONWIDE).alias("_regions"),
    )


def label_extreme_heat(region_days: DataFrame, events: DataFrame) -> DataFrame:
    """Labels of region-day rows by nationwide or regional event days."""
    daily = cut_lineage(heat_event_days(events), "heat-event-days")  # read for the days and for their regions
    open_event = ~F.col("_nationwide") & (F.size("_regions") == 0)
    days = daily.groupBy("date").agg(
        F.bool_or("_nationwide").alias("_all"),
        F.sort_array(F.collect_set("_id")).alias("_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_regions")))).alias("_day_regions"),
        F.sort_array(F.collect_set(F.when(open_event, F.col("_id")))).alias("_open"),
    )

    def day_text(everywhere: Column, ids: Column, regions: Column, unresolved: Column) -> Column:
        return F.to_json(F.struct(everywhere.alias("all_regions"), ids.alias("day_event_ids"), regions.alias("day_region_ids"), unresolved.alias("unresolved_event_ids")))

    # the day's lists become text here, once a day; rows only learn whether there are any
    days = days.select(
        "date", "_all", F.array_join("_ids", ",").alias("_ids"), F.to_json("_ids").alias("_id_list"), (F.size("_day_regions") > 0).alias("_regional"), day_text(F.col("_all"), F.col("_ids"), F.col("_day_regions"), F.col("_open")).alias("_day_text")
    )
    days = cut_lineage(days, "heat-days")
    regional = daily.select("date", F.explode("_regions").alias("region_id"), "_id")
    regional = regional.groupBy("date", "region_id").agg(F.sort_array(F.collect_set("_id")).alias("_hits"))
    rows = _dated(region_days, "region-day table")
    out = rows.join(days, "date", "left").join(regional, ["date", "region_id"], "left")
    none = F.array().cast("array<string>")
    own = F.to_json(F.struct(F.col("date").cast("string").alias("date"), F.col("region_id").alias("sample_region_id")))

    def choose(*values) -> Column:
        return (
            F.when(F.col("_ids").isNull(), values[0])
            .when(F.col("_all"), values[1])
            .when(F.col("_hits").isNotNull(), values[2])
            .when(F.col("_regional"), values[3])
            .otherwise(values[4])
        )

    modes = ("no_event_day", "nationwide_event_day", "region_day_overlap", "outside_event_region", "event_day_unresolved")
    out = out.withColumns(
        {
            "label": choose(lit(0.0), lit(1.0), lit(1.0), lit(0.0), F.lit(None).cast("double")),
            "label_status": choose(*[F.lit(s) for s in ("negative", "positive", "positive", "negative", "uncertain")]),
            "label_source_mode": choose(*[F.lit(s) for s in modes]),
            "matched_event_ids": choose(F.lit(""), F.col("_ids"), F.array_join("_hits", ","), F.lit(""), F.lit("")),
            "label_provenance": _with_day_text(
                F.concat(
                    F.lit('{"matched_event_ids":'),
                    choose(F.lit("[]"), F.col("_id_list"), F.to_json("_hits"), F.lit("[]"), F.lit("[]")),
                    F.lit(","),
                    F.substring(own, 2, F.length(own)),
                ),
                F.coalesce("_day_text", day_text(F.lit(False), none, none, none)),
            ),
        }
    )
    return _keep_labels(out, region_days, "extreme_heat")


def label_point_day(days: DataFrame, events: DataFrame) -> DataFrame:
    """Labels of one-point-per-day rows by date overlap alone."""
    hits = heat_event_days(events).groupBy("date").agg(F.sort_array(F.collect_set("_id")).alias("_ids"))
    out = _dated(days, "point-day table").join(hits, "date", "left")
    found = F.col("_ids").isNotNull()
    none = F.array().cast("array<string>")
    out = out.withColumns(
        {
            "label": F.when(found, lit(1.0)).otherwise(lit(0.0)),
            "label_status": F.when(found, "positive").otherwise("negative"),
            "label_source_mode": F.when(found, "date_range_overlap").otherwise("no_event_day"),
            "matched_event_ids": F.when(found, F.array_join("_ids", ",")).otherwise(""),
            "label_provenance": F.to_json(
                F.struct(
                    F.col("date").cast("string").alias("date"),
                    F.coalesce(F.size("_ids"), F.lit(0)).alias("matched_event_count"),
                    F.coalesce("_ids", none).alias("matched_event_ids"),
                )
            ),
        }
    )
    return _keep_labels(out, days, "extreme_heat").withColumn("sample_unit", F.lit("single-point-day"))


def pseudo_target(df: DataFrame, hazard: str) -> Column:
    """Formula target 0..1 where no labels exist."""
    if hazard == "extreme_heat":
        t, h, m = pick(df, "temp_c"), pick(df, "heat_index_c"), pick(df, "tmax_c")
        return clip(F.greatest((t - 38.0) / 12.0, (h - 41.0) / 12.0, (m - 42.0) / 10.0), 0.0, 1.0)
    if hazard == "dry_heat_agriculture":
        return ph.dry_heat_score(pick(df, "temp_c"), pick(df, "relative_humidity_percent"), pick(df, "wind_speed_mps"))
    if hazard == "flash_flood":
        scales = {"daily_precip_total": 50.0, "daily_convective_precip": 30.0, "cape": 2500.0, "pwat": 50.0, "ivt": 400.0, "wind_shear_850_200": 60.0, "flash_flood_risk": 4.0}
        return clip(F.greatest(*[pick(df, n) / s for n, s in scales.items()]), 0.0, 1.0)
    raise ValueError(f"{hazard} has no formula target")
