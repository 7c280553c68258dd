"""Queries of the event catalogue and of labels drawn from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwarden.functions.basic import once
from gridwarden.functions.geometry import point_buffer_wkt
from gridwarden.operators import events as ev
from gridwarden.operators import labels as lb
from gridwarden.operators.features import region_day_topk_pool
from gridwarden.operators.grid import hottest_point
from gridwarden.session import cut_lineage
from gridwarden.workload.q_columns import _PROVINCE_OF
from gridwarden.workload.registry import day, query, r



def messy(t):
    """The catalogue under other column names, with repeated headers and rows of another hazard."""
    c = t.catalogue
    header = F.col("ingest_seq") % 11 == 0
    other = F.col("ingest_seq") % 13 == 0
    return c.select(
        "ingest_seq",
        F.when(header, "event_id").otherwise("").alias("event_id"),
        F.when(other, "dust storm").otherwise("flash flood").alias("hazard_type"),
        F.col("location_name").alias("city"),
        F.concat(F.col("start_date").cast("string"), F.lit(" 00:00:00")).alias("event_date"),
        F.when(F.col("ingest_seq") % 2 == 0, F.col("end_date").cast("string")).otherwise("").alias("event_end_date"),
        F.col("latitude").cast("string").alias("lat"),
        F.col("longitude").cast("string").alias("lng"),
        F.col("source_record_id").alias("record_id"),
    )


@query(
    "standardize_events",
    ("catalogue",),
    """SELECT ingest_seq, concat('daily_feed_', replace(lower(location_name), ' ', '_'), '_', strftime(start_date, '%Y%m%d')) AS event_id, 'flash_flood' AS hazard_type,
      CAST(start_date AS STRING) AS start_date, CAST(CASE WHEN ingest_seq % 2 = 0 THEN end_date ELSE start_date END AS STRING) AS end_date, location_name, 'SAU' AS country_code,
      latitude, 'medium' AS spatial_confidence, 'verified' AS validation_status, source_record_id FROM catalogue WHERE ingest_seq % 11 <> 0 AND ingest_seq % 13 <> 0""",
)
def _(t):
    out = ev.standardize_events(messy(t), "Daily Feed")
    return out.select(
        "ingest_seq", "event_id", "hazard_type", day("start_date").alias("start_date"), day("end_date").alias("end_date"), "location_name", "country_code", "latitude",
        "spatial_confidence", "validation_status", "source_record_id",
    )


@query("drop_embedded_headers", ("catalogue",), "SELECT ingest_seq FROM catalogue WHERE ingest_seq % 11 <> 0")
def _(t):
    return ev.drop_embedded_headers(messy(t)).select("ingest_seq")


_KEY = """concat('flash_flood|', CAST(start_date AS STRING), '|', CAST(end_date AS STRING), '|sau|',
  CASE WHEN geometry_wkt IS NOT NULL THEN concat('geometry:', geometry_wkt) ELSE concat('location:', replace(lower(location_name), ' ', '_')) END)"""


@query("canonical_event_key", ("catalogue",), f"SELECT event_id, {_KEY} AS key FROM catalogue")
def _(t):
    return t.catalogue.select("event_id", ev.canonical_event_key().alias("key"))


MERGED = f"""k AS (SELECT *, {_KEY} AS key, validation_status = 'seed' AS is_seed, CASE WHEN validation_status = 'verified' THEN 1 ELSE 0 END AS v,
  CASE WHEN geometry_wkt IS NOT NULL THEN 2 WHEN latitude IS NOT NULL THEN 1 ELSE 0 END AS g, CASE WHEN source_record_id <> '' THEN 1 ELSE 0 END AS i FROM catalogue),
kk AS (SELECT *, is_seed AND row_number() OVER (PARTITION BY key, is_seed ORDER BY ingest_seq DESC) > 1 AS gone FROM k),
w AS (SELECT key, list_reduce(list({{'s': ingest_seq, 'v': v, 'g': g, 'i': i}} ORDER BY CASE WHEN is_seed THEN 0 ELSE 1 END, ingest_seq),
  lambda a, b: CASE WHEN b.v > a.v OR b.g > a.g OR b.i > a.i THEN b ELSE a END).s AS s FROM kk WHERE NOT gone GROUP BY key),
merged AS (SELECT c.* FROM catalogue c JOIN w ON w.s = c.ingest_seq),
daily AS (SELECT * EXCLUDE (start_date, end_date), CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS date FROM merged)"""


def merged(t):
    seeds = t.catalogue.filter("validation_status = 'seed'")
    return ev.merge_event_sources(seeds, t.catalogue.filter("validation_status <> 'seed'"))


@query("merge_event_sources", ("catalogue",), f"WITH {MERGED} SELECT event_id, location_name, validation_status FROM merged")
def _(t):
    return merged(t).select("event_id", "location_name", "validation_status")


@query(
    "expand_events_daily",
    ("catalogue",),
    f"""WITH {MERGED} SELECT event_id, CAST(date AS STRING) AS date, CASE WHEN geometry_wkt IS NOT NULL THEN 'source_geometry' WHEN latitude IS NOT NULL THEN 'derived_point_buffer' ELSE '' END AS geometry_source,
      CASE WHEN geometry_wkt IS NULL AND latitude IS NOT NULL THEN 25e0 END AS geometry_buffer_km FROM daily""",
)
def _(t):
    return ev.expand_events_daily(merged(t)).select("event_id", day("date").alias("date"), "geometry_source", "geometry_buffer_km")


@query(
    "point_buffer_geometry",
    ("catalogue",),
    """WITH p AS (SELECT event_id, latitude AS y, longitude AS x, 25 / 110574e-3 AS dy, 25 / (11132e-2 * cos(radians(latitude))) AS dx FROM catalogue WHERE latitude IS NOT NULL),
    q AS (SELECT event_id, list_transform(range(33), lambda i: printf('%.6f %.6f', x + dx * cos(2 * pi() * (i % 32) / 32), y + dy * sin(2 * pi() * (i % 32) / 32))) AS pts FROM p)
    SELECT event_id, concat('POLYGON((', array_to_string(pts, ', '), '))') AS wkt FROM q""",
)
def _(t):
    return t.catalogue.filter("latitude is not null").select("event_id", point_buffer_wkt("latitude", "longitude").alias("wkt"))


_MODE = """CASE WHEN validation_status NOT IN ('seed', 'verified') THEN 'unsupported' WHEN spatial_confidence = 'low' THEN 'uncertain' WHEN geometry_wkt IS NOT NULL THEN 'geometry_wkt'
  WHEN latitude IS NOT NULL THEN 'point_buffer' WHEN location_name <> 'Hidden valley' THEN 'province_day' ELSE 'uncertain' END"""


@query("event_mapping_mode", ("catalogue",), f"SELECT event_id, {_MODE} AS mode FROM catalogue")
def _(t):
    return t.catalogue.select("event_id", ev.event_mapping_mode().alias("mode"))


@query(
    "event_summary",
    ("catalogue",),
    """SELECT validation_status, count(*) AS rows, count(geometry_wkt) AS geometry_wkt_rows, count(latitude) AS point_rows, count(*) - count(geometry_wkt) - count(latitude) AS text_only_rows,
      count(nullif(source_record_id, '')) AS source_record_id_rows FROM catalogue GROUP BY 1""",
)
def _(t):
    return ev.event_summary(t.catalogue)


@query(
    "event_table",
    ("catalogue",),
    """SELECT CASE WHEN geometry_wkt IS NOT NULL THEN 'source_geometry' WHEN latitude IS NOT NULL THEN 'derived_point_buffer' ELSE '' END AS geometry_source,
      count(*) AS rows, count(coalesce(geometry_wkt, CAST(latitude AS STRING))) AS shaped FROM catalogue GROUP BY 1""",
)
def _(t):
    return ev.event_table(t.catalogue).groupBy("geometry_source").agg(F.count("*").alias("rows"), F.count("geometry_wkt").alias("shaped"))


HAVERSINE = """(12742e0 * asin(sqrt(pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2))))"""
_SQ = "regexp_extract(e.geometry_wkt, '\\(\\(([0-9.]+) ([0-9.]+), ([0-9.]+) ([0-9.]+), ([0-9.]+) ([0-9.]+)', {0})"
_SQUARE = f"s.longitude >= CAST({_SQ.format(1)} AS DOUBLE) AND s.longitude < CAST({_SQ.format(3)} AS DOUBLE) AND s.latitude >= CAST({_SQ.format(2)} AS DOUBLE) AND s.latitude < CAST({_SQ.format(6)} AS DOUBLE)"
_SAMPLE_PROVINCE = "CASE s.province_name WHEN 'aseer' THEN 'asir' ELSE lower(s.province_name) END"


def flood_label_sql(samples: str, match: str, grid: bool) -> str:
    ok = "('point_buffer', 'geometry_wkt', 'province_day')" if grid else "('point_buffer', 'province_day')"
    return f"""{MERGED}, e AS (SELECT *, {_MODE} AS mode, string_split({_PROVINCE_OF}, ',') AS provinces FROM daily),
dd AS (SELECT date, bool_or(mode IN {ok}) AS ok FROM e GROUP BY 1),
m AS (SELECT s.k, e.event_id, CASE WHEN e.mode = 'point_buffer' AND NOT {str(grid).lower()} THEN 'province_day' ELSE e.mode END AS mode FROM {samples} s JOIN e ON e.date = s.date WHERE {match}),
h AS (SELECT k, string_agg(event_id, ',' ORDER BY event_id) AS ids, string_agg(DISTINCT mode, ',' ORDER BY mode) AS modes FROM m GROUP BY 1),
labels AS (SELECT s.*, CASE WHEN h.k IS NOT NULL THEN 1e0 WHEN dd.date IS NULL OR dd.ok THEN 0e0 END AS label,
  CASE WHEN h.k IS NOT NULL THEN 'positive' WHEN dd.date IS NULL OR dd.ok THEN 'negative' ELSE 'uncertain' END AS label_status,
  CASE WHEN h.k IS NOT NULL THEN h.modes WHEN dd.date IS NULL THEN 'no_event_day' WHEN dd.ok THEN 'outside_event_footprint' ELSE 'event_day_unresolved' END AS label_source_mode,
  coalesce(h.ids, '') AS matched_event_ids FROM {samples} s LEFT JOIN dd ON dd.date = s.date LEFT JOIN h ON h.k = s.k)"""


GRID_MATCH = f"""(e.mode = 'point_buffer' AND {HAVERSINE.format(a='s', b='e')} <= 25) OR (e.mode = 'geometry_wkt' AND {_SQUARE})
  OR (e.mode = 'province_day' AND s.province_name <> '' AND list_contains(e.provinces, {_SAMPLE_PROVINCE}))"""
PROVINCE_MATCH = f"e.mode IN ('point_buffer', 'province_day') AND s.province_name <> '' AND list_contains(e.provinces, {_SAMPLE_PROVINCE})"
GRID_SAMPLES = "gs AS (SELECT row_id, grid_id, date, latitude, longitude, province_name, row_number() OVER () AS k FROM grid_day)"
PROVINCE_SAMPLES = "ps AS (SELECT date, province_name, concat(CAST(date AS STRING), province_name) AS k FROM grid_day WHERE province_name <> '' GROUP BY 1, 2)"


def flood_catalogue(t):
    return lb.FloodCatalogue(ev.expand_events_daily(merged(t)))


def grid_samples(t):
    return t.grid_day.select("row_id", "grid_id", "date", "latitude", "longitude", "province_name")


def province_samples(t):
    return t.grid_day.filter("province_name <> ''").select("date", "province_name").distinct()


def grid_labels(t):
    return flood_catalogue(t).label(grid_samples(t))


def province_labels(t):
    return flood_catalogue(t).label(province_samples(t))


_OUT = ("label", "label_status", "label_source_mode", "matched_event_ids")


@query(
    "label_flash_flood_grid",
    ("grid_day", "catalogue"),
    f"WITH {GRID_SAMPLES}, {flood_label_sql('gs', GRID_MATCH, True)} SELECT row_id, grid_id, latitude, label, label_status, label_source_mode, matched_event_ids FROM labels",
)
def _(t):
    return grid_labels(t).select("row_id", "grid_id", "latitude", *_OUT)


_DAY_COUNTS = ("event_count_for_day", "day_supported_event_count", "day_unsupported_event_count", "day_geometry_event_count", "day_point_event_count")
_LISTS = ("mapping_modes", "matched_event_ids", "matched_location_names", "matched_geometry_sources", "matched_geometry_wkts")


def provenance_fields(df, counts, lists):
    """Fields of the provenance text, lists joined by a bar."""
    at = lambda name: F.get_json_object("label_provenance", f"$.{name}")
    return df.select(
        *[c for c in df.columns if c != "label_provenance"], *[at(c).cast("long").alias(c) for c in counts], *[F.array_join(F.from_json(at(c), "array<string>"), "|").alias(c) for c in lists]
    )


def flood_provenance_sql(samples: str, match: str, grid: bool) -> str:
    return f"""{flood_label_sql(samples, match, grid)},
q AS (SELECT *, CASE WHEN geometry_wkt IS NOT NULL THEN 'source_geometry' WHEN latitude IS NOT NULL THEN 'derived_point_buffer' ELSE '' END AS source FROM e),
pd AS (SELECT date, count(*) AS n, count(CASE WHEN mode IN ('geometry_wkt', 'point_buffer', 'province_day') THEN 1 END) AS ok_n, count(CASE WHEN source <> '' THEN 1 END) AS shaped, count(latitude) AS points,
  string_agg(mode, '|' ORDER BY event_id) AS modes FROM q GROUP BY 1),
pm AS (SELECT s.k, e.event_id, e.location_name, e.geometry_wkt, e.source, CASE WHEN e.mode = 'point_buffer' AND NOT {str(grid).lower()} THEN 'province_day' ELSE e.mode END AS mode FROM {samples} s JOIN q e ON e.date = s.date WHERE {match}),
ph AS (SELECT k, string_agg(DISTINCT mode, '|' ORDER BY mode) AS modes, string_agg(event_id, '|' ORDER BY event_id) AS ids, string_agg(location_name, '|' ORDER BY event_id) AS places,
  string_agg(CASE WHEN source <> '' THEN source WHEN mode = 'province_day' THEN 'province_boundary' END, '|' ORDER BY event_id) AS sources, string_agg(geometry_wkt, '|' ORDER BY event_id) AS wkts FROM pm GROUP BY 1),
prov AS (SELECT s.*, coalesce(pd.n, 0) AS event_count_for_day, coalesce(pd.ok_n, 0) AS day_supported_event_count, coalesce(pd.n - pd.ok_n, 0) AS day_unsupported_event_count, coalesce(pd.shaped, 0) AS day_geometry_event_count,
  coalesce(pd.points, 0) AS day_point_event_count, md5(coalesce(pd.modes, '')) AS day_modes_md5, coalesce(ph.modes, '') AS mapping_modes, coalesce(ph.ids, '') AS matched_event_ids, coalesce(ph.places, '') AS matched_location_names,
  coalesce(ph.sources, '') AS matched_geometry_sources, coalesce(ph.wkts, '') AS matched_geometry_wkts FROM {samples} s LEFT JOIN pd ON pd.date = s.date LEFT JOIN ph ON ph.k = s.k)"""


def _provenance(catalogue, samples, keys):
    """Fields of both parts of the provenance: a day's list of events is read once a day, not once a sample."""
    known = F.from_json("day_provenance", ", ".join(f"{c} long" for c in _DAY_COUNTS) + ", day_event_mapping_modes array<string>")
    days = catalogue.day_provenance().select("date", known.alias("_day"))
    days = cut_lineage(days.select("date", *[f"_day.{c}" for c in _DAY_COUNTS], F.md5(F.array_join("_day.day_event_mapping_modes", "|")).alias("day_modes_md5")), "day-provenance")
    own = F.from_json("label_provenance", ", ".join(f"{c} array<string>" for c in _LISTS))
    rows = once(catalogue.label(samples, whole=False).select("date", *[k for k in keys if k != "date"], "label_provenance"), {"_own": own})
    none = {c: F.lit(0) for c in _DAY_COUNTS} | {"day_modes_md5": F.md5(F.lit(""))}
    return rows.join(days, "date", "left").select(*keys, *[F.coalesce(c, n).alias(c) for c, n in none.items()], *[F.array_join(f"_own.{c}", "|").alias(c) for c in _LISTS])


@query(
    "label_flash_flood_grid_provenance",
    ("grid_day", "catalogue"),
    f"WITH {GRID_SAMPLES}, {flood_provenance_sql('gs', GRID_MATCH, True)} SELECT row_id, grid_id, {', '.join(_DAY_COUNTS)}, day_modes_md5, {', '.join(_LISTS)} FROM prov",
)
def _(t):
    return _provenance(flood_catalogue(t), grid_samples(t), ("row_id", "grid_id"))


@query(
    "label_flash_flood_province_provenance",
    ("grid_day", "catalogue"),
    f"WITH {PROVINCE_SAMPLES}, {flood_provenance_sql('ps', PROVINCE_MATCH, False)} SELECT CAST(date AS STRING) AS date, province_name, {', '.join(_DAY_COUNTS)}, day_modes_md5, {', '.join(_LISTS)} FROM prov",
)
def _(t):
    return _provenance(flood_catalogue(t), province_samples(t), ("date", "province_name")).withColumn("date", day("date"))


@query(
    "label_flash_flood_province",
    ("grid_day", "catalogue"),
    f"WITH {PROVINCE_SAMPLES}, {flood_label_sql('ps', PROVINCE_MATCH, False)} SELECT CAST(date AS STRING) AS date, province_name, label, label_status, label_source_mode, matched_event_ids FROM labels",
)
def _(t):
    return province_labels(t).select(day("date").alias("date"), "province_name", *_OUT)


_DUST_REGION = f"CASE location_name WHEN 'Hidden valley' THEN 'hidden_valley' ELSE replace({_PROVINCE_OF}, ' ', '_') END"


@query(
    "label_dust_storm",
    ("grid_day", "catalogue"),
    f"""WITH {MERGED}, e AS (SELECT *, string_split({_DUST_REGION}, ',') AS regions FROM daily WHERE validation_status = 'verified'),
    s AS (SELECT DISTINCT date, region_id FROM grid_day), d AS (SELECT DISTINCT date FROM e),
    h AS (SELECT s.date, s.region_id, string_agg(event_id, ',' ORDER BY event_id) AS ids FROM s JOIN e ON e.date = s.date AND list_contains(e.regions, s.region_id) GROUP BY 1, 2)
    SELECT CAST(s.date AS STRING) AS date, s.region_id, CASE WHEN h.ids IS NOT NULL THEN 1e0 ELSE 0e0 END AS label, CASE WHEN h.ids IS NOT NULL THEN 'positive' ELSE 'negative' END AS label_status,
      CASE WHEN h.ids IS NOT NULL THEN 'region_day_text' WHEN d.date IS NULL THEN 'no_event_day' ELSE 'outside_event_regions' END AS label_source_mode, coalesce(h.ids, '') AS matched_event_ids
    FROM s LEFT JOIN d ON d.date = s.date LEFT JOIN h ON h.date = s.date AND h.region_id = s.region_id""",
)
def _(t):
    samples = t.grid_day.select("date", "region_id").distinct()
    return lb.label_dust_storm(samples, ev.expand_events_daily(merged(t))).select(day("date").alias("date"), "region_id", *_OUT)


@query(
    "label_dust_storm_provenance",
    ("grid_day", "catalogue"),
    f"""WITH {MERGED}, e AS (SELECT *, string_split({_DUST_REGION}, ',') AS regions FROM daily WHERE validation_status = 'verified'),
    s AS (SELECT DISTINCT date, region_id FROM grid_day), d AS (SELECT date, count(*) AS n, string_agg(event_id, '|' ORDER BY event_id) AS ids FROM e GROUP BY 1),
    h AS (SELECT s.date, s.region_id, string_agg(event_id, '|' ORDER BY event_id) AS ids, string_agg(location_name, '|' ORDER BY event_id) AS places FROM s JOIN e ON e.date = s.date AND list_contains(e.regions, s.region_id) GROUP BY 1, 2)
    SELECT CAST(s.date AS STRING) AS date, s.region_id, coalesce(d.n, 0) AS event_count_for_day, coalesce(h.ids, '') AS matched_event_ids, coalesce(h.places, '') AS matched_location_names, md5(coalesce(d.ids, '')) AS day_ids_md5
    FROM s LEFT JOIN d ON d.date = s.date LEFT JOIN h ON h.date = s.date AND h.region_id = s.region_id""",
)
def _(t):
    samples = t.grid_day.select("date", "region_id").distinct()
    out = lb.label_dust_storm(samples, ev.expand_events_daily(merged(t))).select(day("date").alias("date"), "region_id", "label_provenance")
    listed = F.from_json(F.get_json_object("label_provenance", "$.resolved_event_regions"), "array<struct<id:string>>")
    out = out.withColumn("day_ids_md5", F.md5(F.array_join(F.transform(listed, lambda e: e["id"]), "|")))
    return provenance_fields(out, ("event_count_for_day",), ("matched_event_ids", "matched_location_names"))


HEAT_EVENTS = f"""{MERGED}, he AS (SELECT event_id, date, replace({_PROVINCE_OF}, ' ', '_') AS region_text FROM daily WHERE validation_status = 'verified'),
hd AS (SELECT date, string_agg(DISTINCT event_id, ',' ORDER BY event_id) AS ids, bool_or(region_text <> '') AS scoped FROM he GROUP BY 1)"""


def heat_events(t):
    return merged(t).filter("validation_status = 'verified'").withColumn("hazard_type", F.lit("extreme heat"))


HEAT_LABELS = f"""{HEAT_EVENTS}, s AS (SELECT DISTINCT date, region_id FROM grid_day),
hh AS (SELECT s.date, s.region_id, string_agg(DISTINCT event_id, ',' ORDER BY event_id) AS ids FROM s JOIN he ON he.date = s.date AND list_contains(string_split(he.region_text, ','), s.region_id) GROUP BY 1, 2),
hl AS (SELECT s.date, s.region_id, CASE WHEN hh.ids IS NOT NULL THEN 1e0 WHEN hd.date IS NULL OR hd.scoped THEN 0e0 END AS label,
  CASE WHEN hh.ids IS NOT NULL THEN 'positive' WHEN hd.date IS NULL OR hd.scoped THEN 'negative' ELSE 'uncertain' END AS label_status,
  CASE WHEN hd.date IS NULL THEN 'no_event_day' WHEN hh.ids IS NOT NULL THEN 'region_day_overlap' WHEN hd.scoped THEN 'outside_event_region' ELSE 'event_day_unresolved' END AS label_source_mode,
  coalesce(hh.ids, '') AS matched_event_ids FROM s LEFT JOIN hd ON hd.date = s.date LEFT JOIN hh ON hh.date = s.date AND hh.region_id = s.region_id)"""


@query(
    "label_extreme_heat",
    ("grid_day", "catalogue"),
    f"WITH {HEAT_LABELS} SELECT CAST(date AS STRING) AS date, region_id, label, label_status, label_source_mode, matched_event_ids FROM hl",
)
def _(t):
    return lb.label_extreme_heat(t.grid_day.select("date", "region_id").distinct(), heat_events(t)).select(day("date").alias("date"), "region_id", *_OUT)


@query(
    "label_extreme_heat_provenance",
    ("grid_day", "catalogue"),
    f"""WITH {HEAT_LABELS}, dr AS (SELECT date, string_agg(DISTINCT r, '|' ORDER BY r) AS regions FROM (SELECT date, unnest(string_split(region_text, ',')) AS r FROM he) WHERE r <> '' GROUP BY 1),
    du AS (SELECT date, string_agg(DISTINCT event_id, '|' ORDER BY event_id) AS ids FROM he WHERE region_text = '' GROUP BY 1)
    SELECT CAST(hl.date AS STRING) AS date, hl.region_id, replace(hl.matched_event_ids, ',', '|') AS matched_event_ids, coalesce(replace(hd.ids, ',', '|'), '') AS day_event_ids, coalesce(dr.regions, '') AS day_region_ids, coalesce(du.ids, '') AS unresolved_event_ids
    FROM hl LEFT JOIN hd ON hd.date = hl.date LEFT JOIN dr ON dr.date = hl.date LEFT JOIN du ON du.date = hl.date""",
)
def _(t):
    out = lb.label_extreme_heat(t.grid_day.select("date", "region_id").distinct(), heat_events(t)).select(day("date").alias("date"), "region_id", "label_provenance")
    return provenance_fields(out, (), ("matched_event_ids", "day_event_ids", "day_region_ids", "unresolved_event_ids"))


@query(
    "label_point_day",
    ("grid_day", "catalogue"),
    f"""WITH {HEAT_EVENTS}, p AS (SELECT date, latitude, longitude FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY heat_index_c DESC, latitude, longitude) AS k FROM grid_day) WHERE k = 1)
    SELECT CAST(p.date AS STRING) AS date, p.latitude, p.longitude, CASE WHEN hd.ids IS NOT NULL THEN 1e0 ELSE 0e0 END AS label, CASE WHEN hd.ids IS NOT NULL THEN 'positive' ELSE 'negative' END AS label_status,
      CASE WHEN hd.ids IS NOT NULL THEN 'date_range_overlap' ELSE 'no_event_day' END AS label_source_mode, coalesce(hd.ids, '') AS matched_event_ids FROM p LEFT JOIN hd ON hd.date = p.date""",
)
def _(t):
    days = hottest_point(t.grid_day, "heat_index_c").select("date", "latitude", "longitude")
    return lb.label_point_day(days, heat_events(t)).select(day("date").alias("date"), "latitude", "longitude", *_OUT)


@query(
    "pseudo_target",
    ("grid_day",),
    """SELECT row_id, grid_id, round(least(1e0, greatest(0e0, (temp_c - 38) / 12e0, (heat_index_c - 41) / 12e0, (tmax_c - 42) / 1e1)), 6) AS heat,
      round(least(1e0, greatest(0e0, daily_precip_total / 50e0, daily_convective_precip / 3e1, cape / 25e2, pwat / 5e1, ivt / 4e2, wind_shear_850_200 / 6e1, flash_flood_risk / 4e0)), 6) AS flood FROM grid_day""",
)
def _(t):
    g = t.grid_day
    return g.select("row_id", "grid_id", r(lb.pseudo_target(g, "extreme_heat")).alias("heat"), r(lb.pseudo_target(g, "flash_flood")).alias("flood"))


def region_days(t):
    return lb.label_extreme_heat(region_day_topk_pool(t.grid_day, "heat_index_c", 3), heat_events(t))
