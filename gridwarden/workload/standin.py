"""Driver tables projected onto layouts of gridded fields.

The given tables hold no grids, so each layout below is a plain projection of one of them, written in SQL
that Spark and other engines read alike. Operators never mention these tables; only the registered
queries use them. Every projection reads its whole table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from gridwarden.session import tune

_CELL = "(160 + ({a}) % 161) / 1e1 AS latitude, (340 + ({b}) % 221) / 1e1 AS longitude"
_REGION = (
    "CASE l_suppkey % 5 WHEN 0 THEN 'riyadh' WHEN 1 THEN 'makkah' WHEN 2 THEN 'eastern_province' "
    "WHEN 3 THEN 'asir' ELSE 'tabuk' END"
)
_PROVINCE = (
    "CASE l_suppkey % 6 WHEN 0 THEN 'Riyadh' WHEN 1 THEN 'makkah' WHEN 2 THEN 'Eastern Province' "
    "WHEN 3 THEN 'aseer' WHEN 4 THEN 'tabuk' ELSE '' END"
)
_LEVEL = (
    "CASE l_linenumber WHEN 1 THEN 925 WHEN 2 THEN 850 WHEN 3 THEN 700 WHEN 4 THEN 500 "
    "WHEN 5 THEN 300 WHEN 6 THEN 200 ELSE 100 END"
)
_PLACE = (
    "CASE o_orderkey % 12 WHEN 0 THEN 'Jeddah' WHEN 1 THEN 'Mecca' WHEN 2 THEN 'Riyadh' WHEN 3 THEN 'Dammam' "
    "WHEN 4 THEN 'Medina' WHEN 5 THEN 'Tabuk' WHEN 6 THEN 'Abha' WHEN 7 THEN 'Hail region' WHEN 8 THEN 'Hidden valley' "
    "WHEN 9 THEN 'Makkah and Riyadh' WHEN 10 THEN 'Najran' ELSE 'Jazan region' END"
)
_SQUARE = (
    "concat('POLYGON((', {x}, '.05 ', {y}, '.05, ', {x2}, '.05 ', {y}, '.05, ', {x2}, '.05 ', {y2}, '.05, ', "
    "{x}, '.05 ', {y2}, '.05, ', {x}, '.05 ', {y}, '.05))')"
).format(
    x="CAST(34 + o_custkey % 20 AS STRING)",
    x2="CAST(36 + o_custkey % 20 AS STRING)",
    y="CAST(16 + o_custkey % 14 AS STRING)",
    y2="CAST(18 + o_custkey % 14 AS STRING)",
)

STANDINS = {
    # Sub-daily observations: one row per event, a station is a cell.
    "obs": f"""
        SELECT event_id, user_id AS station, ts AS time, CAST(ts AS DATE) AS date, event_type, {_CELL.format(a='user_id * 37', b='user_id * 53')},
          15e0 + value % 35e0 AS temp_c,
          CASE WHEN event_id % 50 = 0 THEN -9999e0 ELSE 15e0 + value % 35e0 END AS temp_raw,
          5e0 + (event_id * 7) % 90 AS rh_percent,
          15e0 + value % 35e0 - (95 - (event_id * 7) % 90) / 5e0 AS dewpoint_c,
          ((event_id * 13) % 41 - 20) / 2e0 AS u10, ((event_id * 17) % 37 - 18) / 2e0 AS v10,
          value / 1e1 AS precipitation, value AS running_total, 950e0 + (event_id * 11) % 80 AS pressure_hpa,
          CASE WHEN event_id % 9 = 0 THEN NULL ELSE value / 1e1 END AS precip_1h_mm,
          CAST((event_id * 31) % 4000 AS DOUBLE) AS cape_j_kg
        FROM {{events}}""",
    # Daily grid rows with all indicators.
    "grid_day": f"""
        SELECT l_orderkey, l_linenumber, l_orderkey * 8 + l_linenumber AS row_id, CAST(l_shipdate AS DATE) AS date,
          {_CELL.format(a='l_partkey', b='l_suppkey * 3 + l_linenumber')},
          concat('g', CAST(l_partkey % 161 AS STRING), '_', CAST((l_suppkey * 3 + l_linenumber) % 221 AS STRING)) AS grid_id,
          {_REGION} AS region_id, {_PROVINCE} AS province_name,
          CASE l_returnflag WHEN 'R' THEN 'degraded' ELSE 'normal' END AS source_status,
          concat('file_', l_linestatus, '_', CAST(l_linenumber AS STRING)) AS source_file,
          l_quantity AS temp_c, l_quantity + 1e2 * l_tax AS tmax_c, l_quantity - 1e2 * l_discount AS tmin_c,
          1e3 * l_discount AS rh2m, 2e2 * l_tax AS wind10_speed, l_quantity * 12e-1 AS heat_index_c, l_extendedprice / 2e4 AS vpd_kpa,
          l_extendedprice / 2e3 AS daily_precip_total, l_extendedprice * l_tax / 2e2 AS daily_convective_precip,
          l_extendedprice / 2e3 - l_extendedprice * l_tax / 2e2 AS daily_large_scale_precip,
          CAST((l_orderkey * 31) % 4000 AS DOUBLE) AS cape, l_extendedprice / 15e2 AS pwat, l_extendedprice / 2e2 AS ivt,
          25e1 * l_tax AS wind850_speed, 5e2 * l_discount AS wind_shear_850_200, 1e1 * l_tax AS flash_flood_risk,
          CASE WHEN l_linenumber = 7 THEN NULL ELSE 8e0 * l_discount END AS dust_aod, l_tax / 1e2 AS dust_column_mass,
          CASE WHEN l_linenumber = 6 THEN NULL ELSE l_discount / 1e2 END AS dust_surface_mass,
          CASE WHEN l_linenumber = 5 THEN NULL ELSE l_quantity / 2e0 END AS sst_celsius,
          l_quantity - 25e0 AS t2m_anomaly_c, CASE WHEN l_quantity >= 40 THEN 1e0 ELSE 0e0 END AS heatwave_day_flag,
          CAST(l_linenumber AS DOUBLE) AS heatwave_duration_days
        FROM {{lineitem}}""",
    # Point features with the inputs of every risk rule; some values missing.
    "points": f"""
        SELECT l_orderkey * 8 + l_linenumber AS row_id, concat('p', CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING)) AS grid_id,
          l_shipdate AS valid_time, {_CELL.format(a='l_partkey', b='l_suppkey * 3 + l_linenumber')},
          l_quantity AS temp_c, CASE WHEN l_linenumber = 7 THEN NULL ELSE 1e3 * l_discount END AS rh_percent,
          l_quantity - 1e2 * l_discount AS dewpoint_c, l_extendedprice / 3e3 AS precip_1h_mm, l_extendedprice / 1e3 AS precip_6h_mm,
          l_extendedprice / 5e2 AS precip_24h_mm, 2e2 * l_tax AS wind_speed_mps,
          CASE WHEN l_linenumber = 6 THEN NULL ELSE 3e2 * l_tax END AS wind_gust_mps, 3e0 * l_discount AS soil_moisture_frac,
          CAST(l_partkey % 40 AS DOUBLE) AS slope_deg, 6e0 * l_tax AS impervious_frac, 5e0 * l_discount AS vegetation_index,
          950e0 + l_orderkey % 80 AS pressure_hpa, CAST(l_suppkey % 20 AS DOUBLE) AS visibility_km,
          CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST(l_partkey % 300 AS DOUBLE) END AS coastal_distance_km,
          CASE l_returnflag WHEN 'R' THEN 'degraded' ELSE 'normal' END AS source_status
        FROM {{lineitem}}""",
    # Static 2-d field on contiguous cells; a sheet is one full grid.
    "field": """
        SELECT CAST(floor(p_partkey / 35581e0) AS BIGINT) AS sheet, p_partkey,
          (160 + floor((p_partkey % 35581) / 221e0)) / 1e1 AS latitude, (340 + (p_partkey % 35581) % 221) / 1e1 AS longitude,
          p_retailprice + 3e0 * p_size AS elevation_m, CAST((p_size * 7) % 31 AS DOUBLE) AS u, CAST((p_size * 11) % 29 AS DOUBLE) AS v
        FROM {part}""",
    # Air columns: one profile per order with up to seven levels.
    "profiles": f"""
        SELECT l_orderkey AS profile, {_LEVEL} AS level, max(1e-3 * (1e0 + 1e2 * l_discount)) AS q, max(l_quantity - 25e0) AS u,
          max(3e2 * l_tax - 12e0) AS v, max(l_extendedprice) AS z
        FROM {{lineitem}} GROUP BY 1, 2""",
    # Event catalogue.
    "catalogue": f"""
        SELECT o_orderkey AS ingest_seq, concat('ev', CAST(o_orderkey AS STRING)) AS event_id, 'flash_flood' AS hazard_type,
          CAST(date_trunc('month', o_orderdate) AS DATE) + CAST(o_custkey % 10 AS INT) AS start_date,
          CAST(date_trunc('month', o_orderdate) AS DATE) + CAST(o_custkey % 10 + o_orderkey % 4 AS INT) AS end_date,
          {_PLACE} AS location_name, 'SAU' AS country_code,
          CASE WHEN o_orderkey % 3 = 0 THEN (160 + (o_custkey * 7) % 161) / 1e1 END AS latitude,
          CASE WHEN o_orderkey % 3 = 0 THEN (340 + (o_custkey * 11) % 221) / 1e1 END AS longitude,
          CASE WHEN o_orderkey % 5 = 1 THEN {_SQUARE} END AS geometry_wkt,
          CASE o_orderkey % 7 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'medium' END AS spatial_confidence, 'high' AS temporal_confidence,
          concat('src_', o_orderstatus) AS source_name, '' AS source_url,
          CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('r', CAST(o_orderkey AS STRING)) END AS source_record_id,
          CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'seed' ELSE 'draft' END AS validation_status, '' AS severity, '' AS notes
        FROM {{orders}}""",
    # Province boundaries: 25 squares in a 5 x 5 lattice with gaps; some have a hole.
    "boundaries": """
        SELECT lower(n_name) AS province_name, concat('b', CAST(n_nationkey AS STRING)) AS boundary_id, n_nationkey,
          (160 + 32 * (n_nationkey % 5)) / 1e1 AS lat0, (340 + 44 * floor(n_nationkey / 5e0)) / 1e1 AS lon0
        FROM {nation}""",
}


def standin_sql(name: str) -> str:
    """The projection as SQL over the plain table names."""
    tables = ("events", "lineitem", "part", "orders", "nation")
    return STANDINS[name].format(**{t: t for t in tables}).strip()


class Tables:
    """Lazy access to the given tables and their projections in one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = tune(spark), folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def standin(self, name: str) -> DataFrame:
        tables = ("events", "lineitem", "part", "orders", "nation")
        return self.spark.sql(STANDINS[name].format(**{t: f"parquet.`{self.folder}/{t}.parquet`" for t in tables}))

    @cached_property
    def obs(self) -> DataFrame:
        return self.standin("obs")

    @cached_property
    def grid_day(self) -> DataFrame:
        return self.standin("grid_day")

    @cached_property
    def points(self) -> DataFrame:
        return self.standin("points")

    @cached_property
    def field(self) -> DataFrame:
        return self.standin("field")

    @cached_property
    def profiles(self) -> DataFrame:
        return self.standin("profiles")

    @cached_property
    def catalogue(self) -> DataFrame:
        return self.standin("catalogue")

    @cached_property
    def boundaries(self) -> DataFrame:
        """Boundaries with their squares as WKT text; squares of every seventh province have a hole."""
        from pyspark.sql import functions as F

        def ring(low: float, high_lat: float, high_lon: float) -> object:
            y0, y1, x0, x1 = F.col("lat0") + low, F.col("lat0") + high_lat, F.col("lon0") + low, F.col("lon0") + high_lon
            corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
            return F.concat(F.lit("("), F.concat_ws(", ", *[F.format_string("%.4f %.4f", x, y) for x, y in corners]), F.lit(")"))

        outer, hole = ring(0.0, 3.0, 4.0), ring(1.0, 2.0, 2.0)
        body = F.when(F.col("n_nationkey") % 7 == 0, F.concat(outer, F.lit(", "), hole)).otherwise(outer)
        return self.standin("boundaries").withColumn("geometry", F.concat(F.lit("POLYGON("), body, F.lit(")")))
