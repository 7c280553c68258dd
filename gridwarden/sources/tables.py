"""Readers: tables by suffix, feature records, boundaries, daily files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("csv", "json", "parquet")


def infer_format(path: str, fmt: str | None = None) -> str:
    if fmt:
        return fmt
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in FORMATS:
        return suffix
    raise ValueError(f"cannot tell the table format from path: {path}")


def read_table(
    spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None, whole_documents: bool = False
) -> DataFrame:
    """CSV, JSON or Parquet. Give a schema at scale: without one CSV and JSON need an extra pass.

    JSON is read as one record per line, which splits over tasks; ``whole_documents`` reads files that
    hold an array of records.
    """
    kind = infer_format(path, fmt)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "csv":
        return reader.option("header", True).option("inferSchema", schema is None).csv(path)
    if kind == "json":
        return reader.option("multiLine", whole_documents).json(path)
    return reader.parquet(path)


GRID_TYPE = "struct<id:string,lat:double,lon:double,elevation_m:double,region:string>"
POINT_FIELDS = (
    "temp_c",
    "rh_percent",
    "dewpoint_c",
    "precip_1h_mm",
    "precip_6h_mm",
    "precip_24h_mm",
    "wind_speed_mps",
    "wind_gust_mps",
    "soil_moisture_frac",
    "slope_deg",
    "impervious_frac",
    "vegetation_index",
    "pressure_hpa",
    "visibility_km",
    "coastal_distance_km",
    "pwat_mm",
    "ivt_kg_m_s",
    "cape_j_kg",
)
FEATURE_TYPE = f"grid {GRID_TYPE}, valid_time string, " + ", ".join(f"{c} double" for c in POINT_FIELDS)


def read_features_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Point features from one record, an array of records or ``{"features": [...]}``, or from lines of records."""
    schema = f"{FEATURE_TYPE}, features array<struct<{FEATURE_TYPE.replace('grid struct', 'grid: struct')}>>"
    raw = spark.read.schema(schema).option("multiLine", not lines).json(path)
    names = ["grid", "valid_time", *POINT_FIELDS]
    own = F.struct(*names)
    rows = raw.select(F.explode(F.coalesce("features", F.array(own))).alias("_f")).select("_f.*")
    return flatten_grid(rows.withColumn("valid_time", F.try_to_timestamp("valid_time")))


def flatten_grid(df: DataFrame) -> DataFrame:
    """Grid struct to the flat columns operators work on."""
    flat = {"grid_id": "grid.id", "latitude": "grid.lat", "longitude": "grid.lon", "elevation_m": "grid.elevation_m", "region": "grid.region"}
    return df.select(*[F.col(c).alias(n) for n, c in flat.items()], *[c for c in df.columns if c != "grid"])


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON FeatureCollection to one row per feature: a property map and the geometry as JSON text."""
    schema = "features array<struct<properties: map<string,string>, geometry: string>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select(F.explode("features").alias("_f")).select("_f.properties", "_f.geometry")


def boundary_columns(boundaries: DataFrame, name: tuple[str, ...] = ("province_name", "shapeName", "name"), ident: tuple[str, ...] = ("boundary_id", "shapeID", "id")) -> DataFrame:
    """Pick the first property present as province name and as boundary id."""

    def first(names: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.try_element_at("properties", F.lit(n)) for n in names])

    return boundaries.select(first(name).alias("province_name"), first(ident).alias("boundary_id"), "geometry")


def file_date(name: Column) -> Column:
    """Date of a file name that ends in ``_yyyymmdd`` before its suffix."""
    token = F.regexp_extract(name, r"_(\d{8})(?:\.[^./]+)*$", 1)
    return F.try_to_date(F.nullif(token, F.lit("")), "yyyyMMdd")


def discover_daily(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below a folder with their date (NULL if undated) and signature; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"[^/]+$", 0)
    return files.select(
        "path",
        name.alias("source_file"),
        file_date(name).alias("date"),
        F.col("length").alias("source_size_bytes"),
        F.unix_micros("modificationTime").alias("source_mtime_us"),
    )


def skipped_files(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.count(F.when(F.col("date").isNull(), 1)).alias("skipped_files"))


def read_daily(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """Rows of daily Parquet files with date and signature columns; undated files are left out."""
    rows = spark.read.option("pathGlobFilter", glob).parquet(path)
    meta = F.col("_metadata")
    tagged = rows.select(
        "*",
        meta["file_name"].alias("source_file"),
        meta["file_size"].alias("source_size_bytes"),
        F.unix_micros(meta["file_modification_time"]).alias("source_mtime_us"),
    )
    return tagged.withColumn("date", file_date(F.col("source_file"))).filter(F.col("date").isNotNull())
