"""Writers: tables, date-partitioned exports with manifest, incremental merge, summaries, triples."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwarden.operators.graph import ntriples_lines
from gridwarden.sources.tables import infer_format

SIGNATURE = ("source_file", "source_size_bytes", "source_mtime_us")


#: Files that a task of a partitioned write may hold open at a time.
OPEN_FILES = 8


@contextmanager
def unsorted_writes(spark: SparkSession) -> Iterator[None]:
    """Partitioned writes inside do not sort a task's rows first, unless they belong to more than ``OPEN_FILES`` partitions."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(OPEN_FILES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def write_table(df: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite") -> None:
    """CSV with header, JSON records or Parquet, as a folder of part files."""
    kind = infer_format(path, fmt)
    if kind == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    elif kind == "json":
        df.write.mode(mode).json(path)
    else:
        df.write.mode(mode).parquet(path)


def write_features_json(df: DataFrame, path: str) -> None:
    """Point features as nested records, the inverse of the flat layout; compressed, as each record repeats its names."""
    grid = F.struct(
        F.col("grid_id").alias("id"),
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        *[F.col(c) for c in ("elevation_m", "region") if c in df.columns],
    )
    flat = ("grid_id", "latitude", "longitude", "elevation_m", "region")
    df.select(grid.alias("grid"), *[c for c in df.columns if c not in flat]).write.mode("overwrite").option("compression", "gzip").json(path)


def export_daily(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by date; only dates in the input are replaced.

    The rebalance hint groups rows of a date and lets adaptive execution split a large one.
    """
    df.hint("rebalance", "date").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def export_range(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Days of a stored table; the filter prunes partitions."""
    return spark.read.parquet(path).filter(F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def build_manifest(requested: DataFrame, built: DataFrame, existing: DataFrame | None = None, kind: str = "indicator_table", facts: Sequence[str] = ()) -> DataFrame:
    """One row per requested day: exists (before the run), ok (built now) or error (neither).

    ``metadata`` is a JSON object: for days built now their rows and, for each column in ``facts`` (such as the sources
    used), its distinct values; empty for others.
    """
    days = requested.select("date").distinct()
    told = F.to_json(F.struct(F.count("*").alias("rows"), *[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in facts]))
    now = built.groupBy("date").agg(told.alias("_told")).withColumn("_new", F.lit(True))
    out = days.join(now, "date", "left")
    if existing is not None:
        out = out.join(existing.select("date").distinct().withColumn("_old", F.lit(True)), "date", "left")
    else:
        out = out.withColumn("_old", F.lit(None).cast("boolean"))
    status = F.when(F.col("_old"), "exists").when(F.col("_new"), "ok").otherwise("error")
    detail = F.when(F.col("_old"), "kept stored day").when(F.col("_new"), "built").otherwise("no input for day")
    return out.select(F.lit(kind).alias("kind"), F.col("date").cast("string").alias("identifier"), status.alias("status"), detail.alias("detail"), F.when(status == "ok", F.col("_told")).otherwise("{}").alias("metadata"))


def missing_days(requested: DataFrame, existing: DataFrame) -> DataFrame:
    """Days still to build."""
    return requested.select("date").distinct().join(existing.select("date").distinct(), "date", "left_anti")


def incremental_upsert(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Replace the rows of changed files, add new files, keep the rest.

    A file is unchanged if its name, size and modification time are already in the table.
    """
    if existing is None:
        return incoming
    known = existing.select(*SIGNATURE).distinct()
    changed = incoming.join(known, list(SIGNATURE), "left_anti")
    kept = existing.join(changed.select("source_file").distinct(), "source_file", "left_anti")
    return kept.unionByName(changed, allowMissingColumns=True)


def upsert_report(existing: DataFrame, incoming_files: DataFrame) -> DataFrame:
    """Files seen and files skipped as unchanged."""
    known = existing.select(*SIGNATURE).distinct().withColumn("_known", F.lit(1))
    files = incoming_files.select(*SIGNATURE).distinct().join(known, list(SIGNATURE), "left")
    return files.agg(F.count("*").alias("files"), F.count("_known").alias("skipped_files"))


def write_with_summary(df: DataFrame, path: str, summary: DataFrame) -> DataFrame:
    """Write a table and its one-row summary beside it; the old table goes only once the new one has been opened.

    The new files are written next to the table, read once in full, and then renamed into its place.
    """
    spark = df.sparkSession
    fresh = f"{path}.new-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    spark.read.parquet(fresh).write.format("noop").mode("overwrite").save()
    summary.coalesce(1).write.mode("overwrite").json(f"{path}.summary")
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    target = jvm_path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(target, True)
    if not files.rename(jvm_path(fresh), target):
        raise OSError(f"{fresh} could not be renamed to {path}")
    return spark.read.parquet(path)


def mean_std_payload(stats: DataFrame) -> DataFrame:
    """Channel statistics as one JSON row: means and deviations per (variable, level), overall per variable.

    The input has one row per channel, a short list fixed by the data set's layout.
    """
    channel = F.concat_ws("-", "variable", F.col("level").cast("string"))
    one = stats.withColumn("_k", F.when(F.col("is_overall") == 0, channel).otherwise(F.concat("variable", F.lit("_overall"))))
    pair = lambda v: F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", v))))
    out = one.agg(pair("mean").alias("mean"), pair("std").alias("std"), F.sum(F.when(F.col("is_overall") == 0, F.col("count"))).alias("count"))
    return out.select(F.to_json(F.struct("mean", "std", "count")).alias("value"))


def write_triples(triples: DataFrame, path: str) -> None:
    """One line per triple; compressed, as lines repeat their names."""
    ntriples_lines(triples).write.mode("overwrite").option("compression", "gzip").text(path)


