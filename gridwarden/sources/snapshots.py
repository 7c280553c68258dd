"""Tables of parts with a log of snapshots: a commit replaces some parts, readers never meet a gap.

Layout of a table's folder: ``data/<commit>/`` holds the rows a commit wrote, one sub-folder per part;
``log/v=<number>`` is a small table (part, folder) of all parts as of that version. A version counts once Spark has
finished writing it, which is the last step of a commit: a commit that breaks off leaves the version before it
as it was, and its rows are read by nobody. Readers follow the newest version; folders go only when ``expire`` is
asked to drop the versions that name them. Two commits at one time: the later one finds its version taken and fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwarden.session import cut_lineage
from gridwarden.sources.store import SIGNATURE, unsorted_writes

#: Column of the part in the log and in the folders' names.
PART = "part"
_LOG = f"{PART} string, folder string"


def _folder(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions, ascending."""
    log, files = _folder(spark, f"{path}/log")
    if not files.exists(log):
        return []
    names = [f.getPath().getName() for f in files.listStatus(log)]
    done = [n for n in names if n.startswith("v=") and files.exists(_folder(spark, f"{path}/log/{n}/_SUCCESS")[0])]
    return sorted(int(n[2:]) for n in done)


def parts_of(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(part, folder) of a version, the newest by default; no rows before the first commit."""
    known = versions(spark, path)
    if version is None and not known:
        return spark.createDataFrame([], _LOG)
    return spark.read.schema(_LOG).parquet(f"{path}/log/v={known[-1] if version is None else version}")


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Rows of a version, the newest by default, with their ``part``.

    The folders' names come to the driver, as a file listing would; a commit keeps one folder for all its parts.
    """
    log = parts_of(spark, path, version)
    folders = sorted(r["folder"] for r in log.select("folder").distinct().collect())
    if not folders:
        raise FileNotFoundError(f"{path} has no rows")
    rows = spark.read.option("basePath", f"{path}/data").option("mergeSchema", "true").parquet(*[f"{path}/data/{f}" for f in folders])
    # folders of older commits hold parts that were replaced since
    own = F.regexp_extract(F.col("_metadata.file_path"), r"/data/(commit=[0-9a-f]+)/", 1)
    rows = rows.withColumns({"_folder": own, PART: F.col(PART).cast("string")})
    return rows.join(log.withColumnRenamed("folder", "_folder"), [PART, "_folder"], "left_semi").drop("_folder", "commit")


def commit(spark: SparkSession, path: str, rows: DataFrame, part: str, gone: DataFrame | None = None, together: bool = False) -> int:
    """Replace the parts that ``rows`` have (by their column ``part``), drop those in ``gone``, keep all others; returns the version.

    Only the given rows are written. A part with rows in ``gone`` and in ``rows`` is replaced. ``together`` says that a task
    has rows of few parts already, so they are written as they come, neither dealt anew nor sorted.
    """
    known = versions(spark, path)
    folder = f"commit={uuid.uuid4().hex}"
    named = rows.withColumn(PART, F.col(part).cast("string"))
    if together:
        with unsorted_writes(spark):
            named.write.partitionBy(PART).parquet(f"{path}/data/{folder}")
    else:
        named.hint("rebalance", PART).write.partitionBy(PART).parquet(f"{path}/data/{folder}")
    before = parts_of(spark, path)
    written = f"{path}/data/{folder}"
    fresh = spark.read.option("basePath", written).parquet(written).select(F.col(PART).cast("string").alias(PART)).distinct() if _has_files(spark, written) else before.select(PART).limit(0)
    fresh = cut_lineage(fresh, "snapshot-parts")
    kept = before.join(fresh, PART, "left_anti")
    if gone is not None:
        kept = kept.join(gone.select(F.col(gone.columns[0]).cast("string").alias(PART)).distinct(), PART, "left_anti")
    version = (known[-1] if known else 0) + 1
    kept.unionByName(fresh.withColumn("folder", F.lit(folder))).write.mode("errorifexists").parquet(f"{path}/log/v={version}")
    return version


def _has_files(spark: SparkSession, path: str) -> bool:
    folder, files = _folder(spark, path)
    return any(f.isDirectory() for f in files.listStatus(folder))


def replace_table(spark: SparkSession, path: str, rows: DataFrame) -> int:
    """A commit in which the given rows are all: readers see the old table until the new one is whole."""
    return commit(spark, path, rows.withColumn("_whole", F.lit("all")), "_whole", parts_of(spark, path).select(PART))


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the newest versions and the folders that only they name; returns how many folders went.

    Readers of a version that goes must have ended, so ``keep`` says how many commits a reader may take.
    """
    known = versions(spark, path)
    stay = known[-keep:]
    if not stay:
        return 0
    used = {r["folder"] for v in stay for r in parts_of(spark, path, v).select("folder").distinct().collect()}
    for v in known[:-keep]:
        folder, files = _folder(spark, f"{path}/log/v={v}")
        files.delete(folder, True)
    data, files = _folder(spark, f"{path}/data")
    old = [f.getPath() for f in files.listStatus(data) if f.getPath().getName() not in used]
    for folder in old:
        files.delete(folder, True)
    return len(old)


def update_from_files(spark: SparkSession, path: str, source: str, build: Callable[[DataFrame], DataFrame], schema, glob: str = "*.parquet") -> dict[str, int]:
    """Bring a table up to date with a folder of files: one part per file, rebuilt if its size or time has changed.

    Returns the files seen, those skipped as unchanged, and the version (0 if nothing was to be done). Parts of files that
    are gone are dropped in the same commit. ``build`` sees rows with ``source_file`` and keeps that column.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(source)
    files = listed.select(F.col("path").alias("source_file"), F.col("length").alias("source_size_bytes"), F.unix_micros("modificationTime").alias("source_mtime_us"))
    files = cut_lineage(files, "snapshot-files")
    known = versions(spark, path)
    old = read_snapshot(spark, f"{path}/files").select(*SIGNATURE) if versions(spark, f"{path}/files") else files.limit(0)
    changed = files.join(old, list(SIGNATURE), "left_anti")
    gone = old.join(files, "source_file", "left_anti").select("source_file")
    paths = sorted(r["source_file"] for r in changed.select("source_file").collect())
    dropped = gone.count()
    seen = files.count()
    if not paths and not dropped:
        return {"files": seen, "skipped": seen, "version": 0}
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    built = build(rows.withColumn("source_file", F.col("_metadata.file_path") if paths else F.lit("")))
    part = F.md5("source_file")
    # a file that changed and gives no rows now loses its part as well
    leaving = gone.union(changed.select("source_file")).select(part.alias(PART)) if known else None
    # a task reads whole files or pieces of one, so its rows are of few parts
    version = commit(spark, path, built.withColumn("_part", part), "_part", leaving, together=True)
    # the signatures come last: a run that breaks off before is repeated
    replace_table(spark, f"{path}/files", files.select(*SIGNATURE))
    return {"files": seen, "skipped": seen - len(paths), "version": version}


def changed_parts(spark: SparkSession, path: str, version: int) -> DataFrame:
    """Parts that a version wrote or dropped, against the one before it."""
    now, before = parts_of(spark, path, version), parts_of(spark, path, version - 1)
    return now.exceptAll(before).select(PART).union(before.exceptAll(now).select(PART)).distinct()
