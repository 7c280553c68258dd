"""The batch operators as Structured Streaming queries.

Aggregating streams run in update mode: each micro-batch stores the rows it changed, and a reader takes
the last state of each key. So open windows are visible, nothing waits for a watermark to pass, and the
watermark only bounds the state. Rows later than the watermark are dropped, and ``late_rows`` tells how many.

Where late rows must count, ``accumulate_into`` keeps no state in executors: each micro-batch stores its own partial
aggregates, whatever its times, and a reader merges them. Tables of both kinds are folded by ``compact`` into
one row per key, so their files stay in proportion to the keys and not to the batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import date

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridwarden.functions.physical import precip_flag
from gridwarden.operators.features import numeric_feature_columns
from gridwarden.operators.labels import FloodCatalogue, FloodLabelPolicy, with_day_provenance
from gridwarden.operators.risk import scan_risks
from gridwarden.operators.temporal import heatwave_runs
from gridwarden.session import cut_lineage
from gridwarden.sources.store import SIGNATURE

CELL = ("latitude", "longitude")
_EPOCH = date(1970, 1, 1).toordinal()


def stream_daily_precip(rows: DataFrame, value: str = "precipitation", delay: str = "2 hours", cell: Sequence[str] = CELL) -> DataFrame:
    """Daily totals, largest step and flag over a watermarked stream of rain steps."""
    out = rows.withWatermark("time", delay).groupBy(F.window("time", "1 day").alias("w"), *cell)
    out = out.agg(F.sum(value).alias("daily_precip_total_mm"), F.max(value).alias("daily_precip_max_step_mm"))
    out = out.select(F.to_date("w.start").alias("date"), *cell, "daily_precip_total_mm", "daily_precip_max_step_mm")
    return out.withColumn("daily_precip_extreme_flag", precip_flag("daily_precip_total_mm"))


def stream_rolling_precip(rows: DataFrame, value: str = "precipitation", days: int = 3, delay: str = "2 hours", cell: Sequence[str] = CELL) -> DataFrame:
    """Totals over sliding windows of N days, named by their last day."""
    out = rows.withWatermark("time", delay).groupBy(F.window("time", f"{days} days", "1 day").alias("w"), *cell)
    out = out.agg(F.sum(value).alias(f"precip_{days}day"))
    return out.select(F.date_sub(F.to_date("w.end"), 1).alias("date"), *cell, f"precip_{days}day")


def stream_risk_scan(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """All hazards per row: a stateless projection."""
    return scan_risks(rows, keep)


def stream_province_day(rows: DataFrame, lookup: DataFrame, delay: str = "1 day", province: str = "province_name") -> DataFrame:
    """Province-day means: a stream-static join with a prepared lookup (rounded coordinates, one row each)."""
    names = numeric_feature_columns(rows)
    joined = rows.withColumns({"_la": F.bround("latitude", 4), "_lo": F.bround("longitude", 4)}).join(
        lookup.select(F.col("latitude").alias("_la"), F.col("longitude").alias("_lo"), province), ["_la", "_lo"]
    )
    out = joined.filter(F.col(province).isNotNull()).withWatermark("time", delay)
    out = out.groupBy(F.window("time", "1 day").alias("w"), province).agg(
        F.count("*").alias("grid_cell_count"), *[F.avg(c).alias(c) for c in names]
    )
    return out.select(F.to_date("w.start").alias("date"), province, "grid_cell_count", *names)


_RUN_STATE = "starts array<int>, ends array<int>"


def stream_heatwave_runs(rows: DataFrame, flag: str = "heatwave_day_flag", delay: str = "2 days", cell: Sequence[str] = CELL) -> DataFrame:
    """Runs of consecutive flagged days per cell, open ones too: (cell, start_date, end_date, duration_days).

    To be stored with ``update_into`` and read by (cell, start_date): a run comes again whenever it grows, and a
    start that was joined to an earlier run comes with duration 0. The state holds the runs that rows within
    the watermark can still change; a timer drops a cell's state once the watermark has passed its last run.
    """
    days = rows.filter(F.col(flag) == 1).withWatermark("time", delay).select(*cell, "time", F.unix_date(F.to_date("time")).alias("_day"))
    schema = T.StructType([*[days.schema[c] for c in cell], T.StructField("start_date", T.DateType()), T.StructField("end_date", T.DateType()), T.StructField("duration_days", T.LongType())])

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        runs = dict(zip(*state.get, strict=True)) if state.exists else {}
        changed = set()
        for day in sorted({int(d) for frame in frames for d in frame["_day"]}):
            near = [a for a, b in runs.items() if a - 1 <= day <= b + 1]
            start, end = min([day, *near]), max([day, *[runs[a] for a in near]])
            if near != [start] or runs[start] != end:
                changed |= {start, *near}
                for a in near:
                    del runs[a]
                runs[start] = end
        out = [(*key, date.fromordinal(_EPOCH + a), date.fromordinal(_EPOCH + runs.get(a, a)), runs[a] - a + 1 if a in runs else 0) for a in sorted(changed)]
        done = state.getCurrentWatermarkMs() // 86_400_000 - 1
        open_ = sorted((a, b) for a, b in runs.items() if b >= done)
        if open_:
            state.update(([a for a, _ in open_], [b for _, b in open_]))
            # the day after the last one that a row could still join
            state.setTimeoutTimestamp((max(b for _, b in open_) + 2) * 86_400_000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=schema.names)

    return days.groupBy(*cell).applyInPandasWithState(step, schema, _RUN_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def late_rows(query: StreamingQuery) -> int:
    """Rows the stateful operators dropped because they came after the watermark, over all batches still reported."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def append_to(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run what is available into a Parquet table, in append mode."""
    return rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def update_into(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run what is available; each micro-batch stores its changed rows under its own number, so a retry replaces them."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start()


def latest_state(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Last stored row per key of an update stream."""
    return _last_of(keys)(stored_batches(spark, path)).drop("batch")


def _last_of(keys: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Rows of several batches to the last one per key, with its batch."""

    def merge(rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in keys and c != "batch"]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"), F.max("batch").alias("batch")).select(*keys, "_v.*", "batch")

    return merge


def _steps(value: str) -> Column:
    return F.collect_list(F.when(F.col(value).isNotNull(), F.struct("time", F.col(value).cast("double").alias("value"))))


def _sum_of_steps(steps: str) -> Column:
    return F.when(F.size(steps) > 0, F.aggregate(F.sort_array(steps), F.lit(0.0), lambda total, step: total + step["value"]))


#: How partial aggregates are made from rows and merged with each other. ``sum_by_time`` keeps the values with their ``time`` and
#: adds them in that order when they are read: sums of doubles that do not hang on how rows arrived. It is meant for keys with few rows, as a cell's day.
MAKES = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count, "sum_by_time": _steps}
MERGES = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.sum, "sum_by_time": lambda name: F.flatten(F.collect_list(name))}


def _merged(keys: Sequence[str], parts: Mapping[str, tuple[str, str]]) -> Callable[[DataFrame], DataFrame]:
    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*[MERGES[kind](name).alias(name) for name, (kind, _) in parts.items()], F.max("batch").alias("batch"))

    return merge


def accumulate_into(
    rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str], parts: Mapping[str, tuple[str, str]], prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows
) -> StreamingQuery:
    """Run what is available; each micro-batch stores its partial aggregates ``{name: (kind, column)}`` per key.

    No row is too late: a batch holds whatever times came in it. ``prepare`` makes the key columns in a batch.
    A batch that is run again replaces its rows.
    """

    def store(batch: DataFrame, number: int) -> None:
        prepare(batch).groupBy(*keys).agg(*[MAKES[kind](c).alias(name) for name, (kind, c) in parts.items()]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start()


def accumulated(spark: SparkSession, path: str, keys: Sequence[str], parts: Mapping[str, tuple[str, str]]) -> DataFrame:
    """The whole aggregate of everything that ``accumulate_into`` has stored: one row per key."""
    merged = _merged(keys, parts)(stored_batches(spark, path)).drop("batch")
    return merged.withColumns({name: _sum_of_steps(name) for name, (kind, _) in parts.items() if kind == "sum_by_time"})


def _children(spark: SparkSession, path: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in system.listStatus(folder)) if system.exists(folder) else []


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the finished tables ``<prefix><number>`` in a folder."""
    found = [int(name.removeprefix(prefix)) for name in _children(spark, path) if name.startswith(prefix)]
    return sorted(n for n in found if "_SUCCESS" in _children(spark, f"{path}/{prefix}{n}"))


def stored_batches(spark: SparkSession, path: str) -> DataFrame:
    """Rows with their ``batch``: those of the newest folded table and of all finished batches behind it."""
    folds = _numbers(spark, f"{path}/folded", "upto=")
    upto = folds[-1] if folds else -1
    behind = [n for n in _numbers(spark, path, "batch=") if n > upto]
    parts = [spark.read.parquet(f"{path}/folded/upto={upto}")] if folds else []
    if behind:
        rows = spark.read.option("basePath", path).parquet(*[f"{path}/batch={n}" for n in behind])
        parts.append(rows.withColumn("batch", F.col("batch").cast("long")))
    if not parts:
        raise FileNotFoundError(f"{path} holds no finished batch")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def compact(spark: SparkSession, path: str, keys: Sequence[str], parts: Mapping[str, tuple[str, str]] | None = None) -> int:
    """Fold all finished batches into one row per key; returns the number of the last batch folded, -1 for none.

    ``parts`` are those of ``accumulate_into``; without them the table is one of ``update_into``. The folded table is
    written beside the batches and counts once it is finished: Spark marks that as the last thing it does. What it
    replaces goes only after that, and readers pass over it in any case, so a run that breaks off at any step loses nothing and counts
    nothing twice. A batch that a restarted query runs again is at most the last one, with the same rows.
    """
    folds, batches = _numbers(spark, f"{path}/folded", "upto="), _numbers(spark, path, "batch=")
    last = max([*folds, *batches], default=-1)
    if not folds or last > folds[-1]:
        if last < 0:
            return -1
        merge = _merged(keys, parts) if parts else _last_of(keys)
        merge(stored_batches(spark, path)).withColumn("batch", F.col("batch").cast("long")).write.mode("overwrite").parquet(f"{path}/folded/upto={last}")
    for old in [*[f"{path}/folded/upto={n}" for n in folds if n < last], *[f"{path}/batch={n}" for n in batches if n <= last]]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(old)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return last


#: Partial aggregates of the daily rain totals and of the flagged days, and their keys but for the cell.
RAIN_PARTS = {"daily_precip_total_mm": ("sum_by_time", "precipitation"), "daily_precip_max_step_mm": ("max", "precipitation")}
FLAG_PARTS = {"heatwave_day_flag": ("max", "heatwave_day_flag")}


def on_days(rows: DataFrame) -> DataFrame:
    """Rows with the date of their time."""
    return rows.withColumn("date", F.to_date("time"))


def whole_daily_precip(spark: SparkSession, path: str, cell: Sequence[str] = CELL) -> DataFrame:
    """Daily totals, largest step and flag, late rows included (``RAIN_PARTS`` by date and cell)."""
    return accumulated(spark, path, ["date", *cell], RAIN_PARTS).withColumn("daily_precip_extreme_flag", precip_flag("daily_precip_total_mm"))


def whole_rolling_precip(spark: SparkSession, path: str, days: int = 3, cell: Sequence[str] = CELL) -> DataFrame:
    """Totals over windows of N days named by their last day, late rows included (``RAIN_PARTS`` by date and cell)."""
    daily = accumulated(spark, path, ["date", *cell], RAIN_PARTS)
    spread = daily.withColumn("date", F.explode(F.sequence("date", F.date_add("date", days - 1))))
    return spread.groupBy("date", *cell).agg(F.sum("daily_precip_total_mm").alias(f"precip_{days}day"))


def whole_heatwave_runs(spark: SparkSession, path: str, cell: Sequence[str] = CELL) -> DataFrame:
    """Runs of flagged days, late rows included, by windows over cell-days (``FLAG_PARTS`` by date and cell)."""
    return heatwave_runs(accumulated(spark, path, ["date", *cell], FLAG_PARTS), cell=cell)


def province_parts(names: Sequence[str]) -> dict[str, tuple[str, str]]:
    """Partial aggregates of province-day means."""
    return {"grid_cell_count": ("count", "date")} | {f"{n}_{kind}": (kind, n) for n in names for kind in ("sum", "count")}


def in_provinces(lookup: DataFrame, province: str = "province_name") -> Callable[[DataFrame], DataFrame]:
    """Dated rows with the province of their rounded coordinate; others go."""
    known = lookup.select(F.col("latitude").alias("_la"), F.col("longitude").alias("_lo"), province).filter(F.col(province).isNotNull())

    def prepare(rows: DataFrame) -> DataFrame:
        return on_days(rows).withColumns({"_la": F.bround("latitude", 4), "_lo": F.bround("longitude", 4)}).join(known, ["_la", "_lo"])

    return prepare


def whole_province_day(spark: SparkSession, path: str, names: Sequence[str], province: str = "province_name") -> DataFrame:
    """Province-day means, late rows included."""
    out = accumulated(spark, path, ["date", province], province_parts(names))
    return out.select("date", province, "grid_cell_count", *[F.try_divide(f"{n}_sum", f"{n}_count").alias(n) for n in names])


def stream_label(
    samples: DataFrame, events: DataFrame, path: str, checkpoint: str, policy: FloodLabelPolicy = FloodLabelPolicy(), order: str = "event_id"
) -> StreamingQuery:
    """Label each micro-batch against the event catalogue with the batch operator.

    The catalogue's tables are made once. A batch stores its labels with the samples' own part of the provenance, and under
    ``days`` the other part, once for each of its days; ``stream_labels`` puts them together.
    """
    catalogue = FloodCatalogue(events, policy, order)

    def store(batch: DataFrame, number: int) -> None:
        stored = f"{path}/batch={number}"
        catalogue.label(batch, whole=False).write.mode("overwrite").parquet(stored)
        dates = batch.sparkSession.read.parquet(stored).select("date").distinct()
        catalogue.day_provenance().join(dates, "date", "left_semi").write.mode("overwrite").parquet(f"{path}/days/batch={number}")

    return samples.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start()


def stream_labels(spark: SparkSession, path: str) -> DataFrame:
    """What ``stream_label`` has stored, with whole provenance."""
    labels = spark.read.option("basePath", path).parquet(f"{path}/batch=*").withColumnRenamed("batch", "_batch")
    days = spark.read.option("basePath", f"{path}/days").parquet(f"{path}/days/batch=*").withColumnRenamed("batch", "_batch")
    return with_day_provenance(labels, days, ["_batch", "date"]).drop("_batch")


def stream_incremental_table(spark: SparkSession, source: str, schema, transform: Callable[[DataFrame], DataFrame], path: str, state: str, glob: str = "*.parquet") -> int:
    """One run of the incremental table: reads new and changed files, returns how many.

    A file is known by full path, size and modification time; the file stream source would never read a path
    twice, so the files are listed and compared with the signatures stored in ``state``. A file's rows are
    one partition, replaced as a whole. Signatures are stored after the rows: a run that breaks off is repeated.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(source)
    files = listed.select(F.col("path").alias("source_file"), F.col("length").alias("source_size_bytes"), F.unix_micros("modificationTime").alias("source_mtime_us"))
    known = _signatures(spark, state)
    changed = cut_lineage(files if known is None else files.join(known, list(SIGNATURE), "left_anti"), "stream-files")
    paths = [r["source_file"] for r in changed.collect()]  # names only, as any file source holds them
    if not paths:
        return 0
    meta = F.col("_metadata")
    rows = spark.read.schema(schema).parquet(*paths).select("*", meta["file_path"].alias("source_file"), F.unix_micros(meta["file_modification_time"]).alias("source_mtime_us"))
    out = transform(rows).withColumn("source_key", F.md5("source_file")).hint("rebalance", "source_key")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_key").parquet(path)
    changed.write.mode("overwrite").parquet(f"{state}/{uuid.uuid4().hex}")
    return len(paths)


def _signatures(spark: SparkSession, state: str) -> DataFrame | None:
    """Signatures of all runs so far; None before the first."""
    try:
        return spark.read.option("recursiveFileLookup", "true").parquet(state).select(*SIGNATURE).distinct()
    except AnalysisException:
        return None


def incremental_rows(spark: SparkSession, path: str, source: str, glob: str = "*.parquet") -> DataFrame:
    """Rows of the table that belong to the files as they are now; those of deleted or since emptied files are left out."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(source)
    files = listed.select(F.md5("path").alias("source_key"), F.unix_micros("modificationTime").alias("source_mtime_us"))
    return spark.read.parquet(path).join(files, ["source_key", "source_mtime_us"], "left_semi")
