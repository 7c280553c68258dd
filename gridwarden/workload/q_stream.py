"""Queries of the streaming operators: the given tables read as streams, results equal to batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwarden.operators import events as ev
from gridwarden.session import shared_dir
from gridwarden.sources.store import unsorted_writes
from gridwarden.streaming import streams as ss
from gridwarden.workload import q_events as qe
from gridwarden.workload.q_risk import KEEP, RISKS, _LEVEL
from gridwarden.workload.q_spatial import LOOKUP, lookup
from gridwarden.workload.registry import day, query, r
from gridwarden.workload.standin import STANDINS, Tables

CELL = "latitude, longitude"


def stream_of(t: Tables, name: str, table: str):
    """A projection with its table read as a stream."""
    path = f"{t.folder}/{table}.parquet"
    schema = t.spark.read.parquet(path).schema
    live = t.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet" if _is_file(t, path) else "*.parquet").parquet(t.folder if _is_file(t, path) else path)
    view = f"live_{name}"
    live.createOrReplaceTempView(view)
    return t.spark.sql(STANDINS[name].format(**{table: view}))


def _is_file(t: Tables, path: str) -> bool:
    p = t.spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile())


def run_updates(t: Tables, rows, keys):
    path = shared_dir(t.spark, "stream")
    ss.update_into(rows, path, f"{path}-state").awaitTermination()
    return ss.latest_state(t.spark, path, keys)


def live_obs(t):
    return stream_of(t, "obs", "events").withColumn("time", F.col("time").cast("timestamp"))


@query(
    "stream_daily_precip",
    ("obs",),
    f"""WITH d AS (SELECT date, {CELL}, sum(precipitation) AS p, max(precipitation) AS m FROM obs GROUP BY 1, 2, 3)
    SELECT CAST(date AS STRING) AS date, {CELL}, round(p, 6) AS total, round(m, 6) AS step, CASE WHEN p >= 50 THEN 2e0 WHEN p >= 25 THEN 1e0 ELSE 0e0 END AS flag FROM d""",
)
def _(t):
    out = run_updates(t, ss.stream_daily_precip(live_obs(t).select("time", "latitude", "longitude", "precipitation")), ["date", "latitude", "longitude"])
    return out.select(day("date").alias("date"), "latitude", "longitude", r("daily_precip_total_mm").alias("total"), r("daily_precip_max_step_mm").alias("step"), F.col("daily_precip_extreme_flag").alias("flag"))


@query(
    "stream_rolling_precip",
    ("obs",),
    f"""WITH s AS (SELECT CAST(date AS DATE) + CAST(k AS INT) AS last, {CELL}, precipitation FROM obs CROSS JOIN range(3) w(k))
    SELECT CAST(last AS STRING) AS date, {CELL}, round(sum(precipitation), 6) AS total FROM s GROUP BY 1, 2, 3""",
)
def _(t):
    out = run_updates(t, ss.stream_rolling_precip(live_obs(t).select("time", "latitude", "longitude", "precipitation")), ["date", "latitude", "longitude"])
    return out.select(day("date").alias("date"), "latitude", "longitude", r("precip_3day").alias("total"))


@query("stream_risk_scan", ("points",), f"WITH {RISKS} SELECT row_id, grid_id, hazard_type, round(p, 5) AS p, {_LEVEL.format(p='p')} AS level FROM risks")
def _(t):
    path = shared_dir(t.spark, "stream")
    rows = ss.stream_risk_scan(stream_of(t, "points", "lineitem"), KEEP).select("row_id", "grid_id", "hazard_type", "risk_probability", F.col("risk_level").alias("level"))
    ss.append_to(rows, path, f"{path}-state").awaitTermination()
    return t.spark.read.parquet(path).select("row_id", "grid_id", "hazard_type", r("risk_probability", 5).alias("p"), "level")


@query(
    "stream_province_day",
    ("grid_day", "boundaries"),
    f"""WITH {LOOKUP} SELECT CAST(g.date AS STRING) AS date, lk.province_name, count(*) AS grid_cell_count, round(avg(g.daily_precip_total), 6) AS rain FROM grid_day g
    JOIN lk ON lk.latitude = g.latitude AND lk.longitude = g.longitude WHERE lk.province_name IS NOT NULL GROUP BY 1, 2""",
)
def _(t):
    path = shared_dir(t.spark, "lookup")
    lookup(t).filter("province_name is not null").write.parquet(path)
    rows = stream_of(t, "grid_day", "lineitem").select(F.col("date").cast("timestamp").alias("time"), "latitude", "longitude", "daily_precip_total")
    out = run_updates(t, ss.stream_province_day(rows, t.spark.read.parquet(path)), ["date", "province_name"])
    return out.select(day("date").alias("date"), "province_name", "grid_cell_count", r("daily_precip_total").alias("rain"))


@query(
    "stream_label",
    ("grid_day", "catalogue"),
    f"WITH {qe.GRID_SAMPLES}, {qe.flood_label_sql('gs', qe.GRID_MATCH, True)} SELECT row_id, grid_id, latitude, label, label_status, label_source_mode, matched_event_ids FROM labels",
)
def _(t):
    path = shared_dir(t.spark, "stream")
    rows = stream_of(t, "grid_day", "lineitem").select("row_id", "grid_id", "date", "latitude", "longitude", "province_name")
    ss.stream_label(rows, ev.expand_events_daily(qe.merged(t)), path, f"{path}-state").awaitTermination()
    return ss.stream_labels(t.spark, path).select("row_id", "grid_id", "latitude", *qe._OUT)


@query("stream_incremental_table", ("obs",), "SELECT event_type, count(*) AS n, round(sum(temp_c), 4) AS temp FROM obs GROUP BY 1")
def _(t):
    """The table as two folders of files; the first is written with other values and then once more as it is."""
    source, path = shared_dir(t.spark, "source"), shared_dir(t.spark, "stream")
    events = t.table("events")

    def project(batch):
        return batch.select("event_type", (15 + F.col("value") % 35).alias("temp_c"), "source_file", "source_mtime_us")

    half = F.col("event_id") % 2 == 0
    events.filter(half).withColumn("value", F.col("value") + 1).write.parquet(f"{source}/a")
    events.filter(~half).write.parquet(f"{source}/b")
    ss.stream_incremental_table(t.spark, source, events.schema, project, path, f"{path}-state")
    events.filter(half).write.mode("overwrite").parquet(f"{source}/a")
    ss.stream_incremental_table(t.spark, source, events.schema, project, path, f"{path}-state")
    out = ss.incremental_rows(t.spark, path, source)
    return out.groupBy("event_type").agg(F.count("*").alias("n"), r(F.sum("temp_c"), 4).alias("temp"))


_RUNS = """WITH d AS (SELECT station, date, max(CASE WHEN temp_c >= 35 THEN 1 ELSE 0 END) AS f FROM obs GROUP BY 1, 2),
k AS (SELECT station, date, date - CAST(row_number() OVER (PARTITION BY station ORDER BY date) AS INT) AS run FROM d WHERE f = 1),
s AS (SELECT station, min(date) AS a, max(date) AS b, count(*) AS n FROM k GROUP BY station, run)
SELECT station, CAST(a AS STRING) AS start_date, CAST(b AS STRING) AS end_date, n AS duration_days FROM s"""


@query("stream_heatwave_runs", ("obs",), _RUNS)
def _(t):
    path = shared_dir(t.spark, "stream")
    rows = live_obs(t).select("time", "station", (F.col("temp_c") >= 35).cast("int").alias("heatwave_day_flag"))
    ss.update_into(ss.stream_heatwave_runs(rows, cell=["station"]), path, f"{path}-state").awaitTermination()
    out = ss.latest_state(t.spark, path, ["station", "start_date"]).filter("duration_days > 0")
    return out.select("station", day("start_date").alias("start_date"), day("end_date").alias("end_date"), "duration_days")


def batches_of(t: Tables, name: str, table: str, parts: int = 4):
    """A projection of a table as a stream, and the steps in which its parts arrive: each with rows of all times, the latest first.

    The table is read once; its parts wait in folders beside the stream's. A part is one micro-batch, whatever the number of its files.
    """
    waiting, source = shared_dir(t.spark, "waiting"), shared_dir(t.spark, "source")
    rows = t.table(table)
    column = {"events": "ts", "lineitem": "l_shipdate"}[table]
    # a few late rows in every batch; for the rest, later times come earlier
    late = F.pmod(F.xxhash64(*rows.columns), F.lit(parts * 4))
    place = F.when(late < parts, late).otherwise(parts - 1 - F.pmod(F.year(column) * 12 + F.month(column), F.lit(parts)))
    with unsorted_writes(t.spark):
        rows.withColumn("part", place).write.partitionBy("part").parquet(waiting)
    path = t.spark._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(t.spark._jsc.hadoopConfiguration())
    files.mkdirs(path(source))

    def arrive():
        for k in range(parts):
            if files.exists(path(f"{waiting}/part={k}")) and not files.rename(path(f"{waiting}/part={k}"), path(f"{source}/part={k}")):
                raise OSError(f"part {k} of {waiting} cannot be moved to {source}")
            yield k

    live = t.spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(source)
    view = f"late_{name}"
    live.createOrReplaceTempView(view)
    return t.spark.sql(STANDINS[name].format(**{table: view})), arrive()


def run_parts(t: Tables, rows, arrivals, keys, parts, prepare):
    """The stored partial aggregates of a stream that runs once after each arrival, folded once at the end."""
    path = shared_dir(t.spark, "stream")
    for _ in arrivals:
        ss.accumulate_into(rows, path, f"{path}-state", keys, parts, prepare).awaitTermination()
    ss.compact(t.spark, path, keys, parts)
    return path


def late_obs(t):
    rows, arrivals = batches_of(t, "obs", "events")
    return rows.withColumn("time", F.col("time").cast("timestamp")), arrivals


@query(
    "stream_daily_precip_late",
    ("obs",),
    f"""WITH d AS (SELECT date, {CELL}, sum(precipitation) AS p, max(precipitation) AS m FROM obs GROUP BY 1, 2, 3)
    SELECT CAST(date AS STRING) AS date, {CELL}, round(p, 6) AS total, round(m, 6) AS step, CASE WHEN p >= 50 THEN 2e0 WHEN p >= 25 THEN 1e0 ELSE 0e0 END AS flag FROM d""",
)
def _(t):
    """Several batches out of order, and every late row counts."""
    rows, arrivals = late_obs(t)
    path = run_parts(t, rows.select("time", "latitude", "longitude", "precipitation"), arrivals, ["date", "latitude", "longitude"], ss.RAIN_PARTS, ss.on_days)
    out = ss.whole_daily_precip(t.spark, path)
    return out.select(day("date").alias("date"), "latitude", "longitude", r("daily_precip_total_mm").alias("total"), r("daily_precip_max_step_mm").alias("step"), F.col("daily_precip_extreme_flag").alias("flag"))


@query(
    "stream_rolling_precip_late",
    ("obs",),
    f"""WITH s AS (SELECT CAST(date AS DATE) + CAST(k AS INT) AS last, {CELL}, precipitation FROM obs CROSS JOIN range(3) w(k))
    SELECT CAST(last AS STRING) AS date, {CELL}, round(sum(precipitation), 6) AS total FROM s GROUP BY 1, 2, 3""",
)
def _(t):
    rows, arrivals = late_obs(t)
    path = run_parts(t, rows.select("time", "latitude", "longitude", "precipitation"), arrivals, ["date", "latitude", "longitude"], ss.RAIN_PARTS, ss.on_days)
    return ss.whole_rolling_precip(t.spark, path).select(day("date").alias("date"), "latitude", "longitude", r("precip_3day").alias("total"))


@query(
    "stream_province_day_late",
    ("grid_day", "boundaries"),
    f"""WITH {LOOKUP} SELECT CAST(g.date AS STRING) AS date, lk.province_name, count(*) AS grid_cell_count, round(avg(g.daily_precip_total), 6) AS rain FROM grid_day g
    JOIN lk ON lk.latitude = g.latitude AND lk.longitude = g.longitude WHERE lk.province_name IS NOT NULL GROUP BY 1, 2""",
)
def _(t):
    path = shared_dir(t.spark, "lookup")
    lookup(t).filter("province_name is not null").write.parquet(path)
    names = ["daily_precip_total"]
    rows, arrivals = batches_of(t, "grid_day", "lineitem")
    rows = rows.select(F.col("date").cast("timestamp").alias("time"), "latitude", "longitude", *names)
    path = run_parts(t, rows, arrivals, ["date", "province_name"], ss.province_parts(names), ss.in_provinces(t.spark.read.parquet(path)))
    out = ss.whole_province_day(t.spark, path, names)
    return out.select(day("date").alias("date"), "province_name", "grid_cell_count", r("daily_precip_total").alias("rain"))


@query("stream_heatwave_runs_late", ("obs",), _RUNS)
def _(t):
    rows, arrivals = late_obs(t)
    rows = rows.select("time", "station", (F.col("temp_c") >= 35).cast("int").alias("heatwave_day_flag"))
    path = run_parts(t, rows, arrivals, ["date", "station"], ss.FLAG_PARTS, ss.on_days)
    out = ss.whole_heatwave_runs(t.spark, path, ["station"])
    return out.select("station", day("start_date").alias("start_date"), day("end_date").alias("end_date"), "duration_days")
