"""Queries of daily reductions, windows, climatology, as-of selection and calendar audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwarden.operators import temporal as tm
from gridwarden.workload.registry import day, query, r

CELL = "latitude, longitude"


@query(
    "daily_reduce",
    ("obs",),
    f"""SELECT CAST(date AS STRING) AS date, {CELL}, round(avg(temp_c), 6) AS temp_c_mean, round(avg(precip_1h_mm), 6) AS precip_1h_mm_mean, max(temp_c) AS temp_c_max,
      min(rh_percent) AS rh_percent_min, round(sum(precipitation), 6) AS precipitation_sum FROM obs GROUP BY 1, 2, 3""",
)
def _(t):
    out = tm.daily_reduce(t.obs, ["temp_c", "precip_1h_mm"], ["temp_c"], ["rh_percent"], ["precipitation"])
    return out.withColumns({"date": day("date"), **{c: r(c) for c in ("temp_c_mean", "precip_1h_mm_mean", "precipitation_sum")}})


@query(
    "deaccumulate_daily",
    ("obs",),
    f"""WITH s AS (SELECT {CELL}, date, time, running_total AS v, lag(running_total) OVER (PARTITION BY {CELL} ORDER BY time) AS p FROM obs)
    SELECT CAST(date AS STRING) AS date, {CELL}, round(sum(CASE WHEN extract('hour' FROM time) = 0 THEN greatest(v, 0) ELSE greatest(v - p, 0) END), 6) AS total
    FROM s WHERE p IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(t):
    out = tm.deaccumulate_daily(t.obs, ["running_total"])
    return out.select(day("date").alias("date"), "latitude", "longitude", r("running_total_daily").alias("total"))


@query(
    "deaccumulate_within_day",
    ("obs",),
    f"""WITH s AS (SELECT {CELL}, date, time, running_total AS v, lag(running_total) OVER (PARTITION BY {CELL}, date ORDER BY time) AS p FROM obs)
    SELECT CAST(date AS STRING) AS date, {CELL}, round(sum(CASE WHEN extract('hour' FROM time) = 0 THEN greatest(v, 0) ELSE greatest(v - p, 0) END), 6) AS total
    FROM s WHERE p IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(t):
    out = tm.deaccumulate_daily(t.obs, ["running_total"], across_days=False)
    return out.select(day("date").alias("date"), "latitude", "longitude", r("running_total_daily").alias("total"))


@query(
    "rolling_precip",
    ("grid_day",),
    f"""WITH d AS (SELECT date, {CELL}, sum(daily_precip_total) AS p FROM grid_day GROUP BY 1, 2, 3)
    SELECT CAST(date AS STRING) AS date, {CELL},
      round(sum(p) OVER (PARTITION BY {CELL} ORDER BY date RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW), 5) AS precip_3day,
      round(sum(p) OVER (PARTITION BY {CELL} ORDER BY date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), 5) AS precip_7day FROM d""",
)
def _(t):
    out = tm.rolling_precip(t.grid_day, "daily_precip_total")
    return out.select(day("date").alias("date"), "latitude", "longitude", r("precip_3day", 5).alias("precip_3day"), r("precip_7day", 5).alias("precip_7day"))


@query(
    "daily_precip_stats",
    ("obs",),
    f"""WITH d AS (SELECT date, {CELL}, sum(precipitation) AS p, max(precipitation) AS m FROM obs GROUP BY 1, 2, 3)
    SELECT CAST(date AS STRING) AS date, {CELL}, round(p, 6) AS total, round(m, 6) AS step, CASE WHEN p >= 50 THEN 2e0 WHEN p >= 25 THEN 1e0 ELSE 0e0 END AS flag FROM d""",
)
def _(t):
    out = tm.daily_precip_stats(t.obs)
    return out.select(
        day("date").alias("date"), "latitude", "longitude", r("daily_precip_total_mm").alias("total"), r("daily_precip_max_step_mm").alias("step"),
        F.col("daily_precip_extreme_flag").alias("flag"),
    )


@query(
    "hourly_max_wind",
    ("obs",),
    f"SELECT {CELL}, CAST(date_trunc('hour', time) AS TIMESTAMP) AS hour, round(max(sqrt(u10 * u10 + v10 * v10)), 6) AS speed FROM obs GROUP BY 1, 2, 3",
)
def _(t):
    out = tm.hourly_max_wind(t.obs)
    return out.select("latitude", "longitude", F.col("hour").cast("timestamp_ntz").alias("hour"), r("hourly_max_wind10_m_s").alias("speed"))


_CLIM = """c AS (SELECT dayofyear(date) AS doy, sum(temp_c) AS ts, count(temp_c) AS tc, sum(tmax_c) AS ms, count(tmax_c) AS mc FROM grid_day GROUP BY 1
  UNION ALL SELECT NULL, sum(temp_c), count(temp_c), sum(tmax_c), count(tmax_c) FROM grid_day)"""


@query(
    "day_of_year_climatology",
    ("grid_day",),
    f"""WITH {_CLIM} SELECT coalesce(doy, 0) AS day_of_year, round(ts, 4) AS temp_c_sum, tc AS temp_c_count, round(ts / tc, 6) AS temp_c_mean,
      round(ms, 4) AS tmax_c_sum, mc AS tmax_c_count, round(ms / mc, 6) AS tmax_c_mean FROM c""",
)
def _(t):
    out = tm.day_of_year_climatology(t.grid_day)
    return out.na.fill(0, ["day_of_year"]).withColumns({**{c: r(c, 4) for c in ("temp_c_sum", "tmax_c_sum")}, **{c: r(c) for c in ("temp_c_mean", "tmax_c_mean")}})


@query(
    "climatology_anomaly",
    ("grid_day",),
    f"""WITH {_CLIM}, base AS (SELECT * FROM c WHERE doy IS NULL OR doy % 2 = 0), o AS (SELECT ts / tc AS m FROM c WHERE doy IS NULL)
    SELECT g.row_id, g.grid_id, round(g.temp_c - coalesce(b.ts / b.tc, o.m), 6) AS anomaly,
      CASE WHEN b.doy IS NOT NULL THEN 'day_of_year_archive_mean' ELSE 'historical_indicator_archive_mean_fallback' END AS method
    FROM grid_day g LEFT JOIN base b ON b.doy = dayofyear(g.date) CROSS JOIN o""",
)
def _(t):
    clim = tm.day_of_year_climatology(t.grid_day).filter("day_of_year is null or day_of_year % 2 = 0")
    out = tm.climatology_anomaly(t.grid_day, clim, "temp_c", "anomaly")
    return out.select("row_id", "grid_id", r("anomaly").alias("anomaly"), F.col("anomaly_method").alias("method"))


@query(
    "nearest_time_select",
    ("obs",),
    """WITH l AS (SELECT event_id, station, time FROM obs WHERE event_type = 'click'), s AS (SELECT station, time, temp_c FROM obs WHERE event_type <> 'click'),
    a AS (SELECT l.event_id, l.station, l.time, s.time AS st, s.temp_c FROM l ASOF LEFT JOIN s ON l.station = s.station AND l.time >= s.time),
    b AS (SELECT l.event_id, s.time AS st, s.temp_c FROM l ASOF LEFT JOIN s ON l.station = s.station AND l.time <= s.time),
    n AS (SELECT a.event_id, a.station, CASE WHEN b.st IS NULL OR (a.st IS NOT NULL AND a.time - a.st < b.st - a.time) THEN a.st ELSE b.st END AS near,
      CASE WHEN b.st IS NULL OR (a.st IS NOT NULL AND a.time - a.st < b.st - a.time) THEN a.temp_c ELSE b.temp_c END AS v, a.time FROM a JOIN b ON a.event_id = b.event_id)
    SELECT event_id, station, CASE WHEN abs(epoch_us(near) - epoch_us(time)) <= 43200000000 THEN near END AS selected_time,
      CASE WHEN abs(epoch_us(near) - epoch_us(time)) <= 43200000000 THEN v END AS temp_c FROM n""",
)
def _(t):
    targets = t.obs.filter("event_type = 'click'").select("event_id", "station", "time")
    series = t.obs.filter("event_type <> 'click'").select("station", "time", "temp_c")
    out = tm.nearest_time_select(targets, series, ["temp_c"], 12 * 3600, ["station"])
    return out.select("event_id", "station", "temp_c", F.col("selected_time").cast("timestamp_ntz").alias("selected_time"))


@query(
    "monthly_to_daily",
    ("grid_day",),
    f"""WITH m AS (SELECT date_trunc('month', date) AS month, {CELL}, sum(daily_precip_total) AS p FROM grid_day GROUP BY 1, 2, 3)
    SELECT g.row_id, g.grid_id, round(m.p, 5) AS total, round(m.p / extract('day' FROM last_day(g.date)), 5) AS per_day
    FROM grid_day g JOIN m ON m.month = date_trunc('month', g.date) AND m.latitude = g.latitude AND m.longitude = g.longitude""",
)
def _(t):
    monthly = t.grid_day.groupBy(F.trunc("date", "MM").alias("month"), "latitude", "longitude").agg(F.sum("daily_precip_total").alias("precip"))
    out = tm.monthly_to_daily(t.grid_day, monthly, "precip")
    return out.select("row_id", "grid_id", r("monthly_precip_total", 5).alias("total"), r("monthly_precip_mmday", 5).alias("per_day"))


@query(
    "lead_schedule",
    ("obs",),
    """SELECT event_id, lead AS lead_hours, time + lead * INTERVAL 1 HOUR AS valid_time, concat(event_type, ':+', CAST(lead AS STRING), 'h') AS field_key
    FROM obs CROSS JOIN (VALUES (0), (6), (24)) l(lead)""",
)
def _(t):
    rows = t.obs.select("event_id", F.col("time").alias("issue_time"), F.col("event_type").alias("variable"))
    return tm.lead_schedule(rows, [0, 6, 24]).select("event_id", "lead_hours", "valid_time", "field_key")


@query(
    "heatwave_flag",
    ("points",),
    """SELECT row_id, grid_id, CASE WHEN rh_percent IS NULL AND coastal_distance_km IS NULL AND wind_gust_mps IS NULL THEN NULL
      WHEN rh_percent >= 40 OR coastal_distance_km >= 45 OR wind_gust_mps >= 40 THEN 1e0 ELSE 0e0 END AS flag FROM points""",
)
def _(t):
    return t.points.select("row_id", "grid_id", tm.heatwave_flag("rh_percent", "coastal_distance_km", "wind_gust_mps").alias("flag"))


_RUNS = """WITH d AS (SELECT station, date, max(CASE WHEN temp_c >= 35 THEN 1 ELSE 0 END) AS f FROM obs GROUP BY 1, 2),
k AS (SELECT station, date, date - CAST(row_number() OVER (PARTITION BY station ORDER BY date) AS INT) AS run FROM d WHERE f = 1)
SELECT station, CAST(min(date) AS STRING) AS start_date, CAST(max(date) AS STRING) AS end_date, count(*) AS duration_days FROM k GROUP BY station, run"""


@query("heatwave_runs", ("obs",), _RUNS)
def _(t):
    rows = t.obs.withColumn("heatwave_day_flag", (F.col("temp_c") >= 35).cast("int"))
    out = tm.heatwave_runs(rows, cell=["station"])
    return out.select("station", day("start_date").alias("start_date"), day("end_date").alias("end_date"), "duration_days")


_AUDIT = """p AS (SELECT DISTINCT date, CAST(extract('hour' FROM time) AS INT) AS hour, event_type AS variable FROM obs),
dd AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM p),
e AS (SELECT dd.date, h.hour, v.variable FROM dd CROSS JOIN (VALUES (0), (6), (12), (18)) h(hour) CROSS JOIN (VALUES ('view'), ('click'), ('radar')) v(variable))"""


@query(
    "completeness_missing",
    ("obs",),
    f"""WITH {_AUDIT} SELECT CAST(e.date AS STRING) AS date, e.hour, e.variable FROM e
    LEFT JOIN p ON p.date = e.date AND p.hour = e.hour AND p.variable = e.variable WHERE p.date IS NULL""",
)
def _(t):
    out = tm.completeness_audit(t.obs.withColumnRenamed("event_type", "variable"), ["view", "click", "radar"], 6)
    return out["missing"].withColumn("date", day("date"))


@query(
    "completeness_summary",
    ("obs",),
    f"""WITH {_AUDIT}, h AS (SELECT date, count(DISTINCT hour) AS hours FROM p GROUP BY 1)
    SELECT 'hours' AS kind, CAST(hours AS STRING) AS name, count(*) AS n FROM h GROUP BY hours
    UNION ALL SELECT 'unexpected', CAST(hour AS STRING), count(*) FROM (SELECT DISTINCT date, hour FROM p WHERE hour NOT IN (0, 6, 12, 18)) GROUP BY hour
    UNION ALL SELECT 'missing_days', '', (SELECT count(*) FROM dd WHERE date NOT IN (SELECT date FROM p))
    UNION ALL SELECT 'range', concat(CAST(min(time) AS STRING), ' ', CAST(max(time) AS STRING)), 1 FROM obs""",
)
def _(t):
    out = tm.completeness_audit(t.obs.withColumnRenamed("event_type", "variable"), ["view", "click", "radar"], 6)
    hours = out["hour_counts"].select(F.lit("hours").alias("kind"), F.col("hours").cast("string").alias("name"), F.col("days").alias("n"))
    extra = out["unexpected_hours"].groupBy(F.col("hour").cast("string").alias("name")).agg(F.count("*").alias("n"))
    extra = extra.select(F.lit("unexpected").alias("kind"), "name", "n")
    gone = out["missing_days"].agg(F.count("*").alias("n")).select(F.lit("missing_days").alias("kind"), F.lit("").alias("name"), "n")
    span = out["range"].select(F.lit("range").alias("kind"), F.concat_ws(" ", F.col("start").cast("string"), F.col("end").cast("string")).alias("name"), F.lit(1).alias("n"))
    return hours.unionByName(extra).unionByName(gone).unionByName(span)


_LEVEL_OF = "CASE WHEN event_type IN ('view', 'click') THEN CASE event_id % 3 WHEN 0 THEN 850 WHEN 1 THEN 500 ELSE 300 END END"
_LEVEL_AUDIT = f"""x AS (SELECT DISTINCT date, CAST(hour(time) AS INT) AS hour, event_type AS variable, coalesce({_LEVEL_OF}, -1) AS level FROM obs),
dd AS (SELECT CAST(unnest(generate_series(min(date) + 1, max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM obs),
seen AS (SELECT DISTINCT date, hour, level >= 0 AS on_levels FROM x), whole AS (SELECT date FROM seen GROUP BY 1 HAVING count(DISTINCT on_levels) >= 2)"""


def level_audit(t):
    rows = t.obs.withColumn("level", F.expr(_LEVEL_OF)).withColumnRenamed("event_type", "variable")
    first = t.obs.agg(F.date_add(F.min("date"), 1).cast("string")).first()[0]
    return tm.completeness_audit(rows, ["view", "click", "purchase", "radar"], 6, first, levels={"view": (850, 500), "click": (850, 500)})


@query(
    "completeness_levels_missing",
    ("obs",),
    f"""WITH {_LEVEL_AUDIT}, e AS (SELECT dd.date, h.hour, f.variable, f.level FROM dd JOIN whole w ON w.date = dd.date CROSS JOIN (VALUES (0), (6), (12), (18)) h(hour)
      CROSS JOIN (VALUES ('view', 850), ('view', 500), ('click', 850), ('click', 500), ('purchase', -1), ('radar', -1)) f(variable, level))
    SELECT CAST(e.date AS STRING) AS date, e.hour, e.variable, nullif(e.level, -1) AS level FROM e LEFT JOIN x ON x.date = e.date AND x.hour = e.hour AND x.variable = e.variable AND x.level = e.level WHERE x.date IS NULL""",
)
def _(t):
    return level_audit(t)["missing"].withColumn("date", day("date"))


@query(
    "completeness_levels_summary",
    ("obs",),
    f"""WITH {_LEVEL_AUDIT}, h AS (SELECT s.date, s.on_levels, count(*) AS hours FROM seen s JOIN dd ON dd.date = s.date GROUP BY 1, 2)
    SELECT 'hours' AS kind, concat(CAST(on_levels AS STRING), ' ', CAST(hours AS STRING)) AS name, count(*) AS n FROM h GROUP BY 2
    UNION ALL SELECT 'unexpected', concat(CAST(on_levels AS STRING), ' ', CAST(hour AS STRING)), count(*) FROM seen WHERE hour NOT IN (0, 6, 12, 18) GROUP BY 2
    UNION ALL SELECT 'missing_days', '', (SELECT count(*) FROM dd WHERE date NOT IN (SELECT date FROM whole))
    UNION ALL SELECT 'extra_days', CAST(on_levels AS STRING), count(DISTINCT date) FROM seen WHERE date NOT IN (SELECT date FROM dd) GROUP BY 2
    UNION ALL SELECT 'range', concat(CAST({_LEVEL_OF} IS NOT NULL AS STRING), ' ', CAST(min(time) AS STRING), ' ', CAST(max(time) AS STRING)), 1 FROM obs GROUP BY {_LEVEL_OF} IS NOT NULL""",
)
def _(t):
    out = level_audit(t)
    on, said = F.col("on_levels").cast("string"), lambda kind, df, *name: df.select(F.lit(kind).alias("kind"), F.concat_ws(" ", *name).alias("name"), "n")
    hours = said("hours", out["hour_counts"].withColumnRenamed("days", "n"), on, F.col("hours").cast("string"))
    extra = said("unexpected", out["unexpected_hours"].groupBy("on_levels", "hour").agg(F.count("*").alias("n")), on, F.col("hour").cast("string"))
    gone = said("missing_days", out["missing_days"].agg(F.count("*").alias("n")), F.lit(""))
    more = said("extra_days", out["extra_days"].groupBy("on_levels").agg(F.count("*").alias("n")), on)
    span = said("range", out["range"].withColumn("n", F.lit(1)), on, F.col("start").cast("string"), F.col("end").cast("string"))
    return hours.unionByName(extra).unionByName(gone).unionByName(more).unionByName(span)


@query(
    "stats_window_check",
    ("obs",),
    """WITH w AS (SELECT station, date_trunc('hour', min(time)) AS a, date_trunc('hour', max(time)) AS b, count(*) AS n FROM obs GROUP BY 1)
    SELECT station, n AS count, CAST(floor((epoch(b) - epoch(a)) / 21600) + 1 AS BIGINT) AS expected_count,
      n = CAST(floor((epoch(b) - epoch(a)) / 21600) + 1 AS BIGINT) AS valid FROM w""",
)
def _(t):
    windows = t.obs.groupBy("station").agg(
        F.date_trunc("hour", F.min("time")).alias("start"), F.date_trunc("hour", F.max("time")).alias("end"), F.count("*").alias("count")
    )
    return tm.stats_window_check(windows, 6).select("station", "count", "expected_count", "valid")


_STATS = """WITH s AS (SELECT 'q' AS variable, level, q AS value FROM profiles UNION ALL SELECT 'u', level, u FROM profiles UNION ALL SELECT 'v', level, v FROM profiles)
SELECT variable, level, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM s GROUP BY variable, level
UNION ALL SELECT variable, 0, count(value), round(avg(value), 6), round(stddev_pop(value), 6) FROM s GROUP BY variable"""


def long_profiles(t):
    named = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("value")) for v in ("q", "u", "v")])).alias("_v")
    return t.profiles.select("profile", "level", named).select("profile", "level", "_v.*")


@query("channel_stats", ("profiles",), _STATS)
def _(t):
    out = tm.channel_stats(long_profiles(t))
    return out.na.fill(0, ["level"]).select("variable", "level", "count", r("mean").alias("mean"), r("std").alias("std"))


@query(
    "channel_stats_sources",
    ("profiles",),
    """WITH s AS (SELECT level, q AS value FROM profiles UNION ALL SELECT level, q + 1 FROM profiles)
    SELECT level, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM s GROUP BY level
    UNION ALL SELECT 0, count(value), round(avg(value), 6), round(stddev_pop(value), 6) FROM s""",
)
def _(t):
    one = t.profiles.select(F.lit("q").alias("variable"), "level", F.col("q").alias("value"))
    two = one.withColumn("value", F.col("value") + 1)
    out = tm.channel_stats(tm.merge_channel_sources({"a": one, "b": two}))
    return out.na.fill(0, ["level"]).select("level", "count", r("mean").alias("mean"), r("std").alias("std"))
