"""Streams over several micro-batches: late rows, open runs, changed files."""

import os
import time
from datetime import date, datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gridwarden.streaming import streams as ss


def write(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    pq.write_table(pa.Table.from_pylist(rows), f"{folder}/{name}", coerce_timestamps="us")
    time.sleep(1.1)  # files are taken in the order of their times


@pytest.fixture
def paths(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "out")


def test_late_rows_are_counted(spark, paths):
    source, path = paths
    rain = lambda d, h, v: {"time": datetime(2024, 1, d, h), "latitude": 20.0, "longitude": 40.0, "precipitation": v}
    write(source, "1.parquet", [rain(1, 1, 1.0), rain(1, 5, 2.0)])
    write(source, "2.parquet", [rain(3, 1, 4.0), rain(1, 23, 8.0)])
    write(source, "3.parquet", [rain(3, 2, 32.0)])
    write(source, "4.parquet", [rain(1, 2, 16.0), rain(3, 3, 64.0)])
    live = spark.readStream.schema("time timestamp, latitude double, longitude double, precipitation double").option("maxFilesPerTrigger", 1).parquet(source)
    query = ss.update_into(ss.stream_daily_precip(live), path, f"{path}-state")
    query.awaitTermination()
    out = {r["date"]: r["daily_precip_total_mm"] for r in ss.latest_state(spark, path, ["date", "latitude", "longitude"]).collect()}
    assert out == {date(2024, 1, 1): 11.0, date(2024, 1, 3): 100.0}
    assert ss.late_rows(query) == 1


def test_runs_grow_and_join(spark, paths):
    source, path = paths
    hot = lambda *days: [{"time": datetime(2024, 5, d, 12), "station": "s", "heatwave_day_flag": 1} for d in days]
    write(source, "1.parquet", hot(1, 2, 5))
    write(source, "2.parquet", hot(4, 6) + [{"time": datetime(2024, 5, 7), "station": "s", "heatwave_day_flag": 0}])
    write(source, "3.parquet", hot(3, 9) + hot(9))
    live = spark.readStream.schema("time timestamp, station string, heatwave_day_flag long").option("maxFilesPerTrigger", 1).parquet(source)
    ss.update_into(ss.stream_heatwave_runs(live, delay="30 days", cell=["station"]), path, f"{path}-state").awaitTermination()
    out = ss.latest_state(spark, path, ["station", "start_date"]).filter("duration_days > 0")
    assert sorted((r["start_date"].day, r["end_date"].day, r["duration_days"]) for r in out.collect()) == [(1, 6, 6), (9, 9, 1)]


def test_changed_files_and_equal_names(spark, paths):
    source, path = paths

    def run():
        return ss.stream_incremental_table(spark, source, "v long", lambda rows: rows, path, f"{path}-state")

    def values():
        return sorted(r["v"] for r in ss.incremental_rows(spark, path, source).collect())

    write(f"{source}/a", "x.parquet", [{"v": 1}, {"v": 2}, {"v": 3}])
    write(f"{source}/b", "x.parquet", [{"v": 10}])
    assert run() == 2 and values() == [1, 2, 3, 10]
    assert run() == 0
    write(f"{source}/a", "x.parquet", [{"v": 7}, {"v": 8}])
    assert run() == 1 and values() == [7, 8, 10]
    os.remove(f"{source}/b/x.parquet")
    assert run() == 0 and values() == [7, 8]


def test_late_rows_count_in_accumulated_totals(spark, paths):
    source, path = paths
    rain = lambda d, h, v: {"time": datetime(2024, 1, d, h), "latitude": 20.0, "longitude": 40.0, "precipitation": v}
    keys = ["date", "latitude", "longitude"]

    def run():
        live = spark.readStream.schema("time timestamp, latitude double, longitude double, precipitation double").option("maxFilesPerTrigger", 1).parquet(source)
        ss.accumulate_into(live, path, f"{path}-state", keys, ss.RAIN_PARTS, ss.on_days).awaitTermination()

    def totals():
        return {r["date"].day: (r["daily_precip_total_mm"], r["daily_precip_max_step_mm"]) for r in ss.whole_daily_precip(spark, path).collect()}

    write(source, "1.parquet", [rain(9, 1, 1.0), rain(9, 5, 2.0)])
    write(source, "2.parquet", [rain(30, 1, 4.0), rain(1, 23, 8.0)])
    run()
    assert totals() == {9: (3.0, 2.0), 30: (4.0, 4.0), 1: (8.0, 8.0)}
    assert ss.compact(spark, path, keys, ss.RAIN_PARTS) == 1
    write(source, "3.parquet", [rain(1, 2, 16.0), rain(9, 3, 64.0)])
    run()
    want = {9: (67.0, 64.0), 30: (4.0, 4.0), 1: (24.0, 16.0)}
    assert totals() == want
    assert ss.compact(spark, path, keys, ss.RAIN_PARTS) == 2 == ss.compact(spark, path, keys, ss.RAIN_PARTS)
    assert totals() == want and not [f for f in os.listdir(path) if f.startswith("batch=")] and os.listdir(f"{path}/folded") == ["upto=2"]
    assert {r["date"].day: r["precip_3day"] for r in ss.whole_rolling_precip(spark, path).collect()}[11] == 67.0


def test_compaction_that_breaks_off(spark, paths):
    """Before the folded table is finished, after it, and with an unfinished batch: no row is lost or counted twice."""
    _, path = paths
    for n, v in enumerate((1, 2, 4)):
        spark.createDataFrame([("a", v), (f"k{n}", v)], "k string, v long").write.parquet(f"{path}/batch={n}")
    os.makedirs(f"{path}/batch=3")
    parts = {"v": ("sum", "v")}
    want = {"a": 7, "k0": 1, "k1": 2, "k2": 4}
    read = lambda: {r["k"]: r["v"] for r in ss.accumulated(spark, path, ["k"], parts).collect()}
    assert read() == want
    os.makedirs(f"{path}/folded/upto=2")  # not finished
    assert read() == want
    ss._merged(["k"], parts)(ss.stored_batches(spark, path)).write.mode("overwrite").parquet(f"{path}/folded/upto=2")  # finished, batches still there
    assert read() == want
    assert ss.compact(spark, path, ["k"], parts) == 2 and read() == want and sorted(os.listdir(path)) == ["batch=3", "folded"]
    assert {r["k"]: r["v"] for r in ss.latest_state(spark, path, ["k"]).collect()} == want


def test_accumulated_sums_do_not_hang_on_arrival(spark, tmp_path):
    """A total of 25 mm in decimals: its last bit, and so the flag, is that of the order of times, whatever the batches."""
    values = [7.261, 0.54, 3.582, 12.438, 1.179]
    row = lambda hour, v: {"time": datetime(2024, 1, 1, hour), "latitude": 20.0, "longitude": 40.0, "precipitation": v}
    schema = "time timestamp, latitude double, longitude double, precipitation double"

    def total(name, hours):
        path = f"{tmp_path}/{name}"
        for n, batch in enumerate(hours):
            rows = ss.on_days(spark.createDataFrame([row(h, values[h] if h < len(values) else None) for h in batch], schema))
            rows.groupBy("date", "latitude", "longitude").agg(*[ss.MAKES[kind](c).alias(p) for p, (kind, c) in ss.RAIN_PARTS.items()]).write.parquet(f"{path}/batch={n}")
        (out,) = ss.whole_daily_precip(spark, path).collect()
        return out["daily_precip_total_mm"], out["daily_precip_max_step_mm"], out["daily_precip_extreme_flag"]

    want = 0.0
    for v in values:
        want += v
    for name, hours in (("a", [[0, 1, 2, 3, 4]]), ("b", [[4], [3], [1, 0, 9], [2]]), ("c", [[2, 3], [4, 0], [1]]), ("d", [[3, 1], [0, 2, 4]])):
        assert total(name, hours) == (want, 12.438, 1.0 if want >= 25 else 0.0), name
    assert total("none", [[9]]) == (None, None, None)
