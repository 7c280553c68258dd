"""Tables of parts: commits, readers in between, runs that break off, changed files."""

import os
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gridwarden.sources import snapshots as sn


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, v long")


def test_commits_replace_parts_and_readers_keep_their_version(spark, tmp_path):
    path = str(tmp_path / "t")
    read = lambda v=None: sorted((r["part"], r["v"]) for r in sn.read_snapshot(spark, path, v).collect())
    assert sn.commit(spark, path, frame(spark, [("a", 1), ("a", 2), ("b", 3)]), "k") == 1
    slow = sn.read_snapshot(spark, path)
    assert sn.commit(spark, path, frame(spark, [("b", 4), ("c", 5)]), "k", frame(spark, [("a", 0)])) == 2
    assert read() == [("b", 4), ("c", 5)] and read(1) == [("a", 1), ("a", 2), ("b", 3)]
    assert slow.count() == 3
    assert sorted(r["part"] for r in sn.changed_parts(spark, path, 2).collect()) == ["a", "b", "c"]
    assert sn.commit(spark, path, frame(spark, []), "k", frame(spark, [("b", 0)])) == 3 and read() == [("c", 5)]
    assert sn.replace_table(spark, path, frame(spark, [("x", 9)])) == 4 and read() == [("all", 9)]
    assert sn.expire(spark, path, 1) == 3 and read() == [("all", 9)] and sn.versions(spark, path) == [4]


def test_commits_that_break_off(spark, tmp_path):
    path = str(tmp_path / "t")
    sn.commit(spark, path, frame(spark, [("a", 1)]), "k")
    frame(spark, [("a", 7)]).withColumnRenamed("k", "part").write.partitionBy("part").parquet(f"{path}/data/commit=00")  # rows, no version
    assert [r["v"] for r in sn.read_snapshot(spark, path).collect()] == [1]
    os.makedirs(f"{path}/log/v=2/_temporary")  # a version begun
    assert [r["v"] for r in sn.read_snapshot(spark, path).collect()] == [1]
    with pytest.raises(Exception, match="(?i)exists"):
        sn.commit(spark, path, frame(spark, [("b", 2)]), "k")
    assert [r["v"] for r in sn.read_snapshot(spark, path).collect()] == [1]


def test_one_changed_file_rewrites_one_part(spark, tmp_path):
    path, source = str(tmp_path / "t"), tmp_path / "in"
    source.mkdir()

    def write(name, values):
        pq.write_table(pa.table({"v": pa.array(values, pa.int64())}), source / name)
        time.sleep(0.01)

    run = lambda: sn.update_from_files(spark, path, str(source), lambda rows: rows.filter("v > 0"), "v long")
    values = lambda: sorted(r["v"] for r in sn.read_snapshot(spark, path).collect())
    for k in range(4):
        write(f"{k}.parquet", [k * 10 + 1, -1])
    assert run() == {"files": 4, "skipped": 0, "version": 1} and values() == [1, 11, 21, 31]
    assert run() == {"files": 4, "skipped": 4, "version": 0}
    write("2.parquet", [22, 23, 24])
    assert run() == {"files": 4, "skipped": 3, "version": 2} and values() == [1, 11, 22, 23, 24, 31]
    assert sn.changed_parts(spark, path, 2).count() == 1
    os.remove(source / "0.parquet")
    write("3.parquet", [-5])
    assert run()["version"] == 3 and values() == [11, 22, 23, 24]
