from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from strandloom.streaming import watch

T0 = datetime(2025, 1, 6, 10)


def put(spark, rows, path, mode="append"):
    t = spark.createDataFrame([(k, T0 + timedelta(minutes=m), float(v)) for k, m, v in rows], "k string, ts timestamp, v double")
    t.coalesce(1).write.mode(mode).parquet(str(path))
    return t.schema


def test_arriving_files_are_read_once_and_kept(spark, tmp_path):
    schema = put(spark, [("a", 1, 1), ("b", 2, -1)], tmp_path / "in")
    run = lambda: watch.run_available(watch.arriving(spark, str(tmp_path / "in"), schema), lambda b: b.where("v > 0"), str(tmp_path / "out"), str(tmp_path / "cp"))
    run(), run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    put(spark, [("c", 3, 5)], tmp_path / "in")
    run()
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "c"]
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 2


def test_windows_take_late_rows_up_to_the_limit(spark, tmp_path):
    schema = put(spark, [("a", 1, 1), ("a", 61, 2)], tmp_path / "in")
    w = lambda: watch.windowed(watch.arriving(spark, str(tmp_path / "in"), schema), "ts", "1 hour", "30 minutes", ["k"], "v")
    go = lambda: watch.run_available(w(), lambda b: b, str(tmp_path / "out"), str(tmp_path / "cp"), "update")
    go()
    put(spark, [("a", 2, 10), ("b", 300, 1)], tmp_path / "in")  # late by less than the limit when it is read
    go()
    put(spark, [("a", 3, 100)], tmp_path / "in")  # now the window is closed
    go()
    got = {(r["k"], r["window_start"].hour): (r["n"], r["total"]) for r in watch.latest(spark, str(tmp_path / "out"), ["k", "window_start"]).collect()}
    assert got[("a", 11)] == (1, 2.0) and got[("b", 15)] == (1, 1.0)
    assert got[("a", 10)][1] in (1.0, 11.0) and got[("a", 10)][1] < 100


def test_sessions(spark, tmp_path):
    schema = put(spark, [("a", 0, 1), ("a", 5, 1), ("a", 40, 1), ("b", 7, 1), ("z", 900, 1)], tmp_path / "in")
    s = watch.sessions(watch.arriving(spark, str(tmp_path / "in"), schema), "ts", "10 minutes", "1 minute", "k")
    watch.run_available(s, lambda b: b, str(tmp_path / "out"), str(tmp_path / "cp"), "append")
    got = sorted((r["k"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).where(F.col("k") != "z").collect())
    assert got == [("a", 1), ("a", 2), ("b", 1)]
