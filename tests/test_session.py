from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from strandloom.functions.udtf import register
from strandloom.session import Stage, shared_dir, ship, small


def test_shared_folder_comes_from_the_session(spark):
    first = shared_dir(spark)
    assert first == shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    conf = {"spark.checkpoint.dir": "hdfs:///shared/"}
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=SimpleNamespace(master="spark://x", getConf=lambda: {}))
    assert shared_dir(fake) == "hdfs:///shared"
    conf.clear()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(fake)


def test_stages_are_written_and_dropped(spark):
    stage = Stage(spark, "test")
    t = stage.write(spark.range(10).withColumn("x", F.array("id")), "a")
    assert t.count() == 10 and t.dtypes == [("id", "bigint"), ("x", "array<bigint>")]
    stage.drop("a")
    with pytest.raises(Exception):
        spark.read.parquet(f"{stage.root}/a").count()


def test_small_sides_are_hinted_and_large_ones_not(spark):
    plan = lambda d: d._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(small(spark.range(5), 5)).lower() and "broadcast" not in plan(small(spark.range(6), 5)).lower()


def test_workers_find_the_package(spark):
    ship(spark), ship(spark)

    @F.udf("string")
    def where():
        import strandloom.functions.text as t

        return t.__name__

    assert spark.range(1).select(where()).first()[0] == "strandloom.functions.text"


def test_table_functions(spark):
    register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM window_starts(8, 6)").collect()] == [(1, 6), (2, 7), (3, 8)]
    assert spark.sql("SELECT * FROM segment_pieces(NULL)").count() == 0
    assert [tuple(r) for r in spark.sql("SELECT * FROM segment_pieces('1-2 -> 3-4; x; 5-6->7-8')").collect()] == [(0, 1, 2, 3, 4), (2, 5, 6, 7, 8)]
