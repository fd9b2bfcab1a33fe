"""Algebra of interval sets per key by boundary counting: no expansion to positions, no overlap join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else key


def _steps(df: DataFrame, keys: list[str], start: str, end: str, name: str) -> DataFrame:
    t = df.dropna(subset=keys).where(F.col(start) <= F.col(end))
    ends = F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias(name)), F.struct((F.col(end) + 1).alias("at"), F.lit(-1).alias(name)))
    return t.select(*keys, F.explode(ends).alias("_x")).select(*keys, "_x.*")


def common_stretches(a: DataFrame, b: DataFrame, key: str | list[str], start: str, end: str) -> DataFrame:
    """(key columns, start, end, in_a, in_b) of consecutive stretches covered by either set."""
    keys = _keys(key)
    both = _steps(a, keys, start, end, "a").unionByName(_steps(b, keys, start, end, "b"), allowMissingColumns=True)
    both = both.groupBy(*keys, "at").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
    w = Window.partitionBy(*keys).orderBy("at")
    t = both.select(*keys, F.col("at").alias(start), (F.lead("at").over(w) - 1).alias(end), (F.sum("a").over(w) > 0).alias("in_a"), (F.sum("b").over(w) > 0).alias("in_b"))
    return t.where("in_a OR in_b")


def intersect_sets(a: DataFrame, b: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, length_a, length_b, length_both) of the keys in both sets; overlaps within a set count once."""
    t = common_stretches(a, b, key, start, end).withColumn("_n", (F.col(end) - F.col(start) + 1).cast("bigint"))
    n = lambda c, out: F.coalesce(F.sum(F.when(F.expr(c), F.col("_n"))), F.lit(0)).alias(out)
    return t.groupBy(key).agg(n("in_a", "length_a"), n("in_b", "length_b"), n("in_a AND in_b", "length_both")).where("length_a > 0 AND length_b > 0")


def intersection(a: DataFrame, b: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end) of the stretches in both sets; neighbouring stretches may touch."""
    return common_stretches(a, b, key, start, end).where("in_a AND in_b").select(key, start, end)
