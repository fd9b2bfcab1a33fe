from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators.runs import covered_and_gaps
from strandloom.operators.skew import aggregate_by_fragments, aggregate_sides_by_fragments, fragment_join, plan_fragments, salted_join


def merged(rows):
    out = set()
    for k in {r[0] for r in rows if r[0] is not None}:
        iv = sorted((min(a, b), max(a, b)) for e, a, b in rows if e == k and None not in (a, b))
        seen: list[list[int]] = []
        for a, b in iv:
            if seen and a <= seen[-1][1] + 1:
                seen[-1][1] = max(seen[-1][1], b)
            else:
                seen.append([a, b])
        for n, (a, b) in enumerate(seen):
            out.add((k, "period", a, b))
            if n:
                out.add((k, "gap", seen[n - 1][1] + 1, a - 1))
    return out


@pytest.mark.parametrize("reach", [40, 3000, 10**6, 10**9, 2 * 10**15, 2**62])
def test_periods_against_brute_force(spark, reach):
    rng = random.Random(reach)
    rows = [(e, a := rng.randint(-reach, reach), a + rng.choice([-3, 0, 1, 7, 64, 63, reach // 50])) for e in "ab" for _ in range(120)]
    rows += rows[:20] + [(None, 1, 2), ("a", None, 5), ("b", 5, None), ("c", 1 << 18, (1 << 18) * 3 - 1), ("c", 0, (1 << 18) - 1), ("c", (1 << 20) + 1, (1 << 20) + 1)]
    df = spark.createDataFrame(rows, "k string, s long, e long").withColumn("level", F.lit(0)).withColumn("entity", F.lit("x"))
    got = [tuple(r) for r in covered_and_gaps(df, "k", "s", "e", "bigint").collect()]
    assert len(got) == len(set(got)) and set(got) == merged(rows)


def test_periods_at_the_ends_of_the_numbers_and_beside_long_stretches(spark):
    low, high = -(2**63), 2**63 - 1
    rows = [("all", low, high), ("all", 5, 7), ("ends", low, low), ("ends", high, high), ("halves", low, -1), ("halves", 0, high), ("holes", low, -2), ("holes", 1, high - 1), ("one", 7, 7)]
    rows += [("long", 64**k, 64**k * 3 - k % 2) for k in range(1, 10)] + [("short", 64**k + 5, 64**k + 5 + k) for k in range(1, 10)]
    rows += [("edges", k * 2**18 - 1, k * 2**18) for k in (1, 2, 3)] + [("edges", 2**30 - 2, 2**30 + 2), ("edges", 2**42 - 1, 2**42 - 1), ("edges", 2**42, 2**42), ("edges", 2**18 + 9, 2**18 + 10)]
    df = spark.createDataFrame(rows, "k string, s long, e long")
    got = [tuple(r) for r in covered_and_gaps(df, "k", "s", "e", "bigint").collect()]
    assert len(got) == len(set(got)) and set(got) == merged(rows)


def test_periods_of_times_in_microseconds(spark):
    """Seconds of work in a year of microseconds, many shards to an entity, one entity with half the rows."""
    rng = random.Random(3)
    begin = 1_700_000_000_000_000
    rows = [("hot" if i % 2 else f"e{i % 30}", a := begin + rng.randrange(3 * 10**13), a + rng.choice([0, 250_000, 10**6, 5 * 10**9])) for i in range(3000)]
    got = [tuple(r) for r in covered_and_gaps(spark.createDataFrame(rows, "k string, s long, e long"), "k", "s", "e", "bigint").collect()]
    assert len(got) == len(set(got)) and set(got) == merged(rows)


def test_periods_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, s int, e int")
    assert covered_and_gaps(empty, "k", "s", "e").collect() == []


def skewed(spark, n=3000):
    rng = random.Random(5)
    rows = [(None if i % 50 == 0 else 7 if i % 3 == 0 else rng.randint(10, 900), i, i % 11 - 1) for i in range(n)]
    return rows, spark.createDataFrame(rows + rows[: n // 10], "k int, id int, v int")


def test_fragments_spread_and_add_up(spark):
    rows, df = skewed(spark)
    plan = plan_fragments(df, "k", 8)
    assert 7 in plan.heavy_keys and max(plan.task_loads) < 1.3 * sum(plan.task_loads) / 8
    per_task = plan.route(df, "k", ["id"]).groupBy("_fragment_task").count().collect()
    assert max(r["count"] for r in per_task) < 1.5 * 3300 / 8
    got = {r["k"]: (r["n"], r["s"], r["m"]) for r in aggregate_by_fragments(df, "k", "id", {"n": (F.lit(1), "count"), "s": (F.col("v"), "sum"), "m": (F.col("v"), "max")}, 8).collect()}
    want = {}
    for k, _, v in rows:
        n, s, m = want.get(k, (0, 0, -9))
        want[k] = (n + 1, s + v, max(m, v))
    assert got == want


def test_fragment_join_equals_plain_join(spark):
    _, df = skewed(spark)
    right = spark.createDataFrame([(k, f"x{k}") for k in range(0, 500)] + [(7, "again"), (None, "no")], "k int, label string")
    for how in ("inner", "left"):
        key = lambda d: sorted(map(str, d.select("k", "id", "v", "label").collect()))
        assert key(fragment_join(df, right, "k", ["id"], how, 6)) == key(df.join(right, "k", how))


def test_salted_join_equals_plain_join(spark):
    _, df = skewed(spark)
    right = df.groupBy("k").agg(F.count(F.lit(1)).alias("load"), F.max("v").alias("top"))
    got = salted_join(df, right, "k", "load", "id", 100)
    assert sorted(map(str, got.select("k", "id", "top").collect())) == sorted(map(str, df.join(right, "k").select("k", "id", "top").collect()))


def test_sides_add_up_and_match(spark):
    rng = random.Random(9)
    rows = [(7 if i % 3 == 0 else rng.choice([None, rng.randint(10, 90)]), rng.choice([7, 11, 11, 11, None, 50]), i, i % 11 - 1) for i in range(3000)]
    df = spark.createDataFrame(rows + rows[:400], "a int, b int, id int, v int").withColumn("side", F.lit(1)).withColumn("_side", F.lit(2)).withColumn("key", F.lit(3))
    right = spark.createDataFrame([(7, "seven"), (11, "eleven"), (None, "no")], "k int, label string")
    aggs = {"n": (F.lit(1), "count"), "s": (F.col("v"), "sum"), "m": (F.when(F.col("v") < 5, F.col("v")), "max")}
    got = {(r["side"], r["key"]): (r["n"], r["s"], r["m"], r["label"]) for r in aggregate_sides_by_fragments(df, ["a", "b"], "id", aggs, right, "k", 8).collect()}
    want = {}
    for row in rows:
        for side, k in (("a", row[0]), ("b", row[1])):
            n, s, m, _ = want.get((side, k), (0, 0, -9, None))
            want[side, k] = (n + 1, s + row[3], max(m, row[3] if row[3] < 5 else -9), {7: "seven", 11: "eleven"}.get(k))
    assert got == want
    assert aggregate_sides_by_fragments(df.limit(0), ["a", "b"], "id", aggs).collect() == []


def test_fragments_of_nothing(spark):
    empty = spark.createDataFrame([], "k int, id int, v int")
    assert aggregate_by_fragments(empty, "k", "id", {"n": (F.lit(1), "count")}).collect() == []


def test_fragments_with_clashing_columns(spark):
    _, df = skewed(spark, 600)
    extra = ["_task", "_tasks", "_bin", "_key", "_salt", "load", "_id", "_k", "_v0"]
    odd = df.select("*", *[F.lit(1).alias(c) for c in extra])
    right = spark.createDataFrame([(7, "seven"), (11, "eleven")], "k int, label string")
    got = fragment_join(odd, right, "k", ["id"], n_tasks=4)
    assert set(extra) <= set(got.columns) and got.count() == df.join(right, "k").count()
    a, b = (aggregate_by_fragments(t, "k", "id", {"load": (F.lit(1), "count"), "_k": (F.col("v"), "max")}, 4) for t in (odd, df))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
