"""Randomised controls. Every draw is a hash of (seed, key, number), so results don't depend on the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.text import hash_number
from strandloom.operators.intervals import common_stretches
from strandloom.operators.windows import merge_intervals


def draws(df: DataFrame, n: int, number: str = "draw") -> DataFrame:
    """Every row ``n`` times with a running number from 1."""
    return df.withColumn(number, F.explode(F.sequence(F.lit(1), F.lit(n))))


def random_windows(df: DataFrame, key: str, length: Column, low: Column, high: Column, n: int, seed: str) -> DataFrame:
    """``n`` windows of the row's length placed uniformly in [low, high], with replacement.

    Rows whose window doesn't fit, or with nulls, give none.
    """
    places = (high - low - length + 2).cast("bigint")
    t = draws(df.withColumns({"_places": places, "_low": low, "_len": length}).where("_places > 0"), n)
    start = F.col("_low") + F.pmod(hash_number(F.lit(seed), key, "draw"), F.col("_places"))
    return t.withColumn("random_start", start).withColumn("random_end", F.col("random_start") + F.col("_len") - 1).drop("_places", "_low", "_len")


def random_in_blocks(segments: DataFrame, blocks: DataFrame, key: str, row_id: str, length: str, start: str, end: str, n: int, seed: str) -> DataFrame:
    """``n`` windows per segment in the blocks of its key, a block chosen by its number of valid starts.

    A pick in [1, all valid starts] is found in the running sums of the
    valid starts of the key's blocks, which depend on the window's length.
    A key's blocks travel as one array (they don't overlap, so a sequence
    bounds their number), and a segment has a row per draw only.
    """
    b = blocks.select(key, F.struct(F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e")).alias("_x")).groupBy(key).agg(F.array_sort(F.collect_list("_x")).alias("_blocks"))
    t = segments.select(key, row_id, length).join(b, key)
    t = t.withColumn("_n", F.transform("_blocks", lambda x: F.greatest(F.lit(0).cast("bigint"), x["e"] - x["s"] - F.col(length) + 2)))
    t = t.withColumn("_to", F.expr("aggregate(_n, array(0L), (sums, x) -> concat(sums, array(element_at(sums, -1) + x)))")).withColumn("_all", F.element_at("_to", -1)).where("_all > 0")
    t = draws(t, n).withColumn("_pick", F.pmod(hash_number(F.lit(seed), row_id, "draw"), F.col("_all")) + 1)
    t = t.withColumn("_at", F.expr("array_position(transform(_to, x -> x >= _pick), true) - 2"))  # the first sum is that of no block
    s = F.expr("CAST(_blocks[CAST(_at AS INT)].s + _pick - _to[CAST(_at AS INT)] - 1 AS INT)")
    return t.select(key, row_id, "draw", s.alias("random_start"), (s + F.col(length) - 1).cast("int").alias("random_end"))


def permutation_test(segments: DataFrame, blocks: DataFrame, annotated: DataFrame, key: str, row_id: str, start: str, end: str, n: int, seed: str) -> DataFrame:
    """One row: observed share of segment positions that are annotated, mean and deviation of n re-randomisations, both p-values.

    Per permutation the drawn windows of a key are united and intersected
    with the annotation by boundary counting, all permutations at once:
    the permutation is part of the key.
    """
    lengths = segments.withColumn("_length", F.col(end) - F.col(start) + 1)
    drawn = random_in_blocks(lengths, blocks, key, row_id, "_length", start, end, n, seed).select(key, "draw", F.col("random_start").alias(start), F.col("random_end").alias(end))
    observed = segments.select(key, F.lit(0).alias("draw"), start, end).unionByName(drawn)
    # the annotation is united once, and only for the keys in question, before it is repeated per permutation
    annotated = merge_intervals(annotated, key, start, end, True).join(segments.select(key).distinct(), key, "left_semi")
    inside = draws(annotated.select(key, start, end), n).unionByName(annotated.select(key, start, end, F.lit(0).alias("draw")))
    t = common_stretches(observed, inside, ["draw", key], start, end).where("in_a").withColumn("_n", (F.col(end) - F.col(start) + 1).cast("bigint"))
    by = t.groupBy("draw").agg((F.sum(F.when(F.col("in_b"), F.col("_n")).otherwise(0)) / F.sum("_n")).alias("share"))
    real = F.max(F.when(F.col("draw") == 0, F.col("share")))
    obs = F.broadcast(by.agg(real.alias("observed")))  # one row
    r = by.where("draw > 0").join(obs)
    return r.agg(
        F.first("observed").alias("observed"),
        F.avg("share").alias("mean"),
        F.stddev_samp("share").alias("std"),
        F.count(F.lit(1)).alias("n"),
        ((F.count_if(F.col("share") >= F.col("observed")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_ge"),
        ((F.count_if(F.col("share") <= F.col("observed")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_le"),
    )


def excluded_starts(df: DataFrame, row_id: str, length: Column, low: Column, high: Column, forbidden: DataFrame, forbidden_key: str, start: str, end: str, n: int, seed: str) -> DataFrame:
    """Up to ``n`` different windows per row in [low, high] that overlap none of the row's forbidden intervals.

    All valid starts are listed and ordered by hash, so there is no
    rejection: ``random_n`` says how many there are if fewer than ``n``.
    ``forbidden`` is (forbidden_key = row id, start, end).
    """
    t = df.withColumns({"_len": length, "_low": low, "_high": high}).where("_high - _low - _len + 1 >= 0")
    t = t.select(row_id, "_len", F.explode(F.sequence(F.col("_low"), F.col("_high") - F.col("_len") + 1)).alias("random_start"))
    bad = forbidden.select(F.col(forbidden_key).alias(row_id), F.col(start).alias("_fs"), F.col(end).alias("_fe"))
    bad = bad.join(t.select(row_id, "_len").distinct(), row_id).select(row_id, F.explode(F.sequence(F.col("_fs") - F.col("_len") + 1, F.col("_fe"))).alias("random_start")).distinct()
    free = t.join(bad, [row_id, "random_start"], "left_anti")
    w = Window.partitionBy(row_id)
    k = F.row_number().over(w.orderBy(hash_number(F.lit(seed), row_id, "random_start"), "random_start"))
    out = free.withColumn("draw", k).where(F.col("draw") <= n)
    return out.withColumn("random_n", F.count(F.lit(1)).over(w)).select(row_id, "draw", "random_start", (F.col("random_start") + F.col("_len") - 1).alias("random_end"), "random_n")


def empirical_p(observed: DataFrame, random: DataFrame, key: str, value: str, random_value: str) -> DataFrame:
    """Plus-one p-values (ge, le, two-sided) and the plain share of randoms <= observed, per key."""
    t = random.select(key, F.col(random_value).alias("_r")).where("_r IS NOT NULL").join(observed.select(key, F.col(value).alias("_o")).where("_o IS NOT NULL"), key)
    n = F.count(F.lit(1))
    plus = lambda c: (F.count_if(c) + 1) / (n + 1)
    g = t.groupBy(key).agg(F.max("_o").alias("observed"), n.alias("random_n"), F.avg("_r").alias("random_mean"), plus(F.col("_r") >= F.col("_o")).alias("p_ge"), plus(F.col("_r") <= F.col("_o")).alias("p_le"), (F.count_if(F.col("_r") <= F.col("_o")) / n).alias("fraction_le"))
    return g.withColumn("p_two_sided", F.least(F.lit(1.0), 2 * F.least("p_ge", "p_le")))


def random_pairs(n_items: int, n_pairs: int, seed: str, spark) -> DataFrame:
    """(i, j) with i < j: exactly ``n_pairs`` different unordered pairs of 0..n-1.

    Pair numbers are drawn by a keyed bijection of 0..2**m - 1 (four
    rounds of a hash network over both halves) walked in order, so they
    are different by construction and nothing is sorted or rejected twice.
    """
    total = n_items * (n_items - 1) // 2
    if n_pairs > total:
        raise ValueError(f"there are only {total} pairs")
    half = max(1, (max(1, total - 1).bit_length() + 1) // 2)
    size = 1 << 2 * half
    mask = (1 << half) - 1
    x = spark.range(size).withColumnRenamed("id", "_x") if size <= 4 * n_pairs else spark.range(min(size, max(64, -(-n_pairs * size * 5 // (total * 4)) + 64))).withColumnRenamed("id", "_x")
    left, right = F.shiftright(F.col("_x"), half), F.col("_x").bitwiseAND(F.lit(mask))
    for r in range(4):
        left, right = right, left.bitwiseXOR(hash_number(F.lit(seed), F.lit(r), right).bitwiseAND(F.lit(mask)))
    t = x.withColumn("_code", F.shiftleft(left, half).bitwiseOR(right)).where(F.col("_code") < total).orderBy("_x").limit(n_pairs)
    # code -> (i, j), j-th row of the triangle: j(j-1)/2 <= code
    j = F.floor((F.sqrt(8.0 * F.col("_code") + 1) + 1) / 2).cast("bigint")
    t = t.withColumn("j", j)
    t = t.withColumn("j", F.when(F.expr("j * (j - 1) div 2 > _code"), F.col("j") - 1).when(F.expr("j * (j + 1) div 2 <= _code"), F.col("j") + 1).otherwise(F.col("j")))
    return t.select(F.expr("_code - j * (j - 1) div 2").cast("int").alias("i"), F.col("j").cast("int").alias("j"))


def quota_sample(df: DataFrame, bins: str, row_id: str, quota: int, seed: str) -> DataFrame:
    """Up to ``quota`` rows of every bin in hash order (a stated sampling operator)."""
    w = Window.partitionBy(bins).orderBy(hash_number(F.lit(seed), row_id), row_id)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= quota).drop("_r")


def seeded_sample(df: DataFrame, row_id: str, n: int, seed: str) -> DataFrame:
    """``n`` rows in hash order (top-n, no full sort)."""
    return df.orderBy(hash_number(F.lit(seed), row_id), row_id).limit(n)


def threshold_sensitivity(df: DataFrame, value: str, random_value: str, cluster: str, thresholds: list[float], subsets: dict[str, Column]) -> DataFrame:
    """Per subset and threshold: hit rates of real and random, their difference with a cluster-robust error, z and p.

    Subsets and thresholds become rows of one table, so the data are read
    once and grouped once.
    """
    from strandloom.operators.statistics import clustered_mean, normal_p

    t = df.where(F.col(value).isNotNull() & F.col(random_value).isNotNull())
    flags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in subsets.items()]))
    t = t.withColumn("subset", F.explode(flags)).withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    hit = lambda c: (F.col(c) >= F.col("threshold")).cast("int")
    t = t.withColumn("_g", F.concat_ws("@", "subset", "threshold")).withColumns({"_real": hit(value), "_random": hit(random_value)}).withColumn("_diff", F.col("_real") - F.col("_random"))
    rates = t.groupBy("_g", "subset", "threshold").agg(F.avg("_real").alias("real_rate"), F.avg("_random").alias("random_rate"))
    ci = clustered_mean(t, "_g", cluster, "_diff").select("_g", F.col("mean").alias("difference"), "n", "n_clusters", "se", "low", "high")
    out = rates.join(ci, "_g").drop("_g").withColumn("z", F.when(F.col("se") > 0, F.col("difference") / F.col("se")))
    return out.withColumn("p", normal_p(F.col("z")))


def own_null(actual: DataFrame, random: DataFrame, row_id: str, value: str, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Each row against its own random windows: observed, mean and median of the randoms, their number, plus-one p-value; missing values count 0."""
    r = random.select(row_id, F.coalesce(F.col(value), F.lit(0.0)).alias("_r")).join(actual.select(row_id, *keep, F.coalesce(F.col(value), F.lit(0.0)).alias("observed")), row_id)
    n = F.count(F.lit(1))
    return r.groupBy(row_id, *keep, "observed").agg(
        n.alias("random_n"), F.avg("_r").alias("random_mean"), F.percentile("_r", F.lit(0.5)).alias("random_median"), ((F.count_if(F.col("_r") >= F.col("observed")) + 1) / (n + 1)).alias("p_ge")
    )


def pooled_enrichment(actual: DataFrame, random: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """A row per threshold: all rows against all random windows: numbers, means and their ratio, hit rates and their ratio; missing values count 0, ratios by 0 are null."""
    both = actual.select(F.lit(True).alias("_real"), value).unionByName(random.select(F.lit(False).alias("_real"), value)).withColumn("_v", F.coalesce(F.col(value), F.lit(0.0)))
    t = both.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    of = lambda c, real: F.avg(F.when(F.col("_real") == real, c))
    hit = (F.col("_v") >= F.col("threshold")).cast("double")
    g = t.groupBy("threshold").agg(
        F.count_if("_real").alias("n_real"), F.count_if(~F.col("_real")).alias("n_random"), of(F.col("_v"), True).alias("real_mean"), of(F.col("_v"), False).alias("random_mean"), of(hit, True).alias("real_hit_rate"), of(hit, False).alias("random_hit_rate")
    )
    ratio = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b))
    return g.withColumns({"mean_enrichment": ratio("real_mean", "random_mean"), "hit_enrichment": ratio("real_hit_rate", "random_hit_rate")})
