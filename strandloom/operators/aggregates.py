"""Aggregations: summaries, histograms, threshold grids, alignment columns, correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.numeric import col, unordered


def summary(value: str, single_std: float | None = 0.0) -> list[Column]:
    """n, mean, std, min, quartiles, max of the non-null values; the std of one value is ``single_std``."""
    v = F.col(value)
    std = F.when(F.count(v) == 1, F.lit(single_std).cast("double")).otherwise(F.stddev_samp(v))
    q = lambda p: F.percentile(v, F.lit(p))
    return [F.count(v).alias("n"), F.avg(v).alias("mean"), std.alias("std"), F.min(v).alias("min"), q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"), F.max(v).alias("max")]


def histogram(df: DataFrame, value: str, width: float, groups: list[str] = []) -> DataFrame:  # noqa: B006
    """(groups, bin, n): floor bins of fixed width."""
    return df.where(F.col(value).isNotNull()).groupBy(*groups, F.floor(F.col(value) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_threshold(hist: DataFrame, width: float, share: float, groups: list[str]) -> DataFrame:
    """Upper edge of the first bin at which the cumulated share reaches ``share``.

    The histogram is small; its rows are summed along the bins per group.
    """
    w = Window.partitionBy(*groups)
    run = hist.withColumn("_c", F.sum("n").over(w.orderBy("bin"))).withColumn("_t", F.sum("n").over(w))
    return run.where(F.col("_c") >= share * F.col("_t")).groupBy(*groups).agg(((F.min("bin") + 1) * width).alias("threshold"))


def running_stats(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Mergeable state (n, s, ss, lo, hi) of a value; states of parts are summed by ``merge_stats``."""
    v = F.col(value).cast("double")
    return df.groupBy(*groups).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"), F.min(v).alias("lo"), F.max(v).alias("hi"))


def merge_stats(states: DataFrame, groups: list[str]) -> DataFrame:
    """n, mean, population std, min and max from states of parts."""
    t = states.groupBy(*groups).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.min("lo").alias("min"), F.max("hi").alias("max"))
    mean = F.col("s") / F.col("n")
    return t.select(*groups, "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"), "min", "max")


def threshold_grid(df: DataFrame, first: str, firsts: list[float], second: str, seconds: list[float], group: str, family_a: str, family_b: str) -> DataFrame:
    """Points, pairs and covered families for every (first <=, second >=) threshold.

    A point enters the grid at its tightest first and loosest second
    threshold and is counted there once; the counts of all grid points are
    then cumulated over the small grid. Distinct pairs and families enter
    at the cells of their own corner points, so nothing is multiplied by
    the size of the grid before it is reduced.
    """
    f, s = sorted(firsts), sorted(seconds)
    fa = F.array(*[F.lit(float(x)) for x in f])
    sa = F.array(*[F.lit(float(x)) for x in s])
    cell = df.select(
        (F.size(F.filter(fa, lambda t: F.col(first) > t))).alias("fi"),
        (F.size(F.filter(sa, lambda t: F.col(second) >= t)) - 1).alias("si"),
        F.col(group).alias("g"),
        F.col(family_a).alias("a"),
        F.col(family_b).alias("b"),
    ).where((F.col("fi") < len(f)) & (F.col("si") >= 0))
    spark = df.sparkSession
    grid = F.broadcast(spark.createDataFrame([(i, j, float(x), float(y)) for i, x in enumerate(f) for j, y in enumerate(s)], "gi int, gj int, first double, second double"))
    inside = (F.col("fi") <= F.col("gi")) & (F.col("si") >= F.col("gj"))
    counts = cell.groupBy("fi", "si").agg(F.count(F.lit(1)).alias("n")).join(grid, inside).groupBy("first", "second").agg(F.sum("n").alias("points"))
    corner = lambda names: cell.groupBy(*names, "fi").agg(F.max("si").alias("si"))
    pairs = corner(["g"]).join(grid, inside).groupBy("first", "second").agg(F.countDistinct("g").alias("pairs"))
    families = cell.select(F.explode(F.array("a", "b")).alias("fam"), "fi", "si").groupBy("fam", "fi").agg(F.max("si").alias("si"))
    families = families.join(grid, inside).groupBy("first", "second").agg(F.countDistinct("fam").alias("families"))
    out = grid.select("first", "second").join(counts, ["first", "second"], "left").join(pairs, ["first", "second"], "left").join(families, ["first", "second"], "left")
    return out.fillna(0, ["points", "pairs", "families"])


def alignment_columns(df: DataFrame, family: str, sequence: str, gaps: str = "-.") -> DataFrame:
    """Per family and column (1-based): residues, gaps, completeness in percent, entropy (nats), effective number, majority.

    Of equally frequent residues the smallest letter is the majority.
    """
    cells = df.select(family, F.posexplode(F.split(F.upper(F.col(sequence)), "")).alias("p", "aa")).where("aa != ''")
    counts = cells.groupBy(family, (F.col("p") + 1).alias("position"), "aa").agg(F.count(F.lit(1)).alias("n"))
    residue = ~F.col("aa").isin(*gaps)
    n = F.sum(F.when(residue, F.col("n")))
    log_sum = F.sum(F.when(residue, F.col("n") * F.log("n")))
    g = counts.groupBy(family, "position").agg(
        F.coalesce(n, F.lit(0)).alias("residues"),
        F.coalesce(F.sum(F.when(~residue, F.col("n"))), F.lit(0)).alias("gaps"),
        F.when(n > 0, F.log(n) - log_sum / n).alias("entropy"),
        F.max(F.when(residue, F.struct("n", (-F.ascii("aa")).alias("o"), "aa"))).alias("_top"),
    )
    return g.select(family, "position", "residues", "gaps", (F.col("residues") / (F.col("residues") + F.col("gaps")) * 100).alias("completeness"), "entropy", F.exp("entropy").alias("effective"), F.col("_top.aa").alias("majority"))


def heaviest_edges(edges: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """(a, b, weight): the heaviest of parallel undirected edges, loops dropped."""
    u, v = unordered(a, b)
    t = edges.select(u.alias(a), v.alias(b), weight).where(F.col(a).isNotNull() & (F.col(a) != F.col(b)))
    return t.groupBy(a, b).agg(F.max(weight).alias(weight))


def degrees(edges: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """(node, degree, weighted_degree) of an undirected graph."""
    ends = edges.select(F.explode(F.array(a, b)).alias("node"), weight)
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum(weight).alias("weighted_degree"))


def first_seen_mode(df: DataFrame, groups: list[str], value: str, order: str) -> DataFrame:
    """(groups, mode, fraction): the most frequent value, of equals the one seen first."""
    c = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    g = c.groupBy(*groups).agg(F.max(F.struct("n", (-F.col("first")).alias("o"), F.col(value).alias("v"))).alias("m"), F.sum("n").alias("t"))
    return g.select(*groups, F.col("m.v").alias("mode"), (F.col("m.n") / F.col("t")).alias("fraction"))


def frequencies(df: DataFrame, value: str) -> DataFrame:
    """(value, n, fraction); the total is one row joined by broadcast, not a window over everything."""
    c = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(c.agg(F.sum("n").alias("_t")))
    return c.join(total).select(value, "n", (F.col("n") / F.col("_t")).alias("fraction"))


def average_ranks(df: DataFrame, groups: list[str], value: str, out: str) -> DataFrame:
    """Rank with ties averaged, within groups.

    Counts of the distinct values are cumulated over range partitions, so a
    group of any size is spread over many tasks.
    """
    from strandloom.operators.windows import ordered_buckets, running_total

    c = ordered_buckets(df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n")), [*groups, value])
    c = running_total(c, [F.asc(value)], "_n", "_upto", ["_p"], groups)
    c = c.select(*groups, value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))
    return df.join(c, [*groups, value])


def spearman(df: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """(groups, n, pearson, spearman) over rows with both values."""
    t = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    t = average_ranks(average_ranks(t, groups, x, "_rx"), groups, y, "_ry")
    return t.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))


def depth_track(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, position, depth): number of closed intervals over every covered position.

    Depth changes only at ends, so the changes are summed along the key and
    each stretch of equal depth is expanded once, whatever the number of
    intervals over it.
    """
    steps = intervals.where(F.col(start) <= F.col(end)).select(key, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct((F.col(end) + 1).alias("at"), F.lit(-1).alias("d")))).alias("s"))
    steps = steps.groupBy(key, F.col("s.at").alias("at")).agg(F.sum("s.d").alias("d"))
    w = Window.partitionBy(key).orderBy("at")
    t = steps.select(key, "at", F.sum("d").over(w).alias("depth"), F.lead("at").over(w).alias("to")).where("depth > 0")
    return t.select(key, F.explode(F.sequence(F.col("at"), F.col("to") - 1)).alias("position"), "depth")


def run_stats(df: DataFrame, key: str, pos: str) -> DataFrame:
    """(key, n, n_runs, longest_run) of the distinct integers of a key."""
    t = df.where(F.col(pos).isNotNull()).select(key, pos).distinct()
    t = t.withColumn("_g", F.col(pos) - F.row_number().over(Window.partitionBy(key).orderBy(pos)))
    runs = t.groupBy(key, "_g").agg(F.count(F.lit(1)).alias("_n"))
    return runs.groupBy(key).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("n_runs"), F.max("_n").alias("longest_run"))


def contact_order(fragments: DataFrame, contacts: DataFrame, chain: str, fragment: str, index: str, length: int, near: int) -> DataFrame:
    """Per fragment: distinct contacts at either end, summed and mean separation, relative order, share of long-range ones.

    ``fragments`` is (chain, fragment, index), ``contacts`` (chain, i, j,
    length of chain as ``chain_length``).
    """
    ends = contacts.select(chain, "i", "j", "chain_length", F.explode(F.array("i", "j")).alias(index))
    hit = fragments.join(ends, [chain, index]).select(chain, fragment, "i", "j", "chain_length").distinct()
    sep = F.col("j") - F.col("i")
    return hit.groupBy(chain, fragment).agg(
        F.count(F.lit(1)).alias("n_contacts"),
        F.sum(sep).alias("sum_separation"),
        F.avg(sep).alias("mean_separation"),
        (F.avg(sep) / F.max("chain_length")).alias("rfco"),
        F.avg((sep >= length).cast("int")).alias("long_range"),
    )


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    return F.sum(col(value) * col(weight)) / F.sum(col(weight))


def interval_densities(points: DataFrame, intervals: DataFrame, key: str, row_id: str, pos: str, value: str, start: str, end: str, high: float) -> DataFrame:
    """Fourteen densities of the valued points inside every closed interval of the same key; 0 where there are none.

    Points are summed up by position first, so a position with very many of
    them meets the intervals once; null and NaN values are no points.
    Counts of points, of high points (from ``high`` on) and of their
    positions, whether there are any, all four per unit of length, and the
    sums per unit of length of the values and of the positions' means, as
    they are and cut to 0..1.
    """
    from strandloom.operators.joins import points_in_intervals

    v = F.col(value)
    cut = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    by = points.where(F.col(key).isNotNull() & F.col(pos).isNotNull() & v.isNotNull() & ~F.isnan(v)).groupBy(F.col(key), F.col(pos).alias("_pos"))
    by = by.agg(F.count(F.lit(1)).alias("_n"), F.count_if(v >= high).alias("_h"), F.sum(v).alias("_s"), F.sum(cut).alias("_c"))
    iv = intervals.select(key, row_id, F.col(start).alias("_a"), F.col(end).alias("_b")).where("_a <= _b")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    inside = points_in_intervals(by, iv, key, "_pos", "_a", "_b").groupBy(row_id).agg(
        total("_n").alias("n_points"), total("_h").alias("n_high_points"), F.count(F.lit(1)).cast("double").alias("n_positions"), F.count_if(F.col("_h") > 0).cast("double").alias("n_high_positions"),
        total("_s").alias("_sum"), total("_c").alias("_cut"), total(F.col("_s") / F.col("_n")).alias("_mean"), total(F.col("_c") / F.col("_n")).alias("_mean_cut"),
    )
    t = iv.select(row_id, (F.col("_b") - F.col("_a") + 1).alias("_len")).join(inside, row_id, "left").fillna(0.0)
    counts = ["n_points", "n_high_points", "n_positions", "n_high_positions"]
    sums = {"_sum": "value_density", "_cut": "cut_value_density", "_mean": "position_mean_density", "_mean_cut": "cut_position_mean_density"}
    return t.select(
        row_id, (F.col("n_points") > 0).cast("double").alias("any_point"), (F.col("n_high_points") > 0).cast("double").alias("any_high_point"), *counts,
        *[(F.col(c) / F.col("_len")).alias(f"{c[2:]}_density") for c in counts], *[(F.col(c) / F.col("_len")).alias(n) for c, n in sums.items()],
    )
