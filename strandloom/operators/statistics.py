"""Tests and intervals from grouped moments; p-values in vectorised functions on the small grouped result."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.skew import fair_share, salted_join
from strandloom.operators.windows import ordered_buckets, running_total
from strandloom.session import ship


def welch(df: DataFrame, group: str, value: str, is_first: Column) -> DataFrame:
    """Means of two samples per group, pooled deviation, Cohen's d, Welch's t, its degrees of freedom and two-sided p."""
    ship(df.sparkSession)
    v = {"a": F.when(is_first, F.col(value)), "b": F.when(~is_first, F.col(value))}
    g = df.groupBy(group).agg(*[f(v[s]).alias(f"{n}_{s}") for s in "ab" for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    c = F.col
    se = [c(f"var_{s}") / c(f"n_{s}") for s in "ab"]
    pooled = F.sqrt(((c("n_a") - 1) * c("var_a") + (c("n_b") - 1) * c("var_b")) / (c("n_a") + c("n_b") - 2))
    g = g.where((c("n_a") > 1) & (c("n_b") > 1)).withColumn("pooled_sd", pooled)
    diff = c("mean_a") - c("mean_b")
    g = g.withColumn("cohen_d", F.when(c("pooled_sd") > 0, diff / c("pooled_sd"))).withColumn("t", F.when(se[0] + se[1] > 0, diff / F.sqrt(se[0] + se[1])))
    g = g.withColumn("df", F.when(se[0] + se[1] > 0, F.pow(se[0] + se[1], 2) / (F.pow(se[0], 2) / (c("n_a") - 1) + F.pow(se[1], 2) / (c("n_b") - 1))))

    @F.pandas_udf("double")
    def p(t: pd.Series, df_: pd.Series) -> pd.Series:
        from strandloom.functions.special import student_t_two_sided

        return pd.Series(student_t_two_sided(t.to_numpy(float), df_.to_numpy(float)))

    return g.withColumn("p", p("t", "df")).drop("var_a", "var_b")


def normal_p(z: Column) -> Column:
    """Two-sided p-value of a normal statistic."""

    @F.pandas_udf("double")
    def p(x: pd.Series) -> pd.Series:
        from strandloom.functions.special import normal_two_sided

        return pd.Series(normal_two_sided(x.to_numpy(float)))

    return p(z)


def kolmogorov_p(d: Column, n_a: Column, n_b: Column) -> Column:
    """Asymptotic p-value of a two-sample distance."""

    @F.pandas_udf("double")
    def p(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        from strandloom.functions.special import kolmogorov_two_sided

        a, b = a.to_numpy(float), b.to_numpy(float)
        return pd.Series(kolmogorov_two_sided(x.to_numpy(float), a * b / (a + b)))

    return p(d, n_a, n_b)


def clustered_mean(df: DataFrame, group: str, cluster: str, value: str, z: float = 1.959964) -> DataFrame:
    """Mean with a confidence interval robust to clusters: sqrt(c/(c-1) sum of squared cluster sums of deviations) / n."""
    t = df.where(F.col(value).isNotNull())
    by = t.groupBy(group, cluster).agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    mean = by.groupBy(group).agg((F.sum("_s") / F.sum("_n")).alias("mean"))
    dev = by.join(mean, group).withColumn("_d", F.col("_s") - F.col("_n") * F.col("mean"))
    g = dev.groupBy(group).agg(F.first("mean").alias("mean"), F.sum("_n").alias("n"), F.count(F.lit(1)).alias("n_clusters"), F.sum(F.col("_d") * F.col("_d")).alias("_ss"))
    c = F.col("n_clusters")
    g = g.withColumn("se", F.when(c > 1, F.sqrt(c / (c - 1) * F.col("_ss")) / F.col("n"))).drop("_ss")
    return g.withColumn("low", F.col("mean") - z * F.col("se")).withColumn("high", F.col("mean") + z * F.col("se"))


def fdr(df: DataFrame, groups: list[str], p: str, out: str = "q") -> DataFrame:
    """Benjamini-Hochberg q-values within groups; null and NaN p-values get none and don't count.

    Worked out on the counts of different p-values in ordered buckets, so a
    group of any size is spread over tasks; rows are joined to their value
    with frequent values cut by load.
    """
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]
    names = [f"_g{i}" for i in range(len(groups))]
    t = df.withColumn("_k", F.when(F.col(p).isNotNull() & ~F.isnan(p), F.struct(*keys, F.col(p).cast("double").alias("_p"))))
    counts = t.where("_k IS NOT NULL").groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).select("_k", "_k.*", "_n")
    c = ordered_buckets(counts, [*names, "_p"], "_at")
    c = running_total(c, [F.asc("_p")], "_n", "_rank", ["_at"], names)

    def meet(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        b = b.withColumnsRenamed({x: f"_right{x}" for x in on})
        return a.join(b, [F.col(x).eqNullSafe(F.col(f"_right{x}")) for x in on]).drop(*[f"_right{x}" for x in on])

    total = c.groupBy(*names).agg(F.sum("_n").alias("_all"))
    c = meet(c, total, names).withColumn("_raw", F.col("_p") * F.col("_all") / F.col("_rank"))
    # the running minimum from above: inside a bucket, and over the buckets behind it (a row each)
    above = F.min("_raw").over(Window.partitionBy(*names, "_at").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0))
    least = c.groupBy(*names, "_at").agg(F.min("_raw").alias("_least"))
    behind = F.min("_least").over(Window.partitionBy(*names).orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1))
    least = least.select(*names, "_at", behind.alias("_behind"))
    q = c.withColumn("_above", above)
    q = meet(q, least, [*names, "_at"]).select("_k", F.least(F.lit(1.0), "_above", "_behind").alias(out), F.col("_n").alias("_load"))
    rows = t.withColumn("_spread", F.xxhash64(*df.columns))
    return salted_join(rows, q, "_k", "_load", "_spread", fair_share(df.sparkSession, 0), "left").select(*df.columns, out)


def histogram_distances(df: DataFrame, value: str, is_first: Column, low: float, high: float, bins: int) -> DataFrame:
    """L1, total variation, overlap and Jensen-Shannon divergence (bits) of two histograms; the last bin is closed."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1))
    c = df.where(F.col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count_if(is_first).alias("a"), F.count_if(~is_first).alias("b"))
    totals = F.broadcast(c.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb")))  # one row
    t = c.join(totals).withColumns({"p": F.col("a") / F.col("ta"), "q": F.col("b") / F.col("tb")})
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / m)).otherwise(0.0)
    return t.agg(
        F.sum(F.abs(F.col("p") - F.col("q"))).alias("l1"),
        (F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("total_variation"),
        F.sum(F.least("p", "q")).alias("overlap"),
        (F.sum(part("p") + part("q")) / 2).alias("jensen_shannon"),
    )


def fit_curves(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Five-parameter logistic curve per group: parameters, R squared, x of the steepest point and of both bends.

    A group is one curve, a few hundred points at most; groups with fewer
    than 6 points come out with nulls.
    """
    ship(df.sparkSession)
    kind = dict(df.dtypes)[group]
    names = ["low", "high", "slope", "mid", "asymmetry", "r2", "steepest", "bend_up", "bend_down"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        from strandloom.functions.special import fit_richards, richards

        pts = pdf[[x, y]].astype(float).dropna().groupby(x)[y].mean()
        xs, ys = pts.index.to_numpy(), pts.to_numpy()
        row = [None] * len(names)
        if len(xs) >= 6 and np.ptp(xs) > 0 and np.ptp(ys) > 0:
            p, r2 = fit_richards(xs, ys)
            grid = np.linspace(xs.min(), xs.max(), 1001)
            first = np.gradient(richards(grid, p), grid)
            second = np.gradient(first, grid)
            row = [*p, r2, grid[np.abs(first).argmax()], grid[second.argmax()], grid[second.argmin()]]
        return pd.DataFrame([[pdf[group].iloc[0], *row]], columns=[group, *names])

    return df.select(group, x, y).groupBy(group).applyInPandas(one, f"{group} {kind}, " + ", ".join(f"{n} double" for n in names))


def density(df: DataFrame, group: str, x: str, y: str, sample: str) -> DataFrame:
    """Two-dimensional Gaussian kernel density at every distinct point of a group.

    Points are first counted on a grid of a quarter bandwidth (Scott's
    rule), so a group is at most the cells of its range whatever its rows;
    the density is that of the cell counts.
    """
    ship(df.sparkSession)
    kind = dict(df.dtypes)[group]
    s = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp(x).alias("_sx"), F.stddev_samp(y).alias("_sy"))
    h = F.pow(F.col("_n"), -1 / 6)
    t = df.join(s.where("_n > 2 AND _sx > 0 AND _sy > 0"), group).withColumns({"_hx": F.col("_sx") * h, "_hy": F.col("_sy") * h})
    cell = t.groupBy(group, "_n", "_hx", "_hy", F.floor(F.col(x) / (F.col("_hx") / 4)).alias("cx"), F.floor(F.col(y) / (F.col("_hy") / 4)).alias("cy")).agg(F.count(F.lit(1)).alias("w"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        px, py, w = pdf["cx"].to_numpy(float) / 4, pdf["cy"].to_numpy(float) / 4, pdf["w"].to_numpy(float)
        out = np.zeros(len(px))
        for a in range(0, len(px), 512):
            d2 = (px[a : a + 512, None] - px) ** 2 + (py[a : a + 512, None] - py) ** 2
            out[a : a + 512] = np.exp(-d2 / 2) @ w
        scale = 2 * np.pi * pdf["_hx"].iloc[0] * pdf["_hy"].iloc[0] * pdf["_n"].iloc[0]
        return pd.DataFrame({group: pdf[group], "cx": pdf["cx"], "cy": pdf["cy"], "w": pdf["w"], "density": out / scale})

    return cell.groupBy(group).applyInPandas(one, f"{group} {kind}, cx bigint, cy bigint, w bigint, density double")
