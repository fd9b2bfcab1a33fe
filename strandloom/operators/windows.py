"""Ranking, islands, curves over ranked rows, quantile sets, distribution functions."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.text import hash_number
from strandloom.operators.joins import points_in_intervals
from strandloom.operators.runs import covered_and_gaps
from strandloom.session import Stage, ship


def merge_intervals(df: DataFrame, key: str, start: str, end: str, adjacent: bool) -> DataFrame:
    """(key, start, end) of overlapping closed intervals joined; with ``adjacent`` also those that only touch (s <= e + 1).

    By the run bitmaps, so a key of very many intervals is spread over its
    shards; positions are doubled, so that neighbours touch only where they
    should. Rows with nulls or with start behind end take no part.
    """
    t = df.where(F.col(key).isNotNull() & (F.col(start) <= F.col(end)))
    t = t.select(F.col(key).alias("k"), (2 * F.col(start).cast("bigint")).alias("s"), (2 * F.col(end).cast("bigint") + int(adjacent)).alias("e"))
    periods = covered_and_gaps(t, "k", "s", "e", "bigint").where("kind = 'period'")
    back = lambda c, name: F.shiftright(c, 1).cast(df.schema[name].dataType).alias(name)
    return periods.select(F.col("k").alias(key), back("seg_start", start), back("seg_end", end))


def compress_positions(df: DataFrame, key: str, pos: str) -> DataFrame:
    """(key, segments): a key's integers as ``a-b,c-d``."""
    t = df.where(F.col(pos).isNotNull()).select(key, pos).distinct()
    t = t.withColumn("_g", F.col(pos) - F.row_number().over(Window.partitionBy(key).orderBy(pos)))
    runs = t.groupBy(key, "_g").agg(F.min(pos).alias("a"), F.max(pos).alias("b"))
    g = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("_r"))
    return g.select(key, F.array_join(F.transform("_r", lambda r: F.concat_ws("-", r["a"], r["b"])), ",").alias("segments"))


def ordered_buckets(df: DataFrame, order: list[str], out: str = "_p") -> DataFrame:
    """``df`` in range partitions of an order, the partition's number in ``out``; written, so that it stays what it is.

    Range partitioning draws a sample; reading the partition number off an
    unwritten plan twice could give two different cuts.
    """
    t = df.repartitionByRange(*order).withColumn(out, F.spark_partition_id())
    return Stage(df.sparkSession, "ordered").write(t, "rows")


def running_total(df: DataFrame, order: list[Column], value: str, out: str, buckets: list[str], groups: list[str] = []) -> DataFrame:  # noqa: B006
    """Running sum of ``value`` over the rows (of a group) in an order, without putting all of them into one task.

    ``buckets`` are columns of ``df`` that cut the order into consecutive
    stretches (rows of a lower bucket come first): sums within the buckets
    are shifted by the sums of the buckets before, which are few.
    """
    inner = Window.partitionBy(*groups, *buckets).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    t = df.withColumn("_in", F.sum(value).over(inner))
    sums = df.groupBy(*groups, *buckets).agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*groups) if groups else Window
    before = before.orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    shift = sums.select(*groups, *buckets, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_b"))
    cond = [t[b].eqNullSafe(shift[b]) for b in [*groups, *buckets]]
    j = t.join(shift, cond).select(*[t[c] for c in t.columns], "_b")
    return j.withColumn(out, F.col("_in") + F.col("_b")).drop("_in", "_b")


def quantile_bands(df: DataFrame, group: str, order: list[str], n: int, out: str = "band") -> DataFrame:
    """``n`` bands of equal size (the first ones a row larger) of every group along an order, numbered from 1, without a group in one task."""
    t = ordered_buckets(df.withColumn("_one", F.lit(1).cast("bigint")), [group, *order])
    t = running_total(t, [F.asc(c) for c in order], "_one", "_rank", ["_p"], [group])
    sizes = t.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_size"))
    t = t.join(sizes, F.col(group).eqNullSafe(F.col("_group")))
    base, larger = F.floor(F.col("_size") / n), F.col("_size") % n
    edge = larger * (base + 1)
    band = F.when(F.col("_rank") <= edge, F.floor((F.col("_rank") - 1) / (base + 1)) + 1).otherwise(larger + F.floor((F.col("_rank") - 1 - edge) / F.greatest(base, F.lit(1))) + 1)
    return t.select(*df.columns, band.cast("int").alias(out))


def exact_percentiles(df: DataFrame, value: str, ps: list[float]) -> list[float | None]:
    """Exact percentiles (linear interpolation) of a whole column without gathering its values in one task.

    Counts of the distinct values are cumulated over range partitions; the
    values at the two ranks beside each percentile are minima over them.
    Nulls and NaN don't count; without values all are null. The result is
    ``len(ps)`` numbers.
    """
    v = F.col(value).cast("double")
    t = df.select(v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    c = running_total(ordered_buckets(t, ["_v"]), [F.asc("_v")], "_n", "_upto", ["_p"])
    total = c.agg(F.max("_upto")).first()[0]
    if not total:
        return [None] * len(ps)
    at = [p * (total - 1) for p in ps]
    ranks = sorted({r for x in at for r in (math.floor(x), math.ceil(x))})
    found = c.agg(*[F.min(F.when(F.col("_upto") > r, F.col("_v"))).alias(str(r)) for r in ranks]).first()
    return [found[str(math.floor(x))] + (found[str(math.ceil(x))] - found[str(math.floor(x))]) * (x - math.floor(x)) for x in at]


def coverage_curve(df: DataFrame, score: str, row_id: str, a: str, b: str, digits: int = 1) -> DataFrame:
    """Per distinct score: rows with at least that score and families covered by them.

    A family counts at its best score; rows and first appearances are
    summed per score and cumulated from the top.
    """
    t = df.where(F.col(score).isNotNull())
    fam = t.select(score, F.explode(F.array(a, b)).alias("_f")).where("_f IS NOT NULL").groupBy("_f").agg(F.max(score).alias(score))
    new = fam.groupBy(score).agg(F.count(F.lit(1)).alias("_new"))
    rows = t.groupBy(score).agg(F.count(F.lit(1)).alias("_rows"))
    c = rows.join(new, score, "left").fillna(0, ["_new"]).withColumn("_bucket", -F.floor(F.col(score) * 10**digits))
    c = running_total(c, [F.desc(score)], "_rows", "rows_at_least", ["_bucket"])
    c = running_total(c, [F.desc(score)], "_new", "families", ["_bucket"])
    return c.select(score, "rows_at_least", "families")


def drop_lowest(df: DataFrame, groups: list[str], value: str, row_id: str, share: float, how: str = "floor", seed: str = "0") -> DataFrame:
    """Exactly k = ``how``(share n) lowest rows of every group dropped; ties are broken by a hash of the row id."""
    w = Window.partitionBy(*groups)
    n = F.count(F.lit(1)).over(w)
    k = {"floor": F.floor, "ceil": F.ceil, "round": F.rint}[how](n * share)
    rank = F.row_number().over(w.orderBy(F.asc_nulls_last(value), hash_number(F.lit(seed), row_id), row_id))
    return df.withColumn("_k", k).withColumn("_r", rank).where(F.col("_r") > F.col("_k")).drop("_k", "_r")


def low_set_overlap(df: DataFrame, group: str, a: str, b: str, q: float) -> DataFrame:
    """Agreement of the low sets (at most the q quantile) of two values: precision, recall, Jaccard, fold enrichment."""
    edges = df.groupBy(group).agg(F.percentile(a, F.lit(q)).alias("_qa"), F.percentile(b, F.lit(q)).alias("_qb"))
    t = df.join(edges, group)
    la, lb = F.col(a) <= F.col("_qa"), F.col(b) <= F.col("_qb")
    n = lambda c: F.count_if(c)
    both, na, nb, total = n(la & lb), n(la), n(lb), F.count(F.lit(1))
    return t.groupBy(group).agg(
        both.alias("n_both"), (both / na).alias("precision"), (both / nb).alias("recall"), (both / n(la | lb)).alias("jaccard"), (both * total / (na * nb)).alias("fold_enrichment")
    )


def quantile_bins(df: DataFrame, groups: list[str], value: str, bins: int, out: str = "bin") -> DataFrame:
    """Right-closed quantile bins, the lowest value included, equal edges dropped (not ``ntile``: ties stay together)."""
    ps = [i / bins for i in range(bins + 1)]
    if groups:
        edges = df.groupBy(*groups).agg(F.array_distinct(F.percentile(value, F.array(*map(F.lit, ps)))).alias("_e"))
        t = df.join(edges, groups)
    else:
        edges = list(dict.fromkeys(exact_percentiles(df, value, ps)))
        t = df.withColumn("_e", F.array(*map(F.lit, edges)))
    at = F.size(F.filter(F.slice("_e", 2, bins), lambda e: e < F.col(value)))
    return t.withColumn(out, at.cast("int")).drop("_e")


def two_sample_distance(df: DataFrame, group: str, value: str, is_first: Column) -> DataFrame:
    """Per group: n of both samples, largest differences D+, D- and D of their distribution functions."""
    c = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count_if(is_first).alias("_a"), F.count_if(~is_first).alias("_b"))
    all_, run = Window.partitionBy(group), Window.partitionBy(group).orderBy(value)
    t = c.withColumns({"_na": F.sum("_a").over(all_), "_nb": F.sum("_b").over(all_)}).where("_na > 0 AND _nb > 0")
    t = t.withColumn("_d", F.sum("_a").over(run) / F.col("_na") - F.sum("_b").over(run) / F.col("_nb"))
    g = t.groupBy(group).agg(F.max("_na").alias("n_first"), F.max("_nb").alias("n_second"), F.greatest(F.max("_d"), F.lit(0.0)).alias("d_plus"), F.greatest(-F.min("_d"), F.lit(0.0)).alias("d_minus"))
    return g.withColumn("d", F.greatest("d_plus", "d_minus"))


def lanes(df: DataFrame, key: str, row_id: str, start: str, end: str, gap: int = 1) -> DataFrame:
    """Lane of every interval such that intervals of a lane are ``gap`` apart; greedy by start.

    Sequential only between two stretches that no interval covers: beyond
    such a gap all lanes are free again, so a key is cut there.
    """
    ship(df.sparkSession)
    kinds = dict(df.dtypes)

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([start, end, row_id], kind="stable")
        busy: list[tuple[int, int]] = []  # (last end, lane)
        free: list[int] = []
        used, out = 0, []
        for s, e in zip(pdf[start], pdf[end]):
            while busy and busy[0][0] + gap <= s:
                heapq.heappush(free, heapq.heappop(busy)[1])
            lane = heapq.heappop(free) if free else used
            used = max(used, lane + 1)
            heapq.heappush(busy, (e, lane))
            out.append(lane)
        return pd.DataFrame({key: pdf[key], row_id: pdf[row_id], "lane": out})

    t = df.where(F.col(key).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull()).select(key, row_id, start, end)
    reach = t.withColumn("_to", F.greatest(F.col(start), F.col(end) + gap - 1))
    islands = merge_intervals(reach, key, start, "_to", False).select(key, F.col(start).alias("_from"), "_to")
    t = points_in_intervals(t, islands, key, start, "_from", "_to", 1024).drop("_to")
    return t.groupBy(key, "_from").applyInPandas(assign, f"{key} {kinds[key]}, {row_id} {kinds[row_id]}, lane int")


def split_points(df: DataFrame, order: str, weight: str, shares: list[float]) -> DataFrame:
    """(share, at): the first position at which the running weight reaches each share of the total.

    ``df`` has one row per position (a length distribution), so it is small.
    """
    t = df.groupBy(order).agg(F.sum(weight).alias("_w"))
    w = Window.orderBy(order)
    t = t.withColumn("_run", F.sum("_w").over(w))
    total = F.broadcast(t.agg(F.max("_run").alias("_total")))
    each = t.join(total).withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares]))).where("_run >= share * _total")
    return each.groupBy("share").agg(F.min(order).alias("at"))


def nested_sample(df: DataFrame, strata: str, row_id: str, seed: str) -> DataFrame:
    """``depth`` in the stratum by hash and ``sample_rank`` interleaving the strata: every prefix is balanced."""
    h = hash_number(F.lit(seed), row_id)
    t = df.withColumn("depth", F.row_number().over(Window.partitionBy(strata).orderBy(h, row_id)))
    # rank = rows of smaller depth in all strata + strata up to this one that reach this depth
    sizes = F.broadcast(t.groupBy(strata).agg(F.max("depth").alias("_n")).agg(F.array_sort(F.collect_list(F.struct(F.col(strata).alias("s"), F.col("_n").alias("n")))).alias("_sizes")))
    before = F.expr(f"aggregate(_sizes, 0L, (acc, x) -> acc + least(x.n, depth - 1) + CASE WHEN x.s <= {strata} AND x.n >= depth THEN 1 ELSE 0 END)")
    return t.join(sizes).withColumn("sample_rank", before).drop("_sizes")
