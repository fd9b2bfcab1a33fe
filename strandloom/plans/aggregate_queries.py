"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import numeric as N
from strandloom.operators import aggregates as A
from strandloom.operators import paths as P
from strandloom.plans.catalog import Catalog
from strandloom.plans.common import CONTACTS, PATHS, PIECES, POINTS, SPEEDS, WORK, contacts, paths, pieces, points, speeds, work
from strandloom.session import Stage, table

CATALOG = Catalog()


def rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


@CATALOG.query(
    f"SELECT main_hmm, count(score) AS n, round(avg(score), 10) AS mean, round(CASE WHEN count(score) = 1 THEN 0.0 ELSE stddev_samp(score) END, 10) AS std, min(score) AS min, round(quantile_cont(score, 0.25), 10) AS q25, "
    f"round(quantile_cont(score, 0.5), 10) AS median, round(quantile_cont(score, 0.75), 10) AS q75, max(score) AS max FROM {PATHS} WHERE main_hmm IS NOT NULL GROUP BY 1"
)
def agg_summary(spark: SparkSession, d: str) -> DataFrame:
    """G1: count, mean, deviation, quartiles and range per group."""
    t = paths(spark, d, "main_hmm", "score").where("main_hmm IS NOT NULL")
    return rounded(t.groupBy("main_hmm").agg(*A.summary("score")), "min", "max", digits=10)


@CATALOG.query(f"SELECT main_hmm, count(DISTINCT sub_hmm) AS n_partners, coalesce(string_agg(DISTINCT sub_hmm, ';' ORDER BY sub_hmm), '') AS partners FROM {PATHS} WHERE main_hmm IS NOT NULL GROUP BY 1")
def agg_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct count and the sorted distinct values joined."""
    t = paths(spark, d, "main_hmm", "sub_hmm").where("main_hmm IS NOT NULL")
    return t.groupBy("main_hmm").agg(F.countDistinct("sub_hmm").alias("n_partners"), F.concat_ws(";", F.sort_array(F.collect_set("sub_hmm"))).alias("partners"))


_HIST = f"SELECT workload_stratum, floor(window_cells / 1000.0)::BIGINT AS bin, count(*) AS n FROM {WORK} WHERE window_cells > 0 GROUP BY 1, 2"


@CATALOG.query(
    f"SELECT workload_stratum, (min(bin) + 1) * 1000.0::DOUBLE AS threshold FROM (SELECT *, sum(n) OVER (PARTITION BY workload_stratum ORDER BY bin) AS c, sum(n) OVER (PARTITION BY workload_stratum) AS t FROM ({_HIST})) WHERE c >= 0.95 * t GROUP BY 1"
)
def agg_histogram_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Percentile threshold read off a histogram's cumulated counts."""
    h = A.histogram(work(spark, d, "workload_stratum", "window_cells").where("window_cells > 0"), "window_cells", 1000.0, ["workload_stratum"])
    return A.histogram_threshold(h, 1000.0, 0.95, ["workload_stratum"])


@CATALOG.query(f"SELECT pair_count, count(gpu_wall_seconds_median) AS n, round(avg(gpu_wall_seconds_median), 6) AS mean, round(stddev_pop(gpu_wall_seconds_median), 4) AS std, min(gpu_wall_seconds_median) AS min, max(gpu_wall_seconds_median) AS max FROM {SPEEDS} GROUP BY 1")
def agg_running_stats(spark: SparkSession, d: str) -> DataFrame:
    """States of single days merged into statistics of all days."""
    t = speeds(spark, d, "pair_count", "run_day", "gpu_wall_seconds_median")
    s = A.merge_stats(A.running_stats(t, ["pair_count", "run_day"], "gpu_wall_seconds_median"), ["pair_count"])
    return s.select("pair_count", "n", F.round("mean", 6).alias("mean"), F.round("std", 4).alias("std"), "min", "max")


_FIRST, _SECOND = [0.5, 1.0, 1.5, 2.0, 2.5], [0.0, 0.2, 0.4, 0.6, 0.8]


@CATALOG.query(
    f"""WITH p AS (SELECT i, j, raw, (("row" * 7 + col * 3) % 100) / 100.0 AS v FROM {POINTS}),
    g AS (SELECT unnest({_FIRST})::DOUBLE AS first), h AS (SELECT unnest({_SECOND})::DOUBLE AS second),
    hit AS (SELECT first, second, i, j FROM g, h, p WHERE raw <= first AND v >= second)
    SELECT g.first, h.second, (SELECT count(*) FROM hit WHERE hit.first = g.first AND hit.second = h.second) AS points,
      (SELECT count(DISTINCT i * 1000 + j) FROM hit WHERE hit.first = g.first AND hit.second = h.second) AS pairs,
      (SELECT count(DISTINCT f) FROM (SELECT unnest([i, j]) AS f, hit.first AS x, hit.second AS y FROM hit) WHERE x = g.first AND y = h.second) AS families FROM g, h"""
)
def agg_threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    """Points, pairs and covered families over a grid of two thresholds."""
    p = points(spark, d).select("i", "j", "raw", (((F.col("row") * 7 + F.col("col") * 3) % 100) / 100).alias("v"), (F.col("i") * 1000 + F.col("j")).alias("g"))
    return A.threshold_grid(p, "raw", _FIRST, "v", _SECOND, "g", "i", "j")


_CHAIN = f"""
  SELECT *, sum(fresh) OVER (PARTITION BY i, j, col - "row" ORDER BY "row" ROWS UNBOUNDED PRECEDING) AS c FROM (
    SELECT *, CASE WHEN "row" - lag("row") OVER (PARTITION BY i, j, col - "row" ORDER BY "row") <= 5 THEN 0 ELSE 1 END AS fresh FROM {POINTS})
"""


@CATALOG.query(
    f"""SELECT i, j, min("row") AS x0, min(col) AS y0, count(*) AS n_points, max("row") - min("row") + 6 AS main_len, max(col) - min(col) + 6 AS sub_len, round(avg(raw), 6) AS avg_similarity, max("row") - min("row") + 1 > count(*) AS is_gapped, round(sum(raw), 6) AS total
    FROM ({_CHAIN}) GROUP BY i, j, col - "row", c"""
)
def agg_path_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Diagonal chains and their metrics."""
    c = P.chain_points(points(spark, d), 6)
    return rounded(P.chain_metrics(c, 6, "raw").drop("chain"))


@CATALOG.query(f"SELECT comparison_boundary, sum(n) AS n, round(sum(m * n) / sum(n), 6) AS mean FROM (SELECT comparison_boundary, run_day, count(gpu_wall_seconds_median) AS n, avg(gpu_wall_seconds_median) AS m FROM {SPEEDS} GROUP BY 1, 2) GROUP BY 1")
def agg_weighted_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Means of files rolled up by weight."""
    t = speeds(spark, d, "comparison_boundary", "run_day", "gpu_wall_seconds_median")
    f = t.groupBy("comparison_boundary", "run_day").agg(F.count("gpu_wall_seconds_median").alias("n"), F.avg("gpu_wall_seconds_median").alias("m"))
    return f.groupBy("comparison_boundary").agg(F.sum("n").alias("n"), F.round(A.weighted_mean("m", "n"), 6).alias("mean"))


_CELLS = f"SELECT pfam_id, unnest(range(1, length(s) + 1)) AS position, unnest(string_split(s, '')) AS aa FROM (SELECT pfam_id, upper(target_aligned_frag) AS s FROM {CONTACTS} WHERE target_aligned_frag != '' AND pfam_id IS NOT NULL)"


@CATALOG.query(
    f"""WITH n AS (SELECT pfam_id, position, aa, count(*) AS n FROM ({_CELLS}) GROUP BY ALL)
    SELECT pfam_id, position, coalesce(sum(n) FILTER (aa NOT IN ('-', '.')), 0)::BIGINT AS residues, coalesce(sum(n) FILTER (aa IN ('-', '.')), 0)::BIGINT AS gaps,
      round(coalesce(sum(n) FILTER (aa NOT IN ('-', '.')), 0) / sum(n) * 100, 4) AS completeness,
      round(ln(sum(n) FILTER (aa NOT IN ('-', '.'))) - sum(n * ln(n)) FILTER (aa NOT IN ('-', '.')) / sum(n) FILTER (aa NOT IN ('-', '.')), 6) + 0.0 AS entropy,
      first(aa ORDER BY n DESC, aa) FILTER (aa NOT IN ('-', '.')) AS majority FROM n GROUP BY 1, 2"""
)
def agg_alignment_columns(spark: SparkSession, d: str) -> DataFrame:
    """Residues, gaps, completeness, entropy and majority of every alignment column."""
    t = contacts(spark, d, "pfam_id", "target_aligned_frag").where("target_aligned_frag != '' AND pfam_id IS NOT NULL")
    r = A.alignment_columns(t, "pfam_id", "target_aligned_frag")
    return r.select("pfam_id", "position", "residues", "gaps", F.round("completeness", 4).alias("completeness"), (F.round("entropy", 6) + 0.0).alias("entropy"), "majority")


@CATALOG.query(
    "SELECT vec_id, round(-list_sum([p / t * ln(p / t) for p in ps if p > 0]), 6) AS entropy FROM (SELECT vec_id, [abs(x)::DOUBLE for x in embedding[1:20]] AS ps, list_sum([abs(x)::DOUBLE for x in embedding[1:20]]) AS t FROM embeddings)"
)
def agg_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of a renormalised vector of 20 weights."""
    p = F.transform(F.slice("embedding", 1, 20), lambda x: F.abs(x).cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(N.shannon_entropy(p), 6).alias("entropy"))


@CATALOG.query(
    "SELECT * FROM (SELECT event_id, round(avg(value) OVER w, 6) AS mean, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)) WHERE n = 6"
)
def agg_sliding_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean of every full window of 6 values in a row."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(0, 5)
    t = table(spark, d, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean"), F.count(F.lit(1)).over(w).alias("n"))
    return t.where("n = 6")


_WEIGHTS = "SELECT vec_id, [abs(x)::DOUBLE for x in embedding[1:20]] AS ps FROM embeddings"


@CATALOG.query(
    f"SELECT vec_id, round(sum(CASE WHEN p > 0 AND q > 0 THEN p / t * ln((p / t) / (q / u)) ELSE 0.0 END), 6) AS divergence FROM (SELECT vec_id, unnest(a.ps) AS p, unnest(b.qs) AS q, list_sum(a.ps) AS t, list_sum(b.qs) AS u FROM ({_WEIGHTS}) a, (SELECT ps AS qs FROM ({_WEIGHTS}) ORDER BY vec_id LIMIT 1) b) GROUP BY 1"
)
def agg_relative_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Divergence of every column's distribution from one background distribution."""
    p = F.transform(F.slice("embedding", 1, 20), lambda x: F.abs(x).cast("double"))
    t = table(spark, d, "embeddings").select("vec_id", p.alias("p"))
    bg = F.broadcast(t.agg(F.min_by("p", "vec_id").alias("q")))  # one row
    return t.join(bg).select("vec_id", F.round(N.relative_entropy("p", "q"), 6).alias("divergence"))


_FRAC = f"(SELECT pfam_id AS family, target_hmm_start AS pos, max(coverage) AS frac FROM (SELECT pfam_id, target_hmm_start, CASE WHEN fragment_size_mapped / target_seq_len IS NOT NULL THEN least(1.0, fragment_size_mapped / target_seq_len) END AS coverage FROM {CONTACTS}) WHERE pfam_id IS NOT NULL AND pos IS NOT NULL AND coverage IS NOT NULL GROUP BY ALL)"


def fractions(spark: SparkSession, d: str) -> DataFrame:
    """(family, pos, frac): coverage of single positions, from the contact rows."""
    t = contacts(spark, d, F.col("pfam_id").alias("family"), F.col("target_hmm_start").alias("pos"), F.when(F.expr("fragment_size_mapped / target_seq_len").isNotNull(), F.least(F.lit(1.0), F.expr("fragment_size_mapped / target_seq_len"))).alias("frac"))
    return t.dropna().groupBy("family", "pos").agg(F.max("frac").alias("frac"))


_COVER = f"""WITH c AS {_FRAC}, p AS {PIECES},
  m AS (SELECT p.global_row_index, p.ms, p.me, p.ss, p.se, coalesce(sum(frac), 0.0) / (me - ms + 1) AS cm FROM p LEFT JOIN c ON c.family = p.main_hmm AND pos BETWEEN ms AND me GROUP BY p.global_row_index, p.ms, p.me, p.ss, p.se),
  s AS (SELECT p.global_row_index, p.ms, p.me, p.ss, p.se, coalesce(sum(frac), 0.0) / (se - ss + 1) AS cs FROM p LEFT JOIN c ON c.family = p.sub_hmm AND pos BETWEEN ss AND se GROUP BY p.global_row_index, p.ms, p.me, p.ss, p.se)"""


@CATALOG.query(f"{_COVER} SELECT global_row_index, ms, me, round(cm, 9) AS mean FROM m")
def agg_interval_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean coverage over a closed interval, by prefix sums; uncovered positions count 0."""
    p = pieces(spark, d).select("global_row_index", F.col("main_hmm").alias("family"), "ms", "me", "ss", "se").distinct()
    named = P.interval_means(p.where("family IS NOT NULL"), fractions(spark, d), "family", "ms", "me", "pos", "frac", 0.0)
    out = named.select("global_row_index", "ms", "me", "mean").unionByName(p.where("family IS NULL").select("global_row_index", "ms", "me", F.lit(0.0).alias("mean")))
    return out.withColumn("mean", F.round("mean", 9))


@CATALOG.query(
    f"""{_COVER}, g AS (SELECT a.global_row_index, avg(cm) AS coverage_main, (SELECT avg(cs) FROM s WHERE s.global_row_index = a.global_row_index) AS coverage_sub FROM m a GROUP BY a.global_row_index)
    SELECT t.global_row_index, round(coalesce(g.coverage_main, 0.0), 9) AS coverage_main, round(coalesce(g.coverage_sub, 0.0), 9) AS coverage_sub,
      CASE WHEN avg_similarity * ((g.coverage_main + g.coverage_sub) / 2) ** 2 > 0 THEN round(log10(avg_similarity * ((g.coverage_main + g.coverage_sub) / 2) ** 2), 9) END AS rescored
    FROM (SELECT * EXCLUDE (coverage_main, coverage_sub) FROM {PATHS}) t LEFT JOIN g USING (global_row_index)"""
)
def agg_rescore(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of both sides of a path and the score weighted by its square."""
    t = paths(spark, d, "global_row_index", "main_hmm", "sub_hmm", "avg_similarity", "sub_segments_details")
    r = P.rescore(t, fractions(spark, d), "global_row_index", "main_hmm", "sub_hmm", "sub_segments_details", "avg_similarity")
    return rounded(r.select("global_row_index", "coverage_main", "coverage_sub", "rescored"), digits=9)


_EDGES = f"(SELECT least(main_hmm, sub_hmm) AS a, greatest(main_hmm, sub_hmm) AS b, max(score) AS w FROM {PATHS} WHERE main_hmm IS NOT NULL AND sub_hmm IS NOT NULL AND main_hmm != sub_hmm AND score IS NOT NULL GROUP BY 1, 2)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(a, b, w): families linked by their best path. Cleaned names are written once, or filters on them would repeat the cleaning in every condition."""
    t = paths(spark, d, F.col("main_hmm").alias("a"), F.col("sub_hmm").alias("b"), F.col("score").alias("w"))
    t = Stage(spark, "edges").write(t, "named").where("w IS NOT NULL")
    return A.heaviest_edges(t, "a", "b", "w")


@CATALOG.query(f"SELECT * FROM {_EDGES}")
def agg_heaviest_edges(spark: SparkSession, d: str) -> DataFrame:
    """Heaviest of the parallel undirected edges."""
    return edges(spark, d)


@CATALOG.query(f"SELECT node, count(*) AS degree, round(sum(w), 6) AS weighted_degree FROM (SELECT unnest([a, b]) AS node, w FROM {_EDGES}) GROUP BY 1")
def agg_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Degree and weighted degree of every node."""
    return rounded(A.degrees(edges(spark, d), "a", "b", "w"))


@CATALOG.query(
    f"SELECT main_hmm, first(sub_hmm ORDER BY n DESC, f) AS mode, round(max(n) / sum(n), 6) AS fraction FROM (SELECT main_hmm, sub_hmm, count(*) AS n, min(global_row_index) AS f FROM {PATHS} WHERE main_hmm IS NOT NULL AND sub_hmm IS NOT NULL GROUP BY 1, 2) GROUP BY 1"
)
def agg_first_seen_mode(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent partner, of equals the one seen first."""
    t = paths(spark, d, "main_hmm", "sub_hmm", "global_row_index").where("main_hmm IS NOT NULL")
    return rounded(A.first_seen_mode(t, ["main_hmm"], "sub_hmm", "global_row_index"))


@CATALOG.query(f"SELECT status, count(*) AS n, round(count(*) / (SELECT count(*) FROM {CONTACTS}), 6) AS fraction FROM {CONTACTS} GROUP BY 1")
def agg_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Frequency table with fractions."""
    return rounded(A.frequencies(contacts(spark, d, "status"), "status"))


@CATALOG.query(f"SELECT pair_count, round(avg((gpu_speedup_vs_cpu < 10)::INT) * 100, 6) AS slow_percent, count(*) FILTER (gpu_speedup_vs_cpu BETWEEN 10 AND 30) AS n_middle FROM {SPEEDS} WHERE gpu_speedup_vs_cpu IS NOT NULL AND NOT isnan(gpu_speedup_vs_cpu) GROUP BY 1")
def agg_pass_rate(spark: SparkSession, d: str) -> DataFrame:
    """Rate of values below a limit and counts of a band."""
    t = speeds(spark, d, "pair_count", N.clean_number("gpu_speedup_vs_cpu").alias("x")).where("x IS NOT NULL")
    return t.groupBy("pair_count").agg(F.round(F.avg((F.col("x") < 10).cast("int")) * 100, 6).alias("slow_percent"), F.count_if(F.col("x").between(10, 30)).alias("n_middle"))


@CATALOG.query(
    f"WITH p AS (SELECT DISTINCT pfam_id, target_hmm_start AS pos FROM {CONTACTS} WHERE pfam_id IS NOT NULL AND target_hmm_start IS NOT NULL), r AS (SELECT pfam_id, count(*) AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY pfam_id ORDER BY pos) AS g FROM p) GROUP BY pfam_id, g) SELECT pfam_id, sum(n)::BIGINT AS n, count(*) AS n_runs, max(n) AS longest_run FROM r GROUP BY 1"
)
def agg_runs(spark: SparkSession, d: str) -> DataFrame:
    """Number of runs and longest run of a set of positions."""
    return A.run_stats(contacts(spark, d, "pfam_id", "target_hmm_start").where("pfam_id IS NOT NULL"), "pfam_id", "target_hmm_start")


@CATALOG.query(
    f"WITH p AS (SELECT pfam_id, target_hmm_start AS pos, avg(lr_contact_fraction) AS v FROM {CONTACTS} WHERE pfam_id IS NOT NULL AND target_hmm_start IS NOT NULL GROUP BY 1, 2) SELECT pfam_id, round(sum(v), 6) AS total, round(sum(CASE WHEN v IS NOT NULL THEN least(greatest(v, 0.2), 0.5) END), 6) AS clipped, round(avg(v), 6) AS mean FROM p GROUP BY 1"
)
def agg_position_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of positions, then sums over the family, raw and clipped."""
    t = contacts(spark, d, "pfam_id", F.col("target_hmm_start").alias("pos"), "lr_contact_fraction").where("pfam_id IS NOT NULL AND pos IS NOT NULL")
    p = t.groupBy("pfam_id", "pos").agg(F.avg("lr_contact_fraction").alias("v"))
    return rounded(p.groupBy("pfam_id").agg(F.sum("v").alias("total"), F.sum(F.when(F.col("v").isNotNull(), F.least(F.greatest("v", F.lit(0.2)), F.lit(0.5)))).alias("clipped"), F.avg("v").alias("mean")))


@CATALOG.query(f"SELECT status, round(avg(m), 6) AS case_mean, count(*) AS n_cases FROM (SELECT status, pfam_id, avg(gap_count_in_msa_window) AS m FROM {CONTACTS} WHERE pfam_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def agg_case_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the families' means, every family of equal weight."""
    t = contacts(spark, d, "status", "pfam_id", "gap_count_in_msa_window").where("pfam_id IS NOT NULL")
    c = t.groupBy("status", "pfam_id").agg(F.avg("gap_count_in_msa_window").alias("m"))
    return c.groupBy("status").agg(F.round(F.avg("m"), 6).alias("case_mean"), F.count(F.lit(1)).alias("n_cases"))


@CATALOG.query(
    "WITH j AS (SELECT v AS a, v * (1 + CASE WHEN k % 50 = 0 THEN 0.2 ELSE 0.00001 END) AS b FROM (SELECT max(l_extendedprice) AS v, max(l_partkey) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber)) SELECT count(*) AS cells, count(*) FILTER (abs(a - b) > 0.0001 * abs(b)) AS mismatches, round(count(*) FILTER (abs(a - b) > 0.0001 * abs(b)) / count(*), 6) AS mismatch_fraction, round(avg(abs(a - b)), 4) AS mae, round(sqrt(avg((a - b) * (a - b))), 4) AS rmse, round(max(abs(a - b)), 4) AS max_difference, round(quantile_cont(abs(a - b), 0.95), 4) AS p95_difference, round(corr(a, b), 6) AS pearson FROM j"
)
def agg_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two sets of cells within tolerances."""
    from strandloom.operators.joins import pair_result_sets

    t = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("v"), F.max("l_partkey").alias("l_partkey"))
    u = t.withColumn("v", F.col("v") * (1 + F.when(F.col("l_partkey") % 50 == 0, 0.2).otherwise(0.00001)))
    r = pair_result_sets(t, u, ["l_orderkey", "l_linenumber"], "v", 0.0001, 0.0)
    return r.select("cells", "mismatches", F.round("mismatch_fraction", 6).alias("mismatch_fraction"), *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "max_difference", "p95_difference")], F.round("pearson", 6).alias("pearson"))


_CONTACT = "SELECT DISTINCT l_suppkey AS chain, l_partkey % 200 AS i, l_partkey % 200 + 3 + l_orderkey % 40 AS j FROM lineitem"


@CATALOG.query(
    f"""WITH c AS ({_CONTACT}), f AS (SELECT DISTINCT chain, i // 20 AS fragment, i AS idx FROM c), h AS (SELECT DISTINCT f.chain, fragment, c.i, c.j FROM f JOIN c ON f.chain = c.chain AND (f.idx = c.i OR f.idx = c.j))
    SELECT chain, fragment, count(*) AS n_contacts, sum(j - i)::BIGINT AS sum_separation, round(avg(j - i), 6) AS mean_separation, round(avg(j - i) / 240, 6) AS rfco, round(avg((j - i >= 12)::INT), 6) AS long_range FROM h GROUP BY 1, 2"""
)
def agg_contact_order(spark: SparkSession, d: str) -> DataFrame:
    """Contact order of fragments, each contact once at either end."""
    l = table(spark, d, "lineitem")
    i = F.col("l_partkey") % 200
    c = l.select(F.col("l_suppkey").alias("chain"), i.alias("i"), (i + 3 + F.col("l_orderkey") % 40).alias("j"), F.lit(240).alias("chain_length")).distinct()
    f = c.select("chain", F.floor(F.col("i") / 20).alias("fragment"), F.col("i").alias("idx")).distinct()
    return rounded(A.contact_order(f, c, "chain", "fragment", "idx", 12, 2))


@CATALOG.query(
    f"SELECT main_hmm, count(*) FILTER (score >= 2) AS high_n, round(avg(score) FILTER (score >= 2), 10) AS high_mean, count(*) FILTER (score < 2) AS low_n, round(avg(score) FILTER (score < 2), 10) AS low_mean FROM {PATHS} WHERE main_hmm IS NOT NULL AND score IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (score >= 2) >= 2 AND count(*) FILTER (score < 2) >= 2"
)
def agg_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Groups pivoted to columns, kept with a minimum count in both."""
    t = paths(spark, d, "main_hmm", "score").where("main_hmm IS NOT NULL AND score IS NOT NULL").withColumn("g", F.when(F.col("score") >= 2, "high").otherwise("low"))
    p = t.groupBy("main_hmm").pivot("g", ["high", "low"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 10).alias("mean"))
    return p.where("high_n >= 2 AND low_n >= 2")


@CATALOG.query(f"SELECT gpu_count, round(regr_slope(gpu_wall_seconds_median, window_cells) * 1e6, 6) AS slope, round(regr_intercept(gpu_wall_seconds_median, window_cells), 4) AS intercept, round(regr_r2(gpu_wall_seconds_median, window_cells), 6) AS r2 FROM {SPEEDS} GROUP BY 1")
def agg_linear_fit(spark: SparkSession, d: str) -> DataFrame:
    """Least-squares line of seconds over cells with R squared."""
    t = speeds(spark, d, "gpu_count", F.col("gpu_wall_seconds_median").alias("y"), F.col("window_cells").alias("x"))
    return t.groupBy("gpu_count").agg(F.round(F.regr_slope("y", "x") * 1e6, 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 4).alias("intercept"), F.round(F.regr_r2("y", "x"), 6).alias("r2"))


@CATALOG.query(
    f"WITH t AS (SELECT (SELECT sum(window_cells)::DOUBLE FROM {WORK} WHERE window_cells > 0) AS cells) SELECT gpu_count, round(t.cells / quantile_cont(x, 0.5) / 86400, 6) AS days_median, round(t.cells / quantile_cont(x, 0.75) / 86400, 6) AS days_q25, round(t.cells / quantile_cont(x, 0.25) / 86400, 6) AS days_q75 FROM (SELECT gpu_count, gpu_window_cells_per_second_median AS x FROM {SPEEDS} WHERE gpu_window_cells_per_second_median > 0 AND NOT isnan(gpu_window_cells_per_second_median)), t GROUP BY gpu_count, t.cells"
)
def agg_projection(spark: SparkSession, d: str) -> DataFrame:
    """Duration of the full work list projected from the median throughput and its quartiles."""
    cells = F.broadcast(work(spark, d, "window_cells").where("window_cells > 0").agg(F.sum("window_cells").cast("double").alias("cells")))  # one row
    t = speeds(spark, d, "gpu_count", N.clean_number("gpu_window_cells_per_second_median").alias("x")).where("x > 0")
    q = t.groupBy("gpu_count").agg(F.percentile("x", F.array(*[F.lit(v) for v in (0.5, 0.75, 0.25)])).alias("q"))
    return q.join(cells).select("gpu_count", *[F.round(F.col("cells") / F.col("q")[n] / 86400, 6).alias(c) for n, c in enumerate(("days_median", "days_q25", "days_q75"))])


@CATALOG.query(
    "WITH r AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rx, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS ry FROM lineitem) SELECT l_returnflag, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1"
)
def agg_correlations(spark: SparkSession, d: str) -> DataFrame:
    """Pearson and Spearman correlation per group."""
    return rounded(A.spearman(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"))


@CATALOG.query(f"SELECT main_hmm, position, count(*) AS depth FROM (SELECT main_hmm, unnest(range(ms, me + 1)) AS position FROM {PIECES} WHERE main_hmm IS NOT NULL) GROUP BY 1, 2")
def agg_depth(spark: SparkSession, d: str) -> DataFrame:
    """Number of segments over every position of a family."""
    return A.depth_track(pieces(spark, d).where("main_hmm IS NOT NULL"), "main_hmm", "ms", "me")


@CATALOG.query(f"SELECT message, count(*) AS n FROM {CONTACTS} WHERE status != 'OK' GROUP BY 1 ORDER BY n DESC, message LIMIT 20")
def agg_status_counts(spark: SparkSession, d: str) -> DataFrame:
    """The 20 most frequent reasons of failure."""
    return contacts(spark, d, "status", "message").where("status != 'OK'").groupBy("message").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "message").limit(20)


_SEGMENTS = f"(SELECT global_row_index || ':' || pfam_side AS id, pfam_id, least(target_hmm_start, target_hmm_end) AS s, greatest(target_hmm_start, target_hmm_end) AS e FROM {CONTACTS} WHERE pfam_id IS NOT NULL AND target_hmm_start IS NOT NULL AND target_hmm_end IS NOT NULL)"


@CATALOG.query(
    f"""WITH p AS (SELECT main_hmm AS pfam_id, ms AS pos, count(*) AS n, count(*) FILTER (avg_similarity >= 0.5) AS h, sum(avg_similarity) AS sm, sum(least(greatest(avg_similarity, 0.0), 1.0)) AS ct FROM {PIECES} WHERE main_hmm IS NOT NULL AND avg_similarity IS NOT NULL AND NOT isnan(avg_similarity) GROUP BY 1, 2),
    j AS (SELECT id, e - s + 1 AS len, coalesce(sum(n), 0)::DOUBLE AS n_points, coalesce(sum(h), 0)::DOUBLE AS n_high_points, count(n)::DOUBLE AS n_positions, (count(*) FILTER (h > 0))::DOUBLE AS n_high_positions, coalesce(sum(sm), 0) AS a, coalesce(sum(ct), 0) AS b, coalesce(sum(sm / n), 0) AS c, coalesce(sum(ct / n), 0) AS dd FROM {_SEGMENTS} g LEFT JOIN p ON p.pfam_id = g.pfam_id AND pos BETWEEN s AND e GROUP BY id, e, s)
    SELECT id, (n_points > 0)::DOUBLE AS any_point, (n_high_points > 0)::DOUBLE AS any_high_point, n_points, n_high_points, n_positions, n_high_positions, round(n_points / len, 10) AS points_density, round(n_high_points / len, 10) AS high_points_density, round(n_positions / len, 10) AS positions_density, round(n_high_positions / len, 10) AS high_positions_density,
    round(a / len, 10) AS value_density, round(b / len, 10) AS cut_value_density, round(c / len, 10) AS position_mean_density, round(dd / len, 10) AS cut_position_mean_density FROM j"""
)
def agg_interval_densities(spark: SparkSession, d: str) -> DataFrame:
    """Fourteen densities of the pieces' starts and similarities inside every contact-order segment of their family."""
    seg = contacts(spark, d, "global_row_index", "pfam_side", "pfam_id", "target_hmm_start", "target_hmm_end").dropna()
    seg = seg.select(F.concat_ws(":", "global_row_index", "pfam_side").alias("id"), "pfam_id", F.least("target_hmm_start", "target_hmm_end").alias("s"), F.greatest("target_hmm_start", "target_hmm_end").alias("e"))
    known = pieces(spark, d).select(F.col("main_hmm").alias("pfam_id"), F.col("ms").alias("pos"), "avg_similarity")
    return rounded(A.interval_densities(known, seg, "pfam_id", "id", "pos", "avg_similarity", "s", "e", 0.5), digits=10)
