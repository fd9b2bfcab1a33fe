"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import numeric as N
from strandloom.functions.names import CLEAN_NAME_SQL, clean_name
from strandloom.operators import paths as P
from strandloom.plans.catalog import Catalog
from strandloom.plans.common import BACKGROUND, CONTACTS, PATHS, POINTS, SPEEDS, WINDOW, background, contacts, paths, points, speeds
from strandloom.session import small, table

CATALOG = Catalog()


@CATALOG.query("SELECT l_orderkey, l_linenumber, round(pow(2, -l_extendedprice / 1000), 9) AS p, CASE WHEN l_discount = 0 THEN 0.0 ELSE round(pow(2, -l_discount / 1000), 9) END AS q FROM lineitem")
def flt_log2_to_probability(spark: SparkSession, d: str) -> DataFrame:
    """-1000 log2 units to probabilities; infinity to 0."""
    t = table(spark, d, "lineitem")
    inf = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_discount"))
    return t.select("l_orderkey", "l_linenumber", F.round(N.log2_to_probability("l_extendedprice"), 9).alias("p"), F.round(N.log2_to_probability(inf), 9).alias("q"))


@CATALOG.query(f"SELECT family_id, pfam, greatest(hmm_length - {WINDOW} + 1, 0) AS n_windows, nfrag = greatest(hmm_length - {WINDOW} + 1, 0) AS agrees FROM fragment_index")
def flt_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Number of windows of every profile, L - k + 1, against the index."""
    n = F.greatest(F.col("hmm_length") - WINDOW + 1, F.lit(0))
    return table(spark, d, "fragment_index").select("family_id", "pfam", n.alias("n_windows"), (F.col("nfrag") == n).alias("agrees"))


@CATALOG.query(f'SELECT i, j, "row", col, round_even(raw, 4) AS raw4 FROM {POINTS} WHERE round_even(raw, 4) < 2.0')
def flt_raw_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Points below the raw threshold after rounding half to even."""
    return P.below_raw(points(spark, d), 2.0).select("i", "j", "row", "col", "raw4")


_SCORED = (
    f'SELECT p.i, p.j, p."row", p.col, round_even(((q.bg + t.bg)::FLOAT)::DOUBLE / (round_even(p.raw, 4) + 1e-4) * 20, 4) AS linear '
    f'FROM {POINTS} p JOIN {BACKGROUND} q ON p.i = q.family AND p."row" = q.pos JOIN {BACKGROUND} t ON p.j = t.family AND p.col = t.pos WHERE round_even(p.raw, 4) < 2.0'
)


@CATALOG.query(f"SELECT * FROM ({_SCORED}) WHERE linear >= 13.0")
def flt_background_score(spark: SparkSession, d: str) -> DataFrame:
    """Background-normalised score of the points, kept from 13 on."""
    return P.background_score(P.below_raw(points(spark, d), 2.0), small(background(spark, d), 200_000), WINDOW, 13.0).select("i", "j", "row", "col", "linear")


@CATALOG.query(
    f'SELECT p.i, p.j, p."row", p.col, round_even(b.bg::DOUBLE / (p.raw / 18.407 + 1e-4), 6) AS theory, round_even(b.bg::DOUBLE / (p.raw / 20.0 + 1e-4), 6) AS empirical FROM {POINTS} p JOIN {BACKGROUND} b ON p.i = b.family AND p."row" = b.pos'
)
def flt_score_variants(spark: SparkSession, d: str) -> DataFrame:
    """Distance per state by theory (3k + 0.407) or experience (3k + 2), and the score on it."""
    b = background(spark, d).select(F.col("family").alias("i"), F.col("pos").alias("row"), "bg")
    t = points(spark, d).join(small(b, 200_000), ["i", "row"])
    score = lambda mode: N.round_even(P.state_score(F.col("raw"), F.col("bg").cast("double"), WINDOW, mode), 6)
    return t.select("i", "j", "row", "col", score("theory").alias("theory"), score("empirical").alias("empirical"))


@CATALOG.query(f"SELECT global_row_index, score, coverage_main, coverage_sub FROM {PATHS} WHERE coverage_main >= 0.85 AND coverage_sub >= 0.85 AND score > 1.2")
def flt_coverage_and_score(spark: SparkSession, d: str) -> DataFrame:
    """Paths covered well on both sides and above the score threshold."""
    t = paths(spark, d, "global_row_index", "score", "coverage_main", "coverage_sub")
    return t.where("coverage_main >= 0.85 AND coverage_sub >= 0.85 AND score > 1.2")


@CATALOG.query(f"SELECT global_row_index FROM {PATHS} WHERE main_hmm IN (SELECT pfam FROM fragment_index WHERE nfrag >= 400) OR sub_hmm IN (SELECT pfam FROM fragment_index WHERE nfrag >= 400)")
def flt_allowed_on_either_side(spark: SparkSession, d: str) -> DataFrame:
    """Rows with an allowed family on either side, as two semi-joins of one side each."""
    allowed = table(spark, d, "fragment_index").where("nfrag >= 400").select("pfam")
    t = paths(spark, d, "global_row_index", "main_hmm", "sub_hmm")
    return P.allowed_on_either_side(t, allowed, "main_hmm", "sub_hmm", "pfam", "global_row_index").select("global_row_index")


@CATALOG.query(
    "SELECT o_orderkey, lower(trim(v)) IN ('true', '1', 'yes', 'y', 't') AS flag, CASE WHEN lower(trim(v)) IN ('true', '1', 'yes', 'y', 't') THEN 'true' WHEN lower(trim(v)) IN ('false', '0', 'no', 'n', 'f') THEN 'false' ELSE 'na' END AS state "
    "FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ' Yes' WHEN 1 THEN 'F' WHEN 2 THEN '1' WHEN 3 THEN '' ELSE 'No ' END AS v FROM orders)"
)
def flt_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags written in many ways as a boolean and as a three-state value."""
    v = F.expr("CASE o_orderkey % 5 WHEN 0 THEN ' Yes' WHEN 1 THEN 'F' WHEN 2 THEN '1' WHEN 3 THEN '' ELSE 'No ' END")
    return table(spark, d, "orders").select("o_orderkey", N.parse_bool(v).alias("flag"), N.novelty(v).alias("state"))


@CATALOG.query(f"SELECT global_row_index, score, main_segment_len AS length FROM {PATHS}")
def flt_column_aliases(spark: SparkSession, d: str) -> DataFrame:
    """P10: columns found under any of their known names, required ones checked."""
    from strandloom.sources.tables import resolve_columns

    t = paths(spark, d)
    return resolve_columns(t, {"global_row_index": ["Row_ID", "global_row_index"], "score": ["Threshold_Score", "SCORE"], "length": ["length", "Main_Segment_Len"]})


@CATALOG.query("SELECT run_id, CASE WHEN NOT isnan(gpu_speedup_vs_cpu) AND NOT isinf(gpu_speedup_vs_cpu) THEN gpu_speedup_vs_cpu END AS speedup FROM cpu_gpu_speedup_summary WHERE NOT isnan(gpu_wall_seconds_median) AND gpu_wall_seconds_median IS NOT NULL")
def flt_clean_numbers(spark: SparkSession, d: str) -> DataFrame:
    """NaN and infinities to null, rows without a time dropped."""
    t = table(spark, d, "cpu_gpu_speedup_summary")
    return t.withColumn("t", N.clean_number("gpu_wall_seconds_median")).dropna(subset=["t"]).select("run_id", N.clean_number("gpu_speedup_vs_cpu").alias("speedup"))


@CATALOG.query(
    f"SELECT global_row_index, pfam_side, CASE WHEN rfco IS NULL THEN NULL WHEN rfco < 0.02 THEN 'LOW' WHEN rfco < 0.05 THEN 'MID' ELSE 'HIGH' END AS band, "
    f"CASE WHEN lr_contact_fraction IS NULL THEN NULL WHEN lr_contact_fraction < 0.3 THEN 'none' WHEN lr_contact_fraction < 0.5 THEN 'partial' ELSE 'interface' END AS class FROM {CONTACTS}"
)
def flt_bands(spark: SparkSession, d: str) -> DataFrame:
    """Values sorted into named bands."""
    t = contacts(spark, d, "global_row_index", "pfam_side", "rfco", "lr_contact_fraction")
    return t.select(
        "global_row_index", "pfam_side", N.bands("rfco", [(0.02, "LOW"), (0.05, "MID")], "HIGH").alias("band"), N.bands("lr_contact_fraction", [(0.3, "none"), (0.5, "partial")], "interface").alias("class")
    )


_KINDS = (
    f"SELECT {CLEAN_NAME_SQL.format(c='main_hmm')} AS a, CASE WHEN {CLEAN_NAME_SQL.format(c='main_hmm')} = {CLEAN_NAME_SQL.format(c='sub_hmm')} THEN 'same' ELSE 'diff' END || '_' || CASE WHEN chain_id = 'A' THEN 'intra' ELSE 'inter' END AS kind FROM {CONTACTS}"
)


@CATALOG.query(f"SELECT a, string_agg(DISTINCT kind, ';' ORDER BY kind) AS kinds, bool_or(kind LIKE 'diff%') AS any_different FROM ({_KINDS}) WHERE a IS NOT NULL GROUP BY a")
def flt_pair_types(spark: SparkSession, d: str) -> DataFrame:
    """Type of every pair of sides (same or different family, within the first chain or not), summarised per family."""
    t = contacts(spark, d, clean_name("main_hmm").alias("a"), clean_name("sub_hmm").alias("b"), "chain_id").where("a IS NOT NULL")
    kind = F.concat(F.when(F.col("a") == F.col("b"), "same").otherwise("diff"), F.lit("_"), F.when(F.col("chain_id") == "A", "intra").otherwise("inter"))
    return t.groupBy("a").agg(F.concat_ws(";", F.sort_array(F.collect_set(kind))).alias("kinds"), F.bool_or(kind.startswith("diff")).alias("any_different"))


_DOMINANT = (
    "SELECT l_orderkey, k, frac, n, rank() OVER (PARTITION BY l_orderkey ORDER BY frac DESC, n DESC) AS r FROM (SELECT l_orderkey, l_returnflag AS k, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_orderkey), 6) AS frac, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_returnflag)"
)


@CATALOG.query(
    f"SELECT l_orderkey, CASE WHEN count(*) = 1 THEN 'single' ELSE 'multi' END AS kind, string_agg(k, '+' ORDER BY k) AS combination, CASE WHEN count(*) FILTER (r = 1) > 1 THEN 'ambiguous' ELSE max(k) FILTER (r = 1) END AS dominant FROM ({_DOMINANT}) GROUP BY l_orderkey"
)
def flt_combinations(spark: SparkSession, d: str) -> DataFrame:
    """Combination of hit classes and the dominant one by (share, count); ``ambiguous`` on a tie."""
    t = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("k")).agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    return P.classify_combinations(t, "l_orderkey", "k", "q", "n")


@CATALOG.query(f"SELECT global_row_index, 'main' AS side, main_hmm AS hmm, coverage_main AS coverage FROM {PATHS} UNION ALL SELECT global_row_index, 'sub', sub_hmm, coverage_sub FROM {PATHS}")
def flt_sides_to_rows(spark: SparkSession, d: str) -> DataFrame:
    """Both sides of a row as two rows, in one pass over the table."""
    t = paths(spark, d, "global_row_index", "main_hmm", "sub_hmm", "coverage_main", "coverage_sub")
    return t.select("global_row_index", F.expr("stack(2, 'main', main_hmm, coverage_main, 'sub', sub_hmm, coverage_sub) AS (side, hmm, coverage)"))


@CATALOG.query(f"SELECT run_id, CASE WHEN gpu_wall_seconds_median IS NULL THEN NULL ELSE least(greatest(floor((log10(gpu_wall_seconds_median / 8) + 3) / 6 * 125), -1) + 1, 126)::INT END AS bin FROM {SPEEDS}")
def flt_log_bins(spark: SparkSession, d: str) -> DataFrame:
    """126 logarithmic bins of a positive value."""
    v = F.log10(F.col("gpu_wall_seconds_median") / 8)
    return speeds(spark, d, "run_id", "gpu_wall_seconds_median").select("run_id", N.clip(F.floor((v + 3) / 6 * 125), -1, 125).cast("int").alias("b")).select("run_id", (F.col("b") + 1).alias("bin"))


@CATALOG.query(f"SELECT global_row_index, score >= 2.0 AND coverage_main >= 0.85 AS loose, score >= 2.5 AND coverage_main >= 0.9 AND coverage_sub >= 0.9 AS strict, score >= 3.0 AND coverage_main >= 0.95 AND coverage_sub >= 0.95 AS extreme FROM {PATHS} WHERE score >= 2.0 AND coverage_main >= 0.85")
def flt_tail_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Loose, strict and extreme tails by conjunctive predicates, in one pass."""
    t = paths(spark, d, "global_row_index", "score", "coverage_main", "coverage_sub")
    loose = F.expr("score >= 2.0 AND coverage_main >= 0.85")
    return t.where(loose).select("global_row_index", loose.alias("loose"), F.expr("score >= 2.5 AND coverage_main >= 0.9 AND coverage_sub >= 0.9").alias("strict"), F.expr("score >= 3.0 AND coverage_main >= 0.95 AND coverage_sub >= 0.95").alias("extreme"))


@CATALOG.query(f"SELECT global_row_index, pfam_side, round(fragment_size_mapped / target_hmm_len, 6) AS ratio FROM (SELECT *, abs(target_hmm_end - target_hmm_start) + 1 AS target_hmm_len FROM {CONTACTS} WHERE status = 'OK') WHERE fragment_size_mapped / target_hmm_len BETWEEN 0.8 AND 1.2")
def flt_coverage_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Mapped fragments whose length is 0.8 to 1.2 of the segment's."""
    t = contacts(spark, d, "global_row_index", "pfam_side", "status", "target_hmm_start", "target_hmm_end", "fragment_size_mapped").where("status = 'OK'")
    ratio = F.col("fragment_size_mapped") / (F.abs(F.col("target_hmm_end") - F.col("target_hmm_start")) + 1)
    return t.withColumn("r", ratio).where(F.col("r").between(0.8, 1.2)).select("global_row_index", "pfam_side", F.round("r", 6).alias("ratio"))
