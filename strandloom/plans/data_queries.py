"""Queries of the general data-processing problems (covered periods, heavy keys)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.names import CLEAN_NAME_SQL, clean_name
from strandloom.operators.runs import covered_and_gaps
from strandloom.operators.skew import aggregate_sides_by_fragments, fragment_join
from strandloom.plans.catalog import Catalog
from strandloom.session import Stage, table

CATALOG = Catalog()
HEAVY_PERCENT = 2

_PERIODS_SQL = f"""
WITH seg AS (
  SELECT {CLEAN_NAME_SQL.format(c="pfam_id")} AS pfam_id,
         least(target_hmm_start, target_hmm_end) AS s, greatest(target_hmm_start, target_hmm_end) AS e
  FROM contact_order_results WHERE target_hmm_start IS NOT NULL AND target_hmm_end IS NOT NULL
), marked AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY pfam_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh
  FROM seg WHERE pfam_id IS NOT NULL
), islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY pfam_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked
), periods AS (
  SELECT pfam_id, min(s) AS s, max(e) AS e FROM islands GROUP BY pfam_id, island
), nexts AS (
  SELECT *, lead(s) OVER (PARTITION BY pfam_id ORDER BY s) AS n FROM periods
)
SELECT pfam_id, 'period' AS kind, s AS seg_start, e AS seg_end FROM nexts
UNION ALL SELECT pfam_id, 'gap', e + 1, n - 1 FROM nexts WHERE n IS NOT NULL
"""


@CATALOG.query(_PERIODS_SQL)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered periods and gaps of every family's profile."""
    rows = table(spark, sf_dir, "contact_order_results")
    rows = rows.select(clean_name("pfam_id").alias("pfam_id"), "target_hmm_start", "target_hmm_end")
    return covered_and_gaps(rows, "pfam_id", "target_hmm_start", "target_hmm_end")


@CATALOG.query(
    f"SELECT pfam_id, count(*) FILTER (kind = 'period') AS n_periods, sum(seg_end - seg_start + 1) FILTER (kind = 'period')::BIGINT AS covered, "
    f"coalesce(sum(seg_end - seg_start + 1) FILTER (kind = 'gap'), 0)::BIGINT AS uncovered FROM ({_PERIODS_SQL}) GROUP BY pfam_id"
)
def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered and uncovered positions of every family."""
    period, size = F.col("kind") == "period", (F.col("seg_end") - F.col("seg_start") + 1).cast("bigint")
    return (
        p2_found(spark, sf_dir)
        .groupBy("pfam_id")
        .agg(
            F.count_if(period).alias("n_periods"),
            F.sum(F.when(period, size)).alias("covered"),
            F.coalesce(F.sum(F.when(~period, size)), F.lit(0)).cast("bigint").alias("uncovered"),
        )
    )


_PAIRS_SQL = "SELECT DISTINCT ON (sample_rank) * FROM pairs_500"


def _per_key(spark: SparkSession, sf_dir: str, cells: bool) -> DataFrame:
    """Rows (and cells) of every value of either side, and the number of families with that many windows."""
    pairs = table(spark, sf_dir, "pairs_500")
    families = table(spark, sf_dir, "fragment_index").groupBy("nfrag").agg(F.count(F.lit(1)).alias("n_families"))
    positive: Column = F.when(F.col("window_cells") > 0, F.col("window_cells"))
    aggs = {"n_rows": (F.lit(1), "count")}
    if cells:
        aggs |= {"sum_cells": (positive, "sum"), "max_cells": (positive, "max")}
    out = aggregate_sides_by_fragments(pairs, ["nfrag_i", "nfrag_j"], "sample_rank", aggs, families, "nfrag")
    return out.select(F.expr("right(side, 1)").alias("side"), F.col("key").alias("nfrag"), *aggs, "n_families")


_PER_KEY_SQL = " UNION ALL ".join(
    f"SELECT '{s}' AS side, nfrag_{s} AS nfrag, count(*) AS n_rows, (sum(window_cells) FILTER (window_cells > 0))::BIGINT AS sum_cells, max(window_cells) FILTER (window_cells > 0) AS max_cells, "
    f"(SELECT nullif(count(*), 0) FROM fragment_index f WHERE f.nfrag = nfrag_{s}) AS n_families FROM ({_PAIRS_SQL}) GROUP BY nfrag_{s}"
    for s in "ij"
)


@CATALOG.query(f"SELECT side, nfrag FROM (SELECT side, nfrag, n_rows, sum(n_rows) OVER (PARTITION BY side) AS total FROM ({_PER_KEY_SQL})) WHERE nfrag IS NOT NULL AND n_rows * 100 >= {HEAVY_PERCENT} * total")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of either side that hold at least two hundredths of all pairs."""
    counts = Stage(spark, "keys").write(_per_key(spark, sf_dir, cells=False).select("side", "nfrag", "n_rows"), "counts")
    totals = counts.groupBy("side").agg(F.sum("n_rows").alias("total"))  # two rows
    return counts.join(F.broadcast(totals), "side").where(F.col("nfrag").isNotNull() & (F.col("n_rows") * 100 >= F.col("total") * HEAVY_PERCENT)).select("side", "nfrag")


@CATALOG.query(_PER_KEY_SQL)
def p4_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, sum and maximum of positive cells for every value of either side (null is a value), and how many families have it."""
    return _per_key(spark, sf_dir, cells=True)


@CATALOG.query(
    f"SELECT p.i, f.pfam, count(*) AS n_rows, count(*) FILTER (p.nfrag_i = f.nfrag) AS n_agreeing FROM ({_PAIRS_SQL}) p JOIN fragment_index f ON p.i = f.family_id GROUP BY p.i, f.pfam"
)
def p4_against_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs joined to the index of families on a heavily skewed key, then counted per family."""
    pairs = table(spark, sf_dir, "pairs_500").select("i", "nfrag_i", "sample_rank")
    index = table(spark, sf_dir, "fragment_index").select(F.col("family_id").alias("i"), "pfam", "nfrag")
    joined = fragment_join(pairs, index, "i", ["sample_rank"])
    once = joined.groupBy("i", "pfam", "sample_rank").agg(F.first(F.col("nfrag_i") == F.col("nfrag")).alias("agrees"))
    return once.groupBy("i", "pfam").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("agrees").alias("n_agreeing"))
