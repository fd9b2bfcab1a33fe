"""Window functions, sorts and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.text import HASH_SQL
from strandloom.operators import joins as J
from strandloom.operators import windows as W
from strandloom.operators.paths import chain_points
from strandloom.plans.aggregate_queries import rounded
from strandloom.plans.catalog import Catalog
from strandloom.plans.common import CONTACTS, PATHS, PIECES, POINTS, WORK, contacts, paths, pieces, points, work
from strandloom.session import table

CATALOG = Catalog()


@CATALOG.query(
    f"""SELECT i, j, "row", col, (col - "row") || ':' || max(CASE WHEN fresh THEN "row" END) OVER (PARTITION BY i, j, col - "row" ORDER BY "row" ROWS UNBOUNDED PRECEDING) AS chain FROM (
      SELECT *, coalesce("row" - lag("row") OVER (PARTITION BY i, j, col - "row" ORDER BY "row") > 5, true) AS fresh FROM {POINTS})"""
)
def win_diagonal_chains(spark: SparkSession, d: str) -> DataFrame:
    """Chain of every point along its diagonal."""
    return chain_points(points(spark, d), 6).select("i", "j", "row", "col", "chain")


def _merged(gap: int) -> str:
    return (
        f"WITH m AS (SELECT *, CASE WHEN ms <= max(me) OVER (PARTITION BY main_hmm ORDER BY ms, me ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS f FROM {PIECES} WHERE main_hmm IS NOT NULL), "
        "g AS (SELECT *, sum(f) OVER (PARTITION BY main_hmm ORDER BY ms, me ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT main_hmm, min(ms) AS ms, max(me) AS me FROM g GROUP BY main_hmm, g"
    )


@CATALOG.query(_merged(1))
def win_merge_adjacent(spark: SparkSession, d: str) -> DataFrame:
    """Intervals joined if they overlap or touch."""
    return W.merge_intervals(pieces(spark, d), "main_hmm", "ms", "me", True)


@CATALOG.query(_merged(0))
def win_merge_overlapping(spark: SparkSession, d: str) -> DataFrame:
    """Intervals joined only if they overlap."""
    return W.merge_intervals(pieces(spark, d), "main_hmm", "ms", "me", False)


@CATALOG.query(
    f"WITH p AS (SELECT DISTINCT pfam_id, target_hmm_start AS pos FROM {CONTACTS} WHERE pfam_id IS NOT NULL AND target_hmm_start IS NOT NULL), r AS (SELECT pfam_id, min(pos) AS a, max(pos) AS b FROM (SELECT *, pos - row_number() OVER (PARTITION BY pfam_id ORDER BY pos) AS g FROM p) GROUP BY pfam_id, g) SELECT pfam_id, string_agg(a || '-' || b, ',' ORDER BY a) AS segments FROM r GROUP BY 1"
)
def win_compress_positions(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive positions written as segments."""
    return W.compress_positions(contacts(spark, d, "pfam_id", "target_hmm_start").where("pfam_id IS NOT NULL"), "pfam_id", "target_hmm_start")


@CATALOG.query(
    f"""WITH t AS (SELECT * FROM {PATHS} WHERE score IS NOT NULL), f AS (SELECT f, max(score) AS score FROM (SELECT unnest([main_hmm, sub_hmm]) AS f, score FROM t) WHERE f IS NOT NULL GROUP BY f),
    s AS (SELECT t.score, count(*) AS n, (SELECT count(*) FROM f WHERE f.score = t.score) AS fresh FROM t GROUP BY t.score)
    SELECT score, (sum(n) OVER (ORDER BY score DESC))::BIGINT AS rows_at_least, (sum(fresh) OVER (ORDER BY score DESC))::BIGINT AS families FROM s"""
)
def win_coverage_curve(spark: SparkSession, d: str) -> DataFrame:
    """Rows at or above every score and families covered by them."""
    return W.coverage_curve(paths(spark, d, "global_row_index", "score", "main_hmm", "sub_hmm"), "score", "global_row_index", "main_hmm", "sub_hmm")


@CATALOG.query(
    f"SELECT global_row_index FROM (SELECT *, row_number() OVER (PARTITION BY main_hmm ORDER BY avg_similarity, {HASH_SQL.format(k='concat_ws(chr(124), 7, global_row_index)')}, global_row_index) AS r, floor(count(*) OVER (PARTITION BY main_hmm) * 0.3) AS k FROM {PATHS}) WHERE r > k"
)
def win_drop_lowest(spark: SparkSession, d: str) -> DataFrame:
    """Exactly three tenths of the lowest rows of every family dropped, ties broken by a seeded hash."""
    return W.drop_lowest(paths(spark, d, "main_hmm", "avg_similarity", "global_row_index"), ["main_hmm"], "avg_similarity", "global_row_index", 0.3, "floor", "7").select("global_row_index")


@CATALOG.query(
    "WITH q AS (SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS qa, quantile_cont(l_extendedprice, 0.25) AS qb FROM lineitem GROUP BY 1), t AS (SELECT l.l_returnflag, l_quantity <= qa AS a, l_extendedprice <= qb AS b FROM lineitem l JOIN q USING (l_returnflag)) SELECT l_returnflag, count(*) FILTER (a AND b) AS n_both, round(count(*) FILTER (a AND b) / count(*) FILTER (a), 6) AS precision, round(count(*) FILTER (a AND b) / count(*) FILTER (b), 6) AS recall, round(count(*) FILTER (a AND b) / count(*) FILTER (a OR b), 6) AS jaccard, round(count(*) FILTER (a AND b) * count(*) / (count(*) FILTER (a) * count(*) FILTER (b)), 6) AS fold_enrichment FROM t GROUP BY 1"
)
def win_low_sets(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the low quarters of two values."""
    return rounded(W.low_set_overlap(table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), "l_returnflag", "l_quantity", "l_extendedprice", 0.25))


_DECILES = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]"


@CATALOG.query(
    f"WITH e AS (SELECT list_distinct(list_transform(range(0, 11), lambda i: q[i + 1])) AS edges FROM (SELECT list_concat([min(l_quantity)], quantile_cont(l_quantity, {_DECILES})) AS q FROM lineitem)), "
    "b AS (SELECT len(list_filter(list_sort(edges)[2:], lambda x: x < l_quantity))::INT AS bin, l_extendedprice AS y FROM lineitem, e) SELECT bin, count(*) AS n, round(avg(y), 4) AS mean FROM b GROUP BY 1"
)
def win_decile_trend(spark: SparkSession, d: str) -> DataFrame:
    """Mean of one value over the deciles of another, ties kept together."""
    t = W.quantile_bins(table(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), [], "l_quantity", 10)
    return t.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))


@CATALOG.query(
    f"""WITH c AS (SELECT workload_stratum AS g, window_cells AS v, count(*) FILTER (i < 100) AS a, count(*) FILTER (i >= 100) AS b FROM {WORK} WHERE window_cells > 0 AND workload_stratum IS NOT NULL GROUP BY 1, 2),
    t AS (SELECT g, sum(a) OVER w AS na, sum(b) OVER w AS nb, sum(a) OVER r / sum(a) OVER w - sum(b) OVER r / sum(b) OVER w AS dd FROM c WINDOW w AS (PARTITION BY g), r AS (PARTITION BY g ORDER BY v))
    SELECT g AS workload_stratum, max(na)::BIGINT AS n_first, max(nb)::BIGINT AS n_second, round(greatest(max(dd), 0), 6) AS d_plus, round(greatest(-min(dd), 0), 6) AS d_minus, round(greatest(max(dd), -min(dd), 0), 6) AS d FROM t GROUP BY 1"""
)
def win_two_sample(spark: SparkSession, d: str) -> DataFrame:
    """Largest differences of two empirical distribution functions."""
    t = work(spark, d, "workload_stratum", "window_cells", "i").where("window_cells > 0 AND workload_stratum IS NOT NULL")
    return rounded(W.two_sample_distance(t, "workload_stratum", "window_cells", F.col("i") < 100))


@CATALOG.query()
def win_lanes(spark: SparkSession, d: str) -> DataFrame:
    """Lanes for the segments of a family such that none overlap within a lane."""
    t = pieces(spark, d).where("main_hmm IS NOT NULL").select("main_hmm", F.concat_ws(":", "global_row_index", "ms", "ss").alias("id"), "ms", "me")
    return W.lanes(t, "main_hmm", "id", "ms", "me")


@CATALOG.query(
    "WITH t AS (SELECT hmm_length AS l, sum(sum(nfrag)) OVER (ORDER BY hmm_length) AS run, sum(sum(nfrag)) OVER () AS total FROM fragment_index GROUP BY 1) SELECT share, min(l) AS at FROM t, (SELECT unnest([0.25, 0.5, 0.75, 0.9])::DOUBLE AS share) WHERE run >= share * total GROUP BY 1"
)
def win_split_points(spark: SparkSession, d: str) -> DataFrame:
    """Lengths at which the running number of windows reaches given shares."""
    return W.split_points(table(spark, d, "fragment_index").select("hmm_length", "nfrag"), "hmm_length", "nfrag", [0.25, 0.5, 0.75, 0.9])


_H = HASH_SQL.format(k="concat_ws('|', '11', family_id)")


@CATALOG.query(
    f"WITH b AS (SELECT family_id, ntile(5) OVER (PARTITION BY fragment ORDER BY nfrag, family_id) AS band FROM fragment_index), t AS (SELECT family_id, band, row_number() OVER (PARTITION BY band ORDER BY {_H}, family_id) AS depth FROM b) SELECT family_id, band, depth, row_number() OVER (ORDER BY depth, band) AS sample_rank FROM t"
)
def win_nested_sample(spark: SparkSession, d: str) -> DataFrame:
    """Quantile bands of the whole population and an interleaved sample whose every prefix is balanced."""
    t = W.quantile_bands(table(spark, d, "fragment_index").select("family_id", "fragment", "nfrag"), "fragment", ["nfrag", "family_id"], 5)
    return W.nested_sample(t, "band", "family_id", "11").select("family_id", "band", "depth", "sample_rank")


@CATALOG.query("SELECT event_id, row_number() OVER (ORDER BY event_id) AS row_index FROM events")
def win_row_index(spark: SparkSession, d: str) -> DataFrame:
    """1-based index over a total order: range partitions, numbers within, shifted by the sizes before."""
    t = W.ordered_buckets(table(spark, d, "events").select("event_id", F.lit(1).alias("_one")), ["event_id"])
    return W.running_total(t, [F.asc("event_id")], "_one", "row_index", ["_p"]).select("event_id", "row_index")


_RANKED = f"SELECT global_row_index, score, row_number() OVER (ORDER BY score DESC, global_row_index) AS rank FROM {PATHS} WHERE score IS NOT NULL"


@CATALOG.query(_RANKED)
def ord_by_score(spark: SparkSession, d: str) -> DataFrame:
    """O1: all rows by descending score with their rank: range partitions, numbers within, shifted by the sizes before."""
    t = paths(spark, d, "global_row_index", "score").where("score IS NOT NULL").withColumn("_one", F.lit(1))
    t = W.ordered_buckets(t, [F.desc("score"), F.asc("global_row_index")])
    return W.running_total(t, [F.desc("score"), F.asc("global_row_index")], "_one", "rank", ["_p"]).select("global_row_index", "score", "rank")


@CATALOG.query(f"SELECT * FROM ({_RANKED}) WHERE rank <= 100")
def ord_highest(spark: SparkSession, d: str) -> DataFrame:
    """The 100 rows of highest score (a top-k report; top-k per task before the single final sort)."""
    t = paths(spark, d, "global_row_index", "score").where("score IS NOT NULL").orderBy(F.desc("score"), "global_row_index").limit(100)
    return t.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "global_row_index")))


@CATALOG.query(f"SELECT main_hmm, sub_hmm, global_row_index FROM {PATHS} WHERE score IS NOT NULL AND main_hmm IS NOT NULL AND sub_hmm IS NOT NULL QUALIFY row_number() OVER (PARTITION BY main_hmm, sub_hmm ORDER BY score DESC, global_row_index) <= 2")
def ord_top_per_comparison(spark: SparkSession, d: str) -> DataFrame:
    """O2: the two best paths of every comparison."""
    t = paths(spark, d, "main_hmm", "sub_hmm", "global_row_index", "score").dropna()
    return J.best_candidate(t, ["main_hmm", "sub_hmm"], [F.desc("score"), F.asc("global_row_index")], 2).drop("score")


@CATALOG.query(f"SELECT pfam_id, global_row_index, pfam_side FROM {CONTACTS} WHERE pfam_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pfam_id ORDER BY (status = 'OK') DESC, rfco DESC NULLS LAST, segment_rank, global_row_index, pfam_side) = 1")
def ord_best_hit(spark: SparkSession, d: str) -> DataFrame:
    """O3: best hit of a key in an order of several columns."""
    t = contacts(spark, d, "pfam_id", "global_row_index", "pfam_side", "status", "rfco", "segment_rank").where("pfam_id IS NOT NULL")
    order = [(F.col("status") == "OK").desc(), F.desc_nulls_last("rfco"), F.asc("segment_rank"), F.asc("global_row_index"), F.asc("pfam_side")]
    return J.best_candidate(t, "pfam_id", order).select("pfam_id", "global_row_index", "pfam_side")


@CATALOG.query(f"SELECT main_segment_len AS length, count(*) AS n FROM {PATHS} GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, length LIMIT 15")
def ord_top_lengths(spark: SparkSession, d: str) -> DataFrame:
    """The 15 most frequent lengths with at least 5 rows."""
    t = paths(spark, d, F.col("main_segment_len").alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    return t.where("n >= 5").orderBy(F.desc("n"), "length").limit(15)


@CATALOG.query(
    f"""WITH q AS (SELECT quantile_cont(score, 0.99) AS q1, quantile_cont(score, 0.95) AS q5, quantile_cont(score, 0.9) AS q10 FROM {PATHS}), f AS (SELECT DISTINCT global_row_index, score, unnest([main_hmm, sub_hmm]) AS hmm FROM {PATHS} WHERE score IS NOT NULL)
    SELECT hmm, count(*) FILTER (score >= q1) AS top1, count(*) FILTER (score >= q5) AS top5, count(*) FILTER (score >= q10) AS top10 FROM f, q WHERE hmm IS NOT NULL AND score >= q10 GROUP BY 1"""
)
def ord_percentile_subsets(spark: SparkSession, d: str) -> DataFrame:
    """Rows in the top 1, 5 and 10 percent of scores, counted per family."""
    t = paths(spark, d, "global_row_index", "score", "main_hmm", "sub_hmm").where("score IS NOT NULL")
    q = W.exact_percentiles(t, "score", [0.99, 0.95, 0.9])
    f = t.where(F.col("score") >= q[2]).select("score", F.explode(F.array_distinct(F.array("main_hmm", "sub_hmm"))).alias("hmm")).where("hmm IS NOT NULL")
    return f.groupBy("hmm").agg(*[F.count_if(F.col("score") >= x).alias(c) for x, c in zip(q, ("top1", "top5", "top10"))])


@CATALOG.query(f"SELECT sample_rank, i, j FROM {WORK} WHERE window_cells > 0 AND window_cells <= 50000 QUALIFY row_number() OVER (PARTITION BY workload_stratum ORDER BY sample_rank) <= 10")
def ord_bounded_subset(spark: SparkSession, d: str) -> DataFrame:
    """The first ten bounded pairs of every stratum in sample order (a validation subset)."""
    t = work(spark, d, "sample_rank", "i", "j", "workload_stratum", "window_cells").where("window_cells > 0 AND window_cells <= 50000")
    return J.best_candidate(t, "workload_stratum", [F.asc("sample_rank")], 10).select("sample_rank", "i", "j")
