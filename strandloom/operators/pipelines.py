"""Pipelines over the other operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.numeric import clean_number
from strandloom.operators import joins as J
from strandloom.operators import paths as P


@dataclass(frozen=True)
class Detection:
    """Parameters of the detection from divergence points to final paths."""

    window: int = 6
    raw_threshold: float = 2.0
    keep_score: float = 13.0
    min_path_points: int = 5
    overlap_iou: float = 0.1
    top_paths: int | None = None
    min_coverage: float = 0.85
    min_score: float = 1.2
    missing_coverage: float = 0.0


def detect(points: DataFrame, background: DataFrame, names: DataFrame, coverage: DataFrame, p: Detection = Detection()) -> DataFrame:
    """Final paths: filter, background score, chains, clean paths, coverage, final filter."""
    scored = P.background_score(P.below_raw(points.where("i != j"), p.raw_threshold), background, p.window, p.keep_score)
    found = P.find_paths(scored, names, p.window, p.min_path_points, p.overlap_iou, p.top_paths).where("is_clean")
    found = found.withColumn("path_id", F.concat_ws("/", "main_hmm", "sub_hmm", "path_rank"))
    out = P.rescore(found, coverage, "path_id", "main_hmm", "sub_hmm", "sub_segments_details", "avg_similarity", p.missing_coverage)
    out = out.withColumnRenamed("score", "original_score").withColumnRenamed("rescored", "score")
    return out.where((F.col("coverage_main") >= p.min_coverage) & (F.col("coverage_sub") >= p.min_coverage) & (F.col("score") > p.min_score))


def project_segments(tasks: DataFrame, paths: DataFrame, mapping: DataFrame, family: str, row_id: str) -> DataFrame:
    """Segments of the tasks' families carried to alignment columns; what fails stays as a row with its status.

    ``tasks`` (family), ``paths`` (row id, main, sub, ms, me, ss, se),
    ``mapping`` (family, state, col).
    """
    sides = paths.select(row_id, F.expr("stack(2, main_hmm, ms, me, sub_hmm, ss, se) AS (fam, s, e)")).where("fam IS NOT NULL").distinct()
    t = tasks.select(family).distinct().join(sides.withColumnRenamed("fam", family), family, "left")
    m = mapping.groupBy(family, "state").agg(F.min("col").alias("col"))
    at = lambda c, n: m.select(family, F.col("state").alias(c), F.col("col").alias(n))
    t = t.join(at("s", "col_start"), [family, "s"], "left").join(at("e", "col_end"), [family, "e"], "left")
    status = F.when(F.col(row_id).isNull(), "No_Path").when(F.col("col_start").isNull() | F.col("col_end").isNull(), "Position_Not_In_Map").when(F.col("col_start") > F.col("col_end"), "Inverted").otherwise("OK")
    return t.select(family, row_id, "s", "e", F.when(status == "OK", F.col("col_start")).alias("col_start"), F.when(status == "OK", F.col("col_end")).alias("col_end"), status.alias("status"))


def pick_sides(candidates: DataFrame, row_id: str, side: str, ok: Column, ratio: Column, order: list[Column]) -> DataFrame:
    """Best candidate of every side: usable ones first, then the ratio closest to 1, then ``order``; with ``status``."""
    t = candidates.withColumn("_ok", F.coalesce(ok & ratio.between(0.8, 1.2), F.lit(False)))
    best = J.best_candidate(t, [row_id, side], [F.desc("_ok"), F.abs(ratio - 1).asc_nulls_last(), *order])
    return best.withColumn("side_status", F.when(F.col("_ok"), "OK").otherwise("NO_CANDIDATE_80_120")).drop("_ok")


def annotate_rows(sides: DataFrame, row_id: str, flag: Column) -> DataFrame:
    """Row counts of both sides: assessed, flagged, and whether both are."""
    ok = F.col("side_status") == "OK"
    return sides.groupBy(row_id).agg(F.count_if(ok).alias("n_assessed"), F.count_if(ok & flag).alias("n_flagged"), (F.count_if(ok & flag) == 2).alias("both_flagged"))


def actual_against_random(actual: DataFrame, random: DataFrame, key: str, value: str, random_value: str, interval: list[str]) -> DataFrame:
    """Per key: actual rows once per interval, their mean, and the randoms' mean, population std, quartiles and share <= actual."""
    a = actual.where(F.col(value).isNotNull()).dropDuplicates([key, *interval]).groupBy(key).agg(F.count(F.lit(1)).alias("n_actual"), F.avg(value).alias("actual"))
    r = random.where(F.col(random_value).isNotNull()).join(a.select(key, "actual"), key)
    g = r.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_random"),
        F.avg(random_value).alias("random_mean"),
        F.stddev_pop(random_value).alias("random_std"),
        F.percentile(random_value, F.lit(0.25)).alias("random_q25"),
        F.percentile(random_value, F.lit(0.75)).alias("random_q75"),
        F.avg((F.col(random_value) <= F.col("actual")).cast("int")).alias("fraction_le"),
    )
    return a.join(g, key, "left")


def filter_battery(df: DataFrame, masks: dict[str, Column], group: Column, value: str) -> DataFrame:
    """Every mask's retention and group summary in one pass: a row enters once per mask that keeps it."""
    names = F.array_compact(F.array(*[F.when(m, F.lit(n)) for n, m in masks.items()]))
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("_all")))  # one row
    t = df.select(value, group.alias("group"), F.explode(names).alias("filter"))
    g = t.groupBy("filter", "group").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"))
    kept = F.sum("n").over(Window.partitionBy("filter"))
    return g.withColumn("_kept", kept).join(total).withColumn("retention", F.col("_kept") / F.col("_all")).drop("_kept", "_all")


def sparse_accounting(points: DataFrame, value: str, width: float) -> DataFrame:
    """Per query: points, zeros on and off the diagonal of itself and elsewhere, range and histogram of the values."""
    self_, diag, zero = F.col("i") == F.col("j"), F.col("row") == F.col("col"), F.col(value) == 0
    h = points.groupBy("i", F.floor(F.col(value) / width).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(zero & self_ & diag).alias("zero_self_diagonal"), F.count_if(zero & self_ & ~diag).alias("zero_self_other"), F.count_if(zero & ~self_).alias("zero_elsewhere"), F.min(value).alias("lo"), F.max(value).alias("hi")
    )
    return h.groupBy("i").agg(*[F.sum(c).alias(c) for c in ("n", "zero_self_diagonal", "zero_self_other", "zero_elsewhere")], F.min("lo").alias("lowest"), F.max("hi").alias("highest"), F.count(F.lit(1)).alias("n_bins"))


def scan_combinations(points: DataFrame, combos: list[tuple[float, float]], k: int, value: str = "linear") -> DataFrame:
    """Chains and their metrics for every (raw threshold, score threshold): the combination is one more key, so there is no loop."""
    spark = points.sparkSession
    grid = F.broadcast(spark.createDataFrame([(f"F{a}_S{b}".replace(".", "p"), float(a), float(b)) for a, b in combos], "combo string, _a double, _b double"))
    t = points.join(grid, (F.col("raw") > 0) & (F.col("raw") <= F.col("_a")) & (F.col(value) >= F.col("_b"))).drop("_a", "_b")
    keys = ("combo", "i", "j")
    return P.chain_metrics(P.chain_points(t, k, keys), k, value, keys)


def eligible_with_reasons(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """``reason`` of the first check that fails, in order; OK if none does."""
    reason = F.lit("OK")
    for name, passed in reversed(checks):
        reason = F.when(~F.coalesce(passed, F.lit(False)), name).otherwise(reason)
    return df.withColumn("reason", reason)


def representative_records(rows: DataFrame, family: str, order: list[Column], header: Column, sequence: str) -> DataFrame:
    """(family, header, sequence, fasta): one representative per family, gaps removed."""
    from strandloom.functions.text import ungap

    best = J.best_candidate(rows.where(F.length(ungap(sequence)) > 0), family, order)
    seq = ungap(sequence)
    return best.select(family, header.alias("header"), seq.alias("sequence"), F.concat(F.lit(">"), header, F.lit("\n"), seq).alias("fasta"))


def positive(c: str) -> Column:
    v = clean_number(c)
    return F.when(v > 0, v)
