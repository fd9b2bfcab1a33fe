"""Randomised controls and permutation tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.text import HASH_SQL
from strandloom.operators import controls as C
from strandloom.operators import paths as P
from strandloom.operators.windows import merge_intervals
from strandloom.plans.aggregate_queries import rounded
from strandloom.plans.catalog import Catalog
from strandloom.plans.common import CONTACTS, PATHS, PIECES, contacts, paths, pieces
from strandloom.session import Stage, ship, table

CATALOG = Catalog()

_SEG = f"(SELECT global_row_index || ':' || pfam_side AS id, pfam_id, least(target_hmm_start, target_hmm_end) AS s, greatest(target_hmm_start, target_hmm_end) AS e FROM {CONTACTS} WHERE pfam_id IS NOT NULL AND target_hmm_start IS NOT NULL AND target_hmm_end IS NOT NULL)"


def segments(spark: SparkSession, d: str) -> DataFrame:
    t = contacts(spark, d, "global_row_index", "pfam_side", "pfam_id", "target_hmm_start", "target_hmm_end").dropna()
    return t.select(F.concat_ws(":", "global_row_index", "pfam_side").alias("id"), "pfam_id", F.least("target_hmm_start", "target_hmm_end").alias("s"), F.greatest("target_hmm_start", "target_hmm_end").alias("e"))


_RW = f"SELECT id, draw, s, e, 1 + {HASH_SQL.format(k=chr(39).join(['concat_ws(', '|', ', 3, id, draw)']))} % (hmm_length - (e - s + 1) + 1) AS random_start, e - s + 1 AS n FROM (SELECT *, unnest(range(1, 21)) AS draw FROM {_SEG} JOIN fragment_index ON pfam_id = pfam WHERE hmm_length >= e - s + 1)"


def _windows(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fragment_index").select(F.col("pfam").alias("pfam_id"), "hmm_length")
    return C.random_windows(segments(spark, d).join(f, "pfam_id"), "id", F.col("e") - F.col("s") + 1, F.lit(1), F.col("hmm_length"), 20, "3")


@CATALOG.query(f"SELECT id, draw, random_start, random_start + n - 1 AS random_end FROM ({_RW})")
def rnd_windows(spark: SparkSession, d: str) -> DataFrame:
    """Twenty windows of a segment's length anywhere in its profile."""
    return _windows(spark, d).select("id", F.col("draw").cast("bigint").alias("draw"), "random_start", "random_end")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Two blocks of every profile: its first and last two fifths."""
    f = table(spark, d, "fragment_index").select(F.col("pfam").alias("pfam_id"), "hmm_length")
    cut = F.expr("hmm_length * 2 div 5").cast("int")
    return f.select("pfam_id", F.explode(F.array(F.struct(F.lit(1).alias("s"), cut.alias("e")), F.struct((F.col("hmm_length") - cut + 1).alias("s"), F.col("hmm_length").alias("e")))).alias("b")).select("pfam_id", "b.s", "b.e")


@CATALOG.query(
    f"""WITH b AS (SELECT pfam AS pfam_id, unnest([1, hmm_length - hmm_length * 2 // 5 + 1]) AS bs, unnest([hmm_length * 2 // 5, hmm_length]) AS be FROM fragment_index),
    t AS (SELECT id, e - s + 1 AS len, bs, greatest(0, be - bs - (e - s + 1) + 2) AS n FROM {_SEG} g JOIN b USING (pfam_id)),
    r AS (SELECT *, sum(n) OVER (PARTITION BY id ORDER BY bs) AS upto, sum(n) OVER (PARTITION BY id) AS total FROM t),
    p AS (SELECT *, {HASH_SQL.format(k=chr(39).join(['concat_ws(', '|', ', 5, id, draw)']))} % total + 1 AS pick FROM (SELECT *, unnest(range(1, 6)) AS draw FROM r WHERE total > 0 AND n > 0))
    SELECT id, draw::INT AS draw, (bs + pick - (upto - n) - 1)::INT AS random_start, (bs + pick - (upto - n) - 1 + len - 1)::INT AS random_end FROM p WHERE pick <= upto AND pick > upto - n"""
)
def rnd_in_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Windows in several blocks, a block chosen by its number of valid starts."""
    t = segments(spark, d).withColumn("n", F.col("e") - F.col("s") + 1)
    return C.random_in_blocks(t, _blocks(spark, d), "pfam_id", "id", "n", "s", "e", 5, "5").drop("pfam_id")


@CATALOG.query()
def rnd_permutation_test(spark: SparkSession, d: str) -> DataFrame:
    """Share of segment positions that lie in path segments, against 50 re-randomisations."""
    seg = segments(spark, d)
    known = pieces(spark, d).where("main_hmm IS NOT NULL").select(F.col("main_hmm").alias("pfam_id"), F.col("ms").alias("s"), F.col("me").alias("e"))
    f = table(spark, d, "fragment_index").select(F.col("pfam").alias("pfam_id"), F.lit(1).alias("s"), F.col("hmm_length").alias("e"))
    return C.permutation_test(seg, f, known, "pfam_id", "id", "s", "e", 50, "13")


_K = HASH_SQL.format(k=chr(39).join(["concat_ws(", "|", ", 9, id, st)"]))


@CATALOG.query(
    f"""WITH g AS (SELECT id, s, e, e - s + 1 AS len, hmm_length FROM {_SEG} JOIN fragment_index ON pfam_id = pfam WHERE hmm_length >= e - s + 1), c AS (SELECT id, s, e, len, unnest(range(1, hmm_length - len + 2)) AS st FROM g), f AS (SELECT * FROM c WHERE st + len - 1 < s OR st > e)
    SELECT id, draw, st AS random_start, st + len - 1 AS random_end, count(*) OVER (PARTITION BY id) AS random_n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {_K}, st) AS draw FROM f) WHERE draw <= 10"""
)
def rnd_excluding_observed(spark: SparkSession, d: str) -> DataFrame:
    """Different windows that don't overlap the observed segment, as many as there are up to ten."""
    f = table(spark, d, "fragment_index").select(F.col("pfam").alias("pfam_id"), "hmm_length")
    t = segments(spark, d).join(f, "pfam_id")
    return C.excluded_starts(t, "id", F.col("e") - F.col("s") + 1, F.lit(1), F.col("hmm_length"), t, "id", "s", "e", 10, "9")


_INSIDE = f"(SELECT id, draw, greatest(0, least(random_start + n - 1, e) - greatest(random_start, s) + 1) / n AS v FROM ({_RW}))"


@CATALOG.query(
    f"SELECT id, 0.5::DOUBLE AS observed, count(*) AS random_n, round(avg(v), 9) AS random_mean, round((count(*) FILTER (v >= 0.5) + 1) / (count(*) + 1), 6) AS p_ge, round((count(*) FILTER (v <= 0.5) + 1) / (count(*) + 1), 6) AS p_le, round(count(*) FILTER (v <= 0.5) / count(*), 6) AS fraction_le, round(least(1.0, 2 * least((count(*) FILTER (v >= 0.5) + 1) / (count(*) + 1), (count(*) FILTER (v <= 0.5) + 1) / (count(*) + 1))), 6) AS p_two_sided FROM {_INSIDE} GROUP BY 1"
)
def rnd_empirical_p(spark: SparkSession, d: str) -> DataFrame:
    """A metric of all drawn starts computed once, and empirical p-values of half an overlap."""
    from strandloom.functions.numeric import interval_overlap

    w = _windows(spark, d)
    v = interval_overlap(F.col("random_start"), F.col("random_end"), F.col("s"), F.col("e")) / (F.col("e") - F.col("s") + 1)
    r = C.empirical_p(segments(spark, d).select("id", F.lit(0.5).alias("o")), w.select("id", v.alias("v")), "id", "o", "v")
    return rounded(r, "random_mean").withColumn("random_mean", F.round("random_mean", 9))


@CATALOG.query(
    f"SELECT pfam_id, threshold, count(DISTINCT id) AS n_segments, round(avg((v >= threshold)::INT), 6) AS random_hit_rate FROM (SELECT * FROM {_INSIDE} JOIN (SELECT id, pfam_id FROM {_SEG}) USING (id)), (SELECT unnest([0.3, 0.5])::DOUBLE AS threshold) GROUP BY 1, 2"
)
def rnd_hit_rates(spark: SparkSession, d: str) -> DataFrame:
    """Hit rates of the random windows per family and threshold."""
    from strandloom.functions.numeric import interval_overlap

    w = _windows(spark, d)
    v = interval_overlap(F.col("random_start"), F.col("random_end"), F.col("s"), F.col("e")) / (F.col("e") - F.col("s") + 1)
    t = w.select("pfam_id", "id", v.alias("v"), F.explode(F.array(F.lit(0.3), F.lit(0.5))).alias("threshold"))
    return t.groupBy("pfam_id", "threshold").agg(F.countDistinct("id").alias("n_segments"), F.round(F.avg((F.col("v") >= F.col("threshold")).cast("int")), 6).alias("random_hit_rate"))


@CATALOG.query("SELECT 5000 AS n_pairs, 5000 AS n_different, true AS in_order")
def rnd_pairs(spark: SparkSession, d: str) -> DataFrame:
    """5,000 different unordered random pairs of families."""
    n = table(spark, d, "fragment_index").count()
    p = C.random_pairs(n, 5000, "123", spark)
    return p.agg(F.count(F.lit(1)).cast("int").alias("n_pairs"), F.countDistinct("i", "j").cast("int").alias("n_different"), F.bool_and((F.col("i") < F.col("j")) & (F.col("i") >= 0) & (F.col("j") < n)).alias("in_order"))


@CATALOG.query(
    f"SELECT family_id, bin FROM (SELECT family_id, (hmm_length // 50)::BIGINT AS bin, row_number() OVER (PARTITION BY hmm_length // 50 ORDER BY {HASH_SQL.format(k=chr(39).join(['concat_ws(', '|', ', 17, family_id)']))}, family_id) AS r FROM fragment_index) WHERE r <= 30"
)
def rnd_quota(spark: SparkSession, d: str) -> DataFrame:
    """Up to thirty families of every length bin, in hash order."""
    t = table(spark, d, "fragment_index").select("family_id", F.floor(F.col("hmm_length") / 50).alias("bin"))
    return C.quota_sample(t, "bin", "family_id", 30, "17").select("family_id", "bin")


@CATALOG.query(f"SELECT global_row_index FROM {PATHS} ORDER BY {HASH_SQL.format(k=chr(39).join(['concat_ws(', '|', ', 19, global_row_index)']))}, global_row_index LIMIT 200")
def rnd_seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of 200 paths (the sampling operator itself)."""
    return C.seeded_sample(paths(spark, d, "global_row_index"), "global_row_index", 200, "19")


_TS = (
    f"WITH t AS (SELECT pfam_id, lr_contact_fraction AS v, rfco * 10 AS r, status FROM {CONTACTS} WHERE lr_contact_fraction IS NOT NULL AND rfco IS NOT NULL AND pfam_id IS NOT NULL), x AS (SELECT subset, threshold, pfam_id, (v >= threshold)::INT AS a, (r >= threshold)::INT AS b FROM t, (SELECT unnest([0.3, 0.4])::DOUBLE AS threshold), (SELECT unnest(['all', 'long']) AS subset) WHERE subset = 'all' OR v > 0.2), "
    "m AS (SELECT subset, threshold, avg(a - b) AS mean, avg(a) AS ra, avg(b) AS rb, count(*) AS n FROM x GROUP BY 1, 2), c AS (SELECT x.subset, x.threshold, pfam_id, sum(a - b - mean) AS s FROM x JOIN m USING (subset, threshold) GROUP BY 1, 2, 3), g AS (SELECT subset, threshold, count(*) AS k, sum(s * s) AS ss FROM c GROUP BY 1, 2) "
)


@CATALOG.query(_TS + "SELECT subset, threshold, round(ra, 6) AS real_rate, round(rb, 6) AS random_rate, round(mean, 6) AS difference, n, k AS n_clusters, round(sqrt(k / (k - 1) * ss) / n, 6) AS se FROM m JOIN g USING (subset, threshold)")
def rnd_threshold_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Hit rates over subsets and thresholds with cluster-robust errors."""
    ship(spark)
    t = contacts(spark, d, "pfam_id", "lr_contact_fraction", (F.col("rfco") * 10).alias("r")).where("pfam_id IS NOT NULL")
    o = C.threshold_sensitivity(t, "lr_contact_fraction", "r", "pfam_id", [0.3, 0.4], {"all": F.lit(True), "long": F.col("lr_contact_fraction") > 0.2})
    return rounded(o.select("subset", "threshold", "real_rate", "random_rate", "difference", "n", "n_clusters", "se"))


@CATALOG.query(
    f"SELECT p.global_row_index, abs(c.mean_sequence_separation - c.sum_sequence_separation / c.n_fragment_contacts) <= 1.0 AS agrees FROM {PATHS} p JOIN {CONTACTS} c USING (global_row_index) WHERE c.status = 'OK' AND c.n_fragment_contacts > 0"
)
def rnd_recheck(spark: SparkSession, d: str) -> DataFrame:
    """A stored summary derived again and compared within a tolerance."""
    c = contacts(spark, d, "global_row_index", "status", "mean_sequence_separation", "sum_sequence_separation", "n_fragment_contacts").where("status = 'OK' AND n_fragment_contacts > 0")
    j = paths(spark, d, "global_row_index").join(c, "global_row_index")
    return j.select("global_row_index", (F.abs(F.col("mean_sequence_separation") - F.col("sum_sequence_separation") / F.col("n_fragment_contacts")) <= 1.0).alias("agrees"))


_KF = HASH_SQL.format(k=chr(39).join(["concat_ws(", "|", ", 17, id, st)"]))


@CATALOG.query(
    f"""WITH g AS (SELECT id, pfam_id, e - s + 1 AS len, hmm_length FROM {_SEG} JOIN fragment_index ON pfam_id = pfam WHERE hmm_length >= e - s + 1), c AS (SELECT id, pfam_id, len, unnest(range(1, hmm_length - len + 2)) AS st FROM g),
    f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM {_SEG} x WHERE x.pfam_id = c.pfam_id AND c.st <= x.e AND c.st + c.len - 1 >= x.s))
    SELECT id, draw, st AS random_start, st + len - 1 AS random_end, count(*) OVER (PARTITION BY id) AS random_n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {_KF}, st) AS draw FROM f) WHERE draw <= 10"""
)
def rnd_negative_controls(spark: SparkSession, d: str) -> DataFrame:
    """K8: windows that overlap none of the segments of the row's family, up to ten a row; a family's segments are united before they are forbidden."""
    f = table(spark, d, "fragment_index").select(F.col("pfam").alias("pfam_id"), "hmm_length")
    seg = segments(spark, d)
    covered = merge_intervals(seg.select("pfam_id", "s", "e"), "pfam_id", "s", "e", True)
    forbidden = seg.select("id", "pfam_id").join(covered, "pfam_id").select("id", F.col("s").alias("fs"), F.col("e").alias("fe"))
    return C.excluded_starts(seg.join(f, "pfam_id"), "id", F.col("e") - F.col("s") + 1, F.lit(1), F.col("hmm_length"), forbidden, "id", "fs", "fe", 10, "17")


_KNOWN = f"(SELECT DISTINCT main_hmm AS pfam_id, unnest(range(ms, me + 1)) AS pos FROM {PIECES} WHERE main_hmm IS NOT NULL)"
_FRACTIONS = f"""w AS (SELECT id, pfam_id, 0 AS draw, s AS a, e AS b FROM {_SEG} UNION ALL SELECT r.id, g.pfam_id, draw, random_start, random_start + n - 1 FROM ({_RW}) r JOIN {_SEG} g ON r.id = g.id),
    v AS (SELECT w.id, w.draw, count(k.pos) / (b - a + 1) AS v FROM w LEFT JOIN {_KNOWN} k ON k.pfam_id = w.pfam_id AND k.pos BETWEEN a AND b GROUP BY w.id, w.draw, a, b)"""


def _fractions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Share of annotated positions (those in path segments of the family) of the segments and of their random windows."""
    known = pieces(spark, d).where("main_hmm IS NOT NULL").select(F.col("main_hmm").alias("pfam_id"), F.explode(F.sequence("ms", "me")).alias("pos")).distinct().withColumn("one", F.lit(1.0))
    w = _windows(spark, d).select("id", "pfam_id", "draw", F.col("random_start").cast("int").alias("a"), F.col("random_end").cast("int").alias("b"))
    both = segments(spark, d).select("id", "pfam_id", F.lit(0).alias("draw"), F.col("s").alias("a"), F.col("e").alias("b")).unionByName(w)
    found = Stage(spark, "fractions").write(P.interval_means(both, known, "pfam_id", "a", "b", "pos", "one", 0.0).select("id", "draw", F.col("mean").alias("v")), "found")
    return found.where("draw = 0"), found.where("draw > 0")


@CATALOG.query(
    f"WITH {_FRACTIONS} SELECT a.id, round(a.v, 6) AS observed, count(*) AS random_n, round(avg(r.v), 6) AS random_mean, round(quantile_cont(r.v, 0.5), 6) AS random_median, round((count(*) FILTER (r.v >= a.v) + 1) / (count(*) + 1), 6) AS p_ge FROM v a JOIN v r ON a.id = r.id AND r.draw > 0 WHERE a.draw = 0 GROUP BY a.id, a.v"
)
def rnd_own_null(spark: SparkSession, d: str) -> DataFrame:
    """The annotated share of every segment against its own random windows."""
    return rounded(C.own_null(*_fractions(spark, d), "id", "v"))


@CATALOG.query(
    f"WITH {_FRACTIONS}, g AS (SELECT threshold, count(*) FILTER (draw = 0) AS n_real, count(*) FILTER (draw > 0) AS n_random, avg(v) FILTER (draw = 0) AS real_mean, avg(v) FILTER (draw > 0) AS random_mean, avg((v >= threshold)::INT) FILTER (draw = 0) AS real_hit_rate, avg((v >= threshold)::INT) FILTER (draw > 0) AS random_hit_rate FROM v, (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS threshold) GROUP BY 1) "
    "SELECT threshold, n_real, n_random, round(real_mean, 6) AS real_mean, round(random_mean, 6) AS random_mean, round(real_hit_rate, 6) AS real_hit_rate, round(random_hit_rate, 6) AS random_hit_rate, round(real_mean / nullif(random_mean, 0), 6) AS mean_enrichment, round(real_hit_rate / nullif(random_hit_rate, 0), 6) AS hit_enrichment FROM g"
)
def rnd_pooled_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """The annotated share of all segments against that of all random windows, with hit rates at three thresholds."""
    return rounded(C.pooled_enrichment(*_fractions(spark, d), "v", [0.1, 0.5, 0.9]))
