"""Scalar functions and statistics, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import numeric as N
from strandloom.functions import text as X
from strandloom.functions.numeric import unordered
from strandloom.operators import statistics as S
from strandloom.operators import windows as W
from strandloom.plans.aggregate_queries import rounded
from strandloom.plans.catalog import Catalog
from strandloom.plans.common import CONTACTS, PATHS, PIECES, SPEEDS, WORK, contacts, paths, pieces, speeds, work
from strandloom.plans.join_queries import HITS, hits
from strandloom.session import ship, table

CATALOG = Catalog()


@CATALOG.query(f"SELECT global_row_index, ms, me, ss, se FROM {PIECES}")
def fn_parse_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Texts of segment pairs parsed to rows."""
    return pieces(spark, d).select("global_row_index", "ms", "me", "ss", "se")


@CATALOG.query(f"SELECT global_row_index, regexp_extract(main_segment, '(\\d+)', 1)::INT AS s, greatest(regexp_extract(main_segment, '(\\d+)', 1)::INT, coalesce(try_cast(regexp_extract(main_segment, '(\\d+)\\D+(\\d+)', 2) AS INT), 0)) AS e FROM {PATHS} WHERE regexp_matches(main_segment, '\\d')")
def fn_parse_interval(spark: SparkSession, d: str) -> DataFrame:
    """Intervals written in several ways, ends in order."""
    return paths(spark, d, "global_row_index", X.parse_interval("main_segment").alias("i")).where("i IS NOT NULL").select("global_row_index", "i.s", "i.e")


@CATALOG.query(
    f"SELECT global_row_index, pfam_side, count(DISTINCT r) AS n_residues, min(r) AS first, max(r) AS last FROM (SELECT global_row_index, pfam_side, unnest(range(split_part(part, '-', 1)::INT, split_part(part, '-', -1)::INT + 1)) AS r FROM (SELECT *, unnest(string_split_regex(mapped_pdb_residues, '[,;\\s]+')) AS part FROM {CONTACTS}) WHERE regexp_matches(part, '^\\d+(-\\d+)?$')) GROUP BY 1, 2"
)
def fn_parse_residues(spark: SparkSession, d: str) -> DataFrame:
    """Residue lists such as 1,2;5-8."""
    t = contacts(spark, d, "global_row_index", "pfam_side", X.parse_residues("mapped_pdb_residues").alias("r")).where("size(r) > 0")
    return t.select("global_row_index", "pfam_side", F.size("r").cast("bigint").alias("n_residues"), F.array_min("r").cast("bigint").alias("first"), F.array_max("r").cast("bigint").alias("last"))


@CATALOG.query(f"SELECT global_row_index, pfam_side, split_part(trim(accession), '.', 1) AS base, nullif(regexp_extract(target_header, '\\b([OPQ][0-9][A-Z0-9]{{3}}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{{2}}[0-9]){{1,2}})\\b', 1), '') AS found FROM {CONTACTS}")
def fn_accessions(spark: SparkSession, d: str) -> DataFrame:
    """Base accession and the accession found in a header."""
    return contacts(spark, d, "global_row_index", "pfam_side", X.base_accession("accession").alias("base"), X.uniprot_accession("target_header").alias("found"))


@CATALOG.query(
    f"SELECT global_row_index, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim(k), '[\\\\/:]+', '__', 'g'), '[^A-Za-z0-9._+-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'record') AS name FROM (SELECT global_row_index, 'run/' || coalesce(main_hmm, '') || ':' || file || ' (x)' AS k FROM {PATHS})"
)
def fn_safe_names(spark: SparkSession, d: str) -> DataFrame:
    """Names fit for files."""
    k = F.concat(F.lit("run/"), F.coalesce("main_hmm", F.lit("")), F.lit(":"), "file", F.lit(" (x)"))
    return paths(spark, d, "global_row_index", X.safe_name(k).alias("name"))


@CATALOG.query("SELECT DISTINCT (l_linenumber / 2.0)::DOUBLE AS first, (l_tax * 100 / 4)::DOUBLE AS second FROM lineitem")
def fn_combination_tags(spark: SparkSession, d: str) -> DataFrame:
    """Threshold combinations written as tags and read back."""
    t = table(spark, d, "lineitem").select((F.col("l_linenumber") / 2).alias("a"), (F.col("l_tax") * 100 / 4).alias("b")).distinct()
    tag = F.concat(F.lit("F"), X.number_tag("a"), F.lit("_S"), X.number_tag("b"))
    return t.select(X.parse_combination(tag).alias("c")).select("c.first", "c.second")


@CATALOG.query(f"SELECT global_row_index, pfam_side, pdb_id, chain_id, target_seq_len::VARCHAR AS len FROM {CONTACTS} WHERE pdb_id IS NOT NULL AND chain_id IS NOT NULL AND target_seq_len IS NOT NULL")
def fn_pipe_headers(spark: SparkSession, d: str) -> DataFrame:
    """key=value headers written and parsed."""
    t = contacts(spark, d, "global_row_index", "pfam_side", "pdb_id", "chain_id", "target_seq_len").where("pdb_id IS NOT NULL AND chain_id IS NOT NULL AND target_seq_len IS NOT NULL")
    h = X.parse_pipe_header(F.concat(F.lit("x|pdb="), "pdb_id", F.lit("| chain = "), "chain_id", F.lit("|len="), F.col("target_seq_len").cast("string"), F.lit("|odd")))
    return t.withColumn("h", h).select("global_row_index", "pfam_side", F.col("h")["pdb"].alias("pdb_id"), F.col("h")["chain"].alias("chain_id"), F.col("h")["len"].alias("len"))


_CODES = "CASE l_linenumber " + " ".join(f"WHEN {n} THEN '{c}'" for n, c in enumerate(["Ala", "TRP", "mse", "xyz", "Gly", "LYS", "Cys"], 1)) + " END"


@CATALOG.query("SELECT l_linenumber, CASE l_linenumber WHEN 1 THEN 'A' WHEN 2 THEN 'W' WHEN 3 THEN 'M' WHEN 5 THEN 'G' WHEN 6 THEN 'K' WHEN 7 THEN 'C' ELSE 'X' END AS letter, count(*) AS n FROM lineitem GROUP BY 1")
def fn_residue_letters(spark: SparkSession, d: str) -> DataFrame:
    """Three-letter residue codes to letters."""
    t = table(spark, d, "lineitem").withColumn("letter", X.one_letter(F.expr(_CODES)))
    return t.groupBy("l_linenumber", "letter").agg(F.count(F.lit(1)).alias("n"))


@CATALOG.query(
    "SELECT l_orderkey, l_linenumber, round(log10(l_extendedprice), 9) AS a, round(ln(l_quantity), 9) AS b, round(exp(-l_discount), 9) AS c, round(pow(l_quantity, 0.25), 9) AS e, round(sqrt(l_extendedprice), 9) AS f, round_even(l_extendedprice / 7, 2) AS g, least(greatest(l_quantity, 10), 40) AS h FROM lineitem"
)
def fn_math(spark: SparkSession, d: str) -> DataFrame:
    """Logarithms, powers, rounding half to even, clipping."""
    r = lambda c, n: F.round(c, 9).alias(n)
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(F.log10(p), "a"), r(F.log(q), "b"), r(F.exp(-F.col("l_discount")), "c"), r(F.pow(q, 0.25), "e"), r(F.sqrt(p), "f"), N.round_even(p / 7, 2).alias("g"), N.clip(q, 10.0, 40.0).alias("h"))


_W = (
    "WITH g AS (SELECT l_returnflag, count(*) FILTER (a) AS n_a, count(*) FILTER (NOT a) AS n_b, avg(x) FILTER (a) AS mean_a, avg(x) FILTER (NOT a) AS mean_b, var_samp(x) FILTER (a) AS va, var_samp(x) FILTER (NOT a) AS vb FROM (SELECT l_returnflag, l_extendedprice AS x, l_linenumber <= 3 AS a FROM lineitem) GROUP BY 1), s AS (SELECT *, va / n_a AS ea, vb / n_b AS eb, sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)) AS sd FROM g) "
)


@CATALOG.query(
    _W + "SELECT l_returnflag, n_a, n_b, round(mean_a, 4) AS mean_a, round(mean_b, 4) AS mean_b, round(sd, 4) AS pooled_sd, round((mean_a - mean_b) / sd, 6) AS cohen_d, round((mean_a - mean_b) / sqrt(ea + eb), 6) AS t, round(pow(ea + eb, 2) / (ea * ea / (n_a - 1) + eb * eb / (n_b - 1)), 4) AS df, true AS p_valid FROM s"
)
def fn_welch(spark: SparkSession, d: str) -> DataFrame:
    """X11: pooled deviation, Cohen's d, Welch's t and its p-value."""
    w = S.welch(table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", "l_linenumber"), "l_returnflag", "l_extendedprice", F.col("l_linenumber") <= 3)
    r = {"mean_a": 4, "mean_b": 4, "pooled_sd": 4, "cohen_d": 6, "t": 6, "df": 4}
    return w.select("l_returnflag", "n_a", "n_b", *[F.round(c, k).alias(c) for c, k in r.items()], F.col("p").between(0, 1).alias("p_valid"))


@CATALOG.query()
def fn_normal_p(spark: SparkSession, d: str) -> DataFrame:
    """Two-sided normal p-values of standardised scores."""
    ship(spark)
    t = paths(spark, d, "global_row_index", "score").where("score IS NOT NULL")
    m = F.broadcast(t.agg(F.avg("score").alias("m"), F.stddev_samp("score").alias("s")))  # one row
    return t.join(m).select("global_row_index", S.normal_p((F.col("score") - F.col("m")) / F.col("s")).alias("p"))


@CATALOG.query(
    f"""WITH t AS (SELECT gpu_count, pair_count, gpu_wall_seconds_median AS x FROM {SPEEDS} WHERE gpu_wall_seconds_median IS NOT NULL), m AS (SELECT gpu_count, avg(x) AS mean, count(*) AS n FROM t GROUP BY 1),
    c AS (SELECT t.gpu_count, t.pair_count, sum(x - mean) AS s FROM t JOIN m USING (gpu_count) GROUP BY 1, 2), g AS (SELECT gpu_count, count(*) AS k, sum(s * s) AS ss FROM c GROUP BY 1)
    SELECT gpu_count, round(mean, 4) AS mean, n, k AS n_clusters, round(sqrt(k / (k - 1) * ss) / n, 4) AS se FROM m JOIN g USING (gpu_count) WHERE k > 1"""
)
def fn_clustered_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean with a cluster-robust standard error."""
    r = S.clustered_mean(speeds(spark, d, "gpu_count", "pair_count", "gpu_wall_seconds_median"), "gpu_count", "pair_count", "gpu_wall_seconds_median")
    return r.where("n_clusters > 1").select("gpu_count", F.round("mean", 4).alias("mean"), "n", "n_clusters", F.round("se", 4).alias("se"))


@CATALOG.query(
    f"WITH t AS (SELECT global_row_index, pfam_side, status, lr_contact_fraction AS p FROM {CONTACTS} WHERE lr_contact_fraction IS NOT NULL), r AS (SELECT *, p * count(*) OVER (PARTITION BY status) / row_number() OVER (PARTITION BY status ORDER BY p, global_row_index, pfam_side) AS raw FROM t) SELECT global_row_index, pfam_side, round(least(1.0, min(raw) OVER (PARTITION BY status ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 9) AS q FROM r"
)
def fn_fdr(spark: SparkSession, d: str) -> DataFrame:
    """Benjamini-Hochberg q-values."""
    t = contacts(spark, d, "global_row_index", "pfam_side", "status", F.col("lr_contact_fraction").alias("p")).where("p IS NOT NULL")
    return S.fdr(t, ["status"], "p").select("global_row_index", "pfam_side", F.round("q", 9).alias("q"))


@CATALOG.query(
    "WITH c AS (SELECT least(floor((l_quantity - 1) / 4.9), 9) AS bin, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag != 'A') AS b FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY 1), t AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM c) SELECT round(sum(abs(p - q)), 6) AS l1, round(sum(abs(p - q)) / 2, 6) AS total_variation, round(sum(least(p, q)), 6) AS overlap, round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 9) AS jensen_shannon FROM t"
)
def fn_histogram_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances of two histograms."""
    r = S.histogram_distances(table(spark, d, "lineitem").select("l_quantity", "l_returnflag"), "l_quantity", F.col("l_returnflag") == "A", 1.0, 50.0, 10)
    return r.select(*[F.round(c, 6).alias(c) for c in ("l1", "total_variation", "overlap")], F.round("jensen_shannon", 9).alias("jensen_shannon"))


@CATALOG.query()
def fn_fit_curves(spark: SparkSession, d: str) -> DataFrame:
    """Logistic fit of the share of pairs below a size, per stratum, with steepest point and bends."""
    t = work(spark, d, "workload_stratum", "window_cells").where("window_cells > 0 AND workload_stratum IS NOT NULL").withColumn("x", F.round(F.log10("window_cells"), 1))
    h = t.groupBy("workload_stratum", "x").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    w = Window.partitionBy("workload_stratum")
    c = h.withColumn("y", F.sum("n").over(w.orderBy("x")) / F.sum("n").over(w))
    return S.fit_curves(c, "workload_stratum", "x", "y")


@CATALOG.query()
def fn_density(spark: SparkSession, d: str) -> DataFrame:
    """Kernel density of score against similarity."""
    t = paths(spark, d, F.lit("all").alias("g"), "score", F.log10("avg_similarity").alias("sim")).where("score IS NOT NULL AND sim IS NOT NULL AND NOT isnan(sim)")
    return S.density(t, "g", "score", "sim", "all")


@CATALOG.query(f"SELECT global_row_index, {X.HASH_SQL.format(k=chr(39).join(['concat_ws(', '|', ', 42, main_hmm, global_row_index)']))} AS seed FROM {PATHS}")
def fn_hash_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Seeds from a stable hash of the key."""
    return paths(spark, d, "global_row_index", X.hash_number(F.lit(42), "main_hmm", "global_row_index").alias("seed"))


@CATALOG.query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k, json_extract_string(props, '$.none') AS none FROM events")
def fn_json(spark: SparkSession, d: str) -> DataFrame:
    """Values of JSON texts."""
    m = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", m.getItem("k").cast("int").alias("k"), m.getItem("none").alias("none"))


@CATALOG.query(
    f"WITH c AS (SELECT workload_stratum AS g, window_cells AS v, count(*) FILTER (j % 2 = 0) AS a, count(*) FILTER (j % 2 = 1) AS b FROM {WORK} WHERE window_cells > 0 AND workload_stratum IS NOT NULL GROUP BY 1, 2), t AS (SELECT g, sum(a) OVER r / sum(a) OVER w - sum(b) OVER r / sum(b) OVER w AS dd FROM c WINDOW w AS (PARTITION BY g), r AS (PARTITION BY g ORDER BY v)) SELECT g AS workload_stratum, round(greatest(max(dd), -min(dd)), 6) AS d, true AS p_valid FROM t GROUP BY 1"
)
def fn_kolmogorov(spark: SparkSession, d: str) -> DataFrame:
    """Two-sample test with its asymptotic p-value."""
    ship(spark)
    t = work(spark, d, "workload_stratum", "window_cells", "j").where("window_cells > 0 AND workload_stratum IS NOT NULL")
    r = W.two_sample_distance(t, "workload_stratum", "window_cells", F.col("j") % 2 == 0)
    return r.select("workload_stratum", F.round("d", 6).alias("d"), S.kolmogorov_p(F.col("d"), F.col("n_first"), F.col("n_second")).between(0, 1).alias("p_valid"))


# ---- set operations ----


@CATALOG.query("SELECT c_name AS name, c_nationkey AS nation, 'customer' AS kind FROM customer UNION ALL SELECT s_name, s_nationkey, 'supplier' FROM supplier")
def set_concat(spark: SparkSession, d: str) -> DataFrame:
    """Tables put one below the other by column names."""
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s)


@CATALOG.query("SELECT global_row_index, main_hmm, min(loaded_at) AS first_loaded, count(*) AS deliveries FROM (SELECT DISTINCT * FROM global_high_score_summary_fin) GROUP BY 1, 2")
def set_distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    """Repeated rows once, the earliest delivery kept."""
    t = table(spark, d, "global_high_score_summary_fin").select("global_row_index", "main_hmm", "loaded_at").distinct()
    return t.groupBy("global_row_index", "main_hmm").agg(F.min("loaded_at").alias("first_loaded"), F.count(F.lit(1)).alias("deliveries"))


_PA = f"(SELECT DISTINCT least(main_hmm, sub_hmm) AS a, greatest(main_hmm, sub_hmm) AS b FROM {PATHS} WHERE main_hmm IS NOT NULL AND sub_hmm IS NOT NULL)"
_PB = f"(SELECT DISTINCT least(main_hmm, sub_hmm) AS a, greatest(main_hmm, sub_hmm) AS b FROM {HITS} WHERE main_hmm IS NOT NULL AND sub_hmm IS NOT NULL)"


def _pair_sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    u, v = unordered("main_hmm", "sub_hmm")
    make = lambda t: t.select(u.alias("a"), v.alias("b")).dropna().distinct()
    return make(paths(spark, d, "main_hmm", "sub_hmm")), make(hits(spark, d))


@CATALOG.query(f"SELECT a, b FROM {_PA} INTERSECT SELECT a, b FROM {_PB}")
def set_pairs_shared(spark: SparkSession, d: str) -> DataFrame:
    """Unordered pairs in both sets."""
    a, b = _pair_sets(spark, d)
    return a.intersect(b)


@CATALOG.query(f"SELECT a, b FROM {_PA} EXCEPT SELECT a, b FROM {_PB}")
def set_pairs_missing(spark: SparkSession, d: str) -> DataFrame:
    """Unordered pairs of the first set that the second lacks."""
    a, b = _pair_sets(spark, d)
    return a.subtract(b)


@CATALOG.query(
    f"""WITH a AS (SELECT DISTINCT main_hmm AS k, unnest(range(ms, me + 1)) AS p FROM {PIECES} WHERE main_hmm IS NOT NULL), b AS (SELECT DISTINCT sub_hmm AS k, unnest(range(ss, se + 1)) AS p FROM {PIECES} WHERE sub_hmm IS NOT NULL),
    na AS (SELECT k, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT k, count(*) AS n FROM b GROUP BY 1), x AS (SELECT k, count(*) AS n FROM a JOIN b USING (k, p) GROUP BY 1)
    SELECT na.k AS hmm, na.n AS length_main, nb.n AS length_sub, coalesce(x.n, 0) AS length_both FROM na JOIN nb USING (k) LEFT JOIN x USING (k)"""
)
def set_intervals_shared(spark: SparkSession, d: str) -> DataFrame:
    """Intersection of two merged interval sets per family and its length."""
    from strandloom.operators.intervals import intersect_sets

    p = pieces(spark, d)
    a = p.where("main_hmm IS NOT NULL").select(F.col("main_hmm").alias("hmm"), F.col("ms").alias("s"), F.col("me").alias("e"))
    b = p.where("sub_hmm IS NOT NULL").select(F.col("sub_hmm").alias("hmm"), F.col("ss").alias("s"), F.col("se").alias("e"))
    return intersect_sets(a, b, "hmm", "s", "e").select("hmm", F.col("length_a").alias("length_main"), F.col("length_b").alias("length_sub"), "length_both")


@CATALOG.query(
    f"WITH a AS (SELECT DISTINCT main_hmm AS k FROM {PATHS} WHERE main_hmm IS NOT NULL), b AS (SELECT DISTINCT pfam_id AS k FROM {CONTACTS} WHERE pfam_id IS NOT NULL) SELECT count(*) FILTER (a.k IS NOT NULL) AS n_a, count(*) FILTER (b.k IS NOT NULL) AS n_b, count(*) FILTER (a.k = b.k) AS n_both, count(*) FILTER (b.k IS NULL) AS only_a, count(*) FILTER (a.k IS NULL) AS only_b FROM a FULL JOIN b ON a.k = b.k"
)
def set_key_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of two key sets, their intersection and differences."""
    a = paths(spark, d, F.col("main_hmm").alias("k")).dropna().distinct().withColumn("a", F.lit(True))
    b = contacts(spark, d, F.col("pfam_id").alias("k")).dropna().distinct().withColumn("b", F.lit(True))
    n = lambda e, out: F.count_if(F.expr(e)).alias(out)
    return a.join(b, "k", "full").agg(n("a", "n_a"), n("b", "n_b"), n("a AND b", "n_both"), n("b IS NULL", "only_a"), n("a IS NULL", "only_b"))


@CATALOG.query(
    f"SELECT pfam_id, count(DISTINCT r) AS n_residues FROM (SELECT pfam_id, unnest(range(split_part(part, '-', 1)::INT, split_part(part, '-', -1)::INT + 1)) AS r FROM (SELECT *, unnest(string_split_regex(mapped_pdb_residues, '[,;\\s]+')) AS part FROM {CONTACTS} WHERE pfam_id IS NOT NULL) WHERE regexp_matches(part, '^\\d+(-\\d+)?$')) GROUP BY 1"
)
def set_residue_union(spark: SparkSession, d: str) -> DataFrame:
    """Union of the residues mapped in all structures of a family, by distinct rows instead of growing sets."""
    t = contacts(spark, d, "pfam_id", F.explode(X.parse_residues("mapped_pdb_residues")).alias("r")).where("pfam_id IS NOT NULL")
    return t.distinct().groupBy("pfam_id").agg(F.count(F.lit(1)).alias("n_residues"))
