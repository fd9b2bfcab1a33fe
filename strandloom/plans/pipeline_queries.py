"""Sources, streams, functions of the user, and pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import numeric as N
from strandloom.functions.names import CLEAN_NAME_SQL, clean_name
from strandloom.operators import controls as R
from strandloom.operators import divergence as D
from strandloom.operators import pipelines as K
from strandloom.operators.windows import ordered_buckets, running_total
from strandloom.plans.aggregate_queries import fractions, rounded
from strandloom.plans.catalog import Catalog
from strandloom.plans.common import CONTACTS, PATHS, PIECES, POINTS, WINDOW, WORK, background, contacts, paths, pieces, points, work
from strandloom.session import Stage, ship, small, table
from strandloom.sources import readers as S
from strandloom.streaming import watch

CATALOG = Catalog()

_DUMP = "SELECT doc_id, split_part(l[1], '  ', 2) AS family, unnest(l[2:]) AS line FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\n|\\r') AS l FROM documents WHERE starts_with(text, 'HMM '))"
_STATES = f"SELECT doc_id, family, string_split_regex(line, '\\s+') AS c FROM ({_DUMP}) WHERE len(string_split_regex(line, '\\s+')) = 22 AND regexp_matches(string_split_regex(line, '\\s+')[2], '^\\d+$')"


@CATALOG.query(
    f"SELECT doc_id, family, c[2]::INT AS state, c[1] AS aa, list_sum([CASE WHEN x = '*' OR try_cast(x AS DOUBLE) IS NULL THEN 0 ELSE 1 END for x in c[3:22]])::INT AS n_finite FROM ({_STATES})"
)
def src_profile_dumps(spark: SparkSession, d: str) -> DataFrame:
    """Match states of the profile dumps among the documents."""
    t = S.profile_dumps(table(spark, d, "documents"), "doc_id", "text")
    finite = F.size(F.filter("emissions", lambda x: x.isNotNull() & (x != float("inf"))))
    return t.select("doc_id", F.col("family"), "state", "aa", finite.alias("n_finite"))


@CATALOG.query(
    "SELECT doc_id, n, regexp_extract(rec, '^([^\\r\\n]*)', 1) AS header, length(regexp_replace(substr(rec, length(regexp_extract(rec, '^([^\\r\\n]*)', 1)) + 1), '\\s', '', 'g')) AS n_letters FROM (SELECT doc_id, unnest(r) AS rec, (unnest(range(len(r))))::INT AS n FROM (SELECT doc_id, string_split_regex(substr(text, 2), '(?:\\r\\n|\\n|\\r)>') AS r FROM documents WHERE starts_with(text, '>')))"
)
def src_sequence_records(spark: SparkSession, d: str) -> DataFrame:
    """Sequence records among the documents."""
    return S.sequence_records(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "n", "header", F.length("sequence").alias("n_letters"))


@CATALOG.query(f"SELECT DISTINCT i, j FROM {WORK}")
def src_pair_list(spark: SparkSession, d: str) -> DataFrame:
    """The work list written as CSV and read as a pair list, each pair once."""
    stage = Stage(spark, "pairs")
    path = f"{stage.root}/csv"
    work(spark, d, "i", "j").repartition(8, "i").write.option("header", "true").csv(path)
    return S.read_pair_list(spark, path)


@CATALOG.query('SELECT i, j, "row", col, raw FROM ' + POINTS)
def src_points(spark: SparkSession, d: str) -> DataFrame:
    """Points written in buckets of a family and read back."""
    stage = Stage(spark, "points")
    S.write_points(points(spark, d), f"{stage.root}/p", 16)
    return S.read_points(spark, f"{stage.root}/p")


@CATALOG.query("SELECT s.r_regionkey AS i, n.n_nationkey AS j FROM region s, nation n WHERE n.n_nationkey >= s.r_regionkey")
def src_expand_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of two ranges, upper triangle."""
    ends = [table(spark, d, t).agg(F.min(c), F.max(c)).first() for t, c in (("region", "r_regionkey"), ("nation", "n_nationkey"))]
    return S.expand_ranges(spark, *ends[0], *ends[1], symmetric=True).select(F.col("i").cast("int"), F.col("j").cast("int"))


@CATALOG.query(f"SELECT global_row_index, pfam_side, status FROM {CONTACTS} WHERE status = 'OK'")
def src_related_tables(spark: SparkSession, d: str) -> DataFrame:
    """Two related tables written and read by SQL with a filter on the status."""
    stage = Stage(spark, "obs")
    t = contacts(spark, d, F.concat_ws(":", "global_row_index", "pfam_side").alias("obs_id"), "global_row_index", "pfam_side", "status")
    S.write_observations(t, t.select("obs_id", F.lit(1).alias("draw")), f"{stage.root}/db")
    hits, windows = S.read_observations(spark, f"{stage.root}/db")
    return hits.join(windows, "obs_id").select("global_row_index", "pfam_side", "status")


# ---- profiles and divergence ----


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of the dumps: states in order, transitions fixed, the background the mean emission of all states."""
    t = S.profile_dumps(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "state", D.probabilities("emissions").alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    t = t.where(total > 0).withColumn("e", F.transform("e", lambda x: x / total))
    t = Stage(spark, "profiles").write(t, "states")
    bg = t.select(F.posexplode("e").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("x"))  # 20 rows
    bg = F.broadcast(bg.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda r: r["x"]).alias("background")))
    g = t.groupBy(F.col("doc_id").alias("family")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("state", "e"))), lambda r: r["e"])).alias("emissions"))  # a profile is one document
    return D.fixed_transitions(g.join(bg))


@CATALOG.query()
def pipe_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Divergence of all windows of every profile and the next one; nearest windows of each pair."""
    p = Stage(spark, "profiles").write(profiles(spark, d), "all")
    ids = ordered_buckets(p.select("family", F.lit(1).alias("_one")), ["family"])
    ids = running_total(ids, [F.asc("family")], "_one", "n", ["_p"])
    pairs = ids.select(F.col("family").alias("i"), "n").join(ids.select(F.col("family").alias("j"), (F.col("n") - 1).alias("n")), "n")
    t = D.window_divergence(pairs, p, WINDOW)
    return t.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n_cells"), F.min("raw").alias("nearest"), F.avg("raw").alias("mean"))


@CATALOG.query()
def pipe_column_background(spark: SparkSession, d: str) -> DataFrame:
    """Divergence of every match state from the background and its mean over windows."""
    p = profiles(spark, d).select("family", "background", F.posexplode(F.expr("transform(sequence(0, size(emissions) div 20 - 1), k -> slice(emissions, k * 20 + 1, 20))")).alias("state", "e"))
    return D.window_background(D.column_divergence(p, "family", "state", "e", "background"), "family", "state", "divergence", WINDOW)


@CATALOG.query()
def pipe_detect(spark: SparkSession, d: str) -> DataFrame:
    """The whole detection: points to final paths."""
    names = table(spark, d, "part").select((F.col("p_partkey") % 20).cast("int").alias("family")).distinct().withColumn("name", F.format_string("F%02d", "family"))
    cover = names.select(F.col("name").alias("family"), F.explode(F.sequence(F.lit(1), F.lit(80))).alias("pos"), F.lit(0.95).alias("frac"))
    p = K.Detection(window=WINDOW, keep_score=1.0, min_path_points=1, min_score=0.0)
    return K.detect(points(spark, d), small(background(spark, d), 200_000), names, cover, p)


# ---- composite operators ----

_MAP = f"(SELECT pfam_id, target_hmm_start AS state, min(target_msa_start) AS col FROM {CONTACTS} WHERE pfam_id IS NOT NULL AND target_hmm_start IS NOT NULL AND target_msa_start IS NOT NULL GROUP BY 1, 2)"


@CATALOG.query(
    f"""WITH s AS (SELECT DISTINCT * FROM (SELECT global_row_index, main_hmm AS pfam_id, ms AS s, me AS e FROM {PIECES} UNION ALL SELECT global_row_index, sub_hmm, ss, se FROM {PIECES}) WHERE pfam_id IS NOT NULL),
    j AS (SELECT t.pfam_id, global_row_index, s, e, a.col AS a, b.col AS b FROM (SELECT DISTINCT pfam_id FROM {CONTACTS} WHERE pfam_id IS NOT NULL) t LEFT JOIN s USING (pfam_id) LEFT JOIN {_MAP} a ON a.pfam_id = t.pfam_id AND a.state = s LEFT JOIN {_MAP} b ON b.pfam_id = t.pfam_id AND b.state = e),
    x AS (SELECT *, CASE WHEN global_row_index IS NULL THEN 'No_Path' WHEN a IS NULL OR b IS NULL THEN 'Position_Not_In_Map' WHEN a > b THEN 'Inverted' ELSE 'OK' END AS status FROM j)
    SELECT pfam_id, status, count(*) AS n FROM x GROUP BY 1, 2"""
)
def pipe_project_segments(spark: SparkSession, d: str) -> DataFrame:
    """K1: segments projected onto alignments; every failure keeps a row with its status."""
    tasks = contacts(spark, d, "pfam_id").where("pfam_id IS NOT NULL")
    m = contacts(spark, d, "pfam_id", F.col("target_hmm_start").alias("state"), F.col("target_msa_start").alias("col")).dropna()
    return K.project_segments(tasks, pieces(spark, d), m, "pfam_id", "global_row_index").groupBy("pfam_id", "status").agg(F.count(F.lit(1)).alias("n"))


_RATIO = "fragment_size_mapped / (abs(target_hmm_end - target_hmm_start) + 1)"


@CATALOG.query(
    f"WITH s AS (SELECT pdb_id, pfam_side, coalesce(status = 'OK' AND {_RATIO} BETWEEN 0.8 AND 1.2, false) AS ok, lr_contact_fraction AS v, row_number() OVER (PARTITION BY pdb_id, pfam_side ORDER BY coalesce(status = 'OK' AND {_RATIO} BETWEEN 0.8 AND 1.2, false) DESC, abs({_RATIO} - 1) ASC NULLS LAST, global_row_index) AS r FROM {CONTACTS} WHERE pdb_id IS NOT NULL) SELECT pdb_id, count(*) FILTER (ok) AS n_assessed, count(*) FILTER (ok AND v >= 0.3) AS n_flagged, count(*) FILTER (ok AND v >= 0.3) = 2 AS both_flagged FROM s WHERE r = 1 GROUP BY 1"
)
def pipe_side_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """K2, K3, K4: best candidate of each side of a structure in a fixed order, then counts per structure."""
    t = contacts(spark, d, "pdb_id", "pfam_side", "status", "fragment_size_mapped", "target_hmm_start", "target_hmm_end", "global_row_index", "lr_contact_fraction").where("pdb_id IS NOT NULL")
    s = K.pick_sides(t, "pdb_id", "pfam_side", F.col("status") == "OK", F.expr(_RATIO), [F.asc("global_row_index")])
    return K.annotate_rows(s, "pdb_id", F.col("lr_contact_fraction") >= 0.3)


@CATALOG.query(
    f"""WITH o AS (SELECT pfam_id, rfco FROM (SELECT DISTINCT pfam_id, target_hmm_start, target_hmm_end, rfco FROM {CONTACTS} WHERE pfam_id IS NOT NULL AND rfco IS NOT NULL)), a AS (SELECT pfam_id, avg(rfco) AS actual, count(*) AS n_actual FROM o GROUP BY 1),
    r AS (SELECT c.pfam_id, c.mean_sequence_separation / c.chain_length AS v, a.actual FROM {CONTACTS} c JOIN a USING (pfam_id) WHERE c.mean_sequence_separation / c.chain_length IS NOT NULL)
    SELECT pfam_id, count(*) AS n_random, round(avg(v), 9) AS random_mean, round(stddev_pop(v), 6) AS random_std FROM r GROUP BY 1"""
)
def pipe_actual_against_random(spark: SparkSession, d: str) -> DataFrame:
    """K5, K6: actual measures once per interval against a second measure per family."""
    t = contacts(spark, d, "pfam_id", "target_hmm_start", "target_hmm_end", "rfco", F.expr("mean_sequence_separation / chain_length").alias("v")).where("pfam_id IS NOT NULL")
    r = K.actual_against_random(t, t, "pfam_id", "rfco", "v", ["target_hmm_start", "target_hmm_end", "rfco"])
    return r.where("n_random IS NOT NULL").select("pfam_id", "n_random", F.round("random_mean", 9).alias("random_mean"), F.round("random_std", 6).alias("random_std"))


@CATALOG.query(
    f"""WITH t AS (SELECT score, CASE WHEN coverage_main >= 0.9 THEN 'covered' ELSE 'other' END AS "group", num_sub_segments = 1 AS a, main_segment_len >= 10 AS b FROM {PATHS}),
    x AS (SELECT 'all' AS filter, * FROM t UNION ALL SELECT 'single', * FROM t WHERE a UNION ALL SELECT 'long', * FROM t WHERE b)
    SELECT filter, "group", count(*) AS n, round(avg(score), 9) AS mean, round(median(score), 9) AS median, round(sum(count(*)) OVER (PARTITION BY filter) / (SELECT count(*) FROM t), 9) AS retention FROM x GROUP BY 1, 2"""
)
def pipe_filter_battery(spark: SparkSession, d: str) -> DataFrame:
    """K7: a battery of filters summarised in one pass."""
    t = paths(spark, d, "score", "coverage_main", "num_sub_segments", "main_segment_len")
    masks = {"all": F.lit(True), "single": F.col("num_sub_segments") == 1, "long": F.col("main_segment_len") >= 10}
    return rounded(K.filter_battery(t, masks, F.when(F.col("coverage_main") >= 0.9, "covered").otherwise("other"), "score"), digits=9)


_ZERO = f"(SELECT i, CASE WHEN j = 11 THEN i ELSE j END AS j, \"row\", col, raw FROM {POINTS})"


@CATALOG.query(
    f'SELECT i, count(*) AS n, count(*) FILTER (raw = 0 AND i = j AND "row" = col) AS zero_self_diagonal, count(*) FILTER (raw = 0 AND i = j AND "row" != col) AS zero_self_other, count(*) FILTER (raw = 0 AND i != j) AS zero_elsewhere, min(raw) AS lowest, max(raw) AS highest, count(DISTINCT floor(raw / 0.5)) AS n_bins FROM {_ZERO} GROUP BY 1'
)
def pipe_sparse_accounting(spark: SparkSession, d: str) -> DataFrame:
    """K9: conversion to sparse points with the zeros accounted for by place."""
    t = points(spark, d).withColumn("j", F.when(F.col("j") == 11, F.col("i")).otherwise(F.col("j")))
    return K.sparse_accounting(t, "raw", 0.5)


def _combo_sql() -> str:
    one = lambda n, a, b: f"""SELECT '{n}' AS combo, i, j, col - "row" AS dg, "row" FROM {POINTS} WHERE raw > 0 AND raw <= {a} AND ("row" + col) >= {b}"""
    return " UNION ALL ".join(one(n, a, b) for n, a, b in (("F1p0_S20p0", 1.0, 20.0), ("F2p0_S20p0", 2.0, 20.0), ("F2p0_S60p0", 2.0, 60.0)))


@CATALOG.query(
    f"""WITH p AS ({_combo_sql()}), c AS (SELECT *, sum(f) OVER (PARTITION BY combo, i, j, dg ORDER BY "row") AS c FROM (SELECT *, CASE WHEN "row" - lag("row") OVER (PARTITION BY combo, i, j, dg ORDER BY "row") <= 5 THEN 0 ELSE 1 END AS f FROM p)),
    g AS (SELECT combo, i, j, dg, c, count(*) AS n FROM c GROUP BY ALL) SELECT combo, count(*) AS n_chains, max(n) AS longest, sum(n)::BIGINT AS n_points FROM g GROUP BY 1"""
)
def pipe_scan_combinations(spark: SparkSession, d: str) -> DataFrame:
    """Chains under several combinations of thresholds, the combination being one more key."""
    t = points(spark, d).withColumn("linear", (F.col("row") + F.col("col")).cast("double"))
    r = K.scan_combinations(t, [(1.0, 20.0), (2.0, 20.0), (2.0, 60.0)], WINDOW)
    return r.groupBy("combo").agg(F.count(F.lit(1)).alias("n_chains"), F.max("n_points").alias("longest"), F.sum("n_points").alias("n_points"))


@CATALOG.query(
    f"SELECT CASE WHEN status IS DISTINCT FROM 'OK' THEN 'Status_Not_OK' WHEN fragment_size_mapped >= 5 THEN CASE WHEN coalesce(chain_length > 50, false) THEN 'OK' ELSE 'Short_Chain' END ELSE 'Low_Coverage' END AS reason, count(*) AS n FROM {CONTACTS} GROUP BY 1"
)
def pipe_eligible_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Eligible rows, the reasons of all others counted."""
    t = contacts(spark, d, "status", "fragment_size_mapped", "chain_length")
    checks = [("Status_Not_OK", F.col("status") == "OK"), ("Low_Coverage", F.col("fragment_size_mapped") >= 5), ("Short_Chain", F.col("chain_length") > 50)]
    return K.eligible_with_reasons(t, checks).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@CATALOG.query(
    f"SELECT mode, count(*) AS n, sum(e - s + 1)::BIGINT AS total FROM (SELECT 'sequence' AS mode, target_seq_start AS s, target_seq_end AS e FROM {CONTACTS} UNION ALL SELECT 'alignment', target_msa_start, target_msa_end FROM {CONTACTS}) WHERE s <= e GROUP BY 1"
)
def pipe_two_numberings(spark: SparkSession, d: str) -> DataFrame:
    """One run over two numberings, the mode being a column."""
    t = contacts(spark, d, "target_seq_start", "target_seq_end", "target_msa_start", "target_msa_end")
    t = t.select(F.expr("stack(2, 'sequence', target_seq_start, target_seq_end, 'alignment', target_msa_start, target_msa_end) AS (mode, s, e)")).where("s <= e")
    return t.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("e") - F.col("s") + 1).cast("bigint")).alias("total"))


@CATALOG.query(
    f"SELECT pfam_id, '>' || pfam_id || '|' || target_header || chr(10) || upper(translate(target_aligned_frag, '-.', '')) AS fasta FROM {CONTACTS} WHERE pfam_id IS NOT NULL AND length(translate(target_aligned_frag, '-.', '')) > 0 QUALIFY row_number() OVER (PARTITION BY pfam_id ORDER BY length(translate(target_aligned_frag, '-.', '')) DESC, global_row_index, pfam_side) = 1"
)
def pipe_representatives(spark: SparkSession, d: str) -> DataFrame:
    """One representative per family as a FASTA record."""
    from strandloom.functions.text import ungap

    t = contacts(spark, d, "pfam_id", "target_header", "target_aligned_frag", "global_row_index", "pfam_side").where("pfam_id IS NOT NULL")
    order = [F.length(ungap("target_aligned_frag")).desc(), F.asc("global_row_index"), F.asc("pfam_side")]
    return K.representative_records(t, "pfam_id", order, F.concat_ws("|", "pfam_id", "target_header"), "target_aligned_frag").select("pfam_id", "fasta")


# ---- functions of the user ----


@CATALOG.query(f"SELECT family_id, count(*) AS n FROM (SELECT family_id, unnest(range(1, hmm_length - {WINDOW} + 2)) AS w FROM fragment_index WHERE family_id % 7 = 0 OR hmm_length >= {WINDOW}) GROUP BY 1")
def udf_window_rows(spark: SparkSession, d: str) -> DataFrame:
    """D3: a table function of the user: one row of a profile to a row per window (generated on the JVM side)."""
    t = table(spark, d, "fragment_index").where(F.col("hmm_length") >= WINDOW)
    t = t.select("family_id", F.explode(F.sequence(F.lit(1), F.col("hmm_length") - WINDOW + 1)).alias("w"))
    return t.groupBy("family_id").agg(F.count(F.lit(1)).alias("n"))


@CATALOG.query(f"SELECT global_row_index, least(ms, ss) AS s, greatest(me, se) AS e FROM {PIECES}")
def udf_table_function(spark: SparkSession, d: str) -> DataFrame:
    """D3: segment texts taken apart by a Python table function with Arrow batches."""
    import pyarrow as pa

    ship(spark)

    def parts(batches):
        import re

        piece = re.compile(r"(\d+)\s*-\s*(\d+)\s*->\s*(\d+)\s*-\s*(\d+)")
        for b in batches:
            out = [(k, min(int(m[1]), int(m[3])), max(int(m[2]), int(m[4]))) for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for part in (text or "").split(";") if (m := piece.search(part))]
            cols = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], ["global_row_index", "s", "e"])

    return paths(spark, d, "global_row_index", "sub_segments_details").mapInArrow(parts, "global_row_index bigint, s int, e int")


@CATALOG.query(f"SELECT global_row_index, ms, me, ss, se FROM {PIECES} WHERE score > 2")
def udf_lateral(spark: SparkSession, d: str) -> DataFrame:
    """D3: a registered table function used from SQL, beside each row of a view."""
    from strandloom.functions.udtf import register

    register(spark)
    paths(spark, d, "global_row_index", "score", "sub_segments_details").where("score > 2").createOrReplaceTempView("scored_paths")
    return spark.sql("SELECT p.global_row_index, s.ms, s.me, s.ss, s.se FROM scored_paths p, LATERAL segment_pieces(p.sub_segments_details) s")


@CATALOG.query("SELECT l_returnflag, round(exp(avg(ln(l_extendedprice))), 4) AS geometric_mean FROM lineitem GROUP BY 1")
def udf_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """An aggregate of the user (geometric mean) composed of built-in ones, so it combines on the map side."""
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.exp(F.avg(F.log("l_extendedprice"))), 4).alias("geometric_mean"))


# ---- streams ----


def _arriving_events(spark: SparkSession, d: str, stage: Stage) -> DataFrame:
    """The events as a folder of several files, read as a stream."""
    t = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    t.repartition(6, "event_id").write.parquet(f"{stage.root}/in")
    return watch.arriving(spark, f"{stage.root}/in", t.schema, files_per_batch=3)


@CATALOG.query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of files, hourly windows, updates written per batch, the last one of each key."""
    stage = Stage(spark, "stream")
    w = watch.windowed(_arriving_events(spark, d, stage), "ts", "1 hour", "3650 days", ["event_type"], "value")
    watch.run_available(w, lambda b: b, f"{stage.root}/out", f"{stage.root}/checkpoint", "update")
    t = watch.latest(spark, f"{stage.root}/out", ["window_start", "event_type"])
    return t.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@CATALOG.query("SELECT event_id, user_id, value FROM events WHERE value > 10")
def stream_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Arriving files filtered and stored; run twice, the second run finds nothing left to do."""
    stage = Stage(spark, "stream")
    s = _arriving_events(spark, d, stage)
    for _ in range(2):
        watch.run_available(s, lambda b: b.where("value > 10").select("event_id", "user_id", "value"), f"{stage.root}/out", f"{stage.root}/checkpoint")
    return spark.read.parquet(f"{stage.root}/out").drop("batch")
