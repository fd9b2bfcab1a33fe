"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.names import CLEAN_NAME_SQL, clean_name
from strandloom.functions.text import residues_before, ungap
from strandloom.operators import joins as J
from strandloom.plans.catalog import Catalog
from strandloom.plans.common import CONTACTS, PATHS, PIECES, POINTS, SPEEDS, contacts, paths, pieces, points, speeds
from strandloom.session import ship, table

CATALOG = Catalog()


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of another method: the pieces of the contact rows, turned round on every other row."""
    from strandloom.functions.text import parse_pieces

    t = contacts(spark, d, "global_row_index", "main_hmm", "sub_hmm", "sub_segments_details").select("global_row_index", clean_name("main_hmm").alias("m"), clean_name("sub_hmm").alias("s"), F.explode(parse_pieces("sub_segments_details")).alias("p"))
    odd = F.col("global_row_index") % 2 == 1
    pick = lambda a, b: F.when(odd, F.col(a)).otherwise(F.col(b))
    return t.select(pick("s", "m").alias("main_hmm"), pick("m", "s").alias("sub_hmm"), pick("p.ss", "p.ms").alias("ms"), pick("p.se", "p.me").alias("me"), pick("p.ms", "p.ss").alias("ss"), pick("p.me", "p.se").alias("se")).distinct()


_G = r"'(\d+)\s*-\s*(\d+)\s*->\s*(\d+)\s*-\s*(\d+)'"
HITS = (
    "(SELECT DISTINCT CASE WHEN odd THEN s ELSE m END AS main_hmm, CASE WHEN odd THEN m ELSE s END AS sub_hmm, CASE WHEN odd THEN c ELSE a END AS ms, CASE WHEN odd THEN d ELSE b END AS me, CASE WHEN odd THEN a ELSE c END AS ss, CASE WHEN odd THEN b ELSE d END AS se FROM ("
    f"SELECT global_row_index % 2 = 1 AS odd, {CLEAN_NAME_SQL.format(c='main_hmm')} AS m, {CLEAN_NAME_SQL.format(c='sub_hmm')} AS s, "
    + ", ".join(f"regexp_extract(part, {_G}, {g})::INT AS {n}" for g, n in ((1, "a"), (2, "b"), (3, "c"), (4, "d")))
    + f" FROM (SELECT *, unnest(string_split(sub_segments_details, ';')) AS part FROM {CONTACTS}) WHERE regexp_matches(part, {_G})))"
)
_OV = lambda a, b, c, e: f"greatest(0, least({b}, {e}) - greatest({a}, {c}) + 1)"


@CATALOG.query(
    f"""WITH p AS {PIECES}, h AS {HITS}, found AS (
      SELECT global_row_index, p.ms, p.me, p.ss, p.se, h.ms AS a, h.me AS b, h.ss AS c, h.se AS e FROM p JOIN (SELECT main_hmm AS m, sub_hmm AS s, ms, me, ss, se FROM h) h ON p.main_hmm = m AND p.sub_hmm = s
      UNION ALL SELECT global_row_index, p.ms, p.me, p.ss, p.se, h.ss, h.se, h.ms, h.me FROM p JOIN h ON p.main_hmm = h.sub_hmm AND p.sub_hmm = h.main_hmm AND p.main_hmm != p.sub_hmm
    ), best AS (SELECT global_row_index, max(least({_OV('ms', 'me', 'a', 'b')} / (me - ms + 1), {_OV('ss', 'se', 'c', 'e')} / (se - ss + 1))) AS coverage FROM found GROUP BY 1)
    SELECT i.global_row_index, round(coalesce(coverage, 0.0), 6) AS coverage, coalesce(coverage, 0.0) < 0.5 AS is_novel FROM (SELECT DISTINCT global_row_index FROM p) i LEFT JOIN best USING (global_row_index)"""
)
def join_pair_hits(spark: SparkSession, d: str) -> DataFrame:
    """Paths against hits of the same unordered pair; coverage and novelty."""
    return J.pair_hit_coverage(pieces(spark, d), hits(spark, d), "global_row_index", ("main_hmm", "sub_hmm"), 0.5).withColumn("coverage", F.round("coverage", 6))


@CATALOG.query(
    f"SELECT a.global_row_index, b.global_row_index AS other, greatest(0, least(a.seed_global_end, b.seed_global_end) - greatest(a.seed_global_start, b.seed_global_start) + 1) AS overlap_len FROM {CONTACTS} a JOIN {CONTACTS} b ON split_part(trim(a.accession), '.', 1) = split_part(trim(b.accession), '.', 1) WHERE a.status = 'OK' AND b.status = 'OK'"
)
def join_accession_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the same accession (version dropped) with the overlap of their stretches."""
    t = contacts(spark, d, "global_row_index", "status", "accession", "seed_global_start", "seed_global_end").where("status = 'OK'")
    from strandloom.functions.text import base_accession

    a = t.select("global_row_index", base_accession("accession").alias("acc"), F.col("seed_global_start").alias("s1"), F.col("seed_global_end").alias("e1"))
    b = a.select(F.col("global_row_index").alias("other"), "acc", F.col("s1").alias("s2"), F.col("e1").alias("e2"))
    return J.overlap_on_key(a, b, "acc", ("s1", "e1", "s2", "e2")).select("global_row_index", "other", "overlap_len")


@CATALOG.query(
    f"SELECT global_row_index, pfam_side, ts + greatest(target_hmm_start + 2, target_hmm_start) - target_hmm_start AS s, least(ts + least(target_hmm_end + 5, target_hmm_end) - target_hmm_start, target_seq_end) AS e FROM (SELECT *, target_seq_start AS ts FROM {CONTACTS}) WHERE target_hmm_end >= target_hmm_start + 2 AND target_seq_start IS NOT NULL AND target_seq_end IS NOT NULL"
)
def join_project_interval(spark: SparkSession, d: str) -> DataFrame:
    """A stretch carried from profile numbering to sequence numbering, clipped."""
    t = contacts(spark, d, "global_row_index", "pfam_side", "target_hmm_start", "target_hmm_end", "target_seq_start", "target_seq_end")
    p = J.project_interval(F.col("target_hmm_start") + 2, F.col("target_hmm_end") + 5, F.col("target_hmm_start"), F.col("target_hmm_end"), F.col("target_seq_start"), F.col("target_seq_end"))
    return t.withColumn("p", p).where("p IS NOT NULL").select("global_row_index", "pfam_side", "p.s", "p.e")


@CATALOG.query(
    f"SELECT c.pfam_id, count(*) AS n_inside, count(DISTINCT c.pos) AS n_positions FROM (SELECT pfam_id, target_hmm_start AS pos FROM {CONTACTS}) c JOIN {PIECES} p ON c.pfam_id = p.main_hmm AND c.pos BETWEEN p.ms AND p.me GROUP BY 1"
)
def join_points_in_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Annotated positions inside the segments of their family."""
    p = contacts(spark, d, "pfam_id", F.col("target_hmm_start").alias("pos")).where("pfam_id IS NOT NULL")
    i = pieces(spark, d).select(F.col("main_hmm").alias("pfam_id"), "ms", "me")
    return J.points_in_intervals(p, i, "pfam_id", "pos", "ms", "me").groupBy("pfam_id").agg(F.count(F.lit(1)).alias("n_inside"), F.countDistinct("pos").alias("n_positions"))


_MAP = f"(SELECT DISTINCT pfam_id, target_hmm_start AS state, target_msa_start AS col FROM {CONTACTS} WHERE pfam_id IS NOT NULL AND target_hmm_start IS NOT NULL AND target_msa_start IS NOT NULL)"


def _mapping(spark: SparkSession, d: str) -> DataFrame:
    t = contacts(spark, d, "pfam_id", F.col("target_hmm_start").alias("state"), F.col("target_msa_start").alias("col"))
    return t.dropna().distinct()


@CATALOG.query(
    f"SELECT r.global_row_index, r.pfam_side, min(m.col) AS t_start, max(m.col) AS t_end FROM {CONTACTS} r LEFT JOIN {_MAP} m ON r.pfam_id = m.pfam_id AND m.state BETWEEN r.target_hmm_start AND r.target_hmm_end WHERE r.pfam_side = 'main' GROUP BY 1, 2"
)
def join_range_inside(spark: SparkSession, d: str) -> DataFrame:
    """Alignment columns of a range of states, by the mapped states inside."""
    r = contacts(spark, d, "global_row_index", "pfam_side", "pfam_id", "target_hmm_start", "target_hmm_end").where("pfam_side = 'main'")
    return J.map_range(r, _mapping(spark, d), "pfam_id", "global_row_index", "target_hmm_start", "target_hmm_end", "state", "col").withColumn("pfam_side", F.lit("main"))


@CATALOG.query(
    f"WITH m AS (SELECT pfam_id, state, min(col) AS col FROM {_MAP} GROUP BY 1, 2) SELECT r.global_row_index, CASE WHEN b.col IS NOT NULL THEN a.col END AS t_start, CASE WHEN a.col IS NOT NULL THEN b.col END AS t_end FROM {CONTACTS} r LEFT JOIN m a ON r.pfam_id = a.pfam_id AND r.target_hmm_start = a.state LEFT JOIN m b ON r.pfam_id = b.pfam_id AND r.target_hmm_end = b.state WHERE r.pfam_side = 'sub'"
)
def join_range_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """The same by looking up both endpoints, null unless both are mapped."""
    r = contacts(spark, d, "global_row_index", "pfam_side", "pfam_id", "target_hmm_start", "target_hmm_end").where("pfam_side = 'sub'")
    return J.map_range(r, _mapping(spark, d), "pfam_id", "global_row_index", "target_hmm_start", "target_hmm_end", "state", "col", "endpoints")


@CATALOG.query(f"SELECT global_row_index, pfam_side, length(translate(target_aligned_frag, '-.', '')) AS n_residues, length(translate(substr(target_aligned_frag, 1, 5), '-.', '')) AS n_first, upper(translate(target_aligned_frag, '-.', '')) AS residues FROM {CONTACTS}")
def join_alignment_to_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Columns of an aligned fragment to ungapped coordinates."""
    t = contacts(spark, d, "global_row_index", "pfam_side", "target_aligned_frag")
    f = F.col("target_aligned_frag")
    return t.select("global_row_index", "pfam_side", F.length(ungap(f)).alias("n_residues"), residues_before(f, F.lit(5)).alias("n_first"), ungap(f).alias("residues"))


_BEST = "abs(target_seq_len - (abs(target_hmm_end - target_hmm_start) + 1)), gap_count_in_msa_window, abs(fragment_size_mapped / target_seq_len - 1), global_row_index, pfam_side"


@CATALOG.query(
    f"SELECT pfam_id, global_row_index, pfam_side FROM {CONTACTS} WHERE pfam_id IS NOT NULL AND status = 'OK' AND target_hmm_start IS NOT NULL AND target_hmm_end IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pfam_id ORDER BY {_BEST}) = 1"
)
def join_best_candidate(spark: SparkSession, d: str) -> DataFrame:
    """Best candidate of every family by length difference, gaps, ratio."""
    t = contacts(spark, d, "pfam_id", "global_row_index", "pfam_side", "status", "target_seq_len", "target_hmm_start", "target_hmm_end", "gap_count_in_msa_window", "fragment_size_mapped")
    t = t.where("pfam_id IS NOT NULL AND status = 'OK' AND target_hmm_start IS NOT NULL AND target_hmm_end IS NOT NULL")
    order = [F.expr(e) for e in ("abs(target_seq_len - (abs(target_hmm_end - target_hmm_start) + 1))", "gap_count_in_msa_window", "abs(fragment_size_mapped / target_seq_len - 1)", "global_row_index", "pfam_side")]
    return J.best_candidate(t, "pfam_id", [o.asc_nulls_last() for o in order]).select("pfam_id", "global_row_index", "pfam_side")


@CATALOG.query("SELECT l_orderkey, l_linenumber, l_quantity, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 30 AND o_orderstatus = 'F'")
def join_inner(spark: SparkSession, d: str) -> DataFrame:
    """Inner merge on keys."""
    l = table(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_quantity")
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    return l.join(o, "k").select(F.col("k").alias("l_orderkey"), "l_linenumber", "l_quantity", "o_orderpriority")


@CATALOG.query(f"SELECT p.global_row_index, c.pfam_side, c.rfco FROM {PATHS} p LEFT JOIN {CONTACTS} c ON p.global_row_index = c.global_row_index")
def join_left(spark: SparkSession, d: str) -> DataFrame:
    """Left merge of measures onto all paths."""
    return paths(spark, d, "global_row_index").join(contacts(spark, d, "global_row_index", "pfam_side", "rfco"), "global_row_index", "left")


@CATALOG.query(
    f"""WITH a AS (SELECT main_hmm AS hmm, count(*) AS n FROM {PATHS} WHERE main_hmm IS NOT NULL GROUP BY 1), b AS (SELECT sub_hmm AS hmm, count(*) AS n FROM {PATHS} WHERE sub_hmm IS NOT NULL GROUP BY 1)
    SELECT coalesce(a.hmm, b.hmm) AS hmm, coalesce(a.n, 0) AS n_main, coalesce(b.n, 0) AS n_sub, CASE WHEN coalesce(b.n, 0) != 0 THEN round(coalesce(a.n, 0) / b.n, 6) END AS ratio FROM a FULL JOIN b ON a.hmm = b.hmm"""
)
def join_full_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Full outer merge of two frequency tables with a guarded ratio."""
    t = paths(spark, d, "main_hmm", "sub_hmm")
    n = lambda c, out: t.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("hmm")).agg(F.count(F.lit(1)).alias(out))
    j = n("main_hmm", "n_main").join(n("sub_hmm", "n_sub"), "hmm", "full").fillna(0, ["n_main", "n_sub"])
    return j.withColumn("ratio", F.when(F.col("n_sub") != 0, F.round(F.col("n_main") / F.col("n_sub"), 6)))


@CATALOG.query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderdate = l.l_shipdate - INTERVAL 10 DAY)")
def join_semi_composite(spark: SparkSession, d: str) -> DataFrame:
    """Semi-join on a composite key."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderdate") + F.expr("INTERVAL 10 DAYS")).alias("l_shipdate"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(o, ["l_orderkey", "l_shipdate"], "left_semi").select("l_orderkey", "l_linenumber")


@CATALOG.query(f"SELECT global_row_index FROM {PATHS} WHERE global_row_index NOT IN (SELECT global_row_index FROM contact_order_results WHERE status = 'OK')")
def join_anti_missing(spark: SparkSession, d: str) -> DataFrame:
    """Paths without a finished contact-order row (what a resumed run still has to do)."""
    done = table(spark, d, "contact_order_results").where("status = 'OK'").select("global_row_index")
    return paths(spark, d, "global_row_index").join(done, "global_row_index", "left_anti")


@CATALOG.query(
    f"SELECT count(*) AS n_rows, count(DISTINCT pfam_id) AS n_families FROM {CONTACTS} WHERE global_row_index IN (SELECT global_row_index FROM {PATHS} WHERE score > 2.5 AND main_hmm IN (SELECT pfam FROM fragment_index WHERE hmm_length > 100))"
)
def join_key_filter_chain(spark: SparkSession, d: str) -> DataFrame:
    """Keys filtered through a chain of tables by semi-joins, with a strict threshold."""
    long = table(spark, d, "fragment_index").where("hmm_length > 100").select(F.col("pfam").alias("main_hmm"))
    good = paths(spark, d, "global_row_index", "main_hmm", "score").where("score > 2.5").join(long, "main_hmm", "left_semi").select("global_row_index")
    return contacts(spark, d, "global_row_index", "pfam_id").join(good, "global_row_index", "left_semi").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("pfam_id").alias("n_families"))


@CATALOG.query(f"SELECT f.pfam, count(*) AS n_paths FROM fragment_index f JOIN (SELECT DISTINCT global_row_index, unnest([main_hmm, sub_hmm]) AS name FROM {PATHS}) p ON f.pfam = p.name GROUP BY 1")
def join_inverted_index(spark: SparkSession, d: str) -> DataFrame:
    """Paths found under either family."""
    t = J.by_either_name(paths(spark, d, "global_row_index", "main_hmm", "sub_hmm"), "global_row_index", "main_hmm", "sub_hmm", "pfam")
    return t.join(table(spark, d, "fragment_index").select("pfam"), "pfam").groupBy("pfam").agg(F.count(F.lit(1)).alias("n_paths"))


@CATALOG.query(f'WITH p AS {POINTS} SELECT i, j, "row", col FROM p WHERE EXISTS (SELECT 1 FROM p q WHERE q.i = p.i AND q.j = p.j AND q."row" = p."row" AND abs(q.col - p.col) = 1)')
def join_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """Points with another one directly beside them, by a window instead of a self-join."""
    from strandloom.operators.paths import mark_clean

    return mark_clean(points(spark, d)).where("has_neighbour").select("i", "j", "row", "col")


_XYZ = "(SELECT label AS chain, vec_id AS idx, embedding[1]::DOUBLE * 40 AS x, embedding[2]::DOUBLE * 40 AS y, embedding[3]::DOUBLE * 40 AS z FROM embeddings)"


@CATALOG.query(
    f"SELECT a.chain, a.idx AS i, b.idx AS j, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) AS distance FROM {_XYZ} a JOIN {_XYZ} b ON a.chain = b.chain AND b.idx - a.idx > 2 WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 1.0"
)
def join_close_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Residues of a chain within a cutoff, by cubes."""
    e = F.col("embedding")
    t = table(spark, d, "embeddings").select(F.col("label").alias("chain"), F.col("vec_id").alias("idx"), *[(e[n].cast("double") * 40).alias(c) for n, c in enumerate("xyz")])
    return J.close_pairs(t, "chain", "idx", ("x", "y", "z"), 2, 1.0).withColumn("distance", F.round("distance", 6))


@CATALOG.query(
    f"SELECT global_row_index, pfam_side, CASE WHEN target_frag IS NULL OR target_aligned_frag IS NULL THEN 'missing' WHEN upper(translate(target_aligned_frag, '-.', '')) = target_frag THEN 'whole' WHEN contains(upper(translate(target_aligned_frag, '-.', '')), target_frag) THEN 'inside' ELSE 'none' END AS state FROM {CONTACTS}"
)
def join_containment(spark: SparkSession, d: str) -> DataFrame:
    """Is the fragment the ungapped slice of its alignment, exactly or inside."""
    t = contacts(spark, d, "global_row_index", "pfam_side", "target_frag", "target_aligned_frag")
    u, f = ungap("target_aligned_frag"), F.col("target_frag")
    return t.select("global_row_index", "pfam_side", F.when(f.isNull() | u.isNull(), "missing").when(u == f, "whole").when(F.contains(u, f), "inside").otherwise("none").alias("state"))


@CATALOG.query()
def join_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Global alignment of a fragment with its aligned form; number of aligned and identical residues."""
    ship(spark)

    @F.pandas_udf("struct<n_aligned int, n_same int>")
    def align(a, b):
        import pandas as pd

        from strandloom.functions.alignment import global_alignment

        out = []
        for x, y in zip(a, b):
            pairs = global_alignment(x or "", y or "")
            out.append((len(pairs), sum((x or "")[i] == (y or "")[j] for i, j in pairs)))
        return pd.DataFrame(out, columns=["n_aligned", "n_same"])

    t = contacts(spark, d, "global_row_index", "pfam_side", "target_frag", "target_aligned_frag").where("target_frag IS NOT NULL AND target_aligned_frag IS NOT NULL")
    return t.withColumn("r", align("target_frag", ungap("target_aligned_frag"))).select("global_row_index", "pfam_side", "r.n_aligned", "r.n_same")


@CATALOG.query()
def join_superposition(spark: SparkSession, d: str) -> DataFrame:
    """RMSD of consecutive coordinate sets of a label after superposition (coordinates are input)."""
    from pyspark.sql import Window

    ship(spark)

    @F.pandas_udf("double")
    def rmsd(a, b):
        import numpy as np
        import pandas as pd

        from strandloom.functions.alignment import superposed_rmsd

        shape = lambda v: np.asarray(v, dtype=float)[: len(v) // 3 * 3].reshape(-1, 3)
        return pd.Series([float("nan") if x is None or y is None else superposed_rmsd(shape(x), shape(y)) for x, y in zip(a, b)])

    t = table(spark, d, "embeddings").withColumn("before", F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("before IS NOT NULL")
    return t.select("vec_id", "label", rmsd("before", "embedding").alias("rmsd"))


@CATALOG.query(
    f"""WITH cpu AS (SELECT pair_count, median(cpu_wall_seconds_median) AS cpu_seconds FROM {SPEEDS} WHERE cpu_process_count = 1 GROUP BY 1), gpu AS (SELECT pair_count, gpu_count, median(gpu_wall_seconds_median) AS gpu_seconds FROM {SPEEDS} GROUP BY 1, 2)
    SELECT pair_count, gpu_count, round(cpu_seconds / gpu_seconds, 6) AS speedup FROM cpu JOIN gpu USING (pair_count)"""
)
def join_speedups(spark: SparkSession, d: str) -> DataFrame:
    """Times of both kinds paired on the size of the work; speed-up."""
    t = speeds(spark, d, "pair_count", "cpu_process_count", "gpu_count", "cpu_wall_seconds_median", "gpu_wall_seconds_median")
    cpu = t.where("cpu_process_count = 1").groupBy("pair_count").agg(F.median("cpu_wall_seconds_median").alias("c"))
    gpu = t.groupBy("pair_count", "gpu_count").agg(F.median("gpu_wall_seconds_median").alias("g"))
    return cpu.join(gpu, "pair_count").select("pair_count", "gpu_count", F.round(F.col("c") / F.col("g"), 6).alias("speedup"))
