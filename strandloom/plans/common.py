"""Tables as the queries use them, beside the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.names import CLEAN_NAME_SQL, clean_name
from strandloom.functions.numeric import clean_number
from strandloom.session import table

WINDOW = 6  # match states of a window


def _once(t: DataFrame, keys: list[str], columns: tuple) -> DataFrame:
    """Deliveries of a row (equal but for ``loaded_at``) once.

    With the columns asked for, that is distinct over the keys and these
    columns: only they are read and exchanged, and filters on them pass
    through to the scan.
    """
    if not columns:
        return t.dropDuplicates(keys)
    named = [F.col(k).alias(f"_key{n}") for n, k in enumerate(keys)]
    return t.select(*named, *columns).distinct().drop(*[f"_key{n}" for n in range(len(keys))])


def paths(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Final paths: deliveries once, names in one spelling, NaN scores null."""
    t = table(spark, d, "global_high_score_summary_fin").drop("loaded_at")
    t = t.withColumns({"main_hmm": clean_name("main_hmm"), "sub_hmm": clean_name("sub_hmm"), "score": clean_number("score")})
    return _once(t, ["global_row_index"], columns)


PATHS = (
    f"(SELECT DISTINCT ON (global_row_index) * EXCLUDE (loaded_at) REPLACE ({CLEAN_NAME_SQL.format(c='main_hmm')} AS main_hmm, "
    f"{CLEAN_NAME_SQL.format(c='sub_hmm')} AS sub_hmm, CASE WHEN NOT isnan(score) THEN score END AS score) FROM global_high_score_summary_fin)"
)


def contacts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Contact-order rows: deliveries once, names in one spelling, NaN measures null."""
    t = table(spark, d, "contact_order_results").drop("loaded_at")
    t = t.withColumns({"pfam_id": clean_name("pfam_id"), **{c: clean_number(c) for c in ("rfco", "mean_sequence_separation", "lr_contact_fraction")}})
    return _once(t, ["global_row_index", "pfam_side"], columns)


_nn = lambda c: f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}"
CONTACTS = (
    f"(SELECT DISTINCT ON (global_row_index, pfam_side) * EXCLUDE (loaded_at) REPLACE ({CLEAN_NAME_SQL.format(c='pfam_id')} AS pfam_id, "
    f"{_nn('rfco')}, {_nn('mean_sequence_separation')}, {_nn('lr_contact_fraction')}) FROM contact_order_results)"
)


def speeds(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Benchmark comparisons: deliveries once; times that are no positive numbers null."""
    t = table(spark, d, "cpu_gpu_speedup_summary").drop("loaded_at")
    pos = lambda c: F.when(clean_number(c) > 0, F.col(c))
    t = t.withColumns({c: pos(c) for c in ("cpu_wall_seconds_median", "gpu_wall_seconds_median")})
    return _once(t, ["run_id"], columns)


_pos = lambda c: f"CASE WHEN NOT isnan({c}) AND {c} > 0 THEN {c} END AS {c}"
SPEEDS = f"(SELECT DISTINCT ON (run_id) * EXCLUDE (loaded_at) REPLACE ({_pos('cpu_wall_seconds_median')}, {_pos('gpu_wall_seconds_median')}) FROM cpu_gpu_speedup_summary)"


def work(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The work list of pairs, deliveries once."""
    return _once(table(spark, d, "pairs_500").drop("loaded_at"), ["sample_rank"], columns)


WORK = "(SELECT DISTINCT ON (sample_rank) * EXCLUDE (loaded_at) FROM pairs_500)"


def points(spark: SparkSession, d: str) -> DataFrame:
    """Sparse divergence points (i, j, row, col, raw) made from the order lines."""
    l = table(spark, d, "lineitem")
    i, j = F.col("l_suppkey") % 10, F.col("l_linenumber") + 10
    row, c = F.col("l_partkey") % 61 + 1, (F.col("l_partkey") * 3 + F.col("l_orderkey")) % 61 + 1
    raw = F.col("l_discount") * 30 + F.col("l_tax") * 5
    return l.select(i.cast("int").alias("i"), j.cast("int").alias("j"), row.cast("int").alias("row"), c.cast("int").alias("col"), raw.alias("raw")).groupBy("i", "j", "row", "col").agg(F.min("raw").alias("raw"))


POINTS = (
    '(SELECT (l_suppkey % 10)::INT AS i, (l_linenumber + 10)::INT AS j, (l_partkey % 61 + 1)::INT AS "row", ((l_partkey * 3 + l_orderkey) % 61 + 1)::INT AS col, '
    "min(l_discount * 30 + l_tax * 5) AS raw FROM lineitem GROUP BY ALL)"
)


def background(spark: SparkSession, d: str) -> DataFrame:
    """(family, pos, bg): a background value of every position of a family, made from the parts."""
    p = table(spark, d, "part")
    return p.groupBy((F.col("p_partkey") % 20).cast("int").alias("family"), (F.expr("p_partkey div 20") % 61 + 1).cast("int").alias("pos")).agg(F.max(F.col("p_retailprice") / 1000).cast("float").alias("bg"))


BACKGROUND = "(SELECT (p_partkey % 20)::INT AS family, ((p_partkey // 20) % 61 + 1)::INT AS pos, max(p_retailprice / 1000)::FLOAT AS bg FROM part GROUP BY ALL)"


def pieces(spark: SparkSession, d: str) -> DataFrame:
    """One row per piece of a path: row index, names, ms, me, ss, se."""
    from strandloom.functions.text import parse_pieces

    t = paths(spark, d, "global_row_index", "main_hmm", "sub_hmm", "score", "avg_similarity", "sub_segments_details")
    return t.withColumn("_p", F.explode(parse_pieces("sub_segments_details"))).select("global_row_index", "main_hmm", "sub_hmm", "score", "avg_similarity", "_p.*")


_P = r"'(\d+)\s*-\s*(\d+)\s*->\s*(\d+)\s*-\s*(\d+)'"
PIECES = (
    "(SELECT global_row_index, main_hmm, sub_hmm, score, avg_similarity, "
    + ", ".join(f"regexp_extract(part, {_P}, {g})::INT AS {n}" for g, n in ((1, "ms"), (2, "me"), (3, "ss"), (4, "se")))
    + f" FROM (SELECT *, unnest(string_split(sub_segments_details, ';')) AS part FROM {PATHS}) WHERE regexp_matches(part, {_P}))"
)
