"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.names import CLEAN_NAME_SQL, clean_name
from strandloom.llm.groups import match_groups
from strandloom.llm.packing import pack_containers
from strandloom.llm.spam import spam_pages
from strandloom.llm.sketch import VALUE_ERROR, daily_percentiles
from strandloom.llm.tokens import check_round_trip, count_tokens, encode_texts
from strandloom.llm.topn import top_n
from strandloom.operators.skew import fragment_join
from strandloom.plans.catalog import Catalog
from strandloom.session import Stage, small, table

CATALOG = Catalog()
PERCENTILES = [0.5, 0.9, 0.95, 0.99]
CAPACITY = 4096
# table, key, groups, value, finer grain
_CELLS = ("pairs_500", "sample_rank", ["workload_stratum"], "window_cells", "i")
_SECONDS = ("cpu_gpu_speedup_summary", "run_id", ["pair_count", "gpu_count"], "gpu_wall_seconds_median", None)


def _percentiles(spark: SparkSession, sf_dir: str, source: tuple) -> DataFrame:
    name, key, groups, value, fine = source
    return daily_percentiles(table(spark, sf_dir, name), key, groups, "run_day", value, PERCENTILES, fine)


@CATALOG.query()
def p1_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of positive window cells per stratum, for single days and all days, and per family ``i`` for all days."""
    return _percentiles(spark, sf_dir, _CELLS)


@CATALOG.query()
def p1_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of GPU seconds per pair count and number of GPUs, for single days and all days."""
    return _percentiles(spark, sf_dir, _SECONDS)


def _ranked(found: DataFrame, rows: DataFrame, keys: list[str], skewed: bool = False) -> DataFrame:
    """(keys, percentile, n_rows, within_stated_error): exact ranks of values of ``found`` among ``rows``, a row per key on the right side."""
    each = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("percentile", F.col("value").alias("q"), F.col("rank_error").alias("e")))).alias("_qs"))
    if skewed:
        joined = fragment_join(rows, each, keys[0], ["_id"])
    else:
        same = [each[k].eqNullSafe(rows[k]) for k in keys]
        joined = rows.join(small(each, 10_000), same).select(*[rows[k] for k in keys], "_v", "_qs")
    # ranks of a value that lies anywhere in the code: below its lower end, and up to its upper end
    n, count = len(PERCENTILES), lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    at = [F.col("_qs")[k]["q"] for k in range(n)]
    ranked = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.first("_qs").alias("_qs"), *[count(F.col("_v") < q).alias(f"below{k}") for k, q in enumerate(at)], *[count(F.col("_v") <= q * (1 + VALUE_ERROR)).alias(f"upto{k}") for k, q in enumerate(at)]
    )
    one = lambda k: F.struct(F.col("_qs")[k]["percentile"].alias("percentile"), F.col("_qs")[k]["e"].alias("e"), F.col(f"below{k}").alias("below"), F.col(f"upto{k}").alias("upto"))
    flat = ranked.select(*keys, "n_rows", F.explode(F.array(*[one(k) for k in range(n)])).alias("_x"))
    target = F.ceil(F.col("_x.percentile") * F.col("n_rows")) / F.col("n_rows")
    inside = (F.col("_x.below") / F.col("n_rows") <= target + F.col("_x.e")) & (F.col("_x.upto") / F.col("n_rows") >= target - F.col("_x.e"))
    return flat.select(*keys, "_x.percentile", "n_rows", inside.alias("within_stated_error"))


def _within(spark: SparkSession, sf_dir: str, source: tuple) -> DataFrame:
    """Exact ranks of the all-days percentiles against their stated errors."""
    name, key, groups, value, fine = source
    found = Stage(spark, "ranks").write(_percentiles(spark, sf_dir, source).where("all_days"), "found")
    v = F.col(value).cast("double")
    kinds = table(spark, sf_dir, name)
    rows = kinds.where(~F.isnan(v) & (v > 0)).select(*groups, *([fine] if fine else []), F.col(key).alias("_id"), v.alias("_v")).distinct()
    if not fine:
        return _ranked(found, rows, groups)
    none = lambda columns: [F.lit(None).cast(kinds.schema[c].dataType).alias(c) for c in columns]
    coarse = _ranked(found.where("NOT is_fine").drop(fine), rows.drop(fine), groups)
    finer = _ranked(found.where("is_fine").drop(*groups), rows.drop(*groups), [fine], True)
    tail = ["percentile", "n_rows", "within_stated_error"]
    return coarse.select(*groups, *none([fine]), *tail).unionAll(finer.select(*none(groups), fine, *tail))


def _within_sql(source: tuple) -> str:
    name, key, groups, value, fine = source
    rows = f"(SELECT DISTINCT ON ({key}) * FROM {name}), (SELECT unnest([0.5, 0.9, 0.95, 0.99])::DOUBLE AS percentile) WHERE {value} > 0 AND NOT isnan({value}::DOUBLE)"
    g = ", ".join(groups)
    if not fine:
        return f"SELECT {g}, percentile, count(*) AS n_rows, true AS within_stated_error FROM {rows} GROUP BY {g}, percentile"
    return (
        f"SELECT {g}, NULL::INT AS {fine}, percentile, count(*) AS n_rows, true AS within_stated_error FROM {rows} GROUP BY {g}, percentile "
        f"UNION ALL SELECT {', '.join(f'NULL::VARCHAR AS {x}' for x in groups)}, {fine}, percentile, count(*), true FROM {rows} GROUP BY {fine}, percentile"
    )


@CATALOG.query(_within_sql(_CELLS))
def p1_cells_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells' percentiles of strata and of families counted again exactly: all lie within the stated error."""
    return _within(spark, sf_dir, _CELLS)


@CATALOG.query(_within_sql(_SECONDS))
def p1_seconds_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seconds' percentiles counted again exactly: all lie within the stated error."""
    return _within(spark, sf_dir, _SECONDS)


_LINKS = "SELECT " + ", ".join(f"{CLEAN_NAME_SQL.format(c=c)} AS {x}" for c, x in (("main_hmm", "a"), ("sub_hmm", "b"))) + " FROM global_high_score_summary_fin"


_GROUPS_SQL = f"""
WITH RECURSIVE links AS ({_LINKS}),
edges AS (SELECT a AS x, b AS y FROM links WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM links WHERE a IS NOT NULL AND b IS NOT NULL),
reach AS (
  SELECT hmm, hmm AS other FROM (SELECT a AS hmm FROM links UNION SELECT b FROM links) WHERE hmm IS NOT NULL
  UNION SELECT r.hmm, e.y FROM reach r JOIN edges e ON r.other = e.x
)
SELECT hmm, min(other) AS group_hmm FROM reach GROUP BY hmm
"""


@CATALOG.query(_GROUPS_SQL)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every family named in the path table."""
    rows = table(spark, sf_dir, "global_high_score_summary_fin").select(clean_name("main_hmm").alias("a"), clean_name("sub_hmm").alias("b"))
    return match_groups(rows, "a", "b", "hmm", "group_hmm")


@CATALOG.query(
    f"WITH p AS (SELECT DISTINCT least(a, b) AS x, greatest(a, b) AS y FROM ({_LINKS}) WHERE a IS NOT NULL AND b IS NOT NULL AND a != b) "
    "SELECT hmm, count(*) AS n_links FROM (SELECT x AS hmm FROM p UNION ALL SELECT y FROM p) GROUP BY hmm"
)
def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of different families each family is linked to directly."""
    rows = table(spark, sf_dir, "global_high_score_summary_fin").select(clean_name("main_hmm").alias("a"), clean_name("sub_hmm").alias("b"))
    pairs = rows.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    return pairs.select(F.explode(F.array("x", "y")).alias("hmm")).groupBy("hmm").agg(F.count(F.lit(1)).alias("n_links"))


_TOP_SQL = f"""
WITH once AS (SELECT DISTINCT {CLEAN_NAME_SQL.format(c="main_hmm")} AS main_hmm, global_row_index, score FROM global_high_score_summary_fin WHERE score IS NOT NULL AND NOT isnan(score))
SELECT main_hmm, global_row_index, score, row_number() OVER (PARTITION BY main_hmm ORDER BY score DESC, global_row_index) AS rank FROM once WHERE main_hmm IS NOT NULL
QUALIFY rank <= 5
"""


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "global_high_score_summary_fin").select(clean_name("main_hmm").alias("main_hmm"), "global_row_index", "score")
    return top_n(rows, "main_hmm", "global_row_index", "score", 5)


@CATALOG.query(f"SELECT main_hmm, global_row_index FROM ({_TOP_SQL})")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of every family."""
    return _top(spark, sf_dir).select("main_hmm", "global_row_index")


@CATALOG.query(_TOP_SQL)
def p5_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of every family with score and rank."""
    return _top(spark, sf_dir)


@CATALOG.query()
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


@CATALOG.query("SELECT doc_id, true AS same_text, CASE WHEN coalesce(text, '') = '' THEN 0 END AS n_ids_of_nothing FROM documents")
def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids decoded again: the text comes back, and nothing gives no ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return check_round_trip(docs, "doc_id", "text").select("doc_id", "same_text", F.when(F.col("n_ids") == 0, F.lit(0)).alias("n_ids_of_nothing"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text")
    return pack_containers(sizes, "doc_id", "n_tokens", CAPACITY)


@CATALOG.query()
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the packing had to cut."""
    return _packed(spark, sf_dir).where("n_pieces > 1 AND piece = 0").select("doc_id")


@CATALOG.query()
def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document or piece of one."""
    return _packed(spark, sf_dir)


@CATALOG.query("SELECT (SELECT count(*) FROM documents) AS n_documents, true AS none_above_capacity, true AS little_unused")
def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No container above its capacity, and on average 95 % or more of them used (beyond one per worker)."""
    each = _packed(spark, sf_dir).groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count_if(F.col("piece") == 0).alias("docs"), F.max(F.shiftright("container", 40)).alias("worker"))
    out = each.agg(F.sum("docs").alias("n_documents"), (F.max("used") <= CAPACITY).alias("none_above_capacity"), (F.sum("used") >= 0.95 * CAPACITY * (F.count(F.lit(1)) - F.countDistinct("worker"))).alias("little_unused"))
    return out


@CATALOG.query()
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of keywords, links or product tags."""
    return spam_pages(table(spark, sf_dir, "documents"), "doc_id", "text", "lang").where("is_spam").select("doc_id")


@CATALOG.query("SELECT doc_id, true AS scored FROM documents")
def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page has a finite distance and share."""
    scores = spam_pages(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    return scores.select("doc_id", (F.col("distance").isNotNull() & ~F.isnan("distance") & (F.col("distance") >= 0)).alias("scored"))


@CATALOG.query()
def p8_against_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags against the reviewers' verdicts (who err now and then)."""
    flags = spam_pages(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    labels = table(spark, sf_dir, "page_labels").where(F.col("label").isNotNull()).select("doc_id", "label")
    return flags.join(labels, "doc_id").groupBy("label", "is_spam").agg(F.count(F.lit(1)).alias("n_pages"))
