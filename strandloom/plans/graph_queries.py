"""Graphs and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import graph as G
from strandloom.operators import paths as P
from strandloom.plans.aggregate_queries import _EDGES, edges, rounded
from strandloom.plans.catalog import Catalog
from strandloom.plans.common import PATHS, PIECES, WINDOW, background, pieces, points
from strandloom.session import Stage, small, table

CATALOG = Catalog()

_NODE = lambda n, s: f"{n} || '@' || ({s} // 8 * 8)"


@CATALOG.query(
    f"SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT {_NODE('main_hmm', 'ms')} AS a, {_NODE('sub_hmm', 'ss')} AS b FROM {PIECES} WHERE main_hmm IS NOT NULL AND sub_hmm IS NOT NULL) WHERE a != b"
)
def graph_binned_edges(spark: SparkSession, d: str) -> DataFrame:
    """Coarse nodes of segments and the edges between them, no loops."""
    t = pieces(spark, d).where("main_hmm IS NOT NULL AND sub_hmm IS NOT NULL")
    t = t.select(G.binned_node("main_hmm", "ms").alias("x"), G.binned_node("sub_hmm", "ss").alias("y")).where("x != y")
    return t.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


_REACH = (
    "WITH RECURSIVE both_ways AS (SELECT a AS x, b AS y FROM {e} UNION SELECT b, a FROM {e}), reach AS (SELECT x AS node, x AS other FROM both_ways UNION SELECT r.node, e.y FROM reach r JOIN both_ways e ON r.other = e.x) SELECT node, min(other) AS component FROM reach GROUP BY node"
)


@CATALOG.query(_REACH.format(e=_EDGES))
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    """Connected components of the families."""
    return G.components(edges(spark, d), "a", "b")


_PTS = f"(SELECT DISTINCT main_hmm AS k, ms AS x, me AS y FROM {PIECES} WHERE main_hmm IS NOT NULL)"


@CATALOG.query(
    f"WITH RECURSIVE p AS {_PTS}, e AS (SELECT a.k, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM p a JOIN p b ON a.k = b.k AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3), reach AS (SELECT k, x1 AS x, y1 AS y, x2, y2 FROM e UNION SELECT r.k, r.x, r.y, e.x2, e.y2 FROM reach r JOIN e ON r.k = e.k AND r.x2 = e.x1 AND r.y2 = e.y1) SELECT k AS main_hmm, x AS ms, y AS me, min(x2) AS lo, max(y2) AS hi FROM reach GROUP BY 1, 2, 3"
)
def graph_density_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Segments of a family within 3 positions chained to clusters, smallest start to largest end."""
    t = pieces(spark, d).where("main_hmm IS NOT NULL").select("main_hmm", "ms", "me")
    return G.density_clusters(t, "main_hmm", "ms", "me", 3)


@CATALOG.query(f"SELECT a, b, w FROM {_EDGES} WHERE w >= 2.0")
def graph_strong_edges(spark: SparkSession, d: str) -> DataFrame:
    """C4: weighted graph without loops, weak edges and what they leave isolated."""
    return G.drop_weak(edges(spark, d), "a", "b", "w", 2.0)


@CATALOG.query()
def graph_communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the best run, cut into connected parts and numbered by size."""
    e = Stage(spark, "graph").write(edges(spark, d), "edges")
    return G.split_and_rank(G.best_communities(e, "a", "b", "w"), e, "a", "b")


_COMP = _REACH.format(e=_EDGES).replace("WITH RECURSIVE", "WITH RECURSIVE", 1)


@CATALOG.query(
    f"WITH l AS ({_COMP}), e AS (SELECT x.component AS ca, y.component AS cb, w FROM {_EDGES} t JOIN l x ON t.a = x.node JOIN l y ON t.b = y.node), m AS (SELECT sum(w) AS m FROM e), g AS (SELECT c, sum(w) AS dd FROM (SELECT unnest([ca, cb]) AS c, w FROM e) GROUP BY 1), i AS (SELECT ca AS c, sum(w) FILTER (ca = cb) AS l FROM e GROUP BY 1) SELECT round(sum(coalesce(l, 0) / m - pow(dd / (2 * m), 2)), 6) AS modularity, count(*) AS n_communities FROM g LEFT JOIN i USING (c), m"
)
def graph_modularity(spark: SparkSession, d: str) -> DataFrame:
    """Modularity of the partition into components."""
    e = Stage(spark, "graph").write(edges(spark, d), "edges")
    labels = G.components(e, "a", "b").withColumnRenamed("component", "community")
    return rounded(G.modularity(e, labels, "a", "b", "w"))


@CATALOG.query()
def graph_resolutions(spark: SparkSession, d: str) -> DataFrame:
    """Statistics, modularity and sizes of the communities of three runs at each of ten resolutions, the best run marked."""
    e = Stage(spark, "graph").write(edges(spark, d), "edges")
    return G.resolution_runs(e, "a", "b", "w", (0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.1, 0.15, 0.2))


@CATALOG.query(
    f"WITH l AS ({_COMP}), n AS (SELECT component, count(*) AS n_nodes FROM l GROUP BY 1), e AS (SELECT x.component, count(*) AS n_edges, avg(w) AS avg_weight FROM {_EDGES} t JOIN l x ON t.a = x.node GROUP BY 1) SELECT n.component AS community, n_nodes, n_edges, round(avg_weight, 6) AS avg_weight, round(2 * n_edges / (n_nodes * (n_nodes - 1)), 6) AS density FROM n JOIN e USING (component)"
)
def graph_community_summary(spark: SparkSession, d: str) -> DataFrame:
    """Nodes, edges, density and mean weight of every community."""
    e = Stage(spark, "graph").write(edges(spark, d), "edges")
    labels = Stage(spark, "graph").write(G.components(e, "a", "b").withColumnRenamed("component", "community"), "labels")
    return rounded(G.community_summary(e, labels, "a", "b", "w"))


@CATALOG.query()
def graph_paths(spark: SparkSession, d: str) -> DataFrame:
    """Clean and unclean paths of every pair of families from its scored points."""
    scored = P.background_score(P.below_raw(points(spark, d), 2.0), small(background(spark, d), 200_000), WINDOW, 1.0)
    names = table(spark, d, "part").select((F.col("p_partkey") % 20).cast("int").alias("family")).distinct().withColumn("name", F.format_string("F%02d", "family"))
    return P.find_paths(scored, names, WINDOW, min_points=1)
