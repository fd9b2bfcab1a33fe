"""Graphs of fragments: coarse nodes, components, density clusters, communities, their statistics.

Iterations write their state to the shared folder every round, so no
lineage grows and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.text import hash_number
from strandloom.operators.skew import fair_share, salted_join
from strandloom.session import Stage


def binned_node(name: str | Column, start: str | Column, width: int = 8) -> Column:
    """Coarse node of a segment: family and the start of its bin."""
    s = F.col(start) if isinstance(start, str) else start
    return F.concat_ws("@", name, (F.floor(s / width) * width).cast("int"))


def components(edges: DataFrame, a: str, b: str, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node of the connected component (large-star and small-star steps).

    Large-star links a node's larger neighbours to its smallest neighbour,
    small-star its smaller ones; the edges end up as stars around the
    smallest nodes. Minima combine on the map side, and joins on a node
    shard the heavy ones. ``nodes`` (column ``node``) adds isolated nodes.
    """
    spark = edges.sparkSession
    stage = Stage(spark, "components")
    e = stage.write(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u != v"), "given")
    e = stage.write(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "e0")
    n = 0
    last = None

    def centred(rows: DataFrame, least: Column, name: str) -> DataFrame:
        """``rows`` with the smallest neighbour ``m`` of u."""
        m = stage.write(rows.groupBy("u").agg(least.alias("m"), F.count(F.lit(1)).alias("load")), name)
        most = m.agg(F.max("load"), F.sum("load")).first()
        return salted_join(rows, m, "u", "load", "v", fair_share(spark, most[1] or 0), heaviest=most[0] or 0)

    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = centred(both, F.least(F.min("v"), F.first("u")), f"m{n}").where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage.write(large, f"large{n}")
        # small-star: every larger end u links its smaller neighbours and itself to the smallest of them
        joined = centred(large, F.min("v"), f"s{n}")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(joined.select("u", F.col("m").alias("v"))).distinct()
        n += 1
        e = stage.write(small, f"e{n}")
        for done in ("e", "m", "large", "s"):
            stage.drop(f"{done}{n - 1}")
        # order-free fingerprint of the edge set: both sums and the count
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select("v", "v")).distinct()
    if nodes is not None:
        found = nodes.select("node").distinct().join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return found


def density_clusters(points: DataFrame, key: str, x: str, y: str, eps: int = 3) -> DataFrame:
    """(key, x, y, lo, hi): clusters of distinct integer points within Chebyshev distance ``eps`` of each other, chained.

    With two points to a cluster every point with a neighbour is a core
    point, so clusters are components of the eps-graph; ``lo`` is the
    smallest x, ``hi`` the largest y of the cluster. Single points keep
    their own. Distinct points of a square of edge eps are at most eps**2,
    which bounds the pairs.
    """
    p = points.select(key, x, y).dropna().distinct().withColumns({"cx": F.floor(F.col(x) / eps), "cy": F.floor(F.col(y) / eps)})
    near = p.select(key, F.col(x).alias("x2"), F.col(y).alias("y2"), F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)).alias("cx"), "cy")
    near = near.select(key, "x2", "y2", "cx", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)).alias("cy"))
    e = p.join(near, [key, "cx", "cy"]).where((F.abs(F.col(x) - F.col("x2")) <= eps) & (F.abs(F.col(y) - F.col("y2")) <= eps) & (F.struct(F.col(x), F.col(y)) < F.struct("x2", "y2")))
    node = lambda a, b: F.concat_ws("|", key, F.col(a).cast("string"), F.col(b).cast("string"))
    labels = components(e.select(node(x, y).alias("a"), node("x2", "y2").alias("b")), "a", "b")
    t = p.select(key, x, y, node(x, y).alias("node")).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    c = t.groupBy("component").agg(F.min(x).alias("lo"), F.max(y).alias("hi"))
    return t.join(c, "component").select(key, x, y, "lo", "hi")


def drop_weak(edges: DataFrame, a: str, b: str, weight: str, least: float) -> DataFrame:
    """Heaviest undirected edges of at least ``least``; loops and what they leave isolated are gone."""
    from strandloom.operators.aggregates import heaviest_edges

    return heaviest_edges(edges, a, b, weight).where(F.col(weight) >= least)


def modularity(edges: DataFrame, labels: DataFrame, a: str, b: str, weight: str, resolution: float = 1.0) -> DataFrame:
    """One row: sum over communities of L_c / m - resolution (d_c / 2m)^2 (weighted)."""
    la, lb = (labels.select(F.col("node").alias(n), F.col("community").alias(f"_{n}")) for n in (a, b))
    e = edges.select(a, b, weight).join(la, a).join(lb, b)
    inside = e.groupBy(F.col(f"_{a}").alias("c")).agg(F.coalesce(F.sum(F.when(F.col(f"_{a}") == F.col(f"_{b}"), F.col(weight))), F.lit(0.0)).alias("l"))
    deg = e.select(F.explode(F.array(f"_{a}", f"_{b}")).alias("c"), weight).groupBy("c").agg(F.sum(weight).alias("d"))
    total = F.broadcast(edges.agg(F.sum(weight).alias("m")))  # one row
    t = deg.join(inside, "c", "left").fillna(0.0, ["l"]).join(total)
    return t.agg(F.sum(F.col("l") / F.col("m") - resolution * F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("modularity"), F.count(F.lit(1)).alias("n_communities"))


def _settled(edges: DataFrame, a: str, b: str, weight: str, gammas: tuple[float, ...], seeds: tuple[int, ...], stage: Stage) -> tuple[DataFrame, DataFrame]:
    """Edges (node, other, w), and (node, gamma, seed, community) after local moves on the constant Potts objective.

    The objective is sum(w inside) - gamma n_c^2 / 2. In a round another
    random half of the nodes (so that neighbours don't swap for ever) moves
    to the neighbouring community of largest gain w(v, C) - gamma |C
    without v|, or leaves to be alone where all gains are negative. All
    runs go on at once, by grouping and joins; a node's edges are combined
    per community before they meet its options. Ends when no node of any
    run gains by a move.
    """
    run = ["gamma", "seed"]
    runs = edges.sparkSession.createDataFrame([(float(g), int(s)) for g in gammas for s in seeds], "gamma double, seed int")
    e = stage.write(edges.select(F.col(a).cast("string").alias("node"), F.col(b).cast("string").alias("other"), F.col(weight).cast("double").alias("w")), "edges")
    both = e.unionAll(e.select("other", "node", "w"))
    labels = stage.write(both.select("node").distinct().crossJoin(F.broadcast(runs)).withColumn("community", F.col("node")), "m0")  # as many rows as parameters
    r, moving = 0, True
    while moving:
        r += 1
        sizes = labels.groupBy(*run, "community").agg(F.count(F.lit(1)).alias("size"))
        own = labels.join(sizes, [*run, "community"]).withColumnsRenamed({"community": "_own", "size": "_size"})
        linked = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy(*run, "node", "community").agg(F.sum("w").alias("w"))
        options = linked.join(sizes, [*run, "community"]).join(own.drop("_size"), [*run, "node"])
        stays = F.col("community") == F.col("_own")
        gain = F.round(F.col("w") - F.col("gamma") * (F.col("size") - stays.cast("int")), 9)  # sums in another order are no gain
        best = options.groupBy(*run, "node").agg(F.max(F.struct(gain.alias("g"), stays.alias("own"), F.col("community").alias("c"))).alias("b"))
        # a node's own name may be the label of others by now
        target = F.when(F.col("b.g") > 0, F.col("b.c")).when(F.col("_size") > 1, F.concat_ws("#", "node", F.lit(r))).otherwise(F.col("_own"))
        turn = F.pmod(hash_number("seed", F.lit(r), "node"), F.lit(2)) == 0
        new = own.join(best, [*run, "node"]).select("node", *run, F.when(turn, target).otherwise(F.col("_own")).alias("community"), (target != F.col("_own")).alias("_gains"))
        new = stage.write(new, f"m{r}")
        stage.drop(f"m{r - 1}")
        moving = not new.where("_gains").isEmpty()
        labels = new.drop("_gains")
    return e, labels


def _run_quality(e: DataFrame, labels: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """Edges inside communities, and a row per run: modularity and quality of its partition at its resolution."""
    run = ["gamma", "seed"]
    ends = [labels.select(*run, F.col("node").alias(n), F.col("community").alias(f"_{n}")) for n in ("node", "other")]
    t = stage.write(e.join(ends[0], "node").join(ends[1], [*run, "other"]), "ends")
    inside = t.where("_node = _other")
    degree = t.select(*run, F.explode(F.array("_node", "_other")).alias("community"), "w").groupBy(*run, "community").agg(F.sum("w").alias("d"))
    size = labels.groupBy(*run, "community").agg(F.count(F.lit(1)).alias("n"))
    within = inside.groupBy(*run, F.col("_node").alias("community")).agg(F.sum("w").alias("l"))
    m = F.broadcast(e.agg(F.sum("w").alias("m")))  # one row
    parts = size.join(degree, [*run, "community"]).join(within, [*run, "community"], "left").fillna(0.0, ["l"]).join(m)
    quality = parts.groupBy(*run).agg(
        F.sum(F.col("l") / F.col("m") - F.col("gamma") * F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("modularity"),
        F.sum((2 * F.col("l") - F.col("gamma") * F.col("n") * F.col("n")) / (2 * F.col("m"))).alias("cpm_quality"),
        F.count(F.lit(1)).alias("n_communities"),
    )
    return inside, quality


def best_communities(edges: DataFrame, a: str, b: str, weight: str, gamma: float = 0.05, seeds: tuple[int, ...] = (42, 43, 44)) -> DataFrame:
    """(node, community) of the run of highest modularity over several seeds (of equals the first), each run until no move gains.

    Local moves of single nodes; communities aren't aggregated or refined
    in further levels.
    """
    stage = Stage(edges.sparkSession, "communities")
    e, labels = _settled(edges, a, b, weight, (gamma,), seeds, stage)
    top = _run_quality(e, labels, stage)[1].orderBy(F.desc("modularity"), "seed").select("seed").first()  # a row per seed
    return labels.where(F.col("seed") == (top["seed"] if top else seeds[0])).select("node", "community")


def resolution_runs(edges: DataFrame, a: str, b: str, weight: str, gammas: tuple[float, ...], seeds: tuple[int, ...] = (42, 43, 44)) -> DataFrame:
    """A row per resolution and seed: statistics of its partition, ``selected`` where modularity is the resolution's highest (of equals the smaller seed).

    Local moves until no node of any run gains by one. ``modularity`` and ``cpm_quality`` are those of the partition at
    its resolution, all sizes those after the cut into connected parts.
    """
    stage = Stage(edges.sparkSession, "resolutions")
    e, labels = _settled(edges, a, b, weight, gammas, seeds, stage)
    inside, quality = _run_quality(e, labels, stage)
    name = lambda n: F.concat_ws("|", "gamma", "seed", n)
    connected = components(inside.select(name("node").alias("a"), name("other").alias("b")), "a", "b", labels.select(name("node").alias("node")))
    by = connected.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.substring_index(F.first("node"), "|", 2).alias("run"))
    by = by.groupBy("run", "size").agg(F.count(F.lit(1)).alias("n"))
    nodes = F.sum(F.col("n") * F.col("size"))
    least = {f"n_size_ge_{k}": F.coalesce(F.sum(F.when(F.col("size") >= k, F.col("n"))), F.lit(0)) for k in (2, 5, 10, 50, 100)}
    stats = by.groupBy("run").agg(
        nodes.alias("n_nodes"), F.sum("n").alias("n_connected"), *[x.alias(k) for k, x in least.items()],
        F.coalesce(F.sum(F.when(F.col("size") == 1, F.col("n"))), F.lit(0)).alias("n_singletons"), F.max("size").alias("largest"), (nodes / F.sum("n")).alias("mean_size"),
        F.expr("percentile(size, 0.5, n)").alias("median_size"), F.array_sort(F.collect_list(F.struct("size", "n"))).alias("sizes"),
    )
    found = quality.withColumn("run", F.concat_ws("|", "gamma", "seed")).join(stats, "run").drop("run")
    first = F.row_number().over(Window.partitionBy("gamma").orderBy(F.desc("modularity"), "seed")) == 1  # as many rows as seeds
    return found.withColumn("selected", first)


def split_and_rank(labels: DataFrame, edges: DataFrame, a: str, b: str, least: int = 2) -> DataFrame:
    """(node, community_id, size): communities cut into connected parts, of at least ``least`` nodes, numbered by size."""
    la, lb = (labels.select(F.col("node").alias(n), F.col("community").alias(f"_{n}")) for n in (a, b))
    inside = edges.select(a, b).join(la, a).join(lb, b).where(F.col(f"_{a}") == F.col(f"_{b}"))
    parts = components(inside, a, b, labels.select("node"))
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    # numbers along (size, name): within a size by name, shifted by the communities of larger sizes
    per = F.row_number().over(Window.partitionBy("size").orderBy("component"))
    counts = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("size", F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row per size
    ids = sizes.withColumn("_k", per).join(F.broadcast(before), "size").select("component", "size", (F.col("_before") + F.col("_k")).alias("community_id"))
    return parts.join(ids, "component").select("node", "community_id", "size")


def community_summary(edges: DataFrame, labels: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """(community, n_nodes, n_edges, density, avg_weight) of the edges inside."""
    la, lb = (labels.select(F.col("node").alias(n), F.col("community").alias(f"_{n}")) for n in (a, b))
    inside = edges.join(la, a).join(lb, b).where(F.col(f"_{a}") == F.col(f"_{b}"))
    e = inside.groupBy(F.col(f"_{a}").alias("community")).agg(F.count(F.lit(1)).alias("n_edges"), F.avg(weight).alias("avg_weight"))
    n = labels.groupBy("community").agg(F.count(F.lit(1)).alias("n_nodes"))
    t = n.join(e, "community", "left").fillna(0, ["n_edges"])
    return t.withColumn("density", F.when(F.col("n_nodes") > 1, 2 * F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))))
