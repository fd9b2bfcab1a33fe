"""From sparse divergence points to clean, rescored paths.

Points are (i, j, row, col, raw): windows ``row`` of family i and ``col``
of family j, 1-based. Chains run along diagonals; all of it is windows and
joins keyed by the pair of families, except the order-dependent grouping
of a pair's chains, which is one pandas function per pair.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.numeric import clean_number, round_even
from strandloom.functions.text import parse_pieces
from strandloom.session import ship

EPSILON = 1e-4


def below_raw(points: DataFrame, threshold: float, inclusive: bool = False) -> DataFrame:
    """Points whose raw value, rounded half to even to 4 digits, is below the threshold; with ``raw4``."""
    raw4 = round_even(clean_number("raw"), 4)
    out = points.withColumn("raw4", raw4)
    return out.where(F.col("raw4") <= threshold if inclusive else F.col("raw4") < threshold)


def background_score(points: DataFrame, background: DataFrame, k: int, keep: float) -> DataFrame:
    """``linear`` = (q + t) / (raw4 + 1e-4) (3k + 2) of points with both backgrounds, from ``keep`` on.

    ``background`` is (family, pos, bg FLOAT); q and t are added in single
    precision and the result is rounded half to even to 4 digits.
    """
    q = background.select(F.col("family").alias("i"), F.col("pos").alias("row"), F.col("bg").alias("q"))
    t = background.select(F.col("family").alias("j"), F.col("pos").alias("col"), F.col("bg").alias("t"))
    bg = (F.col("q").cast("float") + F.col("t").cast("float")).cast("float").cast("double")
    linear = bg / (F.col("raw4") + EPSILON) * (3 * k + 2)
    out = points.join(q, ["i", "row"]).join(t, ["j", "col"]).withColumn("_l", clean_number(linear))
    return out.where(F.col("_l") > 0).withColumn("linear", round_even("_l", 4)).where(F.col("linear") >= keep).drop("_l", "q", "t")


def state_score(raw: Column, bg: Column, k: int, mode: str) -> Column:
    """Score on the distance per state, by ``theory`` (3k + 0.407) or ``empirical`` (3k + 2)."""
    return bg / (raw / (3 * k + {"theory": 0.407, "empirical": 2.0}[mode]) + EPSILON)


def allowed_on_either_side(df: DataFrame, allowed: DataFrame, a: str, b: str, name: str, row_id: str) -> DataFrame:
    """Rows with an allowed name on side ``a`` or ``b``, each once."""
    hits = [df.join(allowed.select(F.col(name).alias(c)), c, "left_semi").select(*df.columns) for c in (a, b)]
    return hits[0].unionByName(hits[1]).dropDuplicates([row_id])


def classify_combinations(df: DataFrame, key: str, kind: str, weight: str, count: str) -> DataFrame:
    """single/multi, the sorted combination and the dominant kind by (share, count), ``ambiguous`` on a tie."""
    total = F.sum(weight).over(Window.partitionBy(key))
    t = df.withColumn("_f", F.round(F.col(weight) / total, 6))
    g = t.groupBy(key).agg(F.collect_list(F.struct("_f", count, kind)).alias("_all"))  # a key's kinds are a small fixed set
    best = F.expr(f"array_max(transform(_all, x -> struct(x._f, x.{count})))")
    top = F.filter("_all", lambda x: (x["_f"] == best["_f"]) & (x[count] == best[count]))
    names = F.array_sort(F.transform("_all", lambda x: x[kind]))
    return g.select(
        key,
        F.when(F.size("_all") == 1, "single").otherwise("multi").alias("kind"),
        F.concat_ws("+", names).alias("combination"),
        F.when(F.size(top) > 1, "ambiguous").otherwise(F.get(top, 0)[kind]).alias("dominant"),
    )


def chain_points(points: DataFrame, k: int, keys: tuple[str, ...] = ("i", "j"), x: str = "row", y: str = "col") -> DataFrame:
    """``chain`` of every point: along a diagonal, a gap of k or more starts a new one.

    A chain is named by its diagonal and first x, so the number doesn't
    depend on the partitioning.
    """
    diagonal = F.col(y) - F.col(x)
    w = Window.partitionBy(*keys, "_diag").orderBy(x)
    start = F.when(F.coalesce(F.col(x) - F.lag(x).over(w) > k - 1, F.lit(True)), F.col(x))
    out = points.withColumn("_diag", diagonal).withColumn("_start", start)
    out = out.withColumn("_start", F.last("_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("chain", F.concat_ws(":", "_diag", "_start")).drop("_diag", "_start")


def mark_clean(points: DataFrame, keys: tuple[str, ...] = ("i", "j"), x: str = "row", y: str = "col") -> DataFrame:
    """``has_neighbour``: another point at the same x and y +- 1 (window over the sorted ys of an x, no self-join)."""
    w = Window.partitionBy(*keys, x).orderBy(y)
    near = (F.col(y) - F.lag(y).over(w) == 1) | (F.lead(y).over(w) - F.col(y) == 1)
    return points.withColumn("has_neighbour", F.coalesce(near, F.lit(False)))


def chain_metrics(chained: DataFrame, k: int, value: str = "linear", keys: tuple[str, ...] = ("i", "j"), x: str = "row", y: str = "col") -> DataFrame:
    """Per chain: points, span on both axes (k - 1 added), mean value, gaps, n times mean."""
    span = lambda c: F.max(c) - F.min(c) + k
    return chained.groupBy(*keys, "chain").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.min(x).alias("x0"),
        F.min(y).alias("y0"),
        span(x).alias("main_len"),
        span(y).alias("sub_len"),
        F.avg(value).alias("avg_similarity"),
        (F.max(x) - F.min(x) + 1 > F.count(F.lit(1))).alias("is_gapped"),
        F.sum(value).alias("total"),
        *([F.bool_or("has_neighbour").alias("dirty")] if "has_neighbour" in chained.columns else []),
    )


# ---- grouping of a pair's chains (depends on their order: one function per pair) ----


def _chains(points: dict[tuple[int, int], float], k: int) -> list[list[tuple[int, int]]]:
    open_ends: dict[int, list[tuple[int, int]]] = {}
    done = []
    for x, y in sorted(points):
        chain = open_ends.get(y - x)
        if chain is None or x - chain[-1][0] > k - 1:
            chain = open_ends[y - x] = []
            done.append(chain)
        chain.append((x, y))
    return sorted(c for c in done if not any((x, y + s) in points for x, y in c for s in (1, -1)))


def _grouped(chains: list[list[tuple[int, int]]], min_points: int, iou: float) -> tuple[list, list]:
    """Chains that stand alone, and groups that overlap on x beyond ``iou`` and share a y."""
    clean, unclean = [], []
    left = list(chains)
    while left:
        group, union = [left[0]], {x for x, _ in left[0]}
        rest = []
        for c in left[1:]:
            xs = {x for x, _ in c}
            if len(xs & union) > iou * len(xs | union):
                group.append(c)
                union |= xs
            else:
                rest.append(c)
        left = rest
        ys = [{y for _, y in c} for c in group]
        long = [c for c in group if len(c) >= min_points]
        if len(set().union(*ys)) < sum(map(len, ys)):
            if long:
                unclean.append(long)
        else:
            clean += long
    return clean, unclean


def pair_paths(points: dict[tuple[int, int], float], k: int, min_points: int, iou: float, swap_output: bool) -> list[tuple[bool, list[tuple[int, int]]]]:
    """(is_clean, chain) of one pair, found along both axes and reconciled.

    A chain that is part of an unclean group along either axis is unclean.
    Clean chains come from the axis whose family is the main one
    (``swap_output``: the y axis).
    """
    both = {"x": points, "y": {(y, x): v for (x, y), v in points.items()}}
    found = {axis: _grouped(_chains(p, k), min_points, iou) for axis, p in both.items()}
    same_way = lambda axis, c: tuple(c) if axis == "x" else tuple((x, y) for y, x in c)
    unclean = {same_way(a, c) for a, (_, groups) in found.items() for g in groups for c in g}
    axis = "y" if swap_output else "x"
    clean = [c for c in found[axis][0] if same_way(axis, c) not in unclean]
    back = [same_way("y", c) for c in sorted(unclean)] if swap_output else [list(c) for c in sorted(unclean)]
    return [(True, c) for c in clean] + [(False, list(c)) for c in back]


def needs_flip(points: dict[tuple[int, int], float]) -> bool:
    """More than twice as many rows as columns per row on average."""
    rows: dict[int, int] = {}
    for x, _ in points:
        rows[x] = rows.get(x, 0) + 1
    return bool(rows) and len(rows) > 2 * sum(rows.values()) / len(rows)


def find_paths(points: DataFrame, names: DataFrame, k: int, min_points: int = 5, iou: float = 0.1, top: int | None = None) -> DataFrame:
    """Clean and unclean paths of every pair of families.

    ``points`` is (i, j, row, col, linear), ``names`` (family, name). The
    main family of a clean path is the one whose name comes first. Result:
    main_hmm, sub_hmm, is_clean, path_rank (by n times mean, descending),
    n_points, avg_similarity, score = log10(n mean + 1e-9), main_segment,
    main_segment_len, sub_segments_details, is_gapped. A pair's points are
    bounded by its windows; a null or repeated point counts once at most.
    """
    ship(points.sparkSession)
    a, b = names.select(F.col("family").alias("i"), F.col("name").alias("name_i")), names.select(F.col("family").alias("j"), F.col("name").alias("name_j"))
    rows = points.join(a, "i").join(b, "j").select("name_i", "name_j", "row", "col", "linear").dropna()
    schema = "main_hmm string, sub_hmm string, is_clean boolean, n_points int, avg_similarity double, xs array<int>, ys array<int>"

    def one_pair(pdf: pd.DataFrame) -> pd.DataFrame:
        pts = {(int(x), int(y)): float(v) for x, y, v in zip(pdf["row"], pdf["col"], pdf["linear"])}
        hx, hy = pdf["name_i"].iloc[0], pdf["name_j"].iloc[0]
        if needs_flip(pts):
            pts, hx, hy = {(y, x): v for (x, y), v in pts.items()}, hy, hx
        swap = hx > hy
        out = []
        for clean, c in pair_paths(pts, k, min_points, iou, swap):
            values = [pts[(y, x)] if swap else pts[(x, y)] for x, y in c]
            out.append((min(hx, hy), max(hx, hy), clean, len(c), sum(values) / len(values), [x for x, _ in c], [y for _, y in c]))
        return pd.DataFrame(out, columns=["main_hmm", "sub_hmm", "is_clean", "n_points", "avg_similarity", "xs", "ys"])

    found = rows.groupBy("name_i", "name_j").applyInPandas(one_pair, schema)
    w = Window.partitionBy("main_hmm", "sub_hmm", "is_clean").orderBy(F.desc("total"), F.col("xs"))
    found = found.withColumn("total", F.col("n_points") * F.col("avg_similarity")).withColumn("path_rank", F.row_number().over(w))
    if top:
        found = found.where(~F.col("is_clean") | (F.col("path_rank") <= top))
    main, sub = merged_segments("xs", k - 1), merged_segments("ys", k - 1)
    return found.select(
        "main_hmm",
        "sub_hmm",
        "is_clean",
        "path_rank",
        "n_points",
        "avg_similarity",
        F.when(F.col("total") > 0, F.log10(F.col("total") + 1e-9)).otherwise(F.col("total")).alias("score"),
        main.alias("main_segment"),
        (F.array_max("xs") - F.array_min("xs") + k).alias("main_segment_len"),
        F.concat_ws(" -> ", main, sub).alias("sub_segments_details"),
        (F.array_max("xs") - F.array_min("xs") + 1 > F.size(F.array_distinct("xs"))).alias("is_gapped"),
    )


def runs_of(array: str, extension: int) -> Column:
    """ARRAY<STRUCT<s, e>>: runs of consecutive numbers in a sorted array, each longer by ``extension``."""
    return F.expr(
        f"""aggregate(array_sort({array}), CAST(array() AS array<struct<s:int,e:int>>), (acc, v) ->
              CASE WHEN size(acc) > 0 AND element_at(acc, -1).e + 1 >= v
                   THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('s', element_at(acc, -1).s, 'e', greatest(element_at(acc, -1).e, v))))
                   ELSE concat(acc, array(named_struct('s', CAST(v AS INT), 'e', CAST(v AS INT)))) END,
              acc -> transform(acc, r -> named_struct('s', r.s, 'e', r.e + {extension})))"""
    )


def detailed_segments(array: str, extension: int) -> Column:
    """Runs of window starts as ``a-b,c-d``, each run extended to its last window's end."""
    return F.array_join(F.transform(runs_of(array, extension), lambda r: F.concat_ws("-", r["s"], r["e"])), ",")


def merged_segments(array: str, extension: int) -> Column:
    """The same with extended runs that touch or overlap joined."""
    joined = F.aggregate(
        runs_of(array, extension),
        F.array().cast("array<struct<s:int,e:int>>"),
        lambda acc, r: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["e"] + 1 >= r["s"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], r["e"]).alias("e")))),
        ).otherwise(F.concat(acc, F.array(r))),
    )
    return F.array_join(F.transform(joined, lambda r: F.concat_ws("-", r["s"], r["e"])), ",")


# ---- coverage ----


def interval_means(intervals: DataFrame, values: DataFrame, key: str, start: str, end: str, pos: str, value: str, missing: float) -> DataFrame:
    """Mean of ``value`` over the positions of each closed interval; positions without a value count as ``missing``.

    Prefix sums turn the range join into two equality joins on (key, pos):
    the sum up to the end less the sum before the start. Intervals whose
    key has no values at all get ``missing``.
    """
    w = Window.partitionBy(key).orderBy(pos)
    sums = values.groupBy(key, pos).agg(F.first(value).cast("double").alias("_value"))
    sums = sums.select(key, F.col(pos).alias("_at"), F.sum("_value").over(w).alias("_sum"), F.count("_value").over(w).alias("_count"))
    # boundaries are looked up once per (key, position), so a key with very many intervals is no larger than its positions
    ends = intervals.select(key, F.explode(F.array(F.col(end), F.col(start) - 1)).alias("_at")).dropna().distinct().withColumn("_asked", F.lit(True))
    along = Window.partitionBy(key).orderBy("_at", F.col("_asked").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = ends.unionByName(sums, allowMissingColumns=True)
    last = lambda c, none: F.coalesce(F.last(c, True).over(along), none)
    seen = both.withColumn("_sum", last("_sum", F.lit(0.0))).withColumn("_count", last("_count", F.lit(0))).where("_asked")
    at = lambda c, n: seen.select(key, F.col("_at").alias(c), F.col("_sum").alias(f"_sum{n}"), F.col("_count").alias(f"_count{n}"))
    t = intervals.withColumn("_before", F.col(start) - 1).join(at(end, 1), [key, end], "left").join(at("_before", 0), [key, "_before"], "left")
    length = F.col(end) - F.col(start) + 1
    n, s = F.col("_count1") - F.col("_count0"), F.col("_sum1") - F.col("_sum0")
    mean = F.when(length > 0, (F.coalesce(s, F.lit(0.0)) + (length - F.coalesce(n, F.lit(0))) * missing) / length).otherwise(F.lit(missing))
    return t.withColumn("mean", mean).select(*intervals.columns, "mean")


def rescore(paths: DataFrame, coverage: DataFrame, row_id: str, main: str, sub: str, details: str, similarity: str, missing: float = 0.0) -> DataFrame:
    """``coverage_main``, ``coverage_sub`` and ``rescored`` = log10(similarity ((main + sub) / 2)^2) of every path.

    A path's coverage is the mean over its pieces of the pieces' means;
    ``coverage`` is (family, pos, frac). Paths without pieces, and values
    that are not positive, come out with a null score.
    """
    each = paths.select(row_id, main, sub, F.posexplode(parse_pieces(details)).alias("_n", "_p"))
    sides = each.select(
        row_id,
        "_n",
        F.explode(
            F.array(
                F.struct(F.lit("m").alias("side"), F.col(main).alias("family"), F.col("_p.ms").alias("s"), F.col("_p.me").alias("e")),
                F.struct(F.lit("s").alias("side"), F.col(sub).alias("family"), F.col("_p.ss").alias("s"), F.col("_p.se").alias("e")),
            )
        ).alias("_q"),
    ).select(row_id, "_n", "_q.*")
    means = interval_means(sides.where("family IS NOT NULL"), coverage, "family", "s", "e", "pos", "frac", missing)
    nameless = sides.where("family IS NULL").withColumn("mean", F.lit(float(missing)))
    both = means.select(row_id, "side", "mean").unionByName(nameless.select(row_id, "side", "mean"))
    by_path = both.groupBy(row_id).agg(*[F.avg(F.when(F.col("side") == s, F.col("mean"))).alias(n) for s, n in (("m", "coverage_main"), ("s", "coverage_sub"))])
    out = paths.drop("coverage_main", "coverage_sub").join(by_path, row_id, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(float(missing))) for c in ("coverage_main", "coverage_sub")})
    adjusted = clean_number(similarity) * F.pow((F.col("coverage_main") + F.col("coverage_sub")) / 2, 2)
    return out.withColumn("rescored", F.when((F.size(parse_pieces(details)) > 0) & (adjusted > 0), F.log10(adjusted)))
