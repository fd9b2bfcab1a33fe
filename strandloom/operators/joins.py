"""Joins of the analysis: unordered pairs, intervals, positions, neighbourhoods, best candidates.

Range conditions are turned into equality joins on bins wherever both
sides can grow; what is left is a residual predicate. Nothing is
broadcast here: Spark decides by measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.numeric import interval_overlap, unordered
from strandloom.operators.skew import fragment_join


def pair_hit_coverage(pieces: DataFrame, hits: DataFrame, row_id: str, names: tuple[str, str], threshold: float) -> DataFrame:
    """Best two-sided coverage of each row's pieces by hits of the same unordered pair of names.

    Both sides are (name, name, ms, me, ss, se). The coverage of a piece by
    a hit is the smaller of the overlapped shares of both its intervals,
    with the hit turned round where its names stand the other way. Rows
    without a hit have 0; ``is_novel`` is coverage below ``threshold``.
    """
    a, b = names
    keyed = lambda df: df.withColumns(dict(zip(("_k1", "_k2"), unordered(a, b)))).withColumn("_turned", F.col(a) > F.col(b))
    p = keyed(pieces).where("_k1 IS NOT NULL")
    h = keyed(hits).where("_k1 IS NOT NULL").select("_k1", "_k2", F.col("_turned").alias("_ht"), *[F.col(c).alias(f"h_{c}") for c in ("ms", "me", "ss", "se")])
    j = p.join(h, ["_k1", "_k2"])
    same = (F.col("_turned") == F.col("_ht")) | (F.col("_k1") == F.col("_k2"))
    side = lambda m, s: F.when(same, F.col(m)).otherwise(F.col(s))
    main = interval_overlap(F.col("ms"), F.col("me"), side("h_ms", "h_ss"), side("h_me", "h_se")) / (F.col("me") - F.col("ms") + 1)
    sub = interval_overlap(F.col("ss"), F.col("se"), side("h_ss", "h_ms"), side("h_se", "h_me")) / (F.col("se") - F.col("ss") + 1)
    best = j.groupBy(row_id).agg(F.max(F.least(main, sub)).alias("coverage"))
    ids = pieces.select(row_id).distinct()
    out = ids.join(best, row_id, "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    return out.withColumn("is_novel", F.col("coverage") < threshold)


def overlap_on_key(a: DataFrame, b: DataFrame, key: str, ends: tuple[str, str, str, str]) -> DataFrame:
    """Equality join with the overlap of two closed intervals; rows that don't overlap stay, with 0. Keys of many rows of ``a`` are cut by load."""
    return fragment_join(a, b, key, [c for c in a.columns if c != key]).withColumn("overlap_len", interval_overlap(*[F.col(c) for c in ends]))


def project_interval(s: Column, e: Column, from_s: Column, from_e: Column, to_s: Column, to_e: Column) -> Column:
    """STRUCT<s, e> of an interval carried from one numbering to another, clipped to the mapped stretch; null if outside."""
    a, b = F.greatest(s, from_s), F.least(e, from_e)
    known = s.isNotNull() & e.isNotNull() & from_s.isNotNull() & from_e.isNotNull() & to_s.isNotNull() & to_e.isNotNull()
    return F.when(known & (a <= b), F.struct((to_s + a - from_s).alias("s"), F.least(to_s + b - from_s, to_e).alias("e")))


def points_in_intervals(points: DataFrame, intervals: DataFrame, key: str, pos: str, start: str, end: str, width: int = 64) -> DataFrame:
    """Points joined to the closed intervals of the same key that contain them.

    An interval is listed under the bins of ``width`` it touches, a point
    under its own, so the join is one of equality on (key, bin) and a key's
    points and intervals spread over its bins.
    """
    p = points.withColumn("_bin", F.floor(F.col(pos) / width))
    i = intervals.where(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p.join(i, [key, "_bin"]).where(F.col(pos).between(F.col(start), F.col(end))).drop("_bin")


def map_range(ranges: DataFrame, mapping: DataFrame, key: str, row_id: str, start: str, end: str, source: str, target: str, rule: str = "inside") -> DataFrame:
    """Range of ``target`` for a range of ``source``.

    ``endpoints``: both ends must be mapped, else null. ``inside``: minimum
    and maximum over the mapped positions inside, null if there are none.
    """
    if rule == "endpoints":
        m = mapping.groupBy(key, source).agg(F.min(target).alias("_t"))
        at = lambda c, n: m.select(key, F.col(source).alias(c), F.col("_t").alias(n))
        j = ranges.join(at(start, "t_start"), [key, start], "left").join(at(end, "t_end"), [key, end], "left")
        ok = F.col("t_start").isNotNull() & F.col("t_end").isNotNull()
        return j.select(row_id, F.when(ok, F.col("t_start")).alias("t_start"), F.when(ok, F.col("t_end")).alias("t_end"))
    hit = points_in_intervals(mapping.select(key, source, target), ranges.select(row_id, key, start, end), key, source, start, end)
    best = hit.groupBy(row_id).agg(F.min(target).alias("t_start"), F.max(target).alias("t_end"))
    return ranges.select(row_id).join(best, row_id, "left").select(row_id, "t_start", "t_end")


def best_candidate(df: DataFrame, key: str | list[str], order: list[Column], n: int = 1, keep_rank: bool = False) -> DataFrame:
    """The first ``n`` rows of every key in a total order."""
    keys = [key] if isinstance(key, str) else key
    out = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n)
    return out.withColumnRenamed("_rank", "rank") if keep_rank else out.drop("_rank")


def by_either_name(df: DataFrame, row_id: str, a: str, b: str, name: str = "name") -> DataFrame:
    """Inverted index: (name, row) for both sides, a row once per name."""
    return df.select(row_id, F.explode(F.array_distinct(F.array(a, b))).alias(name)).where(F.col(name).isNotNull())


def close_pairs(atoms: DataFrame, chain: str, index: str, xyz: tuple[str, str, str], near: int, cutoff: float) -> DataFrame:
    """(chain, i, j, distance) of residues i < j, j - i > ``near``, at most ``cutoff`` apart.

    Residues are put into cubes of edge ``cutoff``; only the 27 cubes
    around a residue are looked up, by equality. Several atoms of a residue
    give the distance of the closest two.
    """
    cell = [F.floor(F.col(c) / cutoff).cast("bigint") for c in xyz]
    a = atoms.select(chain, F.col(index).alias("i"), *[F.col(c).alias(f"a{n}") for n, c in enumerate(xyz)], *[c.alias(f"c{n}") for n, c in enumerate(cell)])
    b = atoms.select(chain, F.col(index).alias("j"), *[F.col(c).alias(f"b{n}") for n, c in enumerate(xyz)], *[c.alias(f"d{n}") for n, c in enumerate(cell)])
    for n in range(3):
        b = b.withColumn(f"c{n}", F.explode(F.sequence(F.col(f"d{n}") - 1, F.col(f"d{n}") + 1))).drop(f"d{n}")
    d = F.sqrt(sum((F.pow(F.col(f"a{n}") - F.col(f"b{n}"), 2) for n in range(3)), F.lit(0.0)))
    j = a.join(b, [chain, "c0", "c1", "c2"]).where(F.col("j") - F.col("i") > near).withColumn("distance", d)
    return j.where(F.col("distance") <= cutoff).groupBy(chain, "i", "j").agg(F.min("distance").alias("distance"))


def pair_result_sets(a: DataFrame, b: DataFrame, keys: list[str], value: str, rtol: float, atol: float) -> DataFrame:
    """Agreement of two result sets cell by cell: cells, mismatches, their share, MAE, RMSE, largest difference, correlation."""
    j = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    diff = F.abs(F.col("_a") - F.col("_b"))
    bad = diff > atol + rtol * F.abs(F.col("_b"))
    return j.agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(bad).alias("mismatches"),
        (F.count_if(bad) / F.count(F.lit(1))).alias("mismatch_fraction"),
        F.avg(diff).alias("mae"),
        F.sqrt(F.avg(diff * diff)).alias("rmse"),
        F.max(diff).alias("max_difference"),
        F.percentile(diff, F.lit(0.95)).alias("p95_difference"),
        F.corr("_a", "_b").alias("pearson"),
    )
