"""Groups of directly or indirectly matched records, by random contraction.

In every round each vertex of the remaining graph hooks to the smallest of
its closed neighbourhood in a fresh hash order; edges are relabelled to the
hooks, loops and repeated edges vanish, and the next round works on what is
left. When no edge is left, the rounds' mappings are expanded backwards.
Vertices are 64-bit numbers, and a round's relabelling is ``xxhash64`` of
a number with the round as second argument, which is one-to-one on 64-bit
numbers: hooks are minima of plain numbers that combine on the map side,
whatever the degree of a vertex. Joins on a vertex cut heavy vertices into
shards in proportion to their load where it exceeds a task's fair share. Every round is written to the shared
folder, so the loss of executors costs no more than a round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.skew import fair_share, salted_join
from strandloom.session import Stage, small

#: Rounds of the expansion that are joined in one plan.
_JOINS = 4

def _canonical(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _number(name: str, seed: int) -> Column:
    return F.xxhash64(name, F.lit(seed))


def _numbered(names: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame | None]:
    """(name, id) with distinct ids, and the part of it whose ids aren't the first hash (None if there is none).

    Two names with one 64-bit hash would join their groups. All names are
    checked for it; those that share a hash get further hashes until each
    has a number that no other name has. Among n names about n**2 / 2**64
    share one: none in billions, some thousands in 10**12.
    """
    out = stage.write(names.select("name", _number("name", 0).alias("id")), "names")
    shared = stage.write(out.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "shared")
    if shared.isEmpty():
        return out, None
    settled = out.join(shared, "id", "left_anti").select("name", "id")
    open_names = stage.write(out.join(shared, "id", "left_semi").select("name"), "open0")
    odd = None
    seed = 0
    while not open_names.isEmpty():
        seed += 1
        tried = open_names.select("name", _number("name", seed).alias("id"))
        free = tried.join(settled.select("id"), "id", "left_anti")
        if odd is not None:
            free = free.join(odd.select("id"), "id", "left_anti")
        alone = free.groupBy("id").agg(F.min("name").alias("name"))  # of those that share it again one may keep it
        found = alone.select("name", "id") if odd is None else odd.unionAll(alone.select("name", "id"))
        odd = stage.write(found, f"odd{seed}")
        open_names = stage.write(open_names.join(odd, "name", "left_anti"), f"open{seed}")
    return stage.write(settled.unionAll(odd), "ids"), odd


def match_groups(pairs: DataFrame, left: str, right: str, name: str = "name", group: str = "group_name") -> DataFrame:
    """One group per name linked in ``pairs``: the smallest name (string order) of the group.

    A pair with both names links them, in either order; repeated pairs and
    pairs of a name with itself change nothing. A name whose partner is
    null still comes out, alone if nothing else links it; null is no name
    (the empty string is one). No pairs give no rows; other columns are
    ignored.
    """
    spark = pairs.sparkSession
    stage = Stage(spark, "groups")
    pairs = stage.write(pairs.select(F.col(left).cast("string").alias("a"), F.col(right).cast("string").alias("b")).where("a IS NOT NULL OR b IS NOT NULL").distinct(), "pairs")
    names, odd = _numbered(pairs.select(F.explode(F.array("a", "b")).alias("name")).where("name IS NOT NULL").distinct(), stage)

    ids = pairs.where("a IS NOT NULL AND b IS NOT NULL AND a != b")
    for end in "ab":
        number = _number(end, 0)
        if odd is not None:
            ids = ids.join(small(odd.select(F.col("name").alias(end), F.col("id").alias("_odd")), 1_000_000), end, "left")
            number = F.coalesce("_odd", number)
        ids = ids.withColumn(f"_{end}", number).drop("_odd")
    edges = stage.write(ids.select(*_canonical(F.col("_a"), F.col("_b"))).distinct(), "edges0")

    hooks: list[DataFrame] = []
    while True:
        at = len(hooks)
        fresh = lambda c: F.xxhash64(c, F.lit(at))  # noqa: B023, E731
        ends = edges.select(F.expr("inline(array(named_struct('x', u, 'y', v), named_struct('x', v, 'y', u)))"))
        hook = ends.groupBy("x").agg(F.min(fresh("y")).alias("m"), F.count(F.lit(1)).alias("load"))
        hook = stage.write(hook.select("x", F.least(fresh("x"), "m").alias("hook"), "load"), f"hooks{at}")
        most, n = hook.agg(F.max("load"), F.sum("load")).first()
        if not n:
            break
        limit = fair_share(spark, n)
        one = salted_join(edges, hook.select(F.col("x").alias("u"), F.col("hook").alias("hu"), "load"), "u", "load", "v", limit, heaviest=most)
        two = salted_join(one, hook.select(F.col("x").alias("v"), F.col("hook").alias("hv"), "load"), "v", "load", "hu", limit, heaviest=most)
        edges = stage.write(two.where("hu != hv").select(*_canonical(F.col("hu"), F.col("hv"))).distinct(), f"edges{at + 1}")
        stage.drop(f"edges{at}")
        hooks.append(hook)

    # vertices that share a hook, per round: the keys of the expansion
    loads = [h.groupBy("hook").agg(F.count(F.lit(1)).alias("load")) for h in hooks]
    tops = [t.agg(F.max("load").alias("most"), F.sum("load").alias("n"), F.lit(at).alias("at")) for at, t in enumerate(loads)]
    largest = {r["at"]: r for r in reduce(DataFrame.unionAll, tops).collect()} if tops else {}  # a row per round
    roots = None  # x of a round -> (round, number) of its root
    for at in reversed(range(len(hooks))):
        here = hooks[at].select("x", "hook")
        own = F.struct(F.lit(at).alias("round"), F.col("hook").alias("number"))
        if roots is None:
            roots = here.select("x", own.alias("root"))
            continue
        known = roots.select(F.col("x").alias("hook"), "root")
        most, limit = largest[at]["most"], fair_share(spark, largest[at]["n"])
        if most > limit:
            known = loads[at].join(known, "hook", "left")
            here = salted_join(here, known, "hook", "load", "x", limit)
        else:
            here = here.join(known, "hook", "left")
        roots = here.select("x", F.coalesce("root", own).alias("root"))
        if at % _JOINS == 0:
            roots = stage.write(roots, f"roots{at}")

    alone = F.struct(F.lit(-1).alias("round"), F.col("id").alias("number"))
    if roots is None:
        named = names.select("name", alone.alias("root"))
    else:
        named = names.join(roots.withColumnRenamed("x", "id"), "id", "left").select("name", F.coalesce("root", alone).alias("root"))
    named = stage.write(named, "named")
    smallest = stage.write(named.groupBy("root").agg(F.min("name").alias(group), F.count(F.lit(1)).alias("load")), "smallest")
    most = smallest.agg(F.max("load"), F.sum("load")).first()
    return salted_join(named, smallest, "root", "load", "name", fair_share(spark, most[1] or 0), heaviest=most[0] or 0).select(F.col("name").alias(name), group)
