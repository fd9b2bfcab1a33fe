"""Per-key work without a few overloaded tasks: fragment and replicate by load.

The load of every key is counted with map-side combination. A key above
half a task's fair share is *heavy*: it is cut into shards in proportion
to its load, and rows go to a shard by the hash of a spreading column.
Light keys are hashed to a fixed number of bins. Shards and bins are then
packed onto tasks, largest first. Only the heavy keys (at most twice the
number of tasks) and the bins reach the driver, so what is collected and
broadcast is bounded by the number of tasks, not by the data. A matching
side is replicated to a heavy key's shards only.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.session import Stage, parallelism

BINS_PER_TASK = 16


@dataclass(frozen=True)
class FragmentPlan:
    """Where rows go: tasks of each heavy key's shards and of each bin of light keys."""

    n_tasks: int
    n_bins: int
    heavy: DataFrame  # _fragment_key, _fragment_tasks ARRAY<INT>; at most 2 * n_tasks rows
    bins: DataFrame  # _fragment_bin, _fragment_task; at most n_bins rows
    heavy_keys: list
    task_loads: list[int]

    def route(self, df: DataFrame, key: str, spread: list[str]) -> DataFrame:
        """``df`` with a column ``_fragment_task``, each row once; equal rows get the same task."""
        return self._with_task(df, key, F.element_at("_fragment_tasks", (F.pmod(F.xxhash64(*spread), F.size("_fragment_tasks")) + 1).cast("int")))

    def replicate(self, df: DataFrame, key: str) -> DataFrame:
        """The matching side: heavy keys once per task that holds a shard, others once."""
        tasks = F.coalesce(F.array_distinct("_fragment_tasks"), F.array("_fragment_btask"))
        return self._joined(df, key).withColumn("_fragment_task", F.explode(tasks)).drop("_fragment_tasks", "_fragment_btask", "_fragment_bin", "_fragment_key")

    def _joined(self, df: DataFrame, key: str) -> DataFrame:
        df = df.withColumn("_fragment_bin", F.pmod(F.xxhash64(key), F.lit(self.n_bins)).cast("int"))
        df = df.join(F.broadcast(self.heavy), F.col(key).eqNullSafe(F.col("_fragment_key")), "left")
        return df.join(F.broadcast(self.bins.withColumnRenamed("_fragment_task", "_fragment_btask")), "_fragment_bin", "left")

    def _with_task(self, df: DataFrame, key: str, heavy_task: Column) -> DataFrame:
        return self._joined(df, key).withColumn("_fragment_task", F.coalesce(heavy_task, "_fragment_btask", F.lit(0))).drop("_fragment_tasks", "_fragment_btask", "_fragment_bin", "_fragment_key")


def plan_fragments(df: DataFrame, key: str, n_tasks: int | None = None) -> FragmentPlan:
    """Count the loads of ``df``'s keys (null is a key too) and pack them onto tasks."""
    spark = df.sparkSession
    n_tasks = n_tasks or parallelism(spark)
    n_bins = BINS_PER_TASK * n_tasks
    counted = Stage(spark, "loads").write(df.select(F.col(key).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("load")), "loads")
    share = max(1, -(-(counted.agg(F.sum("load")).first()[0] or 0) // n_tasks))
    hot = F.col("load") > share / 2
    loads = (
        counted.select(hot.alias("hot"), F.when(hot, F.col("key")).alias("key"), F.when(~hot, F.pmod(F.xxhash64("key"), F.lit(n_bins)).cast("int")).alias("bin"), "load")
        .groupBy("hot", "key", "bin")
        .agg(F.sum("load").alias("load"))
        .collect()
    )
    pieces = []
    for r in loads:
        n = -(-r["load"] // share) if r["hot"] else 1
        pieces += [(r["load"] / n, str(r["key"]), r["bin"] or 0, s, r) for s in range(n)]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2], p[3]))
    tasks = [(0.0, t) for t in range(n_tasks)]
    placed: dict = {}
    sums = [0.0] * n_tasks
    for load, _, _, _, r in pieces:
        have, t = heapq.heappop(tasks)
        sums[t] = have + load
        heapq.heappush(tasks, (sums[t], t))
        placed.setdefault((r["hot"], r["key"], r["bin"]), []).append(t)
    kind = df.schema[key].dataType.simpleString()
    heavy = [(k, ts) for (h, k, _), ts in placed.items() if h]
    bins = [(b, ts[0]) for (h, _, b), ts in placed.items() if not h]
    return FragmentPlan(
        n_tasks,
        n_bins,
        spark.createDataFrame(heavy, f"_fragment_key {kind}, _fragment_tasks array<int>"),
        spark.createDataFrame(bins, "_fragment_bin int, _fragment_task int"),
        [k for k, _ in heavy],
        [round(x) for x in sums],
    )


def aggregate_by_fragments(df: DataFrame, key: str, row_id: str, aggs: dict[str, tuple[Column, str]], n_tasks: int | None = None) -> DataFrame:
    """Per-key aggregates over distinct rows, evenly spread whatever the keys' loads.

    ``row_id`` names a row; rows with equal ``row_id`` are deliveries of the
    same row (equal in the columns used here) and count once. ``aggs`` maps
    a result column to (value, ``count``/``sum``/``max``/``min``); values
    are computed from the input columns. Rows go to their key's shard by
    the hash of ``row_id``, so one exchange serves both the removal of
    repeats and the partial aggregation; a second one moves a row per key
    and task. A null key is a key of its own; nulls in values don't count;
    an empty table gives an empty result.
    """
    plan = plan_fragments(df, key, n_tasks)
    values = [v.alias(f"_v{i}") for i, (v, _) in enumerate(aggs.values())]
    rows = plan.route(df.select(F.col(key).alias("_k"), F.col(row_id).alias("_id"), *values), "_k", ["_id"])
    rows = rows.repartitionById(plan.n_tasks, F.col("_fragment_task"))
    once = rows.groupBy("_fragment_task", "_k", "_id").agg(*[F.first(f"_v{i}").alias(f"_v{i}") for i in range(len(aggs))])
    return once.groupBy(F.col("_k").alias(key)).agg(*[_HOW[how][0](f"_v{i}").alias(name) for i, (name, (_, how)) in enumerate(aggs.items())])


_HOW = {"count": (F.count, F.sum), "sum": (F.sum, F.sum), "max": (F.max, F.max), "min": (F.min, F.min)}


def aggregate_sides_by_fragments(df: DataFrame, keys: list[str], row_id: str, aggs: dict[str, tuple[Column, str]], matching: DataFrame | None = None, match_key: str | None = None, n_tasks: int | None = None) -> DataFrame:
    """(side, key, aggs, columns of ``matching``): ``aggregate_by_fragments`` for several key columns of a row in one pass.

    ``side`` is the name of the key column. A row moves once, to a shard of
    its first key; copies of it are removed there, and what is left is
    aggregated for every side before anything moves again. These partial
    rows, one per key and task at most, are written and fragmented by load
    once more for the further sides. ``matching`` (a row per ``match_key``)
    is repeated for the shards of heavy keys only and joins the partial
    rows; keys without a match have nulls. Null is a key of its own that
    matches nothing; nulls in values don't count; an empty table gives an
    empty result. The key columns must be of one type.
    """
    stage = Stage(df.sparkSession, "sides")
    plan = plan_fragments(df, keys[0], n_tasks)
    sides, values = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], [v.alias(f"_v{i}") for i, (v, _) in enumerate(aggs.values())]
    rows = plan.route(df.select(*sides, F.col(row_id).alias("_id"), *values), "_k0", ["_id"]).repartitionById(plan.n_tasks, F.col("_fragment_task"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"_k{i}").alias("key")) for i in range(len(keys))]))
    once = rows.distinct().select("_fragment_task", each.alias("_x"), *[f"_v{i}" for i in range(len(aggs))])
    hows = [how for _, how in aggs.values()]
    partial = once.groupBy("_fragment_task", F.col("_x.side").alias("_side"), F.col("_x.key").alias("_key")).agg(*[_HOW[h][0](f"_v{i}").alias(f"_v{i}") for i, h in enumerate(hows)])
    partial = stage.write(partial.withColumnRenamed("_fragment_task", "_origin"), "partial")
    extra = [c for c in matching.columns if c != match_key] if matching is not None else []
    out = None
    for i, k in enumerate(keys):
        part = partial.where(F.col("_side") == i)
        if matching is not None:
            part = fragment_join(part, matching.withColumnRenamed(match_key, "_key"), "_key", ["_origin"], "left", plan=plan if i == 0 else plan_fragments(part, "_key", n_tasks))
        merged = part.groupBy("_key").agg(*[_HOW[h][1](f"_v{n}").alias(name) for n, (name, (_, h)) in enumerate(aggs.items())], *[F.first(c).alias(c) for c in extra])
        merged = merged.select(F.lit(k).alias("side"), F.col("_key").alias("key"), *aggs, *extra)
        out = merged if out is None else out.unionAll(merged)
    return out


def fragment_join(left: DataFrame, right: DataFrame, key: str, spread: list[str], how: str = "inner", n_tasks: int | None = None, plan: FragmentPlan | None = None) -> DataFrame:
    """Join on ``key`` where a few keys of ``left`` hold most rows.

    ``left`` is fragmented by load, ``right`` goes to the tasks that need
    it; ``how`` is ``inner`` or ``left``. Null keys match nothing, as in
    SQL, and are spread like any other key. Columns of both sides other
    than ``key`` must differ in name. ``plan`` may come from a smaller
    table with the same loads.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    plan = plan or plan_fragments(left, key, n_tasks)
    a = plan.route(left, key, spread).repartitionById(plan.n_tasks, F.col("_fragment_task"))
    b = plan.replicate(right.where(F.col(key).isNotNull()), key).repartitionById(plan.n_tasks, F.col("_fragment_task"))
    return a.join(b, ["_fragment_task", key], how).drop("_fragment_task")


#: A key of fewer rows than that is never worth cutting.
LEAST_HEAVY = 100_000


def fair_share(spark, n_rows: int) -> int:
    """Rows of a task's fair share, the size above which a key is cut into shards."""
    return max(LEAST_HEAVY, -(-n_rows // parallelism(spark)) + 1)


def salted_join(left: DataFrame, right: DataFrame, key: str, load: str, spread: str, limit: int, how: str = "inner", heaviest: int | None = None) -> DataFrame:
    """Join on ``key`` with ``right`` unique per key and ``load`` = rows of ``left`` per key.

    Keys above ``limit`` rows are cut into shards of about ``limit`` rows
    by the hash of ``spread``; ``right`` is repeated for those shards only.
    At most rows(left) / limit keys are that heavy, which bounds the
    broadcast. ``load`` is dropped from the result. Where the largest load
    is known (``heaviest``) and within the limit, nothing is cut.
    """
    if heaviest is not None and heaviest <= limit:
        return left.join(right.drop(load), key, how)
    shards = F.ceil(F.col(load) / F.lit(limit)).cast("int")
    heavy = right.where(F.col(load) > limit).select(key, shards.alias("_fragment_shards"))
    a = left.join(F.broadcast(heavy), key, "left")
    a = a.withColumn("_fragment_salt", F.when(F.col("_fragment_shards").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col("_fragment_shards")).cast("int"))).drop("_fragment_shards")
    b = right.withColumn("_fragment_salt", F.explode(F.when(F.col(load) > limit, F.sequence(F.lit(0), shards - 1)).otherwise(F.array(F.lit(0))))).drop(load)
    return a.join(b, [key, "_fragment_salt"], how).drop("_fragment_salt")
