"""All-pairs window divergence of profiles, tile by tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.numeric import log2_to_probability, relative_entropy
from strandloom.session import parallelism, ship

#: Columns of a table of profiles: -1000 log2 units turned into probabilities, flat in row order.
PROFILE = ("family", "transitions", "emissions", "background")


def fixed_transitions(profiles: DataFrame, states: str = "emissions") -> DataFrame:
    """Transitions for profiles that come without: each state goes on to the next with 0.9."""
    row = [0.9, 0.05, 0.05, 0.5, 0.5, 0.5, 0.5]
    n = F.size(states) / 20 + 1
    return profiles.withColumn("transitions", F.flatten(F.array_repeat(F.array(*[F.lit(x) for x in row]), n.cast("int"))))


#: Families of one side of a tile, and windows whose factors a task keeps (13 KB each for k = 6).
TILE_FAMILIES, KEPT_WINDOWS = 128, 20_000


def window_divergence(pairs: DataFrame, profiles: DataFrame, k: int, keep_below: float | None = None, block: int = 512, tile_families: int = TILE_FAMILIES) -> DataFrame:
    """(i, j, row, col, raw FLOAT): divergence of windows of every pair of families, 1-based.

    Families are hashed into blocks; a pair belongs to the tile of its two
    blocks. A profile travels once to every tile in which it has a pair, so
    what is shuffled grows with families times tiles of a row, not with the
    pairs, and a family of very many pairs is spread over all tiles of its
    row and column: a tile holds at most the square of ``tile_families``
    pairs. Within a tile a profile's windows are prepared once (as long as
    the kept ones have room), a pair's matrix is computed in blocks of
    ``block`` windows a side, and only points that pass ``keep_below``
    (after rounding to 4 digits, strictly) leave the function. Pairs given
    again count once; pairs with a family that is missing or shorter than
    k, and pairs with nulls, give no rows.
    """
    spark = pairs.sparkSession
    ship(spark)
    n_blocks = max(-(-profiles.select("family").count() // tile_families), int(np.ceil(np.sqrt(32 * parallelism(spark)))))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(n_blocks))
    once = pairs.select("i", "j").dropna().distinct().withColumn("tile", of("i") * n_blocks + of("j"))
    needed = once.select("tile", F.explode(F.array("i", "j")).alias("family")).distinct()
    sides = needed.join(profiles.select(*PROFILE), "family").select("tile", F.lit(0).alias("kind"), F.col("family").alias("i"), F.col("family").alias("j"), *PROFILE[1:])
    empty = [F.lit(None).cast(profiles.schema[c].dataType).alias(c) for c in PROFILE[1:]]
    rows = sides.unionByName(once.select("tile", F.lit(1).alias("kind"), "i", "j", *empty))
    n_tasks = 4 * parallelism(spark)  # tiles differ in cells, so several tasks per core
    rows = rows.repartition(n_tasks, "tile").sortWithinPartitions("tile", "kind", "i", "j")
    kinds = dict(pairs.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from strandloom.functions.profile_math import divergence_of, factors, window_tensors

        tile, held = None, {}
        ready: dict = {}
        room = KEPT_WINDOWS

        def prepared(family) -> dict | None:
            nonlocal room
            if family in ready:
                ready[family] = ready.pop(family)  # the one used last goes last
            elif family in held:
                shape = lambda x, w: np.asarray(x, float).reshape(-1, w)
                transitions, emissions, background = held[family]
                found = factors(*window_tensors(shape(transitions, 7), shape(emissions, 20), shape(background, 20)[0], k))
                room -= len(found["c"])
                while room < 0 and ready:
                    room += len(ready.pop(next(iter(ready)))["c"])
                ready[family] = found
            return ready.get(family)

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.tile != tile:
                    tile, held, room = r.tile, {}, KEPT_WINDOWS
                    ready.clear()
                if r.kind == 0:
                    held[r.i] = (r.transitions, r.emissions, r.background)
                    continue
                one = prepared(r.i)
                two = prepared(r.j)
                if one is None or two is None:
                    continue
                for a in range(0, len(one["c"]), block):
                    for b in range(0, len(two["c"]), block):
                        raw = divergence_of({n: x[a : a + block] for n, x in one.items()}, {n: x[b : b + block] for n, x in two.items()}).astype(np.float32)
                        rows, cols = np.nonzero(np.round(raw.astype(np.float64), 4) < keep_below) if keep_below is not None else np.indices(raw.shape).reshape(2, -1)
                        yield pd.DataFrame({"i": r.i, "j": r.j, "row": (rows + a + 1).astype(np.int32), "col": (cols + b + 1).astype(np.int32), "raw": raw[rows, cols]})

    return rows.mapInPandas(run, f"i {kinds['i']}, j {kinds['j']}, row int, col int, raw float")


def column_divergence(states: DataFrame, family: str, state: str, emissions: str, background: str) -> DataFrame:
    """(family, state, divergence): each match state's emissions against the background, renormalised."""
    return states.select(family, state, relative_entropy(emissions, background).alias("divergence"))


def window_background(states: DataFrame, family: str, state: str, value: str, k: int) -> DataFrame:
    """(family, pos, bg FLOAT): mean of every k consecutive states' values, rounded to 4 digits, full windows only."""
    from pyspark.sql import Window

    from strandloom.functions.numeric import round_even

    w = Window.partitionBy(family).orderBy(state).rowsBetween(0, k - 1)
    t = states.select(family, F.col(state).alias("pos"), round_even(F.avg(value).over(w), 4).cast("float").alias("bg"), F.count(value).over(w).alias("_n"))
    return t.where(F.col("_n") == k).drop("_n")


def probabilities(values: str) -> "F.Column":
    """Array of -1000 log2 units (null for ``*``) as probabilities."""
    return F.transform(values, log2_to_probability)
