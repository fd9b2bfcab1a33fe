"""Top N items of every group by two-stage salted ranking.

Rows of a group are hashed into subgroups by their identifier. Stage one
keeps the N best of each subgroup; Spark applies that limit to every map
partition before the exchange, so a group of any size sends at most N rows
per subgroup and map task. Stage two ranks the survivors of all subgroups
by score and identifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUBGROUPS = 16


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, subgroups: int = SUBGROUPS) -> DataFrame:
    """(group, item, score, rank) of the ``n`` highest scores of each group.

    Of equal scores the smaller item goes first. Rows with a null or NaN
    score, a null group or a null item take no part; a row given again
    (equal group and item, hence score) counts once. Groups with fewer
    than ``n`` items come out whole; an empty table gives an empty result;
    other columns are ignored.
    """
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s"))
    rows = rows.where(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
    rows = rows.withColumn("_sub", F.pmod(F.xxhash64("i"), F.lit(subgroups)).cast("int"))
    best = (F.col("s").desc(), F.col("i").asc())
    # dense_rank gives copies of a row one rank; they are in the same subgroup, where distinct needs no exchange
    first = rows.withColumn("_r", F.dense_rank().over(Window.partitionBy("g", "_sub").orderBy(*best))).where(F.col("_r") <= n)
    kept = first.select("g", "_sub", "i", "s").distinct()
    last = kept.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*best))).where(F.col("rank") <= n)
    return last.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")
