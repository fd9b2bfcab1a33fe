"""Covered periods and gaps of overlapping intervals, by compressed run bitmaps.

Exact units (residues, seconds, microseconds, ...) are bits. An interval
becomes at most two bit words on each of eleven levels: a bit of level L
stands for 64**L units, so a stretch of any length of 64-bit numbers needs a
handful of words and a whole word is one bit of the level above. The words
of an entity are united with ``bit_or``, which combines on the map side and
takes repeated rows as they come, and are written once. Then set runs and
clear runs are read off the bitmap of every shard of an entity (2**18
units). Only the first and the last set run of a shard can go on beyond it:
they meet again in shards of 2**30, 2**42 and 2**54 units and at last per
entity, where longer stretches (words of the upper levels) join in. So a
task holds the runs of one shard at a time (at most 4,161 words, later two
runs for each of 4,096 shards), however many rows an entity has. Shards
larger than the span of the data are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandloom.session import Stage, ship

LEVELS = 11
SHARD_BITS = (18, 30, 42, 54, 64)


def _level_words() -> str:
    """The words of [a, b] on level ``n``: what is left at either side of the whole words, which the next level takes."""
    up = lambda c, n: f"(shiftright({c}, 6 * ({n})) + CAST(({c} & (shiftleft(1L, 6 * ({n})) - 1L)) != 0L AS BIGINT))"
    down = lambda c, n: f"(shiftright({c}, 6 * ({n})) - CAST(({c} & (shiftleft(1L, 6 * ({n})) - 1L)) != shiftleft(1L, 6 * ({n})) - 1L AS BIGINT))"
    piece = lambda when, lo, hi: f"CASE WHEN {when} THEN named_struct('level', n, 'lo', {lo}, 'hi', {hi}) END"
    one = "named_struct('lo', " + up("a", "n") + ", 'hi', " + down("b", "n") + ", 'p', IF(n < top, " + up("a", "n + 1") + ", 1L), 'q', IF(n < top, " + down("b", "n + 1") + ", 0L))"
    whole, split = "x.p <= x.q", "shiftright(x.hi, 6) > shiftright(x.lo, 6)"
    head = f"CASE WHEN {whole} THEN {piece('shiftright(x.lo, 6) < x.p', 'x.lo', 'shiftleft(x.p, 6) - 1L')} ELSE {piece('x.lo <= x.hi', 'x.lo', 'least(x.hi, x.lo | 63L)')} END"
    tail = f"CASE WHEN {whole} THEN {piece('shiftright(x.hi, 6) > x.q', 'shiftleft(x.q + 1L, 6)', 'x.hi')} ELSE {piece(f'x.lo <= x.hi AND {split}', 'shiftleft(shiftright(x.hi, 6), 6)', 'x.hi')} END"
    return f"array_compact(flatten(transform(sequence(0, top), n -> element_at(transform(array({one}), x -> array({head}, {tail})), 1))))"


def bitmap_words(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """(entity, level, word, bits): the united bitmap of every entity."""
    both = df.where(F.col(entity).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull())  # least() would skip a null
    spans = both.select(F.col(entity).alias("entity"), F.least(start, end).cast("bigint").alias("a"), F.greatest(start, end).cast("bigint").alias("b"))
    # the level on which the interval lies in two neighbouring words at most
    top = "CASE " + " ".join(f"WHEN shiftright(b, {6 * n + 6}) - shiftright(a, {6 * n + 6}) <= 1 THEN {n}" for n in range(LEVELS - 1)) + f" ELSE {LEVELS - 1} END"
    return (
        spans.withColumn("top", F.expr(top))
        .select("entity", F.expr(f"inline({_level_words()})"))
        .select(
            "entity",
            "level",
            F.expr("shiftright(lo, 6)").alias("word"),
            F.expr("shiftleft(shiftrightunsigned(-1L, CAST(63L - (hi - lo) AS INT)), CAST(lo & 63L AS INT))").alias("bits"),
        )
        .groupBy("entity", "level", "word")
        .agg(F.bit_or("bits").alias("bits"))
    )


def _shard(bits: int, level: str = "level", word: str = "word") -> str:
    """Shard of 2**bits units that a word lies in."""
    return "0L" if bits == 64 else f"shiftright({word}, {bits} - 6 * ({level} + 1))"


def _tier(level: int) -> int:
    """The smallest shards that hold a word of the level."""
    return next(n for n, bits in enumerate(SHARD_BITS) if bits == 64 or 6 * (level + 1) <= bits)


def _uncovered(words: DataFrame, top: int) -> DataFrame:
    """The words without those that a set bit of the larger shards' levels covers altogether."""
    asked = words.where(f"level <= {top}").select("entity", "level", "word")
    above = F.expr(
        "inline(filter(array("
        + ", ".join(f"named_struct('at', {m}, 'over', shiftright(word, 6 * ({m} - level)), 'bit', shiftright(word, 6 * ({m} - level - 1)) & 63L, 'ok', {_tier(m)} > {_tier_sql()})" for m in range(3, top + 1))
        + "), x -> x.ok AND x.at > level))"
    )
    hit = asked.select("entity", "level", "word", above).join(words.select("entity", F.col("level").alias("at"), F.col("word").alias("over"), "bits"), ["entity", "at", "over"])
    covered = hit.where("(shiftrightunsigned(bits, CAST(bit AS INT)) & 1L) = 1L").select("entity", "level", "word").distinct()
    return words.join(covered, ["entity", "level", "word"], "left_anti")


def _tier_sql() -> str:
    return "CASE " + " ".join(f"WHEN level = {n} THEN {_tier(n)}" for n in range(LEVELS)) + " END"


def _islands(shard: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs joined where they overlap or touch; ``shard`` numbers groups in rising order, runs are sorted within."""
    fresh = np.r_[True, shard[1:] != shard[:-1]]
    reach = end.copy()
    for a, b in zip(np.flatnonzero(fresh), np.r_[np.flatnonzero(fresh)[1:], len(shard)]):
        np.maximum.accumulate(end[a:b], out=reach[a:b])
    # start - 1 > reach, written so that neither end of the 64-bit range overflows
    fresh[1:] |= (start[1:] > reach[:-1]) & (start[1:] - 1 != reach[:-1])
    first = np.flatnonzero(fresh)
    return shard[first], start[first], reach[np.r_[first[1:], len(shard)] - 1]


def _reader(schema: pa.Schema, below: int | None, last: bool):
    """Set and clear runs of every shard; rows of a shard follow each other.

    Without ``last`` its first and last set run go on as ``border``. Clear
    runs inside a shard of 2**``below`` units have come out with that one.
    """

    def runs(t: pa.Table) -> pa.RecordBatch:
        entity, shard = t.column(0).combine_chunks(), t.column(1).to_numpy()
        names = entity.dictionary_encode() if not isinstance(entity, pa.ChunkedArray) else entity.combine_chunks().dictionary_encode()
        who = names.indices.to_numpy()
        group = np.cumsum(np.r_[0, (who[1:] != who[:-1]) | (shard[1:] != shard[:-1])])
        level, lo, hi = (t.column(i).to_numpy() for i in (2, 3, 4))
        plain, word = level < 0, level >= 0
        bits = np.unpackbits(hi[word].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edge = np.diff(np.pad(bits.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        at, s = np.nonzero(edge == 1)
        e = np.nonzero(edge == -1)[1]
        shift, base = 6 * level[word][at].astype(np.int64), lo[word][at] << 6
        start = np.r_[lo[plain], (base + s) << shift]
        end = np.r_[hi[plain], ((base + e - 1) << shift) + ((1 << shift) - 1)]
        of = np.r_[group[plain], group[word][at]]
        order = np.lexsort((start, of))
        of, start, end = _islands(of[order], start[order], end[order])
        same = of[1:] == of[:-1]
        outer = np.zeros(len(of), bool) if last else ~(np.r_[False, same] & np.r_[same, False])
        clear = same if below is None else same & (end[:-1] >> below != start[1:] >> below)
        kind = np.r_[np.where(outer, 2, 0), np.ones(int(clear.sum()), np.int64)]
        begin, finish, of = np.r_[start, end[:-1][clear] + 1], np.r_[end, start[1:][clear] - 1], np.r_[of, of[:-1][clear]]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        return pa.RecordBatch.from_arrays(
            [names.dictionary.take(pa.array(who[first][of])).cast(schema.field(0).type), pa.array(["period", "gap", "border"]).take(pa.array(kind)), pa.array(begin), pa.array(finish)], schema=schema
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            who, shard = t.column(0).combine_chunks(), t.column(1).to_numpy()
            final = who[len(who) - 1]
            cut = len(shard) - 1  # rows of the last shard wait for the next batch
            while cut > 0 and shard[cut - 1] == shard[-1] and who[cut - 1] == final:
                cut -= 1
            if cut:
                yield runs(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None:
            yield runs(held)

    return run


def covered_and_gaps(df: DataFrame, entity: str, start: str, end: str, unit_type: str = "int") -> DataFrame:
    """Continuous covered periods of each entity and the gaps between them.

    Closed intervals of any 64-bit whole numbers (times as microseconds,
    say); ends in the wrong order are swapped, adjacent units join. Rows
    without an entity or with a missing end take no part; repeated rows
    change nothing; no rows give no result; other columns are ignored
    whatever their names. Result: entity (under its given name), ``kind``
    (``period`` or ``gap``), ``seg_start``, ``seg_end``.
    """
    spark = df.sparkSession
    ship(spark)
    stage = Stage(spark, "runs")
    words = stage.write(bitmap_words(df, entity, start, end), "words")
    fits = [F.coalesce(F.max(F.expr(f"IF(6 * (level + 1) <= {b}, {_shard(b)}, NULL)")) == F.min(F.expr(f"IF(6 * (level + 1) <= {b}, {_shard(b)}, NULL)")), F.lit(True)) for b in SHARD_BITS[:-1]]
    span = words.agg(F.coalesce(F.max("level"), F.lit(0)).alias("top"), *[f.alias(f"fits{n}") for n, f in enumerate(fits)]).first()
    top = span["top"]
    last = next((n for n in range(_tier(top), len(SHARD_BITS) - 1) if span[f"fits{n}"]), len(SHARD_BITS) - 1)
    if _tier(top):
        words = _uncovered(words, top)
    schema = T.StructType([words.schema["entity"], T.StructField("kind", T.StringType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    arrow = to_arrow_schema(schema)
    found, border = None, None
    for n in range(last + 1):
        here = words.where(F.expr(f"{_tier_sql()} = {n}")).select("entity", F.expr(_shard(SHARD_BITS[n])).alias("shard"), "level", F.col("word").alias("lo"), F.col("bits").alias("hi"))
        if border is not None:
            at = F.lit(0).cast("bigint") if SHARD_BITS[n] == 64 else F.shiftright("a", SHARD_BITS[n])
            here = here.unionAll(border.select("entity", at.alias("shard"), F.lit(-1).alias("level"), F.col("a").alias("lo"), F.col("b").alias("hi")))
        runs = here.repartition("entity", "shard").sortWithinPartitions("entity", "shard").mapInArrow(_reader(arrow, SHARD_BITS[n - 1] if n else None, n == last), schema)
        if n < last:
            runs = stage.write(runs, f"shards{n}")
            border = runs.where("kind = 'border'")
            runs = runs.where("kind != 'border'")
        found = runs if found is None else found.unionAll(runs)
    return found.select(F.col("entity").alias(entity), "kind", F.col("a").cast(unit_type).alias("seg_start"), F.col("b").cast(unit_type).alias("seg_end"))
