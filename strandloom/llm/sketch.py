"""Percentiles of very large columns by Dyadic Count-sketches.

A positive number is encoded by its binary exponent and the first 11 bits of
its mantissa: 19-bit codes in numeric order. Between 2**-112 and 2**112 a
code is 2**-11 wide (relative), beyond it every power of two is one code, so
every positive finite double has one. A sketch holds, for the dyadic nodes of
every resolution from 13 to 19 bits, one signed Count-sketch (5 rows of 1,024
counters); the 4,096 nodes of 12 bits and hence all coarser ones fit the
space of one sketch and are counted exactly. A sketch is a vector: sketches
of partitions, days or sources are merged by adding, and rows are taken out
again with a negative weight. A rank is inverted by descending from the
12-bit node that holds it to a code, one resolution at a time.

A group of at most ``LISTED_CODES`` different codes is kept as these codes
with their counts, which are much smaller than a sketch and give the same
sketch by the same addition; it is read exactly. It turns into a sketch as
soon as merging gives it more codes.

Error: the value returned is the lower end of a code, at most 2**-11
(beyond 2**112 either way: a half) below a value whose rank is off by at most
``rank_error`` of the rows, which is three times the sketches' standard
error as the sketch itself measures it (from the sum of squared counters at
each resolution), and 0 for a list of codes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandloom.operators.skew import plan_fragments
from strandloom.session import Stage, parallelism, ship

MANTISSA_BITS, BITS = 11, 19
#: Exponents with a whole mantissa, and codes of the smaller and larger powers of two, one each.
LOW, HIGH = -112, 112
_SMALLEST, _LARGEST = -1074, 1023
_BELOW = LOW - _SMALLEST
_FINE = (HIGH - LOW) << MANTISSA_BITS
EXACT_BITS, DEPTH, WIDTH = 12, 5, 1024
EXACT = 1 << EXACT_BITS
RESOLUTIONS = range(EXACT_BITS + 1, BITS + 1)
SIZE = EXACT + len(RESOLUTIONS) * DEPTH * WIDTH
VALUE_ERROR = 2.0**-MANTISSA_BITS
LISTED_CODES = 2048
_BUFFER_ROWS, _LIVE_SKETCHES = 200_000, 256
_LISTED = np.dtype([("code", "<i4"), ("weight", "<i8")])


def encode(values: np.ndarray) -> np.ndarray:
    """Codes of positive finite numbers, in their order."""
    mantissa, exponent = np.frexp(values.astype(np.float64))
    power = exponent.astype(np.int64) - 1
    fine = ((power - LOW) << MANTISSA_BITS) + ((mantissa * 2 - 1) * (1 << MANTISSA_BITS)).astype(np.int64)
    return np.where(power < LOW, power - _SMALLEST, np.where(power >= HIGH, _BELOW + _FINE + power - HIGH, _BELOW + fine))


def decode(codes: np.ndarray | int) -> np.ndarray | float:
    """Lower ends of codes."""
    at = np.asarray(codes, np.int64)
    fine = at - _BELOW
    power = np.where(at < _BELOW, at + _SMALLEST, np.where(fine >= _FINE, fine - _FINE + HIGH, (fine >> MANTISSA_BITS) + LOW))
    mantissa = np.where((fine >= 0) & (fine < _FINE), fine & ((1 << MANTISSA_BITS) - 1), 0) / (1 << MANTISSA_BITS)
    return np.ldexp(1 + mantissa, np.minimum(power, _LARGEST).astype(np.int32))


@lru_cache(1)
def _slots() -> dict[int, np.ndarray]:
    """For each resolution [row, node]: twice the bucket, plus one where the sign is negative."""
    out = {}
    for bits in RESOLUTIONS:
        node = np.arange(1 << bits, dtype=np.uint64)
        rows = []
        for row in range(DEPTH):
            with np.errstate(over="ignore"):  # splitmix64
                x = node + np.uint64((0x9E3779B97F4A7C15 * (bits * DEPTH + row + 1)) & (2**64 - 1))
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                x ^= x >> np.uint64(31)
            rows.append((x & np.uint64(2 * WIDTH - 1)).astype(np.int32))
        out[bits] = np.stack(rows)
    return out


def update(sketch: np.ndarray, codes: np.ndarray, weights: np.ndarray | None = None) -> None:
    """Add rows to a sketch (a weight of -1 takes a row out)."""
    count = lambda x, n: np.bincount(x, minlength=n) if weights is None else np.rint(np.bincount(x, weights, n)).astype(np.int64)
    sketch[:EXACT] += count(codes >> (BITS - EXACT_BITS), EXACT)
    at = EXACT
    for bits in RESOLUTIONS:
        node = codes >> (BITS - bits)
        for slot in _slots()[bits]:
            both = count(slot[node], 2 * WIDTH)
            sketch[at : at + WIDTH] += both[0::2] - both[1::2]
            at += WIDTH


def pack(sketch: np.ndarray) -> bytes:
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.abs(sketch).max(initial=0) <= np.iinfo(k).max)
    at = np.flatnonzero(sketch)
    if len(at) * (4 + np.dtype(kind).itemsize) < SIZE * np.dtype(kind).itemsize:
        return b"s" + np.dtype(kind).char.encode() + zlib.compress(at.astype(np.int32).tobytes() + sketch[at].astype(kind).tobytes(), 1)
    return b"d" + np.dtype(kind).char.encode() + zlib.compress(sketch.astype(kind).tobytes(), 1)


def pack_codes(codes: np.ndarray, weights: np.ndarray | None, most: int = LISTED_CODES) -> bytes | None:
    """A small group as its codes and their weights, which stand for the sketch they give; None if they are too many."""
    found, at = np.unique(codes, return_inverse=True)
    if len(found) > most:
        return None
    out = np.zeros(len(found), _LISTED)
    out["code"], out["weight"] = found, np.rint(np.bincount(at, weights, len(found))) if len(found) else 0
    return b"c-" + out.tobytes()


def listed(data: bytes) -> tuple[np.ndarray, np.ndarray] | None:
    """Codes and weights of a packed list, None for a sketch."""
    if data[:1] != b"c":
        return None
    rows = np.frombuffer(data, _LISTED, offset=2)
    return rows["code"].astype(np.int64), rows["weight"]


def unpack(data: bytes) -> np.ndarray:
    if (codes := listed(data)) is not None:
        out = np.zeros(SIZE, np.int64)
        update(out, *codes)
        return out
    kind, body = np.dtype(data[1:2].decode()), zlib.decompress(data[2:])
    if data[:1] == b"d":
        return np.frombuffer(body, kind).astype(np.int64)
    n = len(body) // (4 + kind.itemsize)
    out = np.zeros(SIZE, np.int64)
    out[np.frombuffer(body[: 4 * n], np.int32)] = np.frombuffer(body[4 * n :], kind)
    return out


def rank_error(sketch: np.ndarray) -> float:
    """Stated bound of the rank error as a share of the rows."""
    n = sketch[:EXACT].sum()
    rows = sketch[EXACT:].astype(np.float64).reshape(len(RESOLUTIONS), DEPTH, WIDTH)
    squares = np.median((rows**2).sum(axis=2), axis=1)
    return float(3 * np.sqrt(squares.sum() / WIDTH) / n) if n > 0 else 0.0


def quantile(sketch: np.ndarray, p: float) -> float:
    """The value of rank ceil(p n), by descent through the resolutions."""
    cumulated = np.cumsum(sketch[:EXACT])
    n = int(cumulated[-1])
    if n <= 0:
        return float("nan")
    rank = min(n, max(1, int(np.ceil(p * n))))
    node = int(np.searchsorted(cumulated, rank))
    held = int(sketch[node])
    rank -= int(cumulated[node]) - held
    at = EXACT
    for bits in RESOLUTIONS:
        slots, guess = _slots()[bits], []
        for child in (2 * node, 2 * node + 1):
            s = slots[:, child]
            guess.append(np.median(sketch[at + np.arange(DEPTH) * WIDTH + (s >> 1)] * (1 - 2 * (s & 1))))
        left = float(np.clip((guess[0] + held - guess[1]) / 2, 0, held))
        if rank <= left or left >= held:
            node, held = 2 * node, left
        else:
            node, held, rank = 2 * node + 1, held - left, rank - left
        at += DEPTH * WIDTH
    return float(decode(node))


def _read_listed(rows: np.ndarray, ps: np.ndarray) -> tuple[int, np.ndarray]:
    """Rows and codes of the percentiles of a list of codes, -1 if there are no rows."""
    cumulated = rows["weight"].cumsum()
    n = int(cumulated[-1]) if len(cumulated) else 0
    if n <= 0:
        return n, np.full(len(ps), -1)
    return n, rows["code"][cumulated.searchsorted(np.clip(np.ceil(ps * n), 1, n))]


def read(data: bytes, ps: list[float]) -> tuple[int, float, list[float]]:
    """Rows, rank error and percentiles of a packed sketch or list of codes."""
    if data[:1] != b"c":
        sketch = unpack(data)
        return int(sketch[:EXACT].sum()), rank_error(sketch), [quantile(sketch, p) for p in ps]
    n, codes = _read_listed(np.frombuffer(data, _LISTED, offset=2), np.array(ps))
    return n, 0.0, np.where(codes < 0, np.nan, decode(codes)).tolist()


class Collected:
    """Rows, lists and sketches of one group: a list of codes while they are few, then a sketch."""

    def __init__(self, most: int = LISTED_CODES) -> None:
        self.most = most
        self.sketch: np.ndarray | None = None
        self.codes: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []
        self.waiting = 0

    def add(self, codes: np.ndarray, weights: np.ndarray | None) -> None:
        self.codes.append(codes)
        self.weights.append(np.ones(len(codes)) if weights is None else weights)
        self.waiting += len(codes)
        if self.waiting > max(4096, 2 * self.most):
            self._fold()

    def add_packed(self, data: bytes) -> None:
        if (codes := listed(data)) is not None:
            self.add(*codes)
        else:
            self.sketch = unpack(data) if self.sketch is None else self.sketch + unpack(data)

    def _fold(self) -> None:
        codes, weights = np.concatenate(self.codes), np.concatenate(self.weights)
        if self.sketch is None:
            found, at = np.unique(codes, return_inverse=True)
            if len(found) <= self.most:  # many rows of few codes stay a list
                self.codes, self.weights, self.waiting = [found], [np.bincount(at, weights, len(found))], len(found)
                return
            self.sketch = np.zeros(SIZE, np.int64)
        update(self.sketch, codes, None if (weights == 1).all() else weights)
        self.codes, self.weights, self.waiting = [], [], 0

    def pack(self) -> bytes:
        if self.sketch is None and (few := pack_codes(np.concatenate(self.codes), np.concatenate(self.weights), self.most)) is not None:
            return few
        if self.codes:
            self._fold()
        return pack(self.sketch)


def merged(sketches: list[bytes], most: int = LISTED_CODES) -> bytes:
    """The sum of packed sketches and lists."""
    total = Collected(most)
    for s in sketches:
        total.add_packed(s)
    return total.pack()


def _builder(groups: list[str], schema: pa.Schema, weighted: bool, most: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live: dict[tuple, Collected] = {}

        def flush() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in live], schema.field(i).type) for i in range(len(groups))]
            out = pa.RecordBatch.from_arrays([*columns, pa.array([s.pack() for s in live.values()], pa.binary())], schema=schema)
            live.clear()
            return out

        def take(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            ids, names = np.zeros(t.num_rows, np.int64), []
            for g in groups:
                coded = pc.dictionary_encode(t[g], null_encoding="encode").combine_chunks()
                coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
                names.append(coded.dictionary.to_pylist())
                ids = ids * len(names[-1]) + coded.indices.to_numpy()
            codes, order = encode(t["_value"].to_numpy()), np.argsort(ids, kind="stable")
            weights = t["_weight"].to_numpy()[order] if weighted else None
            codes, ids = codes[order], ids[order]
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(ids)]):
                key, rest = [], int(ids[a])
                for known in reversed(names):
                    rest, i = divmod(rest, len(known))
                    key.append(known[i])
                key = tuple(reversed(key))
                if key not in live and len(live) >= _LIVE_SKETCHES:
                    yield flush()
                if key not in live:
                    live[key] = Collected(most)
                live[key].add(codes[a:b], None if weights is None else weights[a:b])

        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= _BUFFER_ROWS:
                yield from take(held)
                held, rows = [], 0
        if held:
            yield from take(held)
        if live:
            yield flush()

    return build


def build_sketches(df: DataFrame, groups: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Partial sketches of ``df`` as it is partitioned: groups and ``sketch`` BINARY.

    Each partition gives a sketch or a few per group; they are to be merged.
    Null, NaN, infinite, zero and negative values take no part. ``weight``
    (BIGINT) counts a row that many times, negative to delete it. Nulls in
    groups are a group. A clash of names with ``value`` or ``weight`` is of
    no matter; an empty table gives no sketches.
    """
    ship(df.sparkSession)
    v = F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(v) & (v > 0) & (v < float("inf")))
    columns = [*groups, v.alias("_value"), *([F.col(weight).cast("bigint").alias("_weight")] if weight else [])]
    out = T.StructType([*[df.schema[g] for g in groups], T.StructField("sketch", T.BinaryType())])
    return rows.select(*columns).mapInArrow(_builder(groups, to_arrow_schema(out), weight is not None, LISTED_CODES), out)


def _folder(n_keys: int, schema: pa.Schema, most: int, ps: list[float] | None):
    """Streaming sum of the sketches of equal keys, which follow each other; packed, or read at ``ps``."""

    def packed(keys: list[tuple], done: list[bytes]) -> pa.RecordBatch:
        columns = zip(*keys)
        return pa.RecordBatch.from_arrays([*[pa.array(c, f.type) for c, f in zip(columns, schema)], pa.array(done, pa.binary())], schema=schema)

    def values(keys: list[tuple], done: list[bytes]) -> pa.RecordBatch:
        m, at = len(ps), np.array(ps)
        out, rows, errors = np.zeros((len(keys), m)), np.zeros(len(keys), np.int64), np.zeros(len(keys))
        codes = np.full((len(keys), m), -1)
        few = np.array([d[:1] == b"c" for d in done])
        for i, data in enumerate(done):
            if few[i]:
                rows[i], codes[i] = _read_listed(np.frombuffer(data, _LISTED, offset=2), at)
            else:
                rows[i], errors[i], out[i] = read(data, ps)
        out[few] = np.where(codes[few] < 0, np.nan, decode(codes[few]))
        times = np.repeat(np.arange(len(keys)), m)
        columns = [pa.array(c, f.type).take(pa.array(times)) for c, f in zip(zip(*keys), schema)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(at, len(keys))), pa.array(out.ravel()), pa.array(rows[times]), pa.array(errors[times])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        only: bytes | None = None  # the one sketch so far of the key
        total: Collected | None = None
        keys: list[tuple] = []
        done: list[bytes] = []
        size = 0

        def close() -> None:
            nonlocal size
            keys.append(key)
            done.append(only if total is None else total.pack())
            size += len(done[-1])

        def emit() -> pa.RecordBatch:
            nonlocal size
            out = (packed if ps is None else values)(keys, done)
            keys.clear()
            done.clear()
            size = 0
            return out

        for batch in batches:
            for *at, data in zip(*[batch.column(i).to_pylist() for i in range(n_keys + 1)]):
                at = tuple(at)
                if key is None or at != key:
                    if key is not None:
                        close()
                        if size > 16 << 20 or len(keys) >= 20_000:
                            yield emit()
                    key, only, total = at, data, None
                    continue
                if total is None:
                    total = Collected(most)
                    total.add_packed(only)
                total.add_packed(data)
        if key is not None:
            close()
            yield emit()

    return run


_READ = "percentile double, value double, n_rows bigint, rank_error double"


def merge_sketches(df: DataFrame, groups: list[str], most: int = LISTED_CODES, ps: list[float] | None = None) -> DataFrame:
    """One sketch per group: the sum of its sketches, or its percentiles ``ps`` (with value, n_rows, rank_error).

    The sketches of a group are added one after the other as they arrive,
    sorted by group, so a task holds one sketch whatever their number.
    """
    ship(df.sparkSession)
    out = T.StructType([*[df.schema[g] for g in groups], *(T.StructType.fromDDL(_READ) if ps else [T.StructField("sketch", T.BinaryType())])])
    together = df.select(*groups, "sketch").repartition(*groups).sortWithinPartitions(*groups)
    return together.mapInArrow(_folder(len(groups), to_arrow_schema(out), most, ps), out)


def percentiles(sketch: Column, ps: list[float]) -> Column:
    """ARRAY<STRUCT<percentile, value, n_rows, rank_error>> of a sketch column."""

    @F.pandas_udf(f"array<struct<{_READ}>>")
    def of(sketches: pd.Series) -> pd.Series:
        out = []
        for data in sketches:
            n, error, values = read(data, ps)
            out.append([{"percentile": p, "value": v, "n_rows": n, "rank_error": error} for p, v in zip(ps, values)])
        return pd.Series(out)

    return of(sketch)


def _both_builder(groups: list[str], schema: pa.Schema, most: int, fan: int):
    """Sketches by groups (``_fine`` false) and by the last input column before the value, along which rows are sorted."""
    n = len(groups)
    daily = _builder(groups, pa.schema([*list(schema)[2 : 2 + n], schema.field(len(schema) - 1)]), False, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() % fan
        fine: list[tuple] = []
        open_key: list = []
        open_rows: Collected | None = None
        fine_type = schema.field(2 + n).type

        def fine_batch() -> pa.RecordBatch:
            m = len(fine)
            out = [pa.array([True] * m), pa.array([0] * m, pa.int32()), *[pa.nulls(m, schema.field(2 + i).type) for i in range(n)]]
            out += [pa.array([k for k, _ in fine], fine_type), pa.array([d for _, d in fine], pa.binary())]
            fine.clear()
            return pa.RecordBatch.from_arrays(out, schema=schema)

        def take(held: list[pa.RecordBatch]) -> None:
            nonlocal open_rows
            t = pa.Table.from_batches(held).combine_chunks()
            coded = pc.dictionary_encode(t.column(n), null_encoding="encode").combine_chunks()
            coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
            names, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
            both, counts = np.unique(ids << BITS | encode(t["_value"].to_numpy()), return_counts=True)
            ids, rows = both >> BITS, np.zeros(len(both), _LISTED)
            rows["code"], rows["weight"] = both & ((1 << BITS) - 1), counts
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            ends = np.r_[starts[1:], len(ids)]
            last = len(starts) - 1
            for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                key, own = names[k], rows[a:b]
                if open_rows is not None and open_key[0] == key:
                    open_rows.add(own["code"].astype(np.int64), own["weight"])
                elif k < last and b - a <= most:
                    fine.append((key, b"c-" + own.tobytes()))
                    continue
                else:
                    if open_rows is not None:
                        fine.append((open_key[0], open_rows.pack()))
                    open_key[:], open_rows = [key], Collected(most)
                    open_rows.add(own["code"].astype(np.int64), own["weight"])

        def whole() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield batch

        held: list[pa.RecordBatch] = []
        rows = 0
        waiting: list[pa.RecordBatch] = []

        def watched() -> Iterator[pa.RecordBatch]:
            """Batches on their way to the daily sketches, read by the finer grain too."""
            nonlocal held, rows
            for batch in whole():
                held.append(batch)
                rows += batch.num_rows
                if rows >= _BUFFER_ROWS:
                    take(held)
                    held, rows = [], 0
                    if len(fine) > 10_000:
                        waiting.append(fine_batch())
                yield batch.select([*range(n), n + 1])
            if held:
                take(held)
            if open_rows is not None:
                fine.append((open_key[0], open_rows.pack()))

        for out in daily(watched()):
            m = out.num_rows
            columns = [pa.array([False] * m), pa.array([part] * m, pa.int32()), *out.columns[:n], pa.nulls(m, fine_type), out.columns[n]]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
            while waiting:
                yield waiting.pop()
        while waiting:
            yield waiting.pop()
        if fine:
            yield fine_batch()

    return run


def daily_percentiles(df: DataFrame, key: str, groups: list[str], day: str, value: str, ps: list[float], fine: str | None = None, most: int = LISTED_CODES) -> DataFrame:
    """Percentiles per group for every day and, merged from the days' sketches, for all days.

    ``fine`` names a column of many values (other than those of ``groups``)
    for each of which the percentiles of all days come out as well. Rows
    with the same ``key`` are deliveries of one row (equal in the columns
    used) and count once. Null, NaN, infinite, zero and negative values
    take no part; null is a group, a day and a value of ``fine`` like any
    other; an empty table gives no rows; other columns are ignored.

    Rows go to tasks by ``fine`` with the keys of many rows cut by load
    (without ``fine``: a day spread over several tasks by the hash of the
    key), so one exchange serves the removal of repeats and the sketches of
    both grains, and only sketches move afterwards. The sketches of a group
    and day are added in two levels, by about the square root of the number
    of tasks each.

    Result: groups, ``fine``, ``all_days``, ``day`` (null: all days),
    ``percentile``, ``value``, ``n_rows``, ``rank_error``; rows of the finer
    grain have nulls in groups and ``is_fine`` is true.
    """
    spark = df.sparkSession
    ship(spark)
    kind = df.schema[day].dataType
    v = F.col(value).cast("double")
    positive = df.where(F.col(value).isNotNull() & ~F.isnan(v) & (v > 0) & (v < float("inf")))
    named = [F.col(g).alias(f"_g{i}") for i, g in enumerate([*groups, day])]
    names = [f"_g{i}" for i in range(len(groups) + 1)]
    if fine is None:
        spread = max(4, parallelism(spark) // 4)
        rows = positive.select(*named, F.col(key).alias("_id"), v.alias("_v")).withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(spread)))
        built = build_sketches(rows.repartition(names[-1], "_salt").distinct(), names, "_v")
        day_sketches = merge_sketches(built, names, most)
        finer = None
    else:
        plan = plan_fragments(positive, fine)
        rows = plan.route(positive.select(*named, F.col(key).alias("_id"), F.col(fine).alias("_fine"), v.alias("_value")), "_fine", ["_id"])
        rows = rows.repartitionById(plan.n_tasks, F.col("_fragment_task"))
        sorted_rows = rows.distinct().select(*names, "_fine", "_value").sortWithinPartitions("_fine")
        out = T.StructType(
            [T.StructField("_is_fine", T.BooleanType()), T.StructField("_part", T.IntegerType()), *[rows.schema[c] for c in [*names, "_fine"]], T.StructField("sketch", T.BinaryType())]
        )
        fan = int(np.ceil(np.sqrt(plan.n_tasks)))
        built = Stage(spark, "sketches").write(sorted_rows.mapInArrow(_both_builder(names, to_arrow_schema(out), most, fan), out), "built")
        part = merge_sketches(built.where("NOT _is_fine"), [*names, "_part"], most)
        day_sketches = merge_sketches(part, names, most)
        finer = merge_sketches(built.where("_is_fine"), ["_fine"], most, ps)
    pair = lambda every, d: F.struct(F.lit(every).alias("every"), d.cast(kind).alias("d"))
    both = day_sketches.withColumn("_day", F.explode(F.array(pair(False, F.col(names[-1])), pair(True, F.lit(None)))))
    both = both.select(*names[:-1], F.col("_day.every").alias("all_days"), F.col("_day.d").alias("_d"), "sketch")
    found = merge_sketches(both, [*names[:-1], "all_days", "_d"], most, ps)
    of = [F.col(f"_g{i}").alias(g) for i, g in enumerate(groups)]
    read_columns = ["percentile", "value", "n_rows", "rank_error"]
    if finer is None:
        return found.select(*of, "all_days", F.col("_d").alias(day), *read_columns)
    none = [F.lit(None).cast(df.schema[g].dataType).alias(g) for g in groups]
    coarse = found.select(F.lit(False).alias("is_fine"), *of, F.lit(None).cast(df.schema[fine].dataType).alias(fine), "all_days", F.col("_d").alias(day), *read_columns)
    return coarse.unionAll(finer.select(F.lit(True).alias("is_fine"), *none, F.col("_fine").alias(fine), F.lit(True).alias("all_days"), F.lit(None).cast(kind).alias(day), *read_columns))
