"""Filling containers of fixed capacity by harmonic packing.

An item of size s is in class j = capacity // s: j such items fit one
container, so a worker closes a container of class j after exactly j items
and keeps at most one open per class. Classes from ``CLASSES`` on hold the
small items; they fill what closed containers leave unused, the largest
that fits first, and then containers of their own. An item beyond the
capacity is cut into full containers and a remainder; nothing else is cut.
Every worker packs its own partition in blocks of bounded size with no
exchange between workers; what is left open at the end of a partition (less
than one container per class and the rest of a block's small items) is put
together largest first.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandloom.session import ship

CLASSES = 16
BLOCK_ITEMS = 50_000
PARTITION_SHIFT = 40


class Packer:
    """One worker's containers. Items are (row, piece, pieces, size); ``out`` gets (row, piece, pieces, size, container)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: list[list[tuple]] = [[] for _ in range(CLASSES)]  # class -> items of its open container
        self.small: list[tuple] = []
        self.next = 0
        self.out: list[tuple] = []

    def _container(self, items: list[tuple]) -> tuple[int, int]:
        """Close a container; its number and unused space."""
        at = self.next
        self.next += 1
        self.out += [(*item, at) for item in items]
        return at, self.capacity - sum(i[3] for i in items)

    def block(self, rows: list, sizes: np.ndarray, last: bool = False) -> list[tuple]:
        """Pack a block of items; what comes out is final."""
        spare: list[tuple[int, int]] = []
        c = self.capacity
        nothing: list[tuple] = []
        for row, size in zip(rows, sizes.tolist()):
            if size <= 0:
                nothing.append((row, 0, 1, 0))
                continue
            full, rest = (size // c, size % c) if size > c else (0, size)
            pieces = full + (rest > 0)
            for k in range(full):
                self._container([(row, k, pieces, c)])
            if rest:
                item, j = (row, full, pieces, rest), c // rest
                if j >= CLASSES:
                    self.small.append(item)
                else:
                    self.open[j].append(item)
                    if len(self.open[j]) == j:
                        spare.append(self._container(self.open[j]))
                        self.open[j] = []
        self.small.sort(key=lambda i: i[3])
        keys = [i[3] for i in self.small]
        for at, free in spare:
            self._fill(at, free, keys)
        if last:
            self._rest(keys)
        else:
            while len(keys) > BLOCK_ITEMS // 10:  # some small items stay for the next block
                self._fill(*self._container([]), keys)
        if nothing:
            if not self.next:
                self._container([])
            self.out += [(*item, 0) for item in nothing]
        done, self.out = self.out, []
        return done

    def _fill(self, at: int, free: int, keys: list[int]) -> None:
        while (k := bisect_right(keys, free) - 1) >= 0:
            item = self.small.pop(k)
            free -= keys.pop(k)
            self.out.append((*item, at))

    def _rest(self, keys: list[int]) -> None:
        """Largest first into the first container with room; less than a container per class, then the small items."""
        bins: list[list] = []
        for item in sorted((i for group in self.open for i in group), key=lambda i: -i[3]):
            room = next((b for b in bins if b[1] >= item[3]), None)
            if room is None:
                bins.append(room := [[], self.capacity])
            room[0].append(item)
            room[1] -= item[3]
        for items, _ in bins:
            self._fill(*self._container(items), keys)
        while keys:
            self._fill(*self._container([]), keys)
        self.open = [[] for _ in range(CLASSES)]


def pack_containers(df: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """Assign every item to containers of ``capacity``.

    Result: ``key``, ``piece`` (0-based), ``n_pieces``, ``n_tokens`` of the
    piece, ``container`` BIGINT (partition number and running number). Only
    an item larger than ``capacity`` has more than one piece. Items of
    size 0, null or less take no space and come out in a container of
    their partition, with 0 tokens. One piece or more per input row:
    repeated and null keys are items of their own. No shuffle; an empty
    table gives no rows; other columns are ignored.
    """
    if capacity < CLASSES:
        raise ValueError(f"capacity must be at least {CLASSES}")
    ship(df.sparkSession)
    schema = T.StructType(
        [df.schema[key], T.StructField("piece", T.IntegerType(), False), T.StructField("n_pieces", T.IntegerType(), False), T.StructField("n_tokens", T.LongType(), False), T.StructField("container", T.LongType(), False)]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(capacity), TaskContext.get().partitionId() << PARTITION_SHIFT

        def emit(done: list[tuple]) -> pa.RecordBatch:
            row, piece, pieces, tokens, container = zip(*done)
            numbers = [pa.array(x, k) for x, k in ((piece, pa.int32()), (pieces, pa.int32()), (tokens, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array(row, arrow.field(0).type), *numbers, pa.array(np.array(container, np.int64) + base)], schema=arrow)

        rows: list = []
        sizes: list[np.ndarray] = []
        for batch in batches:
            rows += batch.column(0).to_pylist()
            sizes.append(batch.column(1).to_numpy(zero_copy_only=False))
            if len(rows) >= BLOCK_ITEMS:
                if done := packer.block(rows, np.concatenate(sizes)):
                    yield emit(done)
                rows, sizes = [], []
        if done := packer.block(rows, np.concatenate(sizes) if sizes else np.zeros(0, np.int64), last=True):
            yield emit(done)

    return df.select(key, F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("_size")).mapInArrow(run, schema)
