"""Table functions for SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from strandloom.functions.text import PIECE
from strandloom.session import ship


class SegmentPieces:
    """One row (piece, ms, me, ss, se) per piece of a text ``a-b -> c-d; ...``; null gives none."""

    def eval(self, text: str) -> Iterator[tuple[int, int, int, int, int]]:
        for n, part in enumerate((text or "").split(";")):
            if m := re.search(PIECE, part):
                yield (n, *map(int, m.groups()))


class WindowStarts:
    """One row (start, end) per window of k states in a profile of the given length."""

    def eval(self, length: int, k: int) -> Iterator[tuple[int, int]]:
        for s in range(1, (length or 0) - (k or 0) + 2):
            yield s, s + k - 1


def register(spark: SparkSession) -> None:
    """``segment_pieces(text)`` and ``window_starts(length, k)`` for ``LATERAL`` in SQL; rows travel in Arrow batches."""
    ship(spark)
    spark.udtf.register("segment_pieces", udtf(SegmentPieces, returnType="piece: int, ms: int, me: int, ss: int, se: int", useArrow=True))
    spark.udtf.register("window_starts", udtf(WindowStarts, returnType="window_start: int, window_end: int", useArrow=True))
