"""Numeric column expressions with the exact rounding and null rules of the analysis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_even(c: Column | str, digits: int) -> Column:
    """Round half to even on the scaled double (not HALF_UP as ``round`` does)."""
    return F.rint(col(c) * 10.0**digits) / 10.0**digits


def clean_number(c: Column | str) -> Column:
    """Double with NaN and infinities as null; text that is no number is null."""
    d = col(c).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def log2_to_probability(c: Column | str) -> Column:
    """-1000 log2 units to a probability; null or infinite (written ``*``) is 0."""
    x = col(c)
    return F.when(x.isNull() | (x == float("inf")), F.lit(0.0)).otherwise(F.pow(F.lit(2.0), -x / 1000.0))


def guarded_divide(a: Column | str, b: Column | str) -> Column:
    """a / b; null where b is 0 or null."""
    return F.when(col(b) != 0, col(a) / col(b))


def clip(c: Column | str, low: float, high: float) -> Column:
    """Into [low, high]; null stays null."""
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), F.lit(low)), F.lit(high)))


def parse_bool(c: Column | str) -> Column:
    """true, 1, yes, y and t in any case are true; null is false."""
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin("true", "1", "yes", "y", "t"), F.lit(False))


def novelty(c: Column | str) -> Column:
    """Three-state flag: ``true``, ``false`` or ``na``."""
    s = F.lower(F.trim(col(c).cast("string")))
    return F.when(s.isin("true", "1", "yes", "y", "t"), "true").when(s.isin("false", "0", "no", "n", "f"), "false").otherwise("na")


def bands(c: Column | str, edges: list[tuple[float, str]], last: str) -> Column:
    """The label of the first edge the value lies below, else ``last``; null stays null."""
    x = col(c)
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for edge, label in edges:
        out = out.when(x < edge, label)
    return out.otherwise(last)


def interval_overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Length of the intersection of two closed intervals, 0 if apart; null if an end is null."""
    ok = a1.isNotNull() & a2.isNotNull() & b1.isNotNull() & b2.isNotNull()
    return F.when(ok, F.greatest(F.lit(0), F.least(a2, b2) - F.greatest(a1, b1) + 1))


def unordered(a: Column | str, b: Column | str) -> list[Column]:
    """The pair in string order; both null if either is (``least`` would skip a null)."""
    a, b = col(a), col(b)
    ok = a.isNotNull() & b.isNotNull()
    return [F.when(ok, F.least(a, b)), F.when(ok, F.greatest(a, b))]


def shannon_entropy(p: Column | str) -> Column:
    """Entropy (nats) of an array of weights, renormalised over the positive ones; null if there are none."""
    pos = F.filter(col(p), lambda x: x > 0)
    total = F.aggregate(pos, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.aggregate(pos, F.lit(0.0), lambda s, x: s - x / total * F.log(x / total)))


def relative_entropy(p: Column | str, q: Column | str) -> Column:
    """Sum p ln(p/q) of two arrays after renormalising both; terms with a zero on either side don't count."""
    p, q = col(p), col(q)
    tp = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    tq = F.aggregate(q, F.lit(0.0), lambda s, x: s + x)
    term = lambda a, b: F.when((a > 0) & (b > 0), a / tp * F.log((a / tp) / (b / tq))).otherwise(F.lit(0.0))
    return F.when((tp > 0) & (tq > 0), F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda s, x: s + x))
