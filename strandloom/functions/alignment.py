"""Global alignment and superposition of what fits one row (numpy inside vectorised UDFs)."""

from __future__ import annotations

import numpy as np


def global_alignment(a: str, b: str, match: float = 1.0, mismatch: float = -1.0, gap: float = -1.0) -> list[tuple[int, int]]:
    """Aligned pairs of 0-based positions of a best global alignment (diagonal before a gap in ``b`` before one in ``a``)."""
    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    n, m = len(x), len(y)
    score = np.zeros((n + 1, m + 1))
    score[:, 0], score[0] = gap * np.arange(n + 1), gap * np.arange(m + 1)
    steps = gap * np.arange(m + 1)
    for i in range(1, n + 1):
        best = np.maximum(score[i - 1, :-1] + np.where(y == x[i - 1], match, mismatch), score[i - 1, 1:] + gap)
        row = np.concatenate(([score[i, 0]], best))
        score[i] = np.maximum.accumulate(row - steps) + steps  # runs of gaps along the row
    out, i, j = [], n, m
    while i and j:
        s = match if x[i - 1] == y[j - 1] else mismatch
        if np.isclose(score[i, j], score[i - 1, j - 1] + s):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif np.isclose(score[i, j], score[i - 1, j] + gap):
            i -= 1
        else:
            j -= 1
    return out[::-1]


def superposed_rmsd(p: np.ndarray, q: np.ndarray) -> float:
    """RMSD of paired coordinates after the best rigid superposition; NaN for fewer than 3 pairs."""
    if len(p) != len(q) or len(p) < 3:
        return float("nan")
    p, q = p - p.mean(0), q - q.mean(0)
    u, s, vt = np.linalg.svd(p.T @ q)
    s[-1] *= np.sign(np.linalg.det(u @ vt))
    return float(np.sqrt(max(0.0, (p**2).sum() + (q**2).sum() - 2 * s.sum()) / len(p)))
