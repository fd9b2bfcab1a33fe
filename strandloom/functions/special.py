"""Special functions of test statistics in numpy (no scipy needed): Student t, normal, Kolmogorov."""

from __future__ import annotations

import math

import numpy as np


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated forwards (Lentz)."""
    d = 1 / (1 - (a + b) * x / (a + 1))
    c, h = 1.0, d
    for m in range(1, 100_000):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + k * d), 1 + k / c
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    return front * _fraction(a, b, x)


def student_t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-value of Student's t; NaN where t or df is."""
    out = np.full(len(t), np.nan)
    for i, (x, n) in enumerate(zip(t, df)):
        if x == x and n == n and n > 0:
            out[i] = incomplete_beta(n / 2, 0.5, n / (n + x * x)) if math.isfinite(x) else 0.0
    return out


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(abs(x) / math.sqrt(2)) if x == x else math.nan for x in z])


def kolmogorov_two_sided(d: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Asymptotic p-value of a two-sample distance ``d`` with effective size n = na nb / (na + nb)."""
    out = []
    for x, m in zip(d, n):
        if x != x or m != m or m <= 0:
            out.append(math.nan)
            continue
        lam = (math.sqrt(m) + 0.12 + 0.11 / math.sqrt(m)) * x
        p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * lam) ** 2) for k in range(1, 101)) if lam > 0.2 else 1.0
        out.append(min(1.0, max(0.0, p)))
    return np.array(out)


def richards(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Five-parameter logistic: lower, upper, slope, midpoint, asymmetry (log)."""
    low, high, slope, mid, asym = p
    z = np.clip(-slope * (x - mid), -500, 500)
    return low + (high - low) / (1 + np.exp(z)) ** np.exp(np.clip(asym, -3, 3))


def fit_richards(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Least-squares fit by damped Gauss-Newton steps (Levenberg-Marquardt); parameters and R squared."""
    span = float(x.max() - x.min()) or 1.0
    rising = 1.0 if np.corrcoef(x, y)[0, 1] >= 0 else -1.0
    p = np.array([y.min(), y.max(), rising * 4 / span, float(np.median(x)), 0.0])
    if rising < 0:
        p[[0, 1]], p[2] = p[[1, 0]], -p[2]
    damp, r = 1e-2, y - richards(x, p)
    for _ in range(rounds):
        step = np.maximum(1e-6, np.abs(p) * 1e-6)
        jac = np.stack([(richards(x, p + h * np.eye(5)[i]) - richards(x, p - h * np.eye(5)[i])) / (2 * h) for i, h in enumerate(step)], axis=1)
        a, g = jac.T @ jac, jac.T @ r
        new = p + np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), g, rcond=None)[0]
        nr = y - richards(x, new)
        if nr @ nr < r @ r:
            done = r @ r - nr @ nr < 1e-14 * max(1e-300, r @ r)
            p, r, damp = new, nr, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    total = float(((y - y.mean()) ** 2).sum())
    return p, 1 - float(r @ r) / total if total > 0 else float("nan")
