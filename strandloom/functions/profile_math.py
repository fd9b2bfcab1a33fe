"""Windows of a profile as small Markov models and their divergence, in numpy.

A window of k match states has m = 3k + 1 states I0, M1, D1, I1, ... Mk,
Dk, Ik. Symbol 21 stands for silence: only deletions emit it.
"""

from __future__ import annotations

import numpy as np

SYMBOLS = 21
TOO_FAR = 1000.0
# Order of the seven transition columns of a profile: M->M, M->I, M->D, I->M, I->I, D->M, D->D.
MM, MI, MD, IM, II, DM, DD = range(7)


def window_tensors(transitions: np.ndarray, emissions: np.ndarray, null: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start vectors (n, m), transition matrices (n, m, m) and emissions (n, m, 21) of all n = L - k + 1 windows.

    ``transitions`` is (L + 1, 7) (row 0 leads to the first match state),
    ``emissions`` (L, 20), ``null`` (20). A window at w uses transition rows
    w..w+k and emissions w..w+k-1 and starts in its first match state.
    """
    length = len(emissions)
    n, m = max(0, length - k + 1), 3 * k + 1
    pi, a, b = np.zeros((n, m)), np.zeros((n, m, m)), np.zeros((n, m, SYMBOLS))
    if not n:
        return pi, a, b
    pi[:, 1] = 1.0
    rows = np.arange(n)[:, None] + np.arange(k + 1)
    t = transitions[rows]  # (n, k + 1, 7)
    match = lambda s: 3 * s - 2
    ins, dele = (lambda s: 3 * s), (lambda s: 3 * s - 1)
    into = np.where(t[:, 0, IM] == 0, 0.01, t[:, 0, IM])
    total = t[:, 0, II] + into
    ok = (t[:, 0, II] + t[:, 0, IM]) > 0
    a[:, 0, 0] = np.where(ok, t[:, 0, II] / total, 0.0)
    a[:, 0, match(1)] = np.where(ok, into / total, 0.0)
    for s in range(1, k + 1):
        if s < k:
            a[:, match(s), match(s + 1)] = t[:, s, MM]
            a[:, match(s), dele(s + 1)] = t[:, s, MD]
            a[:, ins(s), match(s + 1)] = t[:, s, IM]
            a[:, dele(s), match(s + 1)] = t[:, s, DM]
            a[:, dele(s), dele(s + 1)] = t[:, s, DD]
        a[:, match(s), ins(s)] = t[:, s, MI]
        a[:, ins(s), ins(s)] = t[:, s, II]
    e = emissions[np.arange(n)[:, None] + np.arange(k)]  # (n, k, 20)
    b[:, 0, :20] = null
    for s in range(1, k + 1):
        b[:, match(s), :20] = e[:, s - 1]
        b[:, ins(s), :20] = null
        b[:, dele(s), 20] = 1.0
    return pi, a, b


def factors(pi: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """What one side brings to the products: visits times emissions, logarithms, and where there is a value."""
    n, m = pi.shape
    eye = np.eye(m)
    try:
        visits = np.linalg.solve((eye - a).transpose(0, 2, 1), pi[:, :, None])[:, :, 0]  # pi (I - A)^-1, all windows at once
    except np.linalg.LinAlgError:
        visits = pi.copy()
        for i in range(n):
            try:
                visits[i] = np.linalg.solve((eye - a[i]).T, pi[i])
            except np.linalg.LinAlgError:
                pass
    c = np.concatenate([(a @ b), (pi[:, None, :] @ b)], axis=1)  # rows of A B, and pi B once
    weight = np.concatenate([visits, np.ones((n, 1))], axis=1)[:, :, None]
    with np.errstate(divide="ignore"):
        log = np.where(c > 0, np.log(np.where(c > 0, c, 1.0)), 0.0)
    flat = lambda x: x.reshape(n, x.shape[1] * x.shape[2])
    return {"c": flat(weight * c), "clog": flat(weight * c * log), "log": flat(log), "there": flat((c > 0).astype(float))}


def divergence_matrix(one: tuple, two: tuple) -> np.ndarray:
    """Symmetric divergence of all windows of two profiles, (n1, n2), by four matrix products.

    Terms in which either probability is 0 don't count; what is not finite,
    negative or above 1000 is 1000.
    """
    return divergence_of(factors(*one), factors(*two))


def divergence_of(f: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> np.ndarray:
    """``divergence_matrix`` of sides whose factors are known."""

    def directed(p: dict, q: dict) -> np.ndarray:
        return p["clog"] @ q["there"].T - p["c"] @ q["log"].T

    # a term counts only where the first side has a value too; c is 0 there already
    d = (directed(f, g) + directed(g, f).T) / 2
    d[np.abs(d) < 1e-12] = 0.0
    return np.where(np.isfinite(d) & (d >= 0) & (d <= TOO_FAR), d, TOO_FAR)


def sliding_background(values: np.ndarray, k: int) -> np.ndarray:
    """Mean of every k values in a row by prefix sums, rounded to 4 digits."""
    if len(values) < k:
        return np.zeros(0, np.float32)
    s = np.concatenate([[0.0], np.cumsum(values)])
    return np.round((s[k:] - s[:-k]) / k, 4).astype(np.float32)
