"""Detection: hand-made cases and brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import profile_math as M
from strandloom.operators import divergence as D
from strandloom.operators import paths as P
from strandloom.operators import pipelines as K


def test_end_to_end(spark):
    """Three families, points of 1.0 on the diagonals of 12 windows, everything covered: three final paths."""
    points = spark.createDataFrame([(i, j, r, c, 1.0 if r == c else 3.0) for i, j in ((0, 1), (0, 2), (1, 2)) for r in range(1, 13) for c in range(1, 13)], "i int, j int, row int, col int, raw double")
    background = spark.createDataFrame([(f, p, 1.0) for f in range(3) for p in range(1, 13)], "family int, pos int, bg float")
    names = spark.createDataFrame([(f, f"PF0000{f}") for f in range(3)], "family int, name string")
    coverage = spark.createDataFrame([(f"PF0000{f}", p, 1.0) for f in range(3) for p in range(1, 40)], "family string, pos int, frac double")
    got = K.detect(points, background, names, coverage).orderBy("main_hmm", "sub_hmm").collect()
    assert [(r["main_hmm"], r["sub_hmm"]) for r in got] == [("PF00000", "PF00001"), ("PF00000", "PF00002"), ("PF00001", "PF00002")]
    for r in got:
        assert (r["main_segment"], r["main_segment_len"], r["n_points"]) == ("1-17", 17, 12)
        assert r["avg_similarity"] == pytest.approx(39.996, abs=1e-4) and r["original_score"] == pytest.approx(2.6812, abs=1e-4)
        assert r["score"] == pytest.approx(1.602, abs=1e-4) and r["coverage_main"] == 1.0 == r["coverage_sub"]


def test_path_metrics(spark):
    t = spark.createDataFrame([(0, 1, 1, 2, 10.0), (0, 1, 2, 3, 20.0), (0, 1, 3, 4, 30.0)], "i int, j int, row int, col int, linear double")
    r = P.chain_metrics(P.chain_points(t, 6), 6).first()
    assert (r["n_points"], r["main_len"], r["sub_len"], r["avg_similarity"], r["is_gapped"], r["total"]) == (3, 8, 8, 20.0, False, 60.0)


def slow_paths(points, k):
    """Nearest predecessor on the diagonal, first successor followed, as stated."""
    nxt = {}
    for x, y in sorted(points):
        for dlt in range(1, k):
            if (x - dlt, y - dlt) in points:
                nxt.setdefault((x - dlt, y - dlt), []).append((x, y))
                break
    heads = set(points) - {q for v in nxt.values() for q in v}
    out = []
    for h in heads:
        c = [h]
        while c[-1] in nxt:
            c.append(sorted(nxt[c[-1]])[0])
        out.append(tuple(c))
    return sorted(out)


@pytest.mark.parametrize("k", [2, 3, 6])
def test_chains_against_nearest_predecessor(spark, k):
    rng = random.Random(k)
    pts = {(rng.randint(1, 30), rng.randint(1, 30)) for _ in range(250)}
    t = spark.createDataFrame([(0, 0, x, y) for x, y in pts], "i int, j int, row int, col int")
    got = {}
    for r in P.chain_points(t, k).collect():
        got.setdefault(r["chain"], []).append((r["row"], r["col"]))
    want = slow_paths(pts, k)
    assert sorted(tuple(sorted(c)) for c in got.values()) == want
    clean = sorted(c for c in want if not any((x, y + s) in pts for x, y in c for s in (1, -1)))
    assert [tuple(c) for c in P._chains(dict.fromkeys(pts, 1.0), k)] == clean
    near = {(r["row"], r["col"]) for r in P.mark_clean(t).where("has_neighbour").collect()}
    assert near == {(x, y) for x, y in pts if (x, y + 1) in pts or (x, y - 1) in pts}


def test_overlapping_chains():
    line = lambda x, y, n: [(x + i, y + i) for i in range(n)]
    # same x, shared ys: unclean; the short one goes but the group stays unclean
    clean, unclean = P._grouped([line(1, 1, 8), line(3, 7, 6), line(40, 1, 6)], 5, 0.1)
    assert clean == [line(40, 1, 6)] and unclean == [[line(1, 1, 8), line(3, 7, 6)]]
    # same x, different ys: both are clean
    assert P._grouped([line(1, 1, 8), line(1, 20, 8)], 5, 0.1) == ([line(1, 1, 8), line(1, 20, 8)], [])
    # below the limit of points nothing is left
    assert P._grouped([line(1, 1, 4)], 5, 0.1) == ([], [])
    # a chain that is unclean along the other axis is unclean
    pts = dict.fromkeys([*line(1, 1, 8), *line(20, 3, 8), *line(22, 30, 6)], 1.0)
    kinds = dict((tuple(c), ok) for ok, c in P.pair_paths(pts, 6, 5, 0.1, False))
    ys = [c for c in kinds]
    assert len(ys) == 3 and kinds[tuple(line(1, 1, 8))] and kinds[tuple(line(20, 3, 8))]
    assert P.needs_flip({(x, 1): 1.0 for x in range(5)}) and not P.needs_flip({(1, y): 1.0 for y in range(5)})


def test_segments_as_text(spark):
    t = spark.createDataFrame([([1, 2, 3, 9, 20],), ([5],)], "xs array<int>")
    got = [tuple(r) for r in t.select(P.detailed_segments("xs", 5), P.merged_segments("xs", 5)).collect()]
    assert got == [("1-8,9-14,20-25", "1-14,20-25"), ("5-10", "5-10")]


def naive_directed(one, two, p, q):
    (pi, a, b), (_, a2, b2) = (x for x in ((one[0][p], one[1][p], one[2][p]), (two[0][q], two[1][q], two[2][q])))
    c1, c2 = a @ b, a2 @ b2
    w = np.array([sum(x * math.log(x / y) for x, y in zip(r1, r2) if x > 0 and y > 0) for r1, r2 in zip(c1, c2)])
    d1, d2 = pi @ b, two[0][q] @ b2
    last = sum(x * math.log(x / y) for x, y in zip(d1, d2) if x > 0 and y > 0)
    return pi @ np.linalg.inv(np.eye(len(a)) - a) @ w + last


def profile(rng, n):
    t = rng.dirichlet(np.ones(7), n + 1)
    t[:, 3:5] = rng.dirichlet([1, 1], n + 1)
    t[:, 5:7] = rng.dirichlet([1, 1], n + 1)
    t[:, 0:3] = rng.dirichlet([1, 1, 1], n + 1)
    e = rng.dirichlet(np.ones(20), n)
    e[rng.random(e.shape) < 0.3] = 0
    return t, e, rng.dirichlet(np.ones(20))


def test_divergence_against_cell_by_cell():
    rng = np.random.default_rng(3)
    one, two = (M.window_tensors(*profile(rng, n), 3) for n in (9, 7))
    got = M.divergence_matrix(one, two)
    assert got.shape == (7, 5)
    for p in range(7):
        for q in range(5):
            want = (naive_directed(one, two, p, q) + naive_directed(two, one, q, p)) / 2
            want = want if 0 <= want <= 1000 else 1000.0
            assert got[p, q] == pytest.approx(want, rel=1e-9, abs=1e-9)
    assert np.allclose(np.diag(M.divergence_matrix(one, one)), 0)
    assert M.window_tensors(*profile(rng, 2), 3)[0].shape[0] == 0


def test_divergence_operator_and_background(spark):
    rng = np.random.default_rng(4)
    rows = []
    for f, n in ((0, 12), (1, 9), (2, 4)):
        t, e, b = profile(rng, n)
        rows.append((f, t.ravel().tolist(), e.ravel().tolist(), b.tolist()))
    df = spark.createDataFrame(rows, "family int, transitions array<double>, emissions array<double>, background array<double>")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 7)], "i int, j int")
    shape = lambda r: M.window_tensors(np.array(r[1]).reshape(-1, 7), np.array(r[2]).reshape(-1, 20), np.array(r[3]), 6)
    want = M.divergence_matrix(shape(rows[0]), shape(rows[1])).astype(np.float32)
    got = D.window_divergence(pairs, df, 6, block=3).collect()
    assert {(r["i"], r["j"]) for r in got} == {(0, 1)} and len(got) == want.size
    assert all(r["raw"] == want[r["row"] - 1, r["col"] - 1] for r in got)
    limit = float(np.median(want))
    kept = D.window_divergence(pairs, df, 6, keep_below=limit).count()
    assert kept == int((np.round(want.astype(float), 4) < limit).sum())
    s = spark.createDataFrame([(0, i, float(i)) for i in range(1, 9)], "family int, state int, v double")
    bg = {r["pos"]: r["bg"] for r in D.window_background(s, "family", "state", "v", 6).collect()}
    assert bg == {i + 1: float(x) for i, x in enumerate(M.sliding_background(np.arange(1.0, 9), 6))}


def test_rescore_edges(spark):
    cov = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 1.0), ("b", 5, 1.0)], "family string, pos int, frac double")
    t = spark.createDataFrame([(1, "a", "b", "1-2 -> 5-6", "100"), (2, "a", "zz", "1-1 -> 1-1; 2-2 -> 3-3", "100"), (3, "a", "b", "nonsense", "5"), (4, None, "b", "1-2 -> 5-5", "10"), (5, "a", "b", None, None), (6, "a", "b", "1-1 -> 5-5", "N/A (Overlap)")], "id int, m string, s string, d string, v string").withColumn("_n", F.lit(1))
    got = {r["id"]: r for r in P.rescore(t, cov, "id", "m", "s", "d", "v").collect()}
    assert (got[1]["coverage_main"], got[1]["coverage_sub"]) == (0.75, 0.5) and got[1]["rescored"] == pytest.approx(math.log10(100 * 0.625**2))
    assert (got[2]["coverage_main"], got[2]["coverage_sub"]) == (0.75, 0.0)
    assert got[3]["rescored"] is None and got[4]["coverage_main"] == 0.0 and got[5]["rescored"] is None and got[6]["rescored"] is None
