"""Statistics, controls, windows and graphs against hand-made cases and brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import numeric as N
from strandloom.functions import special as X
from strandloom.functions.alignment import global_alignment, superposed_rmsd
from strandloom.operators import aggregates as A
from strandloom.operators import controls as C
from strandloom.operators import graph as G
from strandloom.operators import intervals as I
from strandloom.operators import joins as J
from strandloom.operators import statistics as S
from strandloom.operators import windows as W


def test_special_functions():
    grid = np.linspace(0, 1, 2_000_001)[1:-1]  # the upper tail, mapped to (0, 1) by x = t + u / (1 - u)

    def tail(t, n):
        x = t + grid / (1 - grid)
        log = math.lgamma((n + 1) / 2) - math.lgamma(n / 2) - 0.5 * math.log(n * math.pi) - (n + 1) / 2 * np.log1p(x * x / n)
        return 2 * np.trapezoid(np.exp(log) / (1 - grid) ** 2, grid)

    ts, dfs = np.array([2.0, 0.3, 2.5, 2.0, 3.0, math.nan]), np.array([10, 5, 3, 1000, 30, 3])
    p = X.student_t_two_sided(ts, dfs)
    assert np.allclose(p[:5], [tail(t, n) for t, n in zip(ts[:5], dfs[:5])], atol=1e-6) and math.isnan(p[5])
    assert X.student_t_two_sided(np.array([0.0, math.inf]), np.array([4, 4])).tolist() == [1.0, 0.0]
    assert X.normal_two_sided(np.array([1.959964]))[0] == pytest.approx(0.05, abs=1e-6)
    assert X.kolmogorov_two_sided(np.array([0.0, 1.0]), np.array([50.0, 50.0])) == pytest.approx([1.0, 0.0], abs=1e-9)
    x = np.linspace(0, 10, 40)
    true = np.array([1, 5, 1.3, 4, 0.5])
    fit, r2 = X.fit_richards(x, X.richards(x, true))
    assert r2 > 0.999999 and np.allclose(X.richards(x, fit), X.richards(x, true), atol=1e-4)
    assert X.fit_richards(x, X.richards(x, true)[::-1])[1] > 0.999


def test_alignment_and_superposition():
    assert global_alignment("ACDE", "ACE") == [(0, 0), (1, 1), (3, 2)]
    assert global_alignment("", "A") == [] and len(global_alignment("AAAA", "AAAA")) == 4
    rng = np.random.default_rng(1)
    p = rng.normal(size=(9, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q = q * np.sign(np.linalg.det(q))
    assert superposed_rmsd(p, p @ q + 5) == pytest.approx(0, abs=1e-6) and superposed_rmsd(p, -p) > 0.1
    assert math.isnan(superposed_rmsd(p[:2], p[:2]))


def test_rounding_and_guards(spark):
    x = np.random.default_rng(2).uniform(0, 3, 5000)
    t = spark.createDataFrame([(float(v),) for v in x], "v double")
    assert [r[0] for r in t.select(N.round_even("v", 4)).collect()] == np.round(x, 4).tolist()
    r = spark.sql("SELECT 1.0D AS a, 0.0D AS b, double('NaN') AS n, double('Infinity') AS i, CAST(NULL AS INT) AS z")
    assert tuple(r.select(N.guarded_divide("a", "b"), N.clean_number("n"), N.clean_number("i"), N.clip("z", 0, 1), N.interval_overlap(F.col("z"), F.lit(3), F.lit(1), F.lit(2)), *N.unordered("z", "a")).first()) == (None,) * 7


def test_fdr_and_ties(spark):
    ps = [0.01, 0.04, 0.03, 0.03, 0.5, None, float("nan")]
    df = spark.createDataFrame([(i, "g", p) for i, p in enumerate(ps)], "i int, g string, p double")
    got = {r["i"]: r["q"] for r in S.fdr(df, ["g"], "p").collect()}
    assert [got[i] and round(got[i], 6) for i in range(7)] == [0.05, 0.05, 0.05, 0.05, 0.5, None, None]


def test_interval_algebra(spark):
    rng = random.Random(3)
    make = lambda n: [(rng.choice("xy"), s := rng.randint(1, 300), s + rng.randint(0, 20)) for _ in range(n)]
    a, b = make(30), make(25)
    cover = lambda rows, k: {p for kk, s, e in rows if kk == k for p in range(s, e + 1)}
    da, db = (spark.createDataFrame(r, "k string, s int, e int") for r in (a, b))
    got = {r["k"]: (r["length_a"], r["length_b"], r["length_both"]) for r in I.intersect_sets(da, db, "k", "s", "e").collect()}
    assert got == {k: (len(cover(a, k)), len(cover(b, k)), len(cover(a, k) & cover(b, k))) for k in "xy"}
    both = {(r["k"], p) for r in I.intersection(da, db, "k", "s", "e").collect() for p in range(r["s"], r["e"] + 1)}
    assert both == {(k, p) for k in "xy" for p in cover(a, k) & cover(b, k)}
    depth = {(r["k"], r["position"]): r["depth"] for r in A.depth_track(da, "k", "s", "e").collect()}
    assert depth == {(k, p): sum(kk == k and s <= p <= e for kk, s, e in a) for k in "xy" for p in cover(a, k)}
    inside = J.points_in_intervals(spark.createDataFrame([("x", p) for p in range(1, 330)], "k string, pos int"), da, "k", "pos", "s", "e", 8)
    assert inside.count() == sum(e - s + 1 for k, s, e in a if k == "x")


def test_lanes(spark):
    rng = random.Random(4)
    rows = [("k", i, s := rng.randint(1, 80), s + rng.randint(0, 12)) for i in range(60)] + [("k", 99, None, 3)]
    got = {r["id"]: r["lane"] for r in W.lanes(spark.createDataFrame(rows, "k string, id int, s int, e int"), "k", "id", "s", "e").collect()}
    assert set(got) == set(range(60))
    for _, i, s, e in rows[:60]:
        assert not any(got[j] == got[i] and i != j and s <= e2 and s2 <= e for _, j, s2, e2 in rows[:60])
    busy = max(sum(s <= p <= e for _, _, s, e in rows[:60]) for p in range(1, 100))
    assert max(got.values()) + 1 == busy


def test_controls(spark):
    p = C.random_pairs(100, 500, "123", spark).collect()
    assert len(p) == 500 == len({tuple(r) for r in p}) and all(0 <= r["i"] < r["j"] < 100 for r in p)
    assert [tuple(r) for r in p] == [tuple(r) for r in C.random_pairs(100, 500, "123", spark).collect()]
    assert len(C.random_pairs(5, 10, "1", spark).collect()) == 10
    with pytest.raises(ValueError):
        C.random_pairs(5, 11, "1", spark)
    t = spark.createDataFrame([("a", 3), ("b", 50)], "id string, n int")
    w = C.random_windows(t, "id", F.col("n"), F.lit(1), F.lit(20), 200, "s").collect()
    assert {r["id"] for r in w} == {"a"} and {r["random_start"] for r in w} == set(range(1, 19))
    f = spark.createDataFrame([("a", 4, 6), ("a", 6, 15)], "id string, s int, e int")
    free = C.excluded_starts(t, "id", F.col("n"), F.lit(1), F.lit(20), f, "id", "s", "e", 10, "s").collect()
    assert {r["random_start"] for r in free} == {1, 16, 17, 18} and {r["random_n"] for r in free} == {4}


def test_permutation_test(spark):
    seg = spark.createDataFrame([(f"s{i}", "p", 10 * i + 1, 10 * i + 5) for i in range(5)], "id string, k string, s int, e int")
    blocks = spark.createDataFrame([("p", 1, 1000)], "k string, s int, e int")
    known = spark.createDataFrame([("p", 1, 60)], "k string, s int, e int")
    r = C.permutation_test(seg, blocks, known, "k", "id", "s", "e", 40, "1").first()
    assert r["observed"] == 1.0 and r["n"] == 40 and 0 < r["mean"] < 0.3 and r["p_ge"] == pytest.approx(1 / 41) and r["p_le"] == 1.0


def brute_components(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_components(spark, shape):
    rng = random.Random(5)
    pairs = {"random": [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(220)], "chain": [(i, i + 1) for i in range(120)], "star": [(500, i) for i in range(200)]}[shape]
    pairs = [p for p in pairs if p[0] != p[1]]
    got = {r["node"]: r["component"] for r in G.components(spark.createDataFrame(pairs + pairs[:9], "a int, b int"), "a", "b").collect()}
    assert got == brute_components(pairs)


def test_communities(spark):
    rng = random.Random(6)
    block = [(a, b) for c in range(4) for a in range(c * 8, c * 8 + 8) for b in range(a + 1, c * 8 + 8)]
    e = spark.createDataFrame([(f"n{a:02}", f"n{b:02}", 1.0) for a, b in block] + [(f"n{c * 8:02}", f"n{c * 8 + 9:02}", 0.05) for c in range(3)], "a string, b string, w double")
    best = G.best_communities(e, "a", "b", "w", 0.05)
    labels = {r["node"]: r["community"] for r in best.collect()}
    q = G.modularity(e, best, "a", "b", "w").first()["modularity"]
    assert q > 0.6 and len(set(labels.values())) <= 6
    ranked = G.split_and_rank(best, e, "a", "b").collect()
    assert sorted({r["community_id"] for r in ranked}) == list(range(1, len({r["community_id"] for r in ranked}) + 1))
    assert rng is not None


def test_density_clusters(spark):
    t = spark.createDataFrame([("f", 1, 10), ("f", 3, 12), ("f", 6, 15), ("f", 30, 40), ("f", 30, 40), ("g", 2, 11)], "k string, s int, e int")
    got = {(r["k"], r["s"]): (r["lo"], r["hi"]) for r in G.density_clusters(t, "k", "s", "e", 3).collect()}
    assert got == {("f", 1): (1, 15), ("f", 3): (1, 15), ("f", 6): (1, 15), ("f", 30): (30, 40), ("g", 2): (2, 11)}


def test_close_pairs_and_agreement(spark):
    rng = random.Random(7)
    atoms = [("A", i // 2, *[rng.uniform(-6, 6) for _ in range(3)]) for i in range(120)]
    got = {(r["i"], r["j"]): r["distance"] for r in J.close_pairs(spark.createDataFrame(atoms, "c string, i int, x double, y double, z double"), "c", "i", ("x", "y", "z"), 2, 2.5).collect()}
    want = {}
    for a in atoms:
        for b in atoms:
            dist = math.dist(a[2:], b[2:])
            if b[1] - a[1] > 2 and dist <= 2.5:
                want[a[1], b[1]] = min(dist, want.get((a[1], b[1]), 9))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    make = lambda last: spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, last)], "r int, c int, v double")
    r = J.pair_result_sets(make(4.0), make(4.2), ["r", "c"], "v", 0.0, 0.05).first()
    assert (r["cells"], r["mismatches"], r["mismatch_fraction"]) == (4, 1, 0.25)


def test_novelty_by_orientation(spark):
    cols = "id int, m string, s string, ms int, me int, ss int, se int"
    p = spark.createDataFrame([(1, "A", "B", 1, 10, 21, 30), (2, "A", "C", 1, 10, 1, 10), (3, None, "B", 1, 2, 1, 2)], cols)
    h = spark.createDataFrame([(0, "B", "A", 21, 30, 1, 5)], cols).drop("id")
    got = {r["id"]: (r["coverage"], r["is_novel"]) for r in J.pair_hit_coverage(p, h, "id", ("m", "s"), 0.5).collect()}
    assert got == {1: (0.5, False), 2: (0.0, True), 3: (0.0, True)}


def test_exact_percentiles(spark):
    rng = np.random.default_rng(8)
    ps = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    for x in (rng.normal(size=1001), rng.integers(0, 5, 400).astype(float), np.array([3.0])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
        assert np.allclose(W.exact_percentiles(df, "v", ps), np.quantile(x, ps))
    assert W.exact_percentiles(df.limit(0), "v", ps) == [None] * 6


def test_average_ranks_and_running_totals(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.randint(0, 9), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = {r["i"]: r["r"] for r in A.average_ranks(df, ["g"], "v", "r").collect()}
    for g, v, i in rows:
        below, same = sum(x[0] == g and x[1] < v for x in rows), sum(x[0] == g and x[1] == v for x in rows)
        assert got[i] == below + (same + 1) / 2
    t = W.ordered_buckets(df, ["i"])
    run = {r["i"]: r["s"] for r in W.running_total(t, [F.asc("i")], "v", "s", ["_p"]).collect()}
    total = 0
    for _, v, i in rows:
        total += v
        assert run[i] == total


def test_resolution_runs(spark):
    block = [(f"n{a:02}", f"n{b:02}", 1.0) for c in range(4) for a in range(c * 8, c * 8 + 8) for b in range(a + 1, c * 8 + 8)]
    e = spark.createDataFrame(block + [("n00", "n09", 0.05), ("x", "n00", 0.01)], "a string, b string, w double")
    rows = G.resolution_runs(e, "a", "b", "w", (0.2, 2.0), (1, 2, 3)).collect()
    assert sorted((r["gamma"], r["seed"]) for r in rows) == [(g, s) for g in (0.2, 2.0) for s in (1, 2, 3)]
    for g in (0.2, 2.0):
        own = [r for r in rows if r["gamma"] == g]
        assert [r["modularity"] for r in own if r["selected"]] == [max(r["modularity"] for r in own)]
        assert all(r["n_nodes"] == 33 and sum(x["size"] * x["n"] for x in r["sizes"]) == 33 for r in own)
        # with no gain left, x is alone at 0.2 and everything at 2.0
        assert all(r["n_singletons"] == (1 if g == 0.2 else 33) for r in own)
