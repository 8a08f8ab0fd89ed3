"""Varimax and the alignment of axes against planted rotations, swaps and flips."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ideolens.plans import varimax as VX


def _criterion(x):
    return (x ** 2).var(axis=0).sum()


def _moments(x):
    d = x.shape[1]
    return len(x), *([float(np.prod(x[:, list(at)], axis=1).sum()) for at in VX._products(d, k)] for k in (2, 4)), d


@pytest.mark.parametrize("d", [1, 2, 3, 4])
def test_rotation_is_the_best_one(d):
    """Orthogonal, ordered, back at simple structure, and better than any small turn."""
    rng = np.random.default_rng(d)
    simple = np.zeros((60, d))
    simple[np.arange(60), np.arange(60) % d] = rng.choice([-1, 1], 60) * rng.uniform(1, 2, 60) * (1 + np.arange(60) % d)
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    r = VX.rotation(*_moments(simple @ turn))
    assert r.T @ r == pytest.approx(np.eye(d), abs=1e-12)
    x = simple @ turn @ r
    assert np.sort(np.abs(x), axis=1)[:, :-1].max(initial=0) < 1e-6
    assert list((x ** 2).sum(axis=0)) == sorted((x ** 2).sum(axis=0), reverse=True)
    noisy = x + rng.normal(0, 0.4, x.shape)
    best = noisy @ VX.rotation(*_moments(noisy))
    for _ in range(20 if d > 1 else 0):
        small = np.linalg.qr(np.eye(d) + rng.normal(0, 0.02, (d, d)))[0]
        assert _criterion(best @ small) <= _criterion(best) + 1e-12


def _draws(spark, d, turned, n_draws=12, n=20, seed=5):
    rng = np.random.default_rng(seed)
    simple = np.zeros((n, d))
    simple[np.arange(n), np.arange(n) % d] = rng.choice([-1, 1], n) * rng.uniform(1, 2, n)
    rows, planted = [], []
    for m in range(n_draws):
        if turned:
            turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
        else:
            turn = np.eye(d)[:, rng.permutation(d)] * rng.choice([-1, 1], d)
        planted.append(turn)
        x = (simple + rng.normal(0, 0.1, simple.shape)) @ turn
        rows += [(m, i, [float(v) for v in x[i]]) for i in range(n)]
    return simple, planted, spark.createDataFrame(rows, "draw long, idx long, x array<double>")


@pytest.mark.parametrize("d,turned", [(2, True), (3, True), (3, False)])
def test_planted_rotations_flips_and_swaps_are_undone(spark, d, turned):
    simple, planted, x = _draws(spark, d, turned)
    turns, rounds, converged = VX.align(x, d, rotate=turned)
    assert converged and rounds < 10
    got = np.stack([np.array(r.by).reshape(d, d) for r in turns.orderBy("draw").collect()])
    whole = np.stack([p @ g for p, g in zip(planted, got)])  # the same signed permutation for all draws
    assert np.abs(whole - whole[0]).max() < (0.15 if turned else 1e-12)
    assert np.abs(np.abs(whole[0]) - np.round(np.abs(whole[0]))).max() < 0.15
    out = VX.apply_turns(x, turns, d).groupBy("idx").agg(F.array(*[F.stddev_samp(F.col("x")[k]) for k in range(d)]).alias("s"))
    assert max(max(r.s) for r in out.collect()) < 0.35


def test_nearest_signed_permutation(spark):
    """Against all signed permutations."""
    d, rng = 3, np.random.default_rng(8)
    crosses = rng.standard_normal((10, d, d))
    df = spark.createDataFrame([(i, [float(v) for v in c.ravel()]) for i, c in enumerate(crosses)], "i int, cross array<double>")
    for r in df.select("i", VX.signed_permutations(d).alias("by")).collect():
        best = max(sum(abs(crosses[r.i][p[k], k]) for k in range(d)) for p in permutations(range(d)))
        assert (np.array(r.by).reshape(d, d) * crosses[r.i]).sum() == pytest.approx(best)
    tie = spark.createDataFrame([([0.0] * 4,)], "cross array<double>").select(VX.signed_permutations(2).alias("by")).first().by
    assert tie == [1, 0, 0, 1]


def test_loadings_and_empty_draws(spark):
    rows = [("beta", 1, 1, 1, 0.5), ("beta", 1, 1, 2, -1.0), ("beta", 1, 2, 2, 3.0), ("alpha", 1, 1, 1, 9.0)]
    draws = spark.createDataFrame(rows, "variable string, draw long, idx long, idx2 long, value double")
    got = {r.idx: r.x for r in VX.loadings_of(draws, "beta", 2).collect()}
    assert got == {1: [0.5, -1.0], 2: [0.0, 3.0]}
    turns, rounds, converged = VX.align(VX.loadings_of(draws.limit(0), "beta", 2), 2)
    assert converged and rounds == 1 and turns.count() == 0
