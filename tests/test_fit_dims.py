"""Multi-dimensional fit against dense linear algebra, and recovery."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ideolens.plans import fit_dims as FD
from ideolens.plans import model as M
from ideolens.session import cut_lineage

SCALES = (0.1, 1.5, 0.8)


def _simulate(spark, n_voters, n_races, d=2, size=3, seed=1):
    """Races load on one axis each, as axes found by varimax must."""
    rng = np.random.default_rng(seed)
    alpha = rng.standard_normal((n_voters, d))
    disc = np.zeros((n_races, size, d))
    for k in range(n_races):
        disc[k, 1:, k % d] = rng.choice([-1, 1], size - 1) * rng.uniform(1.5, 3, size - 1)
    diff = rng.normal(0, 0.5, (n_races, size))
    diff[:, 0] = 0
    u = np.einsum("jd,kcd->jkc", alpha, disc) - diff[None]
    p = np.exp(u - u.max(axis=2, keepdims=True))
    p = (p / p.sum(axis=2, keepdims=True)).cumsum(axis=2)
    y = (rng.random((n_voters, n_races, 1)) > p).sum(axis=2)
    rows = [(j + 1, k + 1, int(y[j, k]) + 1) for j in range(n_voters) for k in range(n_races)]
    votes = spark.createDataFrame(rows, "voter_id long, race_id long, candidate_id long")
    ids = spark.createDataFrame([(k + 1, c + 1) for k in range(n_races) for c in range(size)], "race_id long, candidate_id long")
    return votes, ids, alpha


@pytest.mark.parametrize("n", [1, 2, 4])
def test_small_matrices(spark, n):
    rng = np.random.default_rng(n)
    m = [(lambda x: x @ x.T + np.eye(n))(rng.standard_normal((n, n))) for _ in range(5)]
    b = rng.standard_normal((5, n))
    rows = [(i, [float(x[r, c]) for r, c in FD._lower(n)], [float(x) for x in b[i]]) for i, x in enumerate(m)]
    df = spark.createDataFrame(rows, "i int, a array<double>, b array<double>").withColumn("l", F.expr(FD.cholesky("a", n)))
    for r in df.withColumns({"x": F.expr(FD.solve("l", "b", n)), "v": F.expr(FD.inverse_diagonal("l", n))}).collect():
        assert r.x == pytest.approx(np.linalg.solve(m[r.i], b[r.i]))
        assert r.v == pytest.approx(np.diag(np.linalg.inv(m[r.i])))


def _gradient(votes, voters, cands, d, z):
    """Gradient of the log posterior at all alphas and all (disc, diff) of free candidates."""
    mean_diff, sigma_diff, sigma_disc = SCALES
    a = {j: z[d * i:d * i + d] for i, j in enumerate(voters)}
    off, n = d * len(voters), d + 1
    theta = {k: z[off + n * i:off + n * i + n] for i, k in enumerate(cands)}
    mean, precision = np.array([0.0] * d + [mean_diff]), np.array([sigma_disc ** -2.0] * d + [sigma_diff ** -2.0])
    g = {j: -v for j, v in a.items()}
    h = {k: -(v - mean) * precision for k, v in theta.items()}
    for j, k, y, w in votes:
        both = [theta.get((k, c), np.zeros(n)) for c in (1, 2, 3)]
        x = np.append(a[j], -1.0)
        u = np.array([t @ x for t in both])
        prob = np.exp(u - u.max()) / np.exp(u - u.max()).sum()
        r = w * ((np.arange(1, 4) == y) - prob)
        g[j] = g[j] + sum(r[c] * both[c][:d] for c in range(3))
        for c in (2, 3):
            h[k, c] = h[k, c] + r[c - 1] * x
    return np.concatenate([*(g[j] for j in voters), *(h[k] for k in cands)])


@pytest.mark.parametrize("d", [2, 3])
def test_systems_and_products(spark, d):
    """Gradients, blocks and the product with the eliminated matrix, also with salted contests."""
    votes, ids, _ = _simulate(spark, 30, 4, d)
    votes = votes.where((F.col("voter_id") + F.col("race_id")) % 5 != 0)
    v = cut_lineage(votes.withColumn("weight", F.when(F.col("voter_id") % 3 == 0, 2.0).otherwise(1.0)))
    rng = np.random.default_rng(2)
    voters = sorted(r.voter_id for r in v.select("voter_id").distinct().collect())
    cands = [(k, c) for k in range(1, 5) for c in (2, 3)]
    n, off = d + 1, d * len(voters)
    z = rng.standard_normal(off + n * len(cands))
    x = spark.createDataFrame([(j, [*map(float, z[d * i:d * i + d]), -1.0]) for i, j in enumerate(voters)], "voter_id long, x array<double>")
    thetas = [(*k, [float(t) for t in z[off + n * i:off + n * i + n]]) for i, k in enumerate(cands)]
    params = spark.createDataFrame(thetas + [(k, 1, [0.0] * n) for k in range(1, 5)], "race_id long, candidate_id long, theta array<double>")
    rows = [(r.voter_id, r.race_id, r.candidate_id, r.weight) for r in v.collect()]
    g = _gradient(rows, voters, cands, d, z)
    e = 1e-5
    m = np.stack([-(_gradient(rows, voters, cands, d, z + e * u) - _gradient(rows, voters, cands, d, z - e * u)) / (2 * e) for u in np.eye(len(z))])
    system = cut_lineage(FD.voter_system(v, x, FD.contest_thetas(params), d))
    got = {r.voter_id: r for r in system.collect()}
    for i, j in enumerate(voters):
        assert got[j].grad == pytest.approx(g[d * i:d * i + d])
        block = m[d * i:d * i + d, d * i:d * i + d]
        assert got[j].curv == pytest.approx([block[a, b] for a, b in FD._lower(d)], rel=1e-4, abs=1e-4)
    own = cut_lineage(FD.candidate_system(v, x, params, FD.contest_thetas(params), d, SCALES))
    got = {(r.race_id, r.candidate_id): r.grad for r in own.collect()}
    assert [t for k in cands for t in got[k]] == pytest.approx(g[off:])
    move = rng.standard_normal(n * len(cands))
    state = spark.createDataFrame([(*k, [float(t) for t in move[n * i:n * i + n]]) for i, k in enumerate(cands)],
                                  "race_id long, candidate_id long, p array<double>")
    want = m[off:, off:] @ move - m[off:, :off] @ np.linalg.solve(
        np.kron(np.eye(len(voters)), np.ones((d, d))) * m[:off, :off], m[:off, off:] @ move)
    for spread in (False, True):
        got = {(r.race_id, r.candidate_id): r.q for r in FD._product(v, system, params, state, d, SCALES, "p", spread).collect()}
        assert [t for k in cands for t in got[k]] == pytest.approx(want, rel=1e-4, abs=1e-4)


def _largest_gradient(votes, fit, d):
    x = fit.alpha.select("voter_id", F.concat("alpha", F.array(F.lit(-1.0))).alias("x"))
    params = cut_lineage(fit.params.select("race_id", "candidate_id", F.concat("disc", F.array("diff")).alias("theta")))
    v, arrays = votes.withColumn("weight", F.lit(1.0)), FD.contest_thetas(params)
    scales = (fit.mean_diff, fit.sigma_diff, fit.sigma_disc)
    a = FD.voter_system(v, x, arrays, d).agg(F.max(F.expr(FD._most("grad"))).alias("g")).first().g
    return a, FD.candidate_system(v, x, params, arrays, d, scales).agg(F.max(F.expr(FD._most("grad"))).alias("g")).first().g


def test_recovery_of_two_axes(spark):
    """The mode is reached (gradients vanish, the log posterior never falls), and the axes of
    the simulation come back up to their order, each pointing to the right voters."""
    votes, ids, truth = _simulate(spark, 200, 8)
    right = spark.createDataFrame([(j + 1,) for j in range(len(truth)) if truth[j].sum() > 0], "voter_id long")
    fit = FD.fit_map_dims(votes, ids, 2, right_voters=right, tol=1e-2, update_hyper=False)
    assert fit.converged and fit.iterations < 25
    a, c = _largest_gradient(votes, fit, 2)
    assert a < 1e-2 and c < 5e-2
    values = [h["log_posterior"] for h in fit.history if "log_posterior" in h]
    assert all(y >= x - 1e-6 for x, y in zip(values, values[1:]))
    got = np.array([r.alpha for r in fit.alpha.orderBy("voter_id").collect()])
    r = np.corrcoef(got.T, truth.T)[:2, 2:]
    assert r.max(axis=1).min() > 0.6 and np.abs(r).min(axis=1).max() < 0.35
    assert sorted(r.argmax(axis=1)) == [0, 1]


def test_one_dimension_is_the_mode_of_the_other_model(spark):
    """The gradients of the one-dimensional model vanish, and the variances are its own."""
    votes, ids, _ = _simulate(spark, 60, 4, d=1)
    fit = FD.fit_map_dims(votes, ids, 1, tol=1e-2, update_hyper=False, mean_diff=0.1, sigma_diff=1.5, sigma_disc=0.8)
    assert fit.converged
    alpha = fit.alpha.select("voter_id", F.col("alpha")[0].alias("alpha"))
    params = cut_lineage(fit.params.select("race_id", "candidate_id", F.col("disc")[0].alias("disc"), "diff"))
    g = M.gradient_voter(votes, alpha, params).join(fit.alpha.select("voter_id", F.col("var")[0].alias("var")), "voter_id")
    g = g.agg(F.max(F.abs("grad")).alias("g"), F.max(F.abs(F.col("var") + 1 / F.col("hess"))).alias("v")).first()
    c = M.gradient_candidate(votes, alpha, params, mean_diff=0.1, sigma_diff=1.5, sigma_disc=0.8).agg(
        F.max(F.greatest(F.abs("g_disc"), F.abs("g_diff"))).alias("g")).first().g
    assert g.g < 1e-2 and g.v < 1e-9 and c < 2e-2


def test_odd_votes(spark):
    """Null ids carry nothing; an empty table gives an empty fit."""
    votes, ids, _ = _simulate(spark, 20, 2)
    more = votes.unionByName(spark.createDataFrame([(None, 1, 1), (3, 1, None)], votes.schema))
    a, b = (FD.fit_map_dims(x, ids, 2, max_iter=2) for x in (votes, more))
    a, b = (np.array([r.alpha for r in x.alpha.orderBy("voter_id").collect()]) for x in (a, b))
    assert a == pytest.approx(b)
    none = FD.fit_map_dims(votes.limit(0), ids, 2, max_iter=2)
    assert none.alpha.count() == 0 and none.params.count() == 6
    with pytest.raises(ValueError):
        FD.fit_map_dims(votes, ids, 0)


def test_ballots_and_tables_take_the_same_rounds(spark):
    """Two alternating rounds by whole ballots and by tables (no bytes allowed for them), and
    the joint rounds on ballots end at the mode in few jobs."""
    votes, ids, _ = _simulate(spark, 60, 4)
    a, b = (FD.fit_map_dims(votes, ids, max_iter=2, max_bytes=x) for x in (1 << 30, 0))
    x, y = ({r.voter_id: r.alpha for r in f.alpha.collect()} for f in (a, b))
    assert all(x[j] == pytest.approx(y[j], abs=1e-6) for j in y) and len(x) == 60
    sc = spark.sparkContext
    sc.setJobGroup("few jobs in dims", "fit")
    try:
        fit = FD.fit_map_dims(votes, ids, update_hyper=False, mean_diff=0.1, sigma_diff=1.5, sigma_disc=0.8)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert fit.converged and len(sc.statusTracker().getJobIdsForGroup("few jobs in dims")) <= 12 * fit.iterations + 60
