"""Posterior-table operators checked against numpy brute force."""

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ideolens.plans import diagnostics as D
from ideolens.plans import draws as DR
from ideolens.plans import scores as SC
from ideolens.sources import fixtures as fx


def _draws_frame(spark, x, variable="theta", idx=1):
    n, m = x.shape
    rows = [(int(c), int(i), int(c * n + i), variable, idx, float(x[i, c])) for c in range(m) for i in range(n)]
    return spark.createDataFrame(rows, "chain long, iteration long, draw long, variable string, idx long, value double")


def test_split_rhat_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((125, 4)) + np.array([0, 0, 0.8, 0])
    got = D.split_rhat(_draws_frame(spark, x)).first().rhat
    h = 62
    halves = np.concatenate([x[:h], x[125 - h:]], axis=1)
    w = halves.var(axis=0, ddof=1).mean()
    b = h * halves.mean(axis=0).var(ddof=1)
    assert abs(got - np.sqrt(((h - 1) / h * w + b / h) / w)) < 1e-12


def test_split_halves_by_rank_not_by_number(spark):
    """1-based, thinned and offset iterations split like 0-based ones."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((6, 3))
    plain = _draws_frame(spark, x)
    moved = plain.withColumn("iteration", F.col("iteration") * 5 + 1001)
    assert D.split_rhat(plain).first().rhat == D.split_rhat(moved).first().rhat
    sizes = {r.half: r["count"] for r in D.split_halves(moved).groupBy("half").count().collect()}
    assert sizes == {0: 9, 1: 9}


def _rank_rhat_numpy(x):
    def split(y):
        h = y.shape[0] // 2
        return np.concatenate([y[:h], y[y.shape[0] - h:]], axis=1)

    def basic(y):
        z = np.array([NormalDist().inv_cdf((r - 0.375) / (y.size + 0.25)) for r in pd.Series(y.ravel()).rank()]).reshape(y.shape)
        n = z.shape[0]
        w = z.var(axis=0, ddof=1).mean()
        return np.sqrt(((n - 1) / n * w + z.mean(axis=0).var(ddof=1)) / w)

    return max(basic(split(x)), basic(split(np.abs(x - np.median(x)))))


def test_rank_rhat_against_numpy_with_ties(spark):
    rng = np.random.default_rng(5)
    frames, want = None, {}
    for idx, x in ((1, rng.standard_normal((40, 4))), (2, np.round(rng.standard_normal((41, 4)), 1) + np.array([0, 0, 0, 3.0])),
                   (None, rng.standard_t(2, (30, 2)))):
        f = _draws_frame(spark, x, idx=idx)
        frames = f if frames is None else frames.unionByName(f)
        want[idx] = _rank_rhat_numpy(x)
    got = {r.idx: r.rhat for r in D.rank_rhat(frames).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_ess_of_independent_and_of_sticky_chains(spark):
    """Independent draws count about fully; a chain with autocorrelation rho counts about
    (1 - rho) / (1 + rho) of its length.  Scalars have no index."""
    rng = np.random.default_rng(6)
    sticky = np.zeros((2000, 4))
    for t in range(1, 2000):
        sticky[t] = 0.8 * sticky[t - 1] + rng.standard_normal(4)
    both = _draws_frame(spark, rng.standard_normal((400, 4)), "free", None).unionByName(_draws_frame(spark, sticky, "sticky", 1))
    r = {row.variable: row for row in D.ess(both).collect()}
    assert 1200 < r["free"].ess_bulk < 2200 and r["free"].idx is None
    assert 0.6 * 8000 / 9 < r["sticky"].ess_bulk < 1.6 * 8000 / 9


def test_scalars_and_two_indices_are_kept_apart(spark):
    rows = [(1, i, i, v, a, b, float(i * k)) for i in range(1, 9)
            for k, (v, a, b) in enumerate([("lp__", None, None), ("alpha", 1, None), ("beta", 1, 1), ("beta", 1, 2)], 1)]
    df = spark.createDataFrame(rows, "chain long, iteration long, draw long, variable string, idx long, idx2 long, value double")
    s = {(r.variable, r.idx, r.idx2): r.mean for r in D.summarise_all(df).collect()}
    assert s == {("lp__", None, None): 4.5, ("alpha", 1, None): 9.0, ("beta", 1, 1): 13.5, ("beta", 1, 2): 18.0}
    assert D.trace_table(df, 10, threshold=0.0).count() == 32
    assert SC.compare_fits(df, df, "none").count() == 4
    assert SC.fits_correlation(df, df, "none").first().n == 4


def test_align_signs_restores_flips(spark):
    rng = np.random.default_rng(9)
    load = rng.normal(1.0, 0.3, 12) * np.sign(rng.standard_normal(12))
    draws, flips = [], {}
    for m in range(60):
        s = 1 if m < 5 else int(rng.choice([-1, 1]))
        flips[m] = s
        for v in range(12):
            draws.append((0, m, m, "gamma", v + 1, float(s * (load[v] + 0.1 * rng.standard_normal()))))
    df = spark.createDataFrame(draws, "chain long, iteration long, draw long, variable string, idx long, value double")
    signs, rounds, converged = DR.align_signs(df, "gamma")
    got = {r.draw: r.sign for r in signs.collect()}
    prod = {got[m] * flips[m] for m in flips}
    assert len(prod) == 1 and rounds <= 10 and converged          # every sign recovered up to one global sign


def test_cutpoint_correlation_moments_equal_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(f"r{k}", f"c{i}", float(rng.standard_normal()), float(rng.standard_normal()))
            for k in range(5) for i in range(2 + k)]
    df = spark.createDataFrame(rows, "race string, candidate string, bayes_ideal double, dime_ideal double")
    got = SC.cutpoint_correlation(df).first()
    pairs = [((a[2] + b[2]) / 2, (a[3] + b[3]) / 2) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1]]
    xs, ys = np.array(pairs).T
    assert got.n_pairs == len(pairs) and abs(got.correlation - np.corrcoef(xs, ys)[0, 1]) < 1e-9
    assert SC.cutpoints(df).count() == len(pairs)


def test_weighted_density_integrates_to_one(spark):
    rng = np.random.default_rng(4)
    rows = [("g", float(x), float(w)) for x, w in zip(rng.standard_normal(300), rng.uniform(0.5, 2, 300))]
    df = spark.createDataFrame(rows, "choice string, mean double, precision double")
    dens = sorted((r.x, r.density) for r in SC.weighted_density(df, "choice", grid=256).collect())
    xs, ys = np.array(dens).T
    assert abs(np.trapezoid(ys, xs) - 1) < 0.01


def test_weighted_density_against_the_rows(spark):
    """The binned kernel sum is close to the sum over the rows; a group without spread
    keeps its grid with no density."""
    rng = np.random.default_rng(12)
    v, w = rng.standard_normal(2000), rng.uniform(0.5, 2, 2000)
    rows = [("g", float(a), float(b)) for a, b in zip(v, w)] + [("one", 1.0, 1.0), ("flat", 2.0, 1.0), ("flat", 2.0, 3.0)]
    df = spark.createDataFrame(rows, "choice string, mean double, precision double")
    got = SC.weighted_density(df, "choice").collect()
    bw = 1.06 * v.std(ddof=1) * 2000 ** -0.2
    for r in got:
        if r.choice == "g":
            want = (w * np.exp(-0.5 * ((r.x - v) / bw) ** 2)).sum() / (bw * w.sum() * np.sqrt(2 * np.pi))
            assert abs(r.density - want) < 1e-4
        else:
            assert r.density is None
    assert sorted((r.choice, r.g) for r in got) == sorted((c, g) for c in ("flat", "g", "one") for g in range(64))


def test_draws_from_wide_parses_indices(spark):
    wide = spark.createDataFrame([(1, 1, 1, 0.5, 1.5, -2.0)],
                                 "`.chain` int, `.iteration` int, `.draw` int, `alpha[12]` double, `beta[3,2]` double, lp__ double")
    got = sorted((r.variable, r.idx, r.idx2, r.value) for r in DR.draws_from_wide(wide).collect())
    assert got == [("alpha", 12, None, 0.5), ("beta", 3, 2, 1.5), ("lp__", None, None, -2.0)]


def test_standin_draws_figure(spark, sf_small):
    r = fx.draws(spark, sf_small).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s")).first()
    assert r.n == 32000 and round(r.s, 4) == -33.0991


def test_group_quantiles_match_numpy_on_skewed_ties(spark):
    from ideolens.operators.relational import group_quantiles
    rng = np.random.default_rng(11)
    big = np.round(rng.standard_normal(3000), 1)          # one hot group with many ties
    small = np.array([2.0])                                # a single-row group
    mid = rng.standard_normal(7)
    rows = [("big", float(v)) for v in big] + [("one", 2.0)] + [("mid", float(v)) for v in mid] + [("mid", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q83": 0.83, "q975": 0.975}
    got = {r.g: r for r in group_quantiles(df, ["g"], "v", probs).collect()}
    exact = {r.g: r for r in df.groupBy("g").agg(*[F.percentile("v", p).alias(k) for k, p in probs.items()]).collect()}
    for g, data in (("big", big), ("one", small), ("mid", mid)):
        for k, p in probs.items():
            assert abs(got[g][k] - np.quantile(data, p)) < 1e-12, (g, k)
            assert abs(got[g][k] - exact[g][k]) < 1e-12, (g, k)


def test_alignment_rounds_write_nothing(spark, monkeypatch):
    """The same signs and rounds in one pass a round as by the tables, in few jobs; missing
    values, draws and parameters included."""
    rng = np.random.default_rng(5)
    rows = [(m, i, float(v)) for m in range(60) for i, v in enumerate(rng.standard_normal(7)) if (m + i) % 11]
    rows += [(100, 1, None), (None, 1, 2.0), (101, None, 1.0), (102, 2, None), (102, 3, -0.4)]
    draws = spark.createDataFrame([(m, "disc", i, v) for m, i, v in rows], "draw long, variable string, idx long, value double")
    sc = spark.sparkContext
    sc.setJobGroup("alignment", "rounds")
    try:
        a, rounds, done = DR.align_signs(draws)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert done and rounds > 2 and len(sc.statusTracker().getJobIdsForGroup("alignment")) <= rounds + 12
    monkeypatch.setattr(DR, "MOST_LOADINGS", 0)
    b, *want = DR.align_signs(draws)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and [rounds, done] == want
    empty, *_ = DR.align_signs(draws.where("draw < 0"))
    assert empty.count() == 0
