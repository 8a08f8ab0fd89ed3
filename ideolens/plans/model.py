"""Ideal-point model tables.

Votes stay a distributed long table ``(voter_id, race_id, candidate_id)``.  Voter
parameters are a voter-keyed table joined on ``voter_id``; candidate parameters
are folded into one row per contest holding an array of (candidate_id, disc,
diff) structs, so each vote computes its contest's utilities, log-sum-exp and
probabilities with array expressions inside whole-stage codegen: the candidates
of a contest are never exploded before the softmax sum.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import (cauchy_lpdf_value, dot, inv_logit, log_sum_exp, normal_lpdf, softmax,
                                softplus, student_t_lpdf_value)
from ..session import bounded_broadcast, cut_lineage

SLOPE_INTERCEPT = "slope_intercept"   # u_c = disc_c * alpha - diff_c
CENTERED = "centered"                 # u_c = disc_c * (alpha - diff_c)

# Fixed values of the deterministic test parameters (formulas of the ids).
FIXED_MU = 0.5
FIXED_MEAN_DIFF = 0.1
FIXED_SIGMA_DIFF = 1.5
FIXED_SIGMA_DISC = 0.8
FIXED_B0 = -0.2
FIXED_DIMS = 2
#: Bytes of one contest's effects in a broadcast.
RACE_BYTES = 64


# ---------------------------------------------------------------- parameters

def fixed_alpha(voters: DataFrame, id_col: str = "voter_id") -> DataFrame:
    """alpha_j = ((j*37) % 201 - 100) / 50."""
    return voters.select(F.col(id_col).alias("voter_id"),
                         (((F.col(id_col) * 37) % 201 - 100) / 50.0).alias("alpha"))


def fixed_candidate_params(ids: DataFrame) -> DataFrame:
    """disc/diff as formulas of (race_id, candidate_id); the reference candidate
    (candidate_id 1) has 0, 0."""
    r, c = F.col("race_id"), F.col("candidate_id")
    ref = c == 1
    disc = F.when(ref, F.lit(0.0)).otherwise(((r * 7 + c * 13) % 21 - 10) / 10.0)
    diff = F.when(ref, F.lit(0.0)).otherwise(((r * 5 + c * 11) % 17 - 8) / 8.0)
    return ids.select("race_id", "candidate_id", disc.alias("disc"), diff.alias("diff"))


def fixed_alpha_dims(voters: DataFrame, dims: int = FIXED_DIMS) -> DataFrame:
    j = F.col("voter_id")
    return voters.select("voter_id", F.array(*[
        (((j * 37 + d * 11) % 201 - 100) / 50.0) for d in range(dims)]).alias("alpha"))


def fixed_candidate_params_dims(ids: DataFrame, dims: int = FIXED_DIMS) -> DataFrame:
    r, c = F.col("race_id"), F.col("candidate_id")
    ref = c == 1
    disc = F.array(*[F.when(ref, F.lit(0.0)).otherwise(((r * 7 + c * 13 + d * 5) % 21 - 10) / 10.0)
                     for d in range(dims)])
    diff = F.when(ref, F.lit(0.0)).otherwise(((r * 5 + c * 11) % 17 - 8) / 8.0)
    return ids.select("race_id", "candidate_id", disc.alias("disc"), diff.alias("diff"))


def fixed_bernoulli_params(votes: DataFrame):
    """Race effects (r_race, loggamma, beta) and voter effects (r_voter = alpha)."""
    races = cut_lineage(votes.select("race_id").distinct())
    races = bounded_broadcast(races, RACE_BYTES)
    r = F.col("race_id")
    race_p = races.select("race_id",
                          (((r * 5) % 11 - 5) / 10.0).alias("r_race"),
                          (((r * 3) % 9 - 4) / 8.0).alias("loggamma"),
                          (((r * 7) % 13 - 6) / 6.0).alias("beta"))
    voters = fixed_alpha(votes.select("voter_id").distinct())
    return race_p, voters


# ---------------------------------------------------------------- utilities

def with_voters(votes: DataFrame, voters: DataFrame) -> DataFrame:
    """Votes with the columns of their voter.  Both grow with the voters, and Spark would
    broadcast either by the size of its file or, where that of the other is not known, even the
    votes: they meet by sort and merge (matching buckets without a shuffle)."""
    return votes.join(voters.hint("merge"), "voter_id")


def contest_arrays(params: DataFrame) -> DataFrame:
    """One row per contest: ``p`` = candidate params sorted by candidate_id."""
    fields = [c for c in params.columns if c not in ("race_id",)]
    return params.groupBy("race_id").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("p"))


def _utilities(form: str, alpha: F.Column | None = None) -> F.Column:
    alpha = F.col("alpha") if alpha is None else alpha
    if form == SLOPE_INTERCEPT:
        return F.transform("p", lambda s: s["disc"] * alpha - s["diff"])
    if form == CENTERED:
        return F.transform("p", lambda s: s["disc"] * (alpha - s["diff"]))
    if form == "dims":
        return F.transform("p", lambda s: dot(s["disc"], alpha) - s["diff"])
    raise ValueError(form)


def vote_terms(votes: DataFrame, alpha: DataFrame, params: DataFrame,
               form: str = SLOPE_INTERCEPT, weight_col: str | None = None) -> DataFrame:
    """Per vote: utilities ``u``, log-sum-exp and the log-likelihood term."""
    arr = contest_arrays(params)
    cols = ["voter_id", "race_id", "candidate_id"] + ([weight_col] if weight_col else [])
    j = with_voters(votes.select(*cols), alpha).join(arr, "race_id")
    j = j.withColumn("u", _utilities(form))
    j = j.withColumn("lse", log_sum_exp(F.col("u")))
    return j.withColumn("term", F.element_at("u", F.col("candidate_id").cast("int")) - F.col("lse"))


def loglik(votes: DataFrame, alpha: DataFrame, params: DataFrame, form: str = SLOPE_INTERCEPT,
           weight_col: str | None = None) -> DataFrame:
    """M1/M2/M4/M6: total categorical log-likelihood (one row)."""
    t = vote_terms(votes, alpha, params, form, weight_col)
    w = F.col(weight_col) if weight_col else F.lit(1)
    return t.agg(F.sum(w).cast("long").alias("n_votes"),
                 F.sum(F.col("term") * w).alias("loglik"),
                 F.min("term").alias("min_term"))


def loglik_1pl(votes: DataFrame, alpha: DataFrame, beta: DataFrame, mu: float) -> DataFrame:
    """M3: 1PL utilities: reference candidate mu, others alpha - (beta_c + mu)."""
    params = beta.select("race_id", "candidate_id", "beta")
    arr = contest_arrays(params)
    j = with_voters(votes, alpha).join(arr, "race_id")
    m = F.lit(float(mu))
    u = F.transform("p", lambda s: F.when(s["candidate_id"] == 1, m)
                    .otherwise(F.col("alpha") - (s["beta"] + m)))
    j = j.withColumn("u", u)
    t = j.withColumn("term", F.element_at("u", F.col("candidate_id").cast("int")) - log_sum_exp(F.col("u")))
    return t.agg(F.count(F.lit(1)).alias("n_votes"), F.sum("term").alias("loglik"),
                 F.min("term").alias("min_term"))


def bernoulli_rows(votes: DataFrame, choice: DataFrame) -> DataFrame:
    """Binary outcome rows: votes with their 0/1 ``choice_rep`` (NULL rows dropped)."""
    return votes.join(choice, ["voter_id", "race_id", "candidate_id"]).where(F.col("choice_rep").isNotNull())


def loglik_bernoulli(rows: DataFrame, race_p: DataFrame, voter_p: DataFrame, model: str = "1pl",
                     b0: float = FIXED_B0) -> DataFrame:
    """M5: Bernoulli log-likelihood; 1PL logit = b0 + r_race + r_voter,
    2PL logit = exp(loggamma_race) * alpha_voter - beta_race."""
    j = with_voters(rows, voter_p).join(race_p, "race_id")
    if model == "1pl":
        eta = F.lit(float(b0)) + F.col("r_race") + F.col("alpha")
    elif model == "2pl":
        eta = F.exp("loggamma") * F.col("alpha") - F.col("beta")
    else:
        raise ValueError(model)
    term = F.col("choice_rep") * eta - softplus(eta)
    return j.agg(F.count(F.lit(1)).alias("n_obs"), F.sum(term).alias("loglik"),
                 F.sum("choice_rep").alias("n_rep"))


# ---------------------------------------------------------------- priors

def _sum_parts(parts) -> DataFrame:
    """Sum of several labelled per-row terms in one aggregate over their union."""
    u = parts[0][1].select(F.lit(parts[0][0]).alias("part"), F.col("lp"))
    for name, df in parts[1:]:
        u = u.unionByName(df.select(F.lit(name).alias("part"), F.col("lp")))
    return u.agg(*[F.coalesce(F.sum(F.when(F.col("part") == n, F.col("lp"))), F.lit(0.0)).alias(f"lp_{n}")
                   for n, _ in parts])


def log_prior(alpha: DataFrame, params: DataFrame, mean_diff: float, sigma_diff: float,
              sigma_disc: float, include_reference: bool = False) -> DataFrame:
    """M7: alpha ~ N(0,1); disc ~ N(0, sigma_disc); diff - mean_diff ~ N(0, sigma_diff);
    mean_diff, sigma_diff, sigma_disc ~ Student-t(3, 0, 2.5).  Full densities
    (normalising constants kept).  Reference-candidate parameters never enter the
    likelihood and are left out unless ``include_reference``."""
    a = alpha.select(normal_lpdf(F.col("alpha"), 0.0, 1.0).alias("lp"))
    p = params if include_reference else params.where(F.col("candidate_id") > 1)
    c = p.select((normal_lpdf(F.col("disc"), 0.0, sigma_disc)
                  + normal_lpdf(F.col("diff") - F.lit(mean_diff), 0.0, sigma_diff)).alias("lp"))
    hyper = sum(student_t_lpdf_value(x, 3.0, 0.0, 2.5) for x in (mean_diff, sigma_diff, sigma_disc))
    return _sum_parts([("alpha", a), ("cand", c)]).select(
        (F.col("lp_alpha") + F.col("lp_cand") + F.lit(hyper)).alias("log_prior"),
        "lp_alpha", "lp_cand", F.lit(hyper).alias("lp_hyper"))


def log_prior_1pl(alpha: DataFrame, beta: DataFrame, mu: float, sigma_beta: DataFrame) -> DataFrame:
    """M7, 1PL: alpha ~ N(0,1), mu ~ Cauchy(0,5), sigma_k ~ Cauchy(0,5), beta_kc ~ N(0, sigma_k)."""
    a = alpha.select(normal_lpdf(F.col("alpha"), 0.0, 1.0).alias("lp"))
    b = beta.join(sigma_beta, "race_id").select(normal_lpdf(F.col("beta"), 0.0, F.col("sigma_beta")).alias("lp"))
    s = sigma_beta.select((F.lit(-math.log(math.pi) - math.log(5.0))
                           - F.log1p((F.col("sigma_beta") / 5.0) ** 2)).alias("lp"))
    return _sum_parts([("alpha", a), ("beta", b), ("sigma", s)]).select(
        (F.col("lp_alpha") + F.col("lp_beta") + F.col("lp_sigma")
         + F.lit(cauchy_lpdf_value(mu, 0.0, 5.0))).alias("log_prior"))


def half_normal_lpdf_value(x: float, sigma: float) -> float:
    """Log density of a standard deviation whose prior is a normal cut at zero."""
    return math.log(2.0) - 0.5 * math.log(2 * math.pi) - math.log(sigma) - 0.5 * (x / sigma) ** 2


def normal_lpdf_value(x: float, mu: float, sigma: float) -> float:
    z = (x - mu) / sigma
    return -0.5 * math.log(2 * math.pi) - math.log(sigma) - 0.5 * z * z


def log_prior_bernoulli(race_p: DataFrame, voter_p: DataFrame, model: str, intercepts, sds) -> DataFrame:
    """M7, Bernoulli models.  1PL: intercept ~ N(0,2), effects of races and voters normal
    with sds ~ half N(0,3); ``intercepts`` (b0,), ``sds`` (race, voter).  2PL: mean of beta
    ~ N(0,2), of loggamma ~ N(0,1); alpha, beta, loggamma normal with sds ~ half N(0,1),
    N(0,3), N(0,1); the race effects uncorrelated; ``sds`` (alpha, beta, loggamma)."""
    if model == "1pl":
        race, voter = sds
        parts = [("race", race_p.select(normal_lpdf(F.col("r_race"), 0.0, race).alias("lp"))),
                 ("voter", voter_p.select(normal_lpdf(F.col("alpha"), 0.0, voter).alias("lp")))]
        hyper = normal_lpdf_value(intercepts[0], 0.0, 2.0) + sum(half_normal_lpdf_value(x, 3.0) for x in sds)
    elif model == "2pl":
        a, b, g = sds
        parts = [("race", race_p.select((normal_lpdf(F.col("beta"), intercepts[0], b)
                                         + normal_lpdf(F.col("loggamma"), intercepts[1], g)).alias("lp"))),
                 ("voter", voter_p.select(normal_lpdf(F.col("alpha"), 0.0, a).alias("lp")))]
        hyper = (normal_lpdf_value(intercepts[0], 0.0, 2.0) + normal_lpdf_value(intercepts[1], 0.0, 1.0)
                 + sum(half_normal_lpdf_value(x, s) for x, s in zip(sds, (1.0, 3.0, 1.0))))
    else:
        raise ValueError(model)
    return _sum_parts(parts).select((F.col("lp_race") + F.col("lp_voter") + F.lit(hyper)).alias("log_prior"), "lp_race", "lp_voter")


def bernoulli_probabilities(rows: DataFrame, race_p: DataFrame, voter_p: DataFrame) -> DataFrame:
    """M8, Bernoulli 2PL: probability of the binary outcome for each row."""
    j = with_voters(rows, voter_p).join(race_p, "race_id")
    return j.select("voter_id", "race_id", inv_logit(F.exp("loggamma") * F.col("alpha") - F.col("beta")).alias("prob"))


# ---------------------------------------------------------------- probabilities & gradients

def choice_probabilities(votes: DataFrame, alpha: DataFrame, params: DataFrame,
                         form: str = SLOPE_INTERCEPT) -> DataFrame:
    """M8: P(candidate | voter, contest) for every candidate of each voted contest."""
    t = vote_terms(votes, alpha, params, form).withColumn("prob", softmax(F.col("u")))
    return t.select("voter_id", "race_id", F.col("candidate_id").alias("chosen_id"),
                    F.posexplode("prob").alias("pos", "prob")) \
        .select("voter_id", "race_id", (F.col("pos") + 1).cast("long").alias("candidate_id"),
                "prob", (F.col("pos") + 1 == F.col("chosen_id")).alias("chosen"))


def _prob_terms(votes, alpha, params, form, weight_col=None):
    t = vote_terms(votes, alpha, params, form, weight_col).withColumn("prob", softmax(F.col("u")))
    disc = F.transform("p", lambda s: s["disc"])
    t = t.withColumn("_disc", disc)
    e_disc = F.aggregate(F.zip_with("prob", "_disc", lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    e_disc2 = F.aggregate(F.zip_with("prob", "_disc", lambda a, b: a * b * b), F.lit(0.0), lambda x, y: x + y)
    y_disc = F.element_at("_disc", F.col("candidate_id").cast("int"))
    return t.withColumn("_ed", e_disc).withColumn("_ed2", e_disc2).withColumn("_yd", y_disc)


def gradient_voter(votes: DataFrame, alpha: DataFrame, params: DataFrame,
                   form: str = SLOPE_INTERCEPT, weight_col: str | None = None) -> DataFrame:
    """M9: d log posterior / d alpha_j and its second derivative (N(0,1) prior
    included).  ``du_c/dalpha = disc_c`` in both forms."""
    t = _prob_terms(votes, alpha, params, form, weight_col)
    w = F.col(weight_col) if weight_col else F.lit(1.0)
    g = t.groupBy("voter_id").agg(
        F.sum((F.col("_yd") - F.col("_ed")) * w).alias("g_lik"),
        F.sum((F.col("_ed2") - F.col("_ed") * F.col("_ed")) * w).alias("info"))
    return with_voters(g, alpha).select(
        "voter_id", (F.col("g_lik") - F.col("alpha")).alias("grad"),
        (-F.col("info") - F.lit(1.0)).alias("hess"))


def candidate_residuals(votes: DataFrame, alpha: DataFrame, params: DataFrame,
                        form: str = SLOPE_INTERCEPT, weight_col: str | None = None) -> DataFrame:
    """Per (race_id, candidate_id) sufficient sums over votes: sum r, sum r*alpha,
    sum r*(alpha - diff) and the Fisher-information blocks, with
    r_c = 1[y = c] - p_c.  Arrays are exploded only after the softmax and feed a
    partial aggregate in the same stage."""
    t = vote_terms(votes, alpha, params, form, weight_col).withColumn("prob", softmax(F.col("u")))
    w = F.col(weight_col) if weight_col else F.lit(1.0)
    ex = t.select("race_id", "candidate_id", "alpha", w.alias("_w"),
                  F.posexplode(F.arrays_zip("prob", "p")).alias("pos", "z"))
    c = (F.col("pos") + 1).cast("long")
    r = F.when(c == F.col("candidate_id"), 1.0).otherwise(0.0) - F.col("z.prob")
    pq = F.col("z.prob") * (1.0 - F.col("z.prob"))
    a = F.col("alpha")
    diff = F.col("z.p.diff")
    return ex.groupBy("race_id", c.alias("candidate_id")).agg(
        F.sum(r * F.col("_w")).alias("sum_r"),
        F.sum(r * a * F.col("_w")).alias("sum_ra"),
        F.sum(r * (a - diff) * F.col("_w")).alias("sum_r_centered"),
        F.sum(pq * F.col("_w")).alias("i_11"),
        F.sum(pq * a * F.col("_w")).alias("i_1a"),
        F.sum(pq * a * a * F.col("_w")).alias("i_aa"),
        F.sum(pq * (a - diff) * (a - diff) * F.col("_w")).alias("i_cc"))


def gradient_candidate(votes: DataFrame, alpha: DataFrame, params: DataFrame,
                       form: str = SLOPE_INTERCEPT, mean_diff: float = FIXED_MEAN_DIFF,
                       sigma_diff: float = FIXED_SIGMA_DIFF, sigma_disc: float = FIXED_SIGMA_DISC,
                       weight_col: str | None = None) -> DataFrame:
    """M9: gradient of the log posterior in disc_c and diff_c for non-reference
    candidates (the reference is fixed at 0)."""
    s = candidate_residuals(votes, alpha, params, form, weight_col) \
        .join(params.select("race_id", "candidate_id", "disc", "diff"), ["race_id", "candidate_id"]) \
        .where(F.col("candidate_id") > 1)
    prior_disc = F.col("disc") / F.lit(sigma_disc ** 2)
    prior_diff = (F.col("diff") - F.lit(mean_diff)) / F.lit(sigma_diff ** 2)
    if form == SLOPE_INTERCEPT:
        g_disc = F.col("sum_ra") - prior_disc
        g_diff = -F.col("sum_r") - prior_diff
    else:
        g_disc = F.col("sum_r_centered") - prior_disc
        g_diff = -F.col("disc") * F.col("sum_r") - prior_diff
    return s.select("race_id", "candidate_id", g_disc.alias("g_disc"), g_diff.alias("g_diff"))


# ---------------------------------------------------------------- whitening

def whiten(alpha: DataFrame, dims: int) -> DataFrame:
    """De-mean the voter position vectors, then multiply by the Cholesky
    factor of the inverse sample covariance.  Means and covariances (by updates that do not
    cancel) are one distributed aggregate; the d x d algebra runs on the driver."""
    import numpy as np
    aggs = [F.avg(F.col("alpha")[i]).alias(f"m{i}") for i in range(dims)]
    aggs += [F.covar_samp(F.col("alpha")[i], F.col("alpha")[k]).alias(f"c{i}_{k}")
             for i in range(dims) for k in range(i, dims)]
    row = alpha.agg(*aggs).collect()[0]
    mean = np.array([row[f"m{i}"] for i in range(dims)])
    cov = np.array([[row[f"c{min(i, k)}_{max(i, k)}"] for k in range(dims)] for i in range(dims)])
    ww = np.linalg.cholesky(np.linalg.inv(cov))
    cols = []
    for k in range(dims):
        expr = F.lit(0.0)
        for i in range(dims):
            expr = expr + (F.col("alpha")[i] - F.lit(float(mean[i]))) * F.lit(float(ww[i, k]))
        cols.append(expr)
    return alpha.select("voter_id", F.array(*cols).alias("alpha"))
