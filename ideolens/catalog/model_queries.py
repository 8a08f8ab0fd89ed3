"""Registered model-table queries (M1-M9, M13) at fixed deterministic parameters,
with their DuckDB oracle SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.arrays import student_t_lpdf_value
from ..operators import encode as E
from ..plans import model as M
from ..session import cut_lineage
from . import inputs as I
from .inputs import round_doubles, with_ctes

Q: dict = {}
SQL: dict = {}


def q(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _fixed(spark, d):
    votes, ids, voters, _ = I.encoded(spark, d)
    return votes, ids, voters, M.fixed_alpha(voters), M.fixed_candidate_params(ids)


# Per-vote utilities over all candidates of the contest, then log-sum-exp.
def _vote_sql(u_expr: str, alpha_frag: str = "alpha", params_frag: str = "params",
              votes_frag: str = "votes", weight: str = "1") -> str:
    return f"""
SELECT voter_id, race_id, y, w, max(m) + ln(sum(exp(u - m))) AS lse,
       sum(CASE WHEN c = y THEN u END) AS uy
FROM (SELECT *, max(u) OVER (PARTITION BY voter_id, race_id) AS m FROM (
  SELECT v.voter_id, v.race_id, v.candidate_id AS y, {weight} AS w, p.candidate_id AS c, a.alpha,
         {u_expr} AS u
  FROM {votes_frag} v JOIN {alpha_frag} a ON a.voter_id = v.voter_id
  JOIN {params_frag} p ON p.race_id = v.race_id) t) t2
GROUP BY voter_id, race_id, y, w"""


_SLOPE = "p.disc * a.alpha - p.diff"
_CENTER = "p.disc * (a.alpha - p.diff)"
_LL_FINAL = """
SELECT CAST(sum(w) AS BIGINT) AS n_votes, round(sum((uy - lse) * w), 4) AS loglik,
       round(min(uy - lse), 4) AS min_term FROM pv"""


@q("loglik_2pl", with_ctes(_LL_FINAL, "votes", "alpha", "params", extra={"pv": (_vote_sql(_SLOPE), ["votes", "alpha", "params"])}))
def loglik_2pl(spark, d):
    votes, _, _, alpha, params = _fixed(spark, d)
    return round_doubles(M.loglik(votes, alpha, params, M.SLOPE_INTERCEPT))


@q("loglik_2pl_centered", with_ctes(_LL_FINAL, "votes", "alpha", "params",
                                    extra={"pv": (_vote_sql(_CENTER), ["votes", "alpha", "params"])}))
def loglik_2pl_centered(spark, d):
    votes, _, _, alpha, params = _fixed(spark, d)
    return round_doubles(M.loglik(votes, alpha, params, M.CENTERED))


_U_1PL = f"CASE WHEN p.candidate_id = 1 THEN {M.FIXED_MU} ELSE a.alpha - (p.diff + {M.FIXED_MU}) END"


@q("loglik_1pl", with_ctes(_LL_FINAL, "votes", "alpha", "params",
                           extra={"pv": (_vote_sql(_U_1PL), ["votes", "alpha", "params"])}))
def loglik_1pl(spark, d):
    votes, _, _, alpha, params = _fixed(spark, d)
    beta = params.select("race_id", "candidate_id", F.col("diff").alias("beta"))
    return round_doubles(M.loglik_1pl(votes, alpha, beta, M.FIXED_MU))


_DIMS_EXTRA = {
    "alpha2": ("""SELECT voter_id,
        CAST((voter_id * 37) % 201 - 100 AS DOUBLE) / 50 AS alpha0,
        CAST((voter_id * 37 + 11) % 201 - 100 AS DOUBLE) / 50 AS alpha1, 0 AS alpha FROM voter_ids""", ["voter_ids"]),
    "params2": ("""SELECT race_id, candidate_id, diff,
        CASE WHEN candidate_id = 1 THEN 0.0 ELSE CAST((race_id * 7 + candidate_id * 13) % 21 - 10 AS DOUBLE) / 10 END AS disc0,
        CASE WHEN candidate_id = 1 THEN 0.0 ELSE CAST((race_id * 7 + candidate_id * 13 + 5) % 21 - 10 AS DOUBLE) / 10 END AS disc1
      FROM params""", ["params"]),
}
_DIMS_EXTRA["pv"] = (_vote_sql("p.disc0 * a.alpha0 + p.disc1 * a.alpha1 - p.diff", "alpha2", "params2"),
                     ["votes", "alpha2", "params2"])


@q("loglik_dims", with_ctes(_LL_FINAL, "votes", extra=_DIMS_EXTRA))
def loglik_dims(spark, d):
    votes, ids, voters, _ = I.encoded(spark, d)
    return round_doubles(M.loglik(votes, M.fixed_alpha_dims(voters), M.fixed_candidate_params_dims(ids), "dims"))


def _bern_spark(spark, d, model):
    ch = I.choices(spark, d)
    rows = ch.select("voter_id", "race_id", "candidate_id", tx.republican_choice().alias("choice_rep")) \
             .where(F.col("choice_rep").isNotNull())
    race_p, voter_p = M.fixed_bernoulli_params(ch.select("voter_id", "race_id"))
    return round_doubles(M.loglik_bernoulli(rows, race_p, voter_p, model))


def _bern_sql(eta: str) -> str:
    return with_ctes(f"""
SELECT count(*) AS n_obs, round(sum(y * eta - (greatest(eta, 0) + ln(1 + exp(-abs(eta))))), 4) AS loglik,
       round(sum(y), 4) AS n_rep
FROM (SELECT y, {eta} AS eta FROM (
  SELECT CASE WHEN c.party IN ('republican', 'REPUBLICAN') THEN 1.0 ELSE 0.0 END AS y,
    CAST((c.race_id * 5) % 11 - 5 AS DOUBLE) / 10 AS r_race,
    CAST((c.race_id * 3) % 9 - 4 AS DOUBLE) / 8 AS loggamma,
    CAST((c.race_id * 7) % 13 - 6 AS DOUBLE) / 6 AS beta,
    CAST((c.voter_id * 37) % 201 - 100 AS DOUBLE) / 50 AS alpha
  FROM choices c WHERE c.party IS NOT NULL) r) e""", "choices")


@q("loglik_bernoulli_1pl", _bern_sql(f"{M.FIXED_B0} + r_race + alpha"))
def loglik_bernoulli_1pl(spark, d):
    return _bern_spark(spark, d, "1pl")


@q("loglik_bernoulli_2pl", _bern_sql("exp(loggamma) * alpha - beta"))
def loglik_bernoulli_2pl(spark, d):
    return _bern_spark(spark, d, "2pl")


_GROUPS_EXTRA = {
    "groups": ("""
SELECT state, county_name, ballot, count(*) AS n_group FROM (
  SELECT state, county_name, cvr_id,
         list(struct_pack(race := race, candidate := candidate) ORDER BY race, candidate) AS ballot
  FROM all_valid GROUP BY state, county_name, cvr_id) b
GROUP BY state, county_name, ballot""", ["all_valid"]),
    "glong": ("""
SELECT group_id AS voter_id, i.race_id, i.candidate_id, n_group FROM (
  SELECT n_group, unnest(ballot) AS c,
    CAST(row_number() OVER (ORDER BY state, county_name, ballot) AS BIGINT) AS group_id FROM groups) x
JOIN cand_ids i ON i.race = x.c.race AND i.candidate = x.c.candidate""", ["groups", "cand_ids"]),
    "galpha": ("""SELECT DISTINCT voter_id, CAST((voter_id * 37) % 201 - 100 AS DOUBLE) / 50 AS alpha
      FROM glong""", ["glong"]),
}
_GROUPS_EXTRA["pv"] = (_vote_sql(_SLOPE, "galpha", "params", "glong", "v.n_group"), ["glong", "galpha", "params"])


@q("loglik_grouped", with_ctes(_LL_FINAL, "params", extra=_GROUPS_EXTRA))
def loglik_grouped(spark, d):
    data = cut_lineage(I.all_valid(spark, d))
    ids = cut_lineage(E.candidate_ids(data, "democrat"))
    groups = E.ballot_groups(data)
    gv = E.ballot_groups_long(groups).join(ids, ["race", "candidate"]).select(
        F.col("group_id").alias("voter_id"), "race_id", "candidate_id", "n_group")
    # as many rows as there are distinct ballots: never broadcast by the size of their file
    alpha = M.fixed_alpha(groups, "group_id").hint("merge")
    return round_doubles(M.loglik(gv, alpha, M.fixed_candidate_params(ids), M.SLOPE_INTERCEPT, "n_group"))


_HYPER = sum(student_t_lpdf_value(x, 3.0, 0.0, 2.5)
             for x in (M.FIXED_MEAN_DIFF, M.FIXED_SIGMA_DIFF, M.FIXED_SIGMA_DISC))
_LN2PI = 0.5 * math.log(2 * math.pi)


@q("log_prior", with_ctes(f"""
SELECT round(la + lc + {_HYPER!r}, 4) AS log_prior, round(la, 4) AS lp_alpha, round(lc, 4) AS lp_cand,
       round({_HYPER!r}, 4) AS lp_hyper
FROM (SELECT sum(-{_LN2PI!r} - 0.5 * alpha * alpha) AS la FROM alpha) a,
     (SELECT sum(-{_LN2PI!r} - ln({M.FIXED_SIGMA_DISC}) - 0.5 * (disc / {M.FIXED_SIGMA_DISC}) * (disc / {M.FIXED_SIGMA_DISC})
                 -{_LN2PI!r} - ln({M.FIXED_SIGMA_DIFF})
                 - 0.5 * ((diff - {M.FIXED_MEAN_DIFF}) / {M.FIXED_SIGMA_DIFF}) * ((diff - {M.FIXED_MEAN_DIFF}) / {M.FIXED_SIGMA_DIFF})) AS lc
      FROM params WHERE candidate_id > 1) c""", "alpha", "params"))
def log_prior(spark, d):
    _, _, _, alpha, params = _fixed(spark, d)
    return round_doubles(M.log_prior(alpha, params, M.FIXED_MEAN_DIFF, M.FIXED_SIGMA_DIFF, M.FIXED_SIGMA_DISC))


_BERN_PARTS = {
    "brace": ("""SELECT DISTINCT race_id, CAST((race_id * 5) % 11 - 5 AS DOUBLE) / 10 AS r_race,
      CAST((race_id * 3) % 9 - 4 AS DOUBLE) / 8 AS loggamma, CAST((race_id * 7) % 13 - 6 AS DOUBLE) / 6 AS beta FROM votes""", ["votes"]),
}
# Intercepts and standard deviations of the Bernoulli priors' oracle rows.
BERN_1PL = ((M.FIXED_B0,), (0.7, 1.2))
BERN_2PL = ((0.3, -0.1), (1.1, 0.9, 0.6))


def _normal_sql(x: str, mu: float, sd: float) -> str:
    return f"(-{_LN2PI!r} - ln({sd}) - 0.5 * (({x} - {mu}) / {sd}) * (({x} - {mu}) / {sd}))"


def _bern_prior_sql(race: str, sd_voter: float, hyper: float) -> str:
    return with_ctes(f"""
SELECT round(lr + lv + {hyper!r}, 4) AS log_prior, round(lr, 4) AS lp_race, round(lv, 4) AS lp_voter
FROM (SELECT sum({race}) AS lr FROM brace) r, (SELECT sum({_normal_sql('alpha', 0.0, sd_voter)}) AS lv FROM alpha) v""",
                     "alpha", extra=_BERN_PARTS)


def _bern_prior(spark, d, model, values):
    votes, _, _, _ = I.encoded(spark, d)
    race_p, voter_p = M.fixed_bernoulli_params(votes.select("voter_id", "race_id"))
    return round_doubles(M.log_prior_bernoulli(race_p, voter_p, model, *values))


@q("log_prior_bernoulli_1pl", _bern_prior_sql(
    _normal_sql("r_race", 0.0, BERN_1PL[1][0]), BERN_1PL[1][1],
    M.normal_lpdf_value(BERN_1PL[0][0], 0.0, 2.0) + sum(M.half_normal_lpdf_value(x, 3.0) for x in BERN_1PL[1])))
def log_prior_bernoulli_1pl(spark, d):
    return _bern_prior(spark, d, "1pl", BERN_1PL)


@q("log_prior_bernoulli_2pl", _bern_prior_sql(
    _normal_sql("beta", BERN_2PL[0][0], BERN_2PL[1][1]) + " + " + _normal_sql("loggamma", BERN_2PL[0][1], BERN_2PL[1][2]), BERN_2PL[1][0],
    M.normal_lpdf_value(BERN_2PL[0][0], 0.0, 2.0) + M.normal_lpdf_value(BERN_2PL[0][1], 0.0, 1.0)
    + sum(M.half_normal_lpdf_value(x, s) for x, s in zip(BERN_2PL[1], (1.0, 3.0, 1.0)))))
def log_prior_bernoulli_2pl(spark, d):
    return _bern_prior(spark, d, "2pl", BERN_2PL)


@q("bernoulli_probabilities", with_ctes("""
SELECT v.voter_id, v.race_id, round(1 / (1 + exp(-(exp(b.loggamma) * a.alpha - b.beta))), 4) AS prob
FROM votes v JOIN brace b ON b.race_id = v.race_id JOIN alpha a ON a.voter_id = v.voter_id""", "votes", "alpha", extra=_BERN_PARTS))
def bernoulli_probabilities(spark, d):
    votes, _, _, _ = I.encoded(spark, d)
    race_p, voter_p = M.fixed_bernoulli_params(votes.select("voter_id", "race_id"))
    return round_doubles(M.bernoulli_probabilities(votes, race_p, voter_p))


@q("log_prior_1pl", with_ctes(f"""
SELECT round((SELECT sum({_normal_sql('alpha', 0.0, 1.0)}) FROM alpha)
  + (SELECT sum(-{_LN2PI!r} - ln(s) - 0.5 * (diff / s) * (diff / s)) FROM (SELECT diff, 0.5 + race_id / 10.0 AS s FROM params) b)
  + (SELECT sum(-ln(pi()) - ln(5.0) - ln(1 + (s / 5.0) * (s / 5.0))) FROM (SELECT DISTINCT race_id, 0.5 + race_id / 10.0 AS s FROM params) k)
  + (-ln(pi()) - ln(5.0) - ln(1 + ({M.FIXED_MU} / 5.0) * ({M.FIXED_MU} / 5.0))), 4) AS log_prior""", "alpha", "params"))
def log_prior_1pl(spark, d):
    _, _, _, alpha, params = _fixed(spark, d)
    beta = params.select("race_id", "candidate_id", F.col("diff").alias("beta"))
    sigma = params.select("race_id", (0.5 + F.col("race_id") / 10.0).alias("sigma_beta")).distinct()
    return round_doubles(M.log_prior_1pl(alpha, beta, M.FIXED_MU, sigma))


_PROB_EXTRA = {"pu": (f"""
SELECT v.voter_id, v.race_id, v.candidate_id AS y, p.candidate_id AS c, a.alpha, p.disc, p.diff,
       {_SLOPE} AS u
FROM votes v JOIN alpha a ON a.voter_id = v.voter_id JOIN params p ON p.race_id = v.race_id""",
                      ["votes", "alpha", "params"]),
               "pp": ("""
SELECT *, exp(u - (max(u) OVER w + ln(sum(exp(u - max_u)) OVER w))) AS prob
FROM (SELECT *, max(u) OVER (PARTITION BY voter_id, race_id) AS max_u FROM pu) t
WINDOW w AS (PARTITION BY voter_id, race_id)""", ["pu"])}


@q("choice_probabilities", with_ctes("""
SELECT voter_id, race_id, c AS candidate_id, round(prob, 4) AS prob, c = y AS chosen FROM pp""",
    extra=_PROB_EXTRA))
def choice_probabilities(spark, d):
    votes, _, _, alpha, params = _fixed(spark, d)
    return round_doubles(M.choice_probabilities(votes, alpha, params))


@q("gradient_voter", with_ctes("""
SELECT voter_id, round(sum(yd - ed) - any_value(alpha), 4) AS grad,
       round(-sum(ed2 - ed * ed) - 1, 4) AS hess
FROM (SELECT voter_id, race_id, any_value(alpha) AS alpha,
        sum(prob * disc) AS ed, sum(prob * disc * disc) AS ed2, sum(CASE WHEN c = y THEN disc END) AS yd
      FROM pp GROUP BY voter_id, race_id) v GROUP BY voter_id""", extra=_PROB_EXTRA))
def gradient_voter(spark, d):
    votes, _, _, alpha, params = _fixed(spark, d)
    return round_doubles(M.gradient_voter(votes, alpha, params))


@q("gradient_candidate", with_ctes(f"""
SELECT race_id, c AS candidate_id,
  round(sum(((CASE WHEN c = y THEN 1.0 ELSE 0.0 END) - prob) * alpha)
        - any_value(disc) / {M.FIXED_SIGMA_DISC ** 2!r}, 4) AS g_disc,
  round(-sum((CASE WHEN c = y THEN 1.0 ELSE 0.0 END) - prob)
        - (any_value(diff) - {M.FIXED_MEAN_DIFF}) / {M.FIXED_SIGMA_DIFF ** 2!r}, 4) AS g_diff
FROM pp WHERE c > 1 GROUP BY race_id, c""", extra=_PROB_EXTRA))
def gradient_candidate(spark, d):
    votes, _, _, alpha, params = _fixed(spark, d)
    return round_doubles(M.gradient_candidate(votes, alpha, params))


@q("whiten", with_ctes("""
SELECT a.voter_id, round((a.alpha0 - m0) * l11 + (a.alpha1 - m1) * l21, 4) AS dim1, round((a.alpha1 - m1) * l22, 4) AS dim2
FROM alpha2 a, (
  SELECT m0, m1, sqrt(i11) AS l11, i12 / sqrt(i11) AS l21, sqrt(i22 - i12 * i12 / i11) AS l22 FROM (
    SELECT m0, m1, c11 / (c00 * c11 - c01 * c01) AS i11, -c01 / (c00 * c11 - c01 * c01) AS i12,
           c00 / (c00 * c11 - c01 * c01) AS i22 FROM (
      SELECT avg(alpha0) AS m0, avg(alpha1) AS m1, covar_samp(alpha0, alpha0) AS c00, covar_samp(alpha0, alpha1) AS c01,
             covar_samp(alpha1, alpha1) AS c11 FROM alpha2) c) i) w""", extra={"alpha2": _DIMS_EXTRA["alpha2"]}))
def whiten(spark, d):
    """Whitened two-dimensional voter positions (mean 0, identity covariance)."""
    _, _, voters, _ = I.encoded(spark, d)
    return round_doubles(M.whiten(M.fixed_alpha_dims(voters), M.FIXED_DIMS)
                         .select("voter_id", F.col("alpha")[0].alias("dim1"), F.col("alpha")[1].alias("dim2")))


@q("flat_parameter_index", with_ctes("""
SELECT i.race, i.candidate, i.candidate_id, i.race_id,
  CAST(coalesce(sum(s.size) FILTER (WHERE s.race_id < i.race_id), 0) + i.candidate_id AS BIGINT) AS param_idx
FROM cand_ids i, (SELECT race_id, count(*) AS size FROM cand_ids GROUP BY race_id) s
GROUP BY i.race, i.candidate, i.candidate_id, i.race_id""", "cand_ids"))
def flat_parameter_index(spark, d):
    return E.flat_parameter_index(E.candidate_ids(I.all_valid(spark, d), "democrat"))
