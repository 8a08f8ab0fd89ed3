"""Model tables: fixture figure, identities and finite-difference gradients."""

import math

from pyspark.sql import functions as F

from ideolens.catalog import inputs as I
from ideolens.operators import encode as E
from ideolens.plans import model as M


def _fixed(spark, d):
    votes, ids, voters, data = I.encoded(spark, d)
    return votes.cache(), ids, voters, M.fixed_alpha(voters), M.fixed_candidate_params(ids)


def test_loglik_matches_fixture_figure(spark, sf_small):
    votes, ids, voters, alpha, params = _fixed(spark, sf_small)
    r = M.loglik(votes, alpha, params).first()
    assert (r.n_votes, round(r.loglik, 4), round(r.min_term, 4)) == (2083, -4601.3662, -5.8139)
    assert ids.count() == 164 and voters.count() == 150


def test_probabilities_sum_to_one(spark, sf_small):
    votes, ids, voters, alpha, params = _fixed(spark, sf_small)
    p = M.choice_probabilities(votes, alpha, params)
    sums = p.groupBy("voter_id", "race_id").agg(F.sum("prob").alias("s"), F.sum(F.col("chosen").cast("int")).alias("c"))
    bad = sums.where((F.abs(F.col("s") - 1) > 1e-9) | (F.col("c") != 1)).count()
    assert bad == 0


def test_ragged_dense_round_trip(spark, sf_small):
    votes, ids, voters, alpha, params = _fixed(spark, sf_small)
    dense = E.dense_votes(votes, ids)
    width = ids.select("race_id").distinct().count()
    assert {len(r.choices) for r in dense.select("choices").collect()} == {width}
    back = dense.select("voter_id", F.posexplode("choices").alias("at", "candidate_id")).where("candidate_id <> 0") \
                .select("voter_id", (F.col("at") + 1).cast("long"), "candidate_id")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, votes.collect()))


def test_grouped_loglik_equals_ungrouped(spark, sf_small):
    data = I.all_valid(spark, sf_small)
    ids = E.candidate_ids(data)
    groups = E.ballot_groups(data)
    long = E.ballot_groups_long(groups).join(ids, ["race", "candidate"])
    # ungrouped: every voter of a group gets the group's position
    voters = E.ballots(data).join(groups.select("state", "county_name", "ballot", "group_id"),
                                  ["state", "county_name", "ballot"])
    per_voter = data.join(voters.select("state", "county_name", "cvr_id", "group_id"),
                          ["state", "county_name", "cvr_id"]).join(ids, ["race", "candidate"])
    alpha = M.fixed_alpha(groups.select(F.col("group_id").alias("voter_id")))
    params = M.fixed_candidate_params(ids)
    ungrouped = M.loglik(per_voter.select(F.col("group_id").alias("voter_id"), "race_id", "candidate_id"),
                         alpha, params).first().loglik
    grouped = M.loglik(long.select(F.col("group_id").alias("voter_id"), "race_id", "candidate_id", "n_group"),
                       alpha, params, weight_col="n_group").first().loglik
    assert math.isclose(grouped, ungrouped, rel_tol=1e-10)


def _objective(votes, alpha, params):
    ll = M.loglik(votes, alpha, params).first().loglik
    lp = M.log_prior(alpha, params, M.FIXED_MEAN_DIFF, M.FIXED_SIGMA_DIFF, M.FIXED_SIGMA_DISC).first().log_prior
    return ll + lp


def test_gradients_match_finite_differences(spark, sf_small):
    votes, ids, voters, alpha, params = _fixed(spark, sf_small)
    votes = votes.where(F.col("voter_id") <= 20).cache()
    alpha = alpha.where(F.col("voter_id") <= 20).cache()
    params = params.cache()
    h = 1e-5
    gv = {r.voter_id: r.grad for r in M.gradient_voter(votes, alpha, params).collect()}
    j = 7
    plus = alpha.withColumn("alpha", F.when(F.col("voter_id") == j, F.col("alpha") + h).otherwise(F.col("alpha")))
    minus = alpha.withColumn("alpha", F.when(F.col("voter_id") == j, F.col("alpha") - h).otherwise(F.col("alpha")))
    fd = (_objective(votes, plus, params) - _objective(votes, minus, params)) / (2 * h)
    assert math.isclose(fd, gv[j], rel_tol=1e-4, abs_tol=1e-6)
    gc = {(r.race_id, r.candidate_id): (r.g_disc, r.g_diff) for r in M.gradient_candidate(votes, alpha, params).collect()}
    key = sorted(gc)[3]
    for k, name in enumerate(("disc", "diff")):
        sel = (F.col("race_id") == key[0]) & (F.col("candidate_id") == key[1])
        p1 = params.withColumn(name, F.when(sel, F.col(name) + h).otherwise(F.col(name)))
        p0 = params.withColumn(name, F.when(sel, F.col(name) - h).otherwise(F.col(name)))
        fd = (_objective(votes, alpha, p1) - _objective(votes, alpha, p0)) / (2 * h)
        assert math.isclose(fd, gc[key][k], rel_tol=1e-4, abs_tol=1e-6)


def test_whiten_gives_identity_covariance(spark, sf_small):
    votes, ids, voters, alpha, params = _fixed(spark, sf_small)
    w = M.whiten(M.fixed_alpha_dims(voters), 2)
    r = w.select(F.col("alpha")[0].alias("a"), F.col("alpha")[1].alias("b")).agg(
        F.avg("a"), F.avg("b"), F.var_samp("a"), F.var_samp("b"), F.covar_samp("a", "b")).first()
    assert all(abs(x) < 1e-9 for x in (r[0], r[1], r[4]))
    assert abs(r[2] - 1) < 1e-9 and abs(r[3] - 1) < 1e-9
