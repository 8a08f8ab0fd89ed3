"""Tables that grow with the input are not broadcast by the size of their file."""

import pytest

from ideolens import catalog
from ideolens.catalog import inputs
from ideolens.operators import encode as E
from ideolens.operators import votes as V
from ideolens.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_beyond_the_bound_are_not_broadcast(spark, monkeypatch):
    # nation and region only; the threshold of the session would take any of these small files
    want = sorted(map(tuple, fx.cvr(spark, SF).collect()), key=str)
    monkeypatch.setattr(fx, "SIDE_BYTES", 0)
    df = fx.cvr(spark, SF)
    assert _plan(df).count("BroadcastExchange") == 2
    assert sorted(map(tuple, df.collect()), key=str) == want


def test_grouped_loglik_does_not_broadcast_its_groups(spark):
    plan = _plan(catalog.queries()["loglik_grouped"](spark, SF))
    assert "SortMergeJoin [voter_id" in plan
    # the records are read from their written copy, not joined again for each use
    assert "l_orderkey" not in plan


def test_many_voters_are_joined_by_sort_and_merge(spark, monkeypatch):
    data = inputs.all_valid(spark, SF)
    want = sorted(map(tuple, data.join(E.voter_ids(data), V.VOTER_KEY).collect()), key=str)
    monkeypatch.setattr(E, "VOTERS_BYTES", 0)
    df = data.join(E.voter_ids(data), V.VOTER_KEY)
    assert "SortMergeJoin [state" in _plan(df)
    assert sorted(map(tuple, df.collect()), key=str) == want


#: Queries that join votes and voters, both far below the session's threshold here.
BY_VOTER = ["loglik_2pl", "loglik_2pl_centered", "loglik_1pl", "bernoulli_probabilities", "fit_voter_step", "fit_dims_voter_step", "fit_joint_product"]


@pytest.mark.parametrize("name", BY_VOTER)
def test_neither_votes_nor_voters_are_broadcast(spark, name):
    plan = _plan(catalog.queries()[name](spark, SF))
    assert "SortMergeJoin [voter_id" in plan
    assert "BroadcastHashJoin [voter_id" not in plan
    # the votes are the left side of the joins with contests
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin [race_id" in x and "BuildLeft" in x]
