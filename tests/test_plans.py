"""Plan shapes that the scale design relies on."""

import math
import re

import pytest
from pyspark.sql import functions as F

from ideolens.plans import fit as FT
from ideolens.plans.model import contest_arrays
from ideolens.session import cut_lineage, forget, keep_bucketed


def _plan(df):
    jvm = df.sparkSession._jvm
    return df._jdf.queryExecution().explainString(
        jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


@pytest.fixture
def no_auto_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _votes(spark, n_voters=200, n_races=4):
    rows = [(j, k, 1 + (j + k) % 3) for j in range(1, n_voters + 1) for k in range(1, n_races + 1)]
    votes = spark.createDataFrame(rows, "voter_id long, race_id long, candidate_id long")
    ids = spark.createDataFrame([(k, c) for k in range(1, n_races + 1) for c in (1, 2, 3)],
                                "race_id long, candidate_id long")
    return votes, ids


def test_bucketed_tables_need_no_shuffle(spark, no_auto_broadcast):
    a, b = (keep_bucketed(spark.range(1000).withColumn(c, F.col("id") % 7).repartition(4, "id"), "id", 4) for c in "xy")
    assert "Exchange" not in _plan(a.join(b, "id").groupBy("id").agg(F.sum("x")))
    forget(a, b)


def test_session_settings_stay(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    forget(cut_lineage(spark.range(10)), keep_bucketed(spark.range(10), "id", 2))
    assert before == {k: spark.conf.get(k) for k in before}


def test_voter_step_needs_no_shuffle_of_votes(spark, no_auto_broadcast):
    """Votes and voter state are bucketed by voter_id: with automatic broadcasts off
    (as for a table far above the threshold) the votes x alpha join and the
    per-voter sums plan no Exchange; only the contest arrays are broadcast."""
    votes, ids = _votes(spark)
    v = FT.prepare_votes(votes)
    alpha = keep_bucketed(FT.init_alpha(v), "voter_id", FT.buckets_of(v))
    params = cut_lineage(FT.init_params(v, ids))
    plan = _plan(FT.voter_step(v, alpha, cut_lineage(contest_arrays(params))))
    assert not re.search(r"Exchange hashpartitioning", plan), plan
    assert "SortMergeJoin" in plan


def test_no_task_holds_a_whole_contest_without_broadcast(spark, no_auto_broadcast):
    """Beyond the size bound the contest join is dealt by (contest, salt)."""
    votes, ids = _votes(spark)
    v = FT.prepare_votes(votes)
    arrays = cut_lineage(contest_arrays(FT.init_params(v, ids)))
    joined = FT.with_contest_arrays(v, arrays, spread=True)
    plan = _plan(joined)
    assert "BroadcastHashJoin" not in plan and re.search(r"hashpartitioning\(race_id#\d+L, _salt", plan), plan
    assert joined.count() == v.count()
    salts = v.where("race_id = 1").select(F.pmod(F.xxhash64("voter_id"), F.lit(FT.CONTEST_SALTS))).distinct().count()
    assert salts > FT.CONTEST_SALTS // 2  # the voters of one contest spread over the salts


def test_get_votes_scans_the_records_once(spark, tmp_path):
    """The plan reads written tables only; the records were scanned by one earlier job."""
    from ideolens.operators import votes as V
    from ideolens.sources import fixtures as fx
    from ideolens.sources import io
    io.write_table(fx.cvr(spark, "/root/testdata/sf0.001"), str(tmp_path / "cvr"), ["state", "county_name"])
    cvr = io.read_cvr(spark, str(tmp_path / "cvr"))
    assert "PartitionFilters: [isnotnull(state" in _plan(io.read_cvr(spark, str(tmp_path / "cvr"), "AMERICA"))
    out = V.get_votes(cvr, None, "AMERICA", 0.4, 500, 2)
    assert _plan(out).count("tmp_path") == 0 and str(tmp_path) not in _plan(out)


def test_softmax_is_stable_on_long_and_large_arrays(spark):
    from ideolens.functions.arrays import softmax
    df = spark.createDataFrame([([0.0, 1.0, 2.0],)], "u array<double>")
    p = df.select(softmax(F.col("u")).alias("p")).first().p
    assert abs(sum(p) - 1) < 1e-12 and p[2] > p[1] > p[0]
    big = spark.createDataFrame([([800.0, 801.0, -5.0],), ([float(i) for i in range(400)],)], "u array<double>")
    for r in big.select("u", softmax(F.col("u")).alias("p")).collect():
        top = max(r.u)
        e = [math.exp(x - top) for x in r.u]
        assert all(abs(a - b / sum(e)) < 1e-12 for a, b in zip(r.p, e))


def test_dense_ids_consistent_on_cached_shuffled_input(spark):
    """Ids stay 1..N and unique when the input arrives from a shuffle and a cache
    (range bounds sampled in arrival order must not differ between branches)."""
    from ideolens.operators.relational import dense_ids
    src = spark.range(20000).select((F.col("id") * 7919 % 20000).alias("k"), (F.col("id") % 13).alias("g"))
    df = src.groupBy("g", "k").count().cache()
    df.count()
    ids = dense_ids(df, ["g", "k"], "id")
    r = ids.agg(F.min("id").alias("lo"), F.max("id").alias("hi"),
                F.countDistinct("id").alias("d"), F.count(F.lit(1)).alias("n")).first()
    df.unpersist()
    assert (r.lo, r.hi, r.d, r.n) == (1, 20000, 20000, 20000)
    first = ids.orderBy("id").select("g", "k").limit(3).collect()
    expected = sorted({(i % 13, i * 7919 % 20000) for i in range(20000)})[:3]
    assert [(x.g, x.k) for x in first] == expected
