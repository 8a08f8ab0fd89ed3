"""Vote-record operators: check figures of the stand-in and the semantic traps."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from ideolens.functions import text as tx
from ideolens.operators import encode as E
from ideolens.operators import relational as R
from ideolens.operators import sampling as S
from ideolens.operators import votes as V
from ideolens.sources import fixtures as fx

CVR_COLS = ["state", "precinct", "cvr_id", "county_name", "candidate", "district", "magnitude", "office", "party"]


def cvr_frame(spark, rows):
    return spark.createDataFrame([Row(**dict(zip(CVR_COLS, r))) for r in rows],
                                 "state string, precinct string, cvr_id string, county_name string, candidate string, "
                                 "district string, magnitude tinyint, office string, party string")


def test_standin_check_figures(spark, sf_small):
    cvr = fx.cvr(spark, sf_small).cache()
    assert cvr.count() == 2907
    assert cvr.select("cvr_id").distinct().count() == 150
    comp = fx.compare(spark, sf_small)
    base = V.valid_votes(cvr, comp, fx.SAMPLE_STATE)
    prec = V.sample_precincts(base, fx.SAMPLE_PROP, fx.SAMPLE_SEED)
    voters = V.sample_voters(base, prec, fx.SAMPLE_N, fx.SAMPLE_SEED)
    sampled = base.join(voters, V.VOTER_KEY)
    small = V.small_candidates(sampled, 10)
    races = V.contested_races(base, small)
    out = V.get_votes(cvr, comp, fx.SAMPLE_STATE, fx.SAMPLE_PROP, fx.SAMPLE_N, 10, fx.SAMPLE_SEED)
    assert [base.count(), prec.count(), voters.count(), sampled.count(), small.count(), races.count(),
            out.count()] == [365, 5, 11, 156, 99, 11, 66]


def test_valid_votes_filters_and_race_key(spark):
    rows = [
        ("S", "p", "1", "C", "Alice", None, 1, "mayor", "democrat"),
        ("S", "p", "1", "C", "UNDERVOTE", None, 1, "council", None),
        ("S", "p", "1", "C", "overvote", None, 1, "judge", None),
        ("S", "p", "1", "C", "WriteIn 3", None, 1, "sheriff", None),
        ("S", "p", "1", "C", "Bob", "2", 2, "board", None),        # two seats
        ("S", "p", "1", "C", "Carl", "3", 1, None, None),          # no office
        ("S", "p", "1", "C", None, "4", 1, "clerk", None),         # NULL candidate (dropped like R)
        ("T", "p", "2", "D", "Dan", "5", 1, "mayor", None),
    ]
    out = V.valid_votes(cvr_frame(spark, rows), state="S").collect()
    assert [(r.candidate, r.race) for r in out] == [("Alice", "mayor_NA")]
    assert V.valid_votes(cvr_frame(spark, rows)).count() == 2


def test_fraction_floor_drops_small_counties(spark):
    df = spark.createDataFrame([("S", "C", f"p{i}") for i in range(5)] + [("S", "D", f"q{i}") for i in range(20)],
                               "state string, county_name string, precinct string")
    got = S.sample_fraction(df, ["state", "county_name"], ["precinct"], 0.1, 7)
    counts = {r.county_name: r["count"] for r in got.groupBy("county_name").count().collect()}
    assert counts == {"D": 2}


def test_sampling_ignores_partitioning(spark):
    df = spark.range(0, 3000).select(F.lit("S").alias("state"), (F.col("id") % 3).cast("string").alias("county_name"),
                                     (F.col("id") % 17).cast("string").alias("precinct"),
                                     F.col("id").cast("string").alias("cvr_id"))
    a = S.sample_n(df, ["state", "county_name", "precinct"], ["cvr_id"], 5, 11, ["cvr_id"])
    b = S.sample_n(df.repartition(13), ["state", "county_name", "precinct"], ["cvr_id"], 5, 11, ["cvr_id"])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.count() == 51 * 5


def test_small_counted_on_sample_contested_on_full(spark):
    base = spark.createDataFrame(
        [("r", "A")] * 30 + [("r", "B")] * 30 + [("s", "C")] * 30 + [("s", "D")] * 3, "race string, candidate string")
    sampled = spark.createDataFrame([("r", "A")] * 20 + [("s", "C")] * 20, "race string, candidate string")
    small = V.small_candidates(sampled, 10)           # nothing small in the sample
    races = sorted(r.race for r in V.contested_races(base, small).collect())
    assert races == ["r", "s"]                        # B and D never sampled, still count


def test_candidate_ids_rules(spark):
    data = spark.createDataFrame([
        ("us_1", "Zed", "democrat"), ("us_1", "Amy", "republican"), ("us_1", "Bo", None),
        ("us_1", "Cy", "green"), ("us_1", "Zed", "green"),          # Zed has two labels -> democrat
        ("prop_x_NA", "Yes", "democrat"), ("prop_x_NA", "No", None),  # proposition: no party
    ], "race string, candidate string, party string")
    ids = {(r.race, r.candidate): (r.candidate_id, r.race_id) for r in E.candidate_ids(data).collect()}
    assert ids[("us_1", "Zed")] == (1, 2)
    assert ids[("us_1", "Amy")][0] == 2 and ids[("us_1", "Cy")][0] == 3 and ids[("us_1", "Bo")][0] == 4
    assert ids[("prop_x_NA", "No")] == (1, 1) and ids[("prop_x_NA", "Yes")] == (2, 1)
    plural = {(r.race, r.candidate): r.candidate_id for r in E.candidate_ids(data, "plurality").collect()}
    assert plural[("us_1", "Zed")] == 1 and plural[("us_1", "Amy")] == 2


def test_dense_ids_skewed_and_ordered(spark):
    rows = [("S", "BIG", f"{i:05d}") for i in range(3000)] + [("S", f"C{i}", "1") for i in range(40)]
    df = spark.createDataFrame(rows, "state string, county_name string, cvr_id string")
    got = R.dense_ids(df, ["state", "county_name", "cvr_id"], "voter_id", partitions=7).collect()
    expect = {k: i + 1 for i, k in enumerate(sorted(rows))}
    assert len(got) == len(rows)
    assert all(expect[(r.state, r.county_name, r.cvr_id)] == r.voter_id for r in got)


def test_text_helpers(spark):
    df = spark.createDataFrame([("  JOE   MC HUGH ELIZABETH STORM ", "12345", None, "aXbXc")],
                               "a string, b string, c string, d string")
    r = df.select(tx.recode(tx.squish("a"), tx.TICKET_NAMES).alias("a"), tx.pad_left("b", 3).alias("b"),
                  tx.not_in("c", ["x"]).alias("keep_null"), tx.replace_first("d", "X", "-").alias("d"),
                  tx.replace_fixed("d", "X", F.lit("+")).alias("e"), tx.paste("c", "b").alias("f"),
                  tx.str_c(F.col("c"), F.col("b"), sep="_").alias("g")).first()
    assert r.a == "JOE MCHUGH" and r.b == "12345" and r.keep_null is True
    assert r.d == "a-bXc" and r.e == "a+bXc" and r.f == "NA_12345" and r.g is None


def test_party_delta_bounds(spark, sf_small):
    out = V.party_delta(V.valid_votes(fx.cvr(spark, sf_small))).collect()
    assert out and all(0 <= r.delta <= 1 for r in out if r.delta is not None)
    assert all(r.max_delta >= r.delta for r in out if r.delta is not None)


def test_partitioned_parquet_round_trip(spark, sf_small, tmp_path):
    from ideolens.sources import io
    cvr = fx.cvr(spark, sf_small)
    io.write_table(cvr, str(tmp_path / "cvr"), ["state", "county_name"])
    back = io.read_cvr(spark, str(tmp_path / "cvr"), state="AMERICA")
    assert back.count() == cvr.where(F.col("state") == "AMERICA").count()
    assert "PartitionFilters: [isnotnull(state" in back._jdf.queryExecution().executedPlan().toString()


def test_csv_null_tokens(spark, tmp_path):
    from ideolens.sources import io
    p = tmp_path / "c.csv"
    p.write_text("state,county_name,contest,office,district\nCO,ADAMS,US HOUSE 8,us house,8\n"
                 "CO,ADAMS,#N/A,NA,\nCO,DENVER,Judge,judge,COUNTY_NAME\n")
    d = V.contest_dictionary(io.read_csv_strings(spark, str(p)))
    got = sorted((r.county_name, r.office, r.district) for r in d.collect())
    assert got == [("ADAMS", "US HOUSE", "008"), ("DENVER", "JUDGE", "DENVER")]


def test_party_delta_when_the_largest_office_is_nonpartisan(spark):
    """Sides come from the largest office in which both parties stand; none gives no rows."""
    rows = [("s", "c", str(i), "judge", "judge", "x", "nonpartisan") for i in range(9)]
    rows += [("s", "c", str(i), "mayor", "mayor", "d" if i % 2 else "r", "democrat" if i % 2 else "republican") for i in range(6)]
    cols = "state string, county_name string, cvr_id string, race string, office string, candidate string, party string"
    data = spark.createDataFrame(rows, cols)
    out = {(r.race, r.candidate): r for r in V.party_delta(data).collect()}
    assert out["mayor", "d"].n_dem == 3 and out["mayor", "d"].n_rep == 0 and out["mayor", "d"].delta == 1.0
    assert out["judge", "x"].delta == 0.0
    assert V.party_delta(data.where("office = 'judge'")).count() == 0
