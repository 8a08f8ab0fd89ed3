"""Readers and sinks on small files."""

from pyspark.sql import functions as F

from ideolens.functions import text as tx
from ideolens.plans import scores as SC
from ideolens.sources import io


def test_label_row_csv_gives_doubles(spark, tmp_path):
    (tmp_path / "a.csv").write_text("area,share,code,none\nLabel,Share of all,Code,\nx,1.5,007,\ny,,abc,\nz,-2,8,\n")
    df = io.read_csv_inferred(spark, str(tmp_path / "a.csv"), "area", "Label")
    assert dict(df.dtypes) == {"area": "string", "share": "double", "code": "string", "none": "string"}
    assert sorted((r.area, r.share, r.code) for r in df.collect()) == [("x", 1.5, "007"), ("y", None, "abc"), ("z", -2.0, "8")]


def test_filtered_csv_reads_with_the_schema(spark, tmp_path):
    (tmp_path / "b.csv").write_text("a,b,c\n1,x,2.5\n2,y,3.5\n")
    df = io.read_filtered_csv(spark, str(tmp_path / "b.csv"), F.col("a") > 1, ["c"], "a int, b string, c double")
    assert [tuple(r) for r in df.collect()] == [(3.5,)]


def test_null_tokens(spark, tmp_path):
    (tmp_path / "c.csv").write_text('p,q\nNA,1\n#N/A,""\nx,NA\n')
    assert [tuple(r) for r in io.read_csv_strings(spark, str(tmp_path / "c.csv")).collect()] == [(None, "1"), (None, None), ("x", None)]


def test_party_is_filled_in(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "d"))
    assert io.read_contest_sample(spark, str(tmp_path / "d")).schema["party"].dataType.simpleString() == "string"


def test_partitioned_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("CO", "p", "1", "Adams", "X", "1", "US HOUSE", "democrat")],
                               "state string, precinct string, cvr_id string, county_name string, candidate string, district string, office string, party string")
    io.write_table(df.withColumn("magnitude", F.lit(1).cast("byte")), str(tmp_path / "e"), ["state", "county_name"])
    assert io.read_cvr(spark, str(tmp_path / "e"), "CO").count() == 1
    assert io.read_cvr(spark, str(tmp_path / "e"), "XX").count() == 0


def test_external_scores_prepared(spark):
    """Seats recoded, losers, other states, cycles and seats out, districts padded."""
    rows = [("federal:house", "5", "A", 1.0, 2020, "W", "CO"), ("federal:house", "005", "B", 3.0, 2020, "W", "00"),
            ("federal:house", "5", "C", 9.0, 2020, "L", "CO"), ("federal:house", "5", "D", 9.0, 2020, None, "CO"),
            ("federal:house", "5", "E", 9.0, 2018, "W", "CO"), ("local:mayor", "5", "F", 9.0, 2020, "W", "CO"),
            ("federal:house", "5", "G", 9.0, 2020, "W", "TX"), ("state:upper", "7", "H", 2.0, 2020, "W", "CO")]
    raw = spark.createDataFrame(rows, "seat string, district string, candidate string, cfscore double, cycle int, pwinner string, state string")
    races = spark.createDataFrame([("US HOUSE - 005",), ("STATE SENATE - 007",)], "race string")
    ext = SC.external_seats(raw, 2020, ("CO", "00"))
    got = SC.external_scores(ext, races, None, " - ", pad_width=3).collect()
    assert sorted((r.race, r.candidate, r.dime_score) for r in got) == [("US HOUSE - 005", "A", -1.0), ("US HOUSE - 005", "B", 1.0)]


def test_parameter_names(spark):
    df = spark.createDataFrame([("lp__", None, None), ("alpha", 3, None), ("disc", 1, 2)], "v string, i int, j int")
    assert [r[0] for r in df.select(tx.parameter_name("v", "i", "j")).collect()] == ["lp__", "alpha[3]", "disc[1,2]"]
