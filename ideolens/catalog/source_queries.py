"""Registered queries that go through the sources and sinks (S1-S11): the stand-in tables
are written to the session's checkpoint folder in the form of the reference's files and read
back by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources import io
from . import inputs as I
from .inputs import round_doubles, with_ctes

Q: dict = {}
SQL: dict = {}


def q(name, sql):
    def deco(fn):
        Q[name], SQL[name] = fn, sql
        return fn
    return deco


@q("source_read_cvr", with_ctes(f"""
SELECT precinct, cvr_id, candidate, district, office, party, CAST(magnitude AS INTEGER) AS magnitude, state, county_name
FROM cvr WHERE state = '{fx.SAMPLE_STATE}'""", "cvr"))
def source_read_cvr(spark, d):
    """S7 then S1: records partitioned by state and county, one state read back."""
    path = scratch_path(spark, "cvr")
    io.write_table(I.cvr(spark, d), path, ["state", "county_name"])
    back = io.read_cvr(spark, path, fx.SAMPLE_STATE)
    return back.withColumn("magnitude", F.col("magnitude").cast("int"))


@q("source_contest_sample", with_ctes("""
SELECT DISTINCT state, office, CAST(NULL AS VARCHAR) AS party FROM cvr WHERE office IS NOT NULL""", "cvr"))
def source_contest_sample(spark, d):
    """A file without the party column."""
    path = scratch_path(spark, "contests")
    io.write_table(I.cvr(spark, d).where(F.col("office").isNotNull()).select("state", "office").distinct(), path)
    return io.read_contest_sample(spark, path)


_TOKENS = "CASE o_orderpriority WHEN '5-LOW' THEN 'NA' WHEN '4-NOT SPECIFIED' THEN '#N/A' WHEN '1-URGENT' THEN '' ELSE o_orderpriority END"


@q("source_csv_strings", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
  CASE WHEN o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED', '1-URGENT') THEN NULL ELSE o_orderpriority END AS priority
FROM orders""")
def source_csv_strings(spark, d):
    """S8 then S3: text columns in which three tokens mean NULL."""
    path = scratch_path(spark, "strings")
    io.write_csv(fx.table(spark, d, "orders").select("o_orderkey", F.expr(_TOKENS).alias("priority")), path)
    return io.read_csv_strings(spark, path)


@q("source_csv_labelled", """
SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer""")
def source_csv_labelled(spark, d):
    """A label row under the header; numeric columns come back as doubles."""
    rows = fx.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"),
                                                 F.col("c_acctbal").cast("string").alias("c_acctbal"), "c_mktsegment")
    label = spark.createDataFrame([("Customer key", "Balance", "Segment")], rows.schema)
    path = scratch_path(spark, "labelled")
    io.write_csv(label.unionByName(rows), path)
    return io.read_csv_inferred(spark, path, "c_mktsegment", "Segment")


@q("source_csv_filtered", """
SELECT s_suppkey, round(CAST(s_acctbal AS DOUBLE), 4) AS s_acctbal FROM supplier WHERE s_acctbal > 0""")
def source_csv_filtered(spark, d):
    """Filter and projection of a CSV with a given schema."""
    path = scratch_path(spark, "filtered")
    io.write_csv(fx.table(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey"), path)
    back = io.read_filtered_csv(spark, path, F.col("s_acctbal") > 0, ["s_suppkey", "s_acctbal"],
                                "s_suppkey long, s_acctbal double, s_nationkey long")
    return round_doubles(back)


@q("source_released_counties", with_ctes("SELECT * FROM compare", "compare"))
def source_released_counties(spark, d):
    """The registry written, read as a cached table, and filtered."""
    path = scratch_path(spark, "registry")
    io.write_table(fx.registry(spark, d), path)
    return io.released_counties(io.read_table(spark, path))


@q("source_draws", with_ctes("SELECT chain, iteration, draw, variable, idx, round(value, 6) AS value FROM draws", "draws"))
def source_draws(spark, d):
    """S10 then S9: draws saved by model and number of voters, and read back."""
    draws = fx.draws(spark, d)
    path = io.save_draws(draws, scratch_path(spark, "fits"), "2pl", 32)
    return round_doubles(io.read_draws(spark, path).select(*draws.columns), value=6)
