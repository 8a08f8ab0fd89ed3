"""Explicit schemas of the tables the engine reads and writes."""

from pyspark.sql import types as T

# Cast vote record: one row per voter x contest choice; partitioned by state and county_name.
CVR_SCHEMA = T.StructType([
    T.StructField("state", T.StringType()),
    T.StructField("precinct", T.StringType()),
    T.StructField("cvr_id", T.StringType()),
    T.StructField("county_name", T.StringType()),
    T.StructField("candidate", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("magnitude", T.ByteType()),
    T.StructField("office", T.StringType()),
    T.StructField("party", T.StringType()),
])

CVR_COLUMNS = [f.name for f in CVR_SCHEMA.fields]

# Registry of released counties.
COMPARE_SCHEMA = T.StructType([
    T.StructField("state", T.StringType()),
    T.StructField("county_name", T.StringType()),
    T.StructField("release", T.IntegerType()),
])

# Posterior draws in long form.
DRAWS_SCHEMA = T.StructType([
    T.StructField("chain", T.LongType()),
    T.StructField("iteration", T.LongType()),
    T.StructField("draw", T.LongType()),
    T.StructField("variable", T.StringType()),
    T.StructField("idx", T.LongType()),
    T.StructField("value", T.DoubleType()),
])

# Encoded votes (long form of the ragged arrays).
VOTES_SCHEMA = T.StructType([
    T.StructField("voter_id", T.LongType()),
    T.StructField("race_id", T.LongType()),
    T.StructField("candidate_id", T.LongType()),
])

# External candidate scores.
EXTERNAL_SCHEMA = T.StructType([
    T.StructField("office", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("candidate", T.StringType()),
    T.StructField("cfscore", T.DoubleType()),
    T.StructField("cycle", T.IntegerType()),
])
