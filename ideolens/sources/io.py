"""Sources and sinks: partitioned parquet, CSV with custom null tokens, draws tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import CVR_SCHEMA

# Null tokens of the contest dictionary CSV.
CSV_NULL_TOKENS = ("", "NA", "#N/A")


def read_cvr(spark: SparkSession, path: str, state: str | None = None) -> DataFrame:
    """Partitioned CVR parquet (``state=../county_name=..``) with the projected schema.

    The explicit schema prunes columns at the scan; a ``state`` equality becomes a
    partition filter, so only that state's directories are listed and read."""
    df = (spark.read.schema(CVR_SCHEMA)
          .option("basePath", path)
          .parquet(path))
    if state is not None:
        df = df.where(F.col("state") == F.lit(state))
    return df


def read_contest_sample(spark: SparkSession, path: str) -> DataFrame:
    """Single parquet file; ``party`` back-filled as typed NULL when absent."""
    df = spark.read.parquet(path)
    if "party" not in df.columns:
        df = df.withColumn("party", F.lit(None).cast(T.StringType()))
    return df


def read_csv_strings(spark: SparkSession, path: str, null_tokens=CSV_NULL_TOKENS) -> DataFrame:
    """S3: all-string CSV where several tokens mean NULL (Spark's reader accepts one)."""
    raw = (spark.read.option("header", True).option("inferSchema", False)
           .option("nullValue", None).option("emptyValue", "").csv(path))
    tokens = list(null_tokens)
    return raw.select([
        F.when(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").isin(tokens), F.lit(None).cast("string"))
         .otherwise(F.col(f"`{c}`")).alias(c)
        for c in raw.columns
    ])


def read_csv_inferred(spark: SparkSession, path: str, label_column: str | None = None,
                      label_value: str | None = None) -> DataFrame:
    """CSV with inferred types.  Files carrying one extra label row under the
    header are read as strings, the label row is filtered out, and every column whose
    values (as far as there are any) all read as numbers becomes double: one aggregate
    over the file tells which."""
    reader = spark.read.option("header", True)
    if label_column is None:
        return reader.option("inferSchema", True).csv(path)
    df = reader.option("inferSchema", False).csv(path)
    df = df.where(~F.coalesce(F.col(f"`{label_column}`") == F.lit(label_value), F.lit(False)))
    number = {c: F.col(f"`{c}`").try_cast("double") for c in df.columns}
    checks = df.agg(*[F.sum((F.col(f"`{c}`").isNotNull() & number[c].isNull()).cast("long")).alias(f"bad{i}")
                      for i, c in enumerate(df.columns)],
                    *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return df.select([number[c].alias(c) if checks[f"n{i}"] and not checks[f"bad{i}"] else F.col(f"`{c}`")
                      for i, c in enumerate(df.columns)])


def read_filtered_csv(spark: SparkSession, path: str, predicate, columns, schema) -> DataFrame:
    """Big CSV scan with filter and projection in one pass.  ``schema`` gives the
    types, so the file is not read twice; Catalyst pushes both into the scan."""
    return spark.read.option("header", True).schema(schema).csv(path).where(predicate).select(*columns)


def released_counties(registry: DataFrame) -> DataFrame:
    """Registry of released counties: ``release == 1``, distinct (state, county)."""
    return registry.where(F.col("release") == 1).select("state", "county_name").distinct()


def write_table(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite") -> None:
    """Parquet sink for intermediate tables."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with header."""
    df.write.mode(mode).option("header", True).csv(path)


def fit_path(root: str, model: str, n_voters: int, kind: str = "full") -> str:
    """Location of a saved fit, keyed by model and voter count."""
    return f"{root.rstrip('/')}/{model}_numV{n_voters}_{kind}"


def save_draws(draws: DataFrame, root: str, model: str, n_voters: int, kind: str = "full") -> str:
    """Write a draws table (long form) and return its path."""
    path = fit_path(root, model, n_voters, kind)
    draws.write.mode("overwrite").partitionBy("variable").parquet(path)
    return path


def read_draws(spark: SparkSession, path: str) -> DataFrame:
    """Load saved draws in long form (chain, iteration, draw, variable, idx, value)."""
    return spark.read.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a cached intermediate table."""
    return spark.read.parquet(path)
