"""Exact, reproducible stratified sampling (A1-A5).

Random order is a hash of the seed and the row key, so a sample does not depend
on partitioning, task retries or the physical plan, and an SQL engine can
reproduce it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed, cols) -> F.Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def sample_fraction(df: DataFrame, strata, key_cols, prop: float, seed) -> DataFrame:
    """A1: ``floor(prop * n)`` rows of each stratum, in hash order of (strata, key).

    Applied to a distinct key dimension (e.g. precincts of a county), whose
    strata are bounded by the number of keys per stratum."""
    strata, key_cols = list(strata), list(key_cols)
    w = Window.partitionBy(*strata)
    h = hash_order(seed, strata + key_cols)
    ranked = (df.withColumn("_h", h)
                .withColumn("_rn", F.row_number().over(w.orderBy("_h", *key_cols)))
                .withColumn("_n", F.count(F.lit(1)).over(w)))
    return ranked.where(F.col("_rn") <= F.floor(F.col("_n") * F.lit(float(prop)))) \
                 .drop("_h", "_rn", "_n")


def sample_n(df: DataFrame, strata, key_cols, n: int, seed, hash_cols=None) -> DataFrame:
    """A2: at most ``n`` rows per stratum in hash order.

    ``row_number() <= n`` lets Spark insert a partial per-group limit before the
    shuffle (window group limit), so a huge stratum sends at most n rows per map
    task to the final ranking."""
    strata, key_cols = list(strata), list(key_cols)
    h = hash_order(seed, list(hash_cols) if hash_cols else key_cols)
    w = Window.partitionBy(*strata).orderBy("_h", *key_cols)
    return (df.withColumn("_h", h).withColumn("_rn", F.row_number().over(w))
              .where(F.col("_rn") <= n).drop("_h", "_rn"))


def sample_global(df: DataFrame, key_cols, n: int, seed) -> DataFrame:
    """A3: ``n`` rows overall in hash order (a top-k, no full sort)."""
    key_cols = list(key_cols)
    return (df.withColumn("_h", hash_order(seed, key_cols))
              .orderBy("_h", *key_cols).limit(n).drop("_h"))


def sample_with_forced(df: DataFrame, key_cols, n: int, seed, forced: DataFrame) -> DataFrame:
    """A4: global sample plus members that must always be present, deduplicated."""
    return sample_global(df, key_cols, n, seed).unionByName(forced.select(df.columns)).distinct()


def sample_parameter_names(draws: DataFrame, variable: str, n: int, seed) -> DataFrame:
    """A5: a random set of indices of one variable, returned as its draws."""
    ids = draws.where(F.col("variable") == variable).select("idx").distinct()
    picked = sample_global(ids, ["idx"], n, seed)
    return draws.where(F.col("variable") == variable).join(picked, "idx", "left_semi")
