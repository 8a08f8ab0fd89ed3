"""Generic relational building blocks used by the vote and posterior operators.

Each is written so that a hot key (a contest or candidate holding a third of all
rows) never lands whole in one task: counts and extremes are partial + final
aggregates, group filters are semi joins against the (small) key table, and
global numbering goes through range partitioning instead of a one-partition
window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, scalar_row

_OPS = {
    ">": lambda c, k: c > k, ">=": lambda c, k: c >= k, "<": lambda c, k: c < k,
    "<=": lambda c, k: c <= k, "==": lambda c, k: c == k, "!=": lambda c, k: c != k,
}


def group_size_filter(df: DataFrame, keys, op: str, k: int) -> DataFrame:
    """Keep rows whose key group satisfies ``count(*) <op> k``."""
    keys = list(keys)
    passing = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
                 .where(_OPS[op](F.col("_n"), F.lit(k))).select(*keys))
    return df.join(passing, keys, "left_semi")


def group_keys_where(df: DataFrame, keys, op: str, k: int) -> DataFrame:
    """Keys (distinct) whose group size satisfies the predicate."""
    keys = list(keys)
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
              .where(_OPS[op](F.col("_n"), F.lit(k))).select(*keys))


def distinct_on(df: DataFrame, keys, order) -> DataFrame:
    """One row per key, the first by ``order`` (a list of sort columns, ascending).

    Written as ``min(struct(order..., rest...))`` so it is a partial aggregate."""
    keys = list(keys)
    order = list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.min(F.struct(*[F.col(c) for c in order + rest])).alias("_m")
    out = df.groupBy(*keys).agg(packed)
    return out.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in order + rest]).select(df.columns)


def dense_ids(df: DataFrame, order_cols, id_col: str = "id", partitions: int | None = None) -> DataFrame:
    """Number the rows 1..N in the order of ``order_cols`` (a unique key).

    Range partitioning splits the key space by sampled bounds (a hot county is cut
    across several partitions), each partition is sorted locally, and a partition's
    first id is the prefix sum of the earlier partitions' counts (a table with one
    row per partition).  No window ever sees all rows.

    The range bounds are sampled from the input in arrival order, which after a
    shuffle is not fixed, so two evaluations can cut the key space differently.
    The partitioned, locally numbered rows are therefore written once and both the per-partition counts and the numbering read that
    copy; otherwise a re-planned or recomputed branch could disagree on ids."""
    order_cols = list(order_cols)
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
          .withColumn("_pid", F.spark_partition_id())
          .withColumn("_local", F.monotonically_increasing_id()
                      - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    # one row per partition: a size bound fixed by the partition count
    out = ranged.join(F.broadcast(offsets), "_pid")
    return out.withColumn(id_col, (F.col("_off") + F.col("_local") + 1).cast("long")) \
              .drop("_pid", "_local", "_off")


def group_quantiles(df: DataFrame, by, value_col: str, probs: dict) -> DataFrame:
    """Exact quantiles (linear interpolation, R type 7, as Spark's
    ``percentile``) of ``value_col`` per group; ``probs`` maps output column
    names to probabilities.  One row per group with at least one non-NULL value;
    a NULL in ``by`` is a group of its own.

    ``percentile`` merges every value of a group in one task, which is only safe
    for bounded groups (one parameter's draws).  Here the values are first
    aggregated to (group, value, count) on the map side, so ties collapse.  The
    distinct values are range-partitioned by (group, value), which cuts a hot group
    across partitions, and cumulative counts run within (group, partition); the
    counts of the partitions before come from a table with one row per group and
    partition.  A value holds the ranks [start, start + count), and the one or two
    wanted ranks per quantile pick their value by that interval."""
    by = list(by)
    keys = [f"_b{i}" for i in range(len(by))]
    vals = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value_col).cast("double").alias("_v")) \
             .where(F.col("_v").isNotNull())
    # one text key that tells a NULL from a value
    gkey = F.to_json(F.struct(*keys), {"ignoreNullFields": "true"})
    counts = vals.withColumn("_g", gkey).groupBy("_g", "_v").agg(
        F.count(F.lit(1)).alias("_c"), *[F.first(k).alias(k) for k in keys])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(counts.repartitionByRange(n, "_g", "_v").withColumn("_pid", F.spark_partition_id()))
    parts = ranged.groupBy("_g", "_pid").agg(F.sum("_c").alias("_pc"), *[F.first(k).alias(k) for k in keys])
    before = Window.partitionBy("_g").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut_lineage(parts.withColumn("_base", F.coalesce(F.sum("_pc").over(before), F.lit(0)).cast("long")))
    # the wanted ranks of each group, then the partition each of them lies in
    size = parts.groupBy("_g").agg(F.sum("_pc").alias("_n"), *[F.first(k).alias(k) for k in keys])
    wanted = F.array(*[F.struct(F.lit(name).alias("q"), F.lit(float(pr)).alias("p")) for name, pr in probs.items()])
    t = size.select("_g", "_n", F.explode(wanted).alias("_t"))
    t = t.select("_g", F.col("_t.q").alias("_q"), ((F.col("_n") - 1).cast("double") * F.col("_t.p")).alias("_h"))
    t = t.select("*", F.explode(F.array(F.struct(F.floor("_h").cast("long").alias("pos"), (1 - (F.col("_h") - F.floor("_h"))).alias("w")),
                                        F.struct(F.ceil("_h").cast("long").alias("pos"), (F.col("_h") - F.floor("_h")).alias("w")))).alias("_x"))
    t = t.select("_g", "_q", F.col("_x.pos").alias("_pos"), F.col("_x.w").alias("_w")).where(F.col("_w") > 0)
    at = t.join(parts.select("_g", "_pid", "_base", "_pc"), "_g") \
          .where((F.col("_pos") >= F.col("_base")) & (F.col("_pos") < F.col("_base") + F.col("_pc"))).drop("_pc")
    # only the partitions that hold a wanted rank are numbered
    wide = Window.partitionBy("_g", "_pid").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    need = ranged.join(at.select("_g", "_pid").distinct(), ["_g", "_pid"], "left_semi")
    upto = need.select("_g", "_pid", "_v", F.sum("_c").over(wide).alias("_upto"), "_c")
    hit = upto.join(at, ["_g", "_pid"]).where(
        (F.col("_pos") - F.col("_base") < F.col("_upto")) & (F.col("_pos") - F.col("_base") >= F.col("_upto") - F.col("_c")))
    out = hit.groupBy("_g").agg(*[F.sum(F.when(F.col("_q") == name, F.col("_v") * F.col("_w"))).alias(name) for name in probs])
    return size.join(out, "_g").select(*[F.col(k).alias(c) for c, k in zip(by, keys)], *probs)


def join_keys(a: DataFrame, b: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on ``keys``, NULL equal to NULL; the keys of the result are those of ``a``."""
    keys = list(keys)
    other = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = same if on is None else on & same
    return a.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def zscore(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Global z-score with the sample sd (one aggregate job, two numbers to the driver)."""
    row = scalar_row(df, F.avg(col).alias("m"), F.stddev_samp(col).alias("s"))
    return df.withColumn(out or col, (F.col(col) - F.lit(row["m"])) / F.lit(row["s"]))


def rescale01(df: DataFrame, cols, by) -> DataFrame:
    """Min-max rescale of ``cols`` to [0, 1] within each ``by`` group."""
    by = list(by)
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"_min_{c}"), F.max(c).alias(f"_max_{c}")]
    ext = df.groupBy(*by).agg(*aggs)
    j = df.join(ext, by, "left")
    for c in cols:
        j = j.withColumn(c, (F.col(c) - F.col(f"_min_{c}")) / (F.col(f"_max_{c}") - F.col(f"_min_{c}")))
    return j.drop(*[f"_min_{c}" for c in cols], *[f"_max_{c}" for c in cols])


def running_offset(df: DataFrame, order_col: str, size_col: str, out: str) -> DataFrame:
    """Exclusive prefix sum of ``size_col`` in ``order_col`` order.  Only for
    contest-sized dimensions (one row per contest)."""
    w = Window.orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(size_col).over(w), F.lit(0)).cast("long"))
