"""Spark session and cluster-facing helpers shared by every module."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Largest estimated size of a table that a broadcast join copies to every executor.
BROADCAST_BYTES = 64 << 20


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "ideolens") -> SparkSession:
    """Session with AQE (runtime broadcast conversion, partition coalescing and
    skew-join splitting) switched on.

    On a cluster pass ``master=None``: the master, shuffle partition count and
    memory come from spark-submit and are not overridden (size
    ``spark.sql.shuffle.partitions`` for the data, e.g. a few thousand for
    100 TB; AQE coalesces partitions that turn out small).  Without a configured
    master the session runs ``local[N]`` with N shuffle partitions."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    # launched by spark-submit (it hands Python the gateway port), told a master
    # by the environment, or joining a running session: keep that configuration
    submitted = bool(os.environ.get("PYSPARK_GATEWAY_PORT") or os.environ.get("SPARK_MASTER")
                     or SparkSession.getActiveSession() is not None)
    on_cluster = master is None and submitted
    builder = SparkSession.builder.appName(app)
    if master is None and not on_cluster:
        master = f"local[{cpus}]"
    if master:
        builder = builder.master(master)
    if shuffle_partitions or not on_cluster:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
    if not on_cluster:
        builder = builder.config("spark.driver.memory", os.environ.get("IDEOLENS_DRIVER_MEMORY", "16g"))
    builder = (
        builder
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder; it is only
    filled in here (with a fresh scratch folder) when the session runs in local
    mode and nothing is configured, as in tests.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder "
                           "(for example an object-store or HDFS path) before running fits")
    local_dir = tempfile.mkdtemp(prefix="ideolens-ckpt-", dir="/tmp")
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new location under the session's checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder (Parquet) and read it back.

    The frame is computed once, survives lost executors, and tells the planner its
    real size.  ``forget`` deletes it when a newer state supersedes it."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept = (None, path)
    return out


def keep_bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Like ``cut_lineage``, as a table bucketed by ``key``: joins and aggregates on
    ``key`` between tables with as many buckets need no shuffle, also under adaptive
    execution.  ``df`` should already be partitioned by ``key`` into ``buckets``
    partitions, so that every task writes one bucket."""
    spark = df.sparkSession
    path = scratch_path(spark, "bucketed")
    name = "ideolens_" + uuid.uuid4().hex
    df.write.format("parquet").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    out = spark.table(name)
    out._kept = (name, path)
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables written by ``cut_lineage`` or ``keep_bucketed``."""
    for df in frames:
        kept = getattr(df, "_kept", None)
        if kept is None:
            continue
        spark = df.sparkSession
        name, path = kept
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fits_broadcast(df: DataFrame, row_bytes: F.Column | int, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of an already written table sum to ``max_bytes`` at most."""
    size = row_bytes if isinstance(row_bytes, F.Column) else F.lit(row_bytes)
    return (scalar_row(df, F.sum(size).alias("n"))["n"] or 0) <= max_bytes


def bounded_broadcast(df: DataFrame, row_bytes: F.Column | int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark an already written table for broadcast when its rows (``row_bytes`` each)
    sum to at most ``max_bytes``; a larger one is returned as it is and joined by a
    shuffle."""
    return F.broadcast(df) if fits_broadcast(df, row_bytes, max_bytes) else df


def merged_beyond(df: DataFrame, row_bytes: int, max_bytes: int) -> DataFrame:
    """Mark an already written table for joins by sort and merge when its rows (``row_bytes``
    each) sum to more than ``max_bytes``, whatever is selected from it.  Spark goes by the size
    of the file, and a compressed table below its threshold takes many times as much in the driver."""
    return df if fits_broadcast(df, row_bytes, max_bytes) else df.hint("merge")


def scalar_row(df: DataFrame, *aggs):
    """One global aggregate (partial + final, no single-partition window) returned
    to the driver as a Row of a few numbers."""
    return df.agg(*aggs).collect()[0]
