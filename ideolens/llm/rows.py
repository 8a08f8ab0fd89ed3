"""Tables, row keys and intermediate results shared by the operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ideolens.session import ensure_checkpoint_dir

#: Largest estimated size of a table that a broadcast join may copy to every executor.
BROADCAST_BYTES = 32 << 20
#: Paths of the settled tables of this process that were not discarded.
_settled: list[str] = []


#: Rows of an Arrow batch sent to Python.  Texts are long: at Spark's 10,000 rows a batch
#: takes tens of megabytes on both sides of every worker's pipe, and again when it grows.
ARROW_ROWS = 1024


def short_batches(df: DataFrame) -> None:
    """Lower the session's Arrow batch length to ARROW_ROWS if it is longer.  Results do not
    depend on it; a shorter one that the user chose stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(key))
    if now <= 0 or now > ARROW_ROWS:
        conf.set(key, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str = "text"):
    """Content part of a row key.  Rows are told apart by (doc_id, text_key): repeated
    rows with one id and one text get one result, rows that share an id but not the text
    each get their own."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def pack(docs: DataFrame, *names) -> DataFrame:
    """The named columns, and all of them as the struct ``row``, so that no column of docs
    meets one of an operator."""
    return docs.select(*names, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unpack(df: DataFrame, docs: DataFrame, **new) -> DataFrame:
    """The columns of docs from ``row``; ``new`` columns replace those of the same name (in
    any case) or come after them."""
    left = dict(new)
    out = []
    for c in docs.columns:
        name = next((n for n in left if n.lower() == c.lower()), None)
        out.append(F.col(f"row.`{c}`") if name is None else left.pop(name).alias(name))
    return df.select(*out, *(column.alias(name) for name, column in left.items()))


def join_rows(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on (doc_id, tkey), which stay as a has them; a null doc_id equals a null doc_id."""
    other = b.withColumnsRenamed({"doc_id": "_other_id", "tkey": "_other_key"})
    on = F.col("doc_id").eqNullSafe(F.col("_other_id")) & (F.col("tkey") == F.col("_other_key"))
    return a.join(other, on, how).drop("_other_id", "_other_key")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder as Parquet and read it back.

    It cuts the lineage (a lost executor costs no earlier work), computes the frame once
    for several uses and tells the planner its real size."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _settled.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


@contextmanager
def scratch(spark: SparkSession):
    """Delete the settled tables that were made inside, when the results that need them
    have been written."""
    outer = list(_settled)
    _settled.clear()
    try:
        yield
    finally:
        for path in _settled:
            _delete(spark, path)
        _settled[:] = outer


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete a settled table that a newer one supersedes."""
    path = getattr(df, "_settled_path", None)
    if path:
        _delete(df.sparkSession, path)
        if path in _settled:
            _settled.remove(path)


def broadcast_if_small(df: DataFrame, row_bytes=64, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a settled table for a broadcast join if its rows (``row_bytes``: bytes of one
    row, a number or a column) sum to ``max_bytes`` at most; a larger one is left to a
    shuffled join, which adaptive execution splits where keys are skewed."""
    n = df.agg(F.sum(row_bytes if not isinstance(row_bytes, int) else F.lit(row_bytes)).alias("n")).first()["n"]
    return F.broadcast(df) if (n or 0) <= max_bytes else df
