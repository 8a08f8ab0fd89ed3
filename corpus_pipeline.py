"""Corpus pipeline: documents -> toxicity filter -> line dedup -> near-duplicate removal ->
benchmark decontamination -> mix of the sources.

Every stage takes (spark, docs, sf_dir), works on all rows of its predecessor, and all but
the last return the columns of ``documents``.  Rows are judged by their doc_id and text, so
nulls, repeated rows and further columns are handled as the operators define.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ideolens.llm import lines, mixing, simhash, toxicity, winnowing
from ideolens.llm.rows import broadcast_if_small, join_rows, pack, scratch, settle, table, text_key, unpack
from ideolens.session import ensure_checkpoint_dir


def _judged(docs: DataFrame, result: DataFrame) -> DataFrame:
    """The rows of docs that have a row (doc_id, tkey, ...) in ``result``."""
    keys = broadcast_if_small(settle(result.select("doc_id", "tkey").distinct()), 48)
    return unpack(join_rows(pack(docs, "doc_id", text_key().alias("tkey")), keys, "left_semi"), docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    scored = toxicity.score(pack(docs, "doc_id", "text"), table(spark, sf_dir, "labels"))
    return unpack(scored.where(F.col("predicted") == 0), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without common lines; one of which no text is left goes, unless it had none."""
    kept = lines.drop_common_lines(pack(docs, "doc_id", "text"))
    kept = kept.where((F.col("n_dropped") == 0) | (F.length(F.btrim("kept_text", F.lit(" \t\n\x0b\x0c\r"))) > 0))
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        n_chars = F.when(changed, F.length("kept_text")).otherwise(F.col("row.n_chars"))
        new["n_chars"] = n_chars.cast(docs.schema["n_chars"].dataType)
    return unpack(kept, docs, **new)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: the row with the smallest doc_id;
    of several rows with this id, or if no row has an id, the one with the smallest text hash."""
    found = simhash.near_duplicates(docs)
    least = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey")).alias("x")).select("x.doc_id", "x.tkey")
    copies = found.groupBy("doc_id", "tkey").agg(F.count("*").alias("n"))
    one = broadcast_if_small(settle(join_rows(copies, least, "left_semi")), 56)
    rows = join_rows(pack(docs, "doc_id", text_key().alias("tkey")), one)
    # only repeated rows of one id and text need to be brought together
    kept = rows.where("n = 1").unionByName(rows.where("n > 1").dropDuplicates(["doc_id", "tkey"]))
    return unpack(kept, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words overlap with benchmark items."""
    found = winnowing.find_overlaps(docs, table(spark, sf_dir, "benchmark"))
    return _judged(docs, found.where(~winnowing.contaminated()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and words of each document, and how often the mix takes it."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "repeats", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The toxicity stage trains a classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read by the next one, and
    its intermediate tables are deleted then."""
    docs = table(spark, sf_dir, "documents")
    at = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{at}/{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
