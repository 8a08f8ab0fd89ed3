"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the word budget in proportion to its weight.  A source whose
share exceeds ``max_epochs`` times its size is held there, and what it leaves is shared
again among the others by weight until no source is above its ceiling.  A source that is
given e epochs is repeated floor(e) times whole; the fractional epoch is a seeded sample of
its documents whose sizes sum to what is left of the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ideolens.llm.rows import broadcast_if_small, settle

WORD = r"[^\x20\x09-\x0D]+"
#: Documents are ordered by a seeded hash; 2 x CELL_BITS bits of it number the cells over
#: which sizes are summed before any single document is looked at.
CELL_BITS = 10
#: Passes that fill the rest of a fractional epoch; each leaves less than the size of the
#: first document that no longer fits.
PASSES = 3
WEIGHT_CYCLE = (1.0, 2.0, 3.0)


def source_weights(sources: DataFrame, cycle=WEIGHT_CYCLE) -> DataFrame:
    """Weights by repeating ``cycle`` over the sources in code point order, null last.
    One row per source: the window holds the list of sources, not their rows."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (rank % len(cycle)).cast("int") + 1)
    return sources.select("source", weight.alias("weight"))


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Targets of sources (source, source_size, weight).  The water level (target per unit
    of weight) only rises, so at most one round per source is needed; a round is one
    aggregate over the sources, of which the driver sees two sums."""
    ceiling = F.col("source_size") * F.lit(float(max_epochs))
    level, held = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > ceiling
        r = sources.agg(
            F.sum(F.when(above, ceiling).otherwise(0.0)).alias("full"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("w"),
            F.count(F.when(above, 1)).alias("held")).first()
        if r["held"] == held or not r["w"]:
            break
        held, level = r["held"], (budget - r["full"]) / r["w"]
    target = F.when(F.col("weight") * F.lit(level) > ceiling, ceiling).otherwise(F.col("weight") * F.lit(level))
    return sources.withColumn("target", target)


def _by_source(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "skey")


def _prefix(docs: DataFrame, quota: DataFrame) -> DataFrame:
    """Documents (skey, size, cell1, cell2, pick, ...) that, in the order of their hash, fit
    into quota (skey, room) of their source without exceeding it.

    Sizes are summed over cells of the hash first.  Cells that fit whole are taken, and only
    the cell in which the quota ends is opened, twice, so a window holds the cells of one
    source or the documents of one small cell."""
    taken, rest = None, _by_source(docs, broadcast_if_small(settle(quota)))
    for cell in ("cell1", "cell2"):
        sums = rest.groupBy("skey", cell).agg(F.sum("size").alias("s"), F.first("room").alias("r"))
        upto = F.sum("s").over(Window.partitionBy("skey").orderBy(cell))
        sums = sums.withColumn("upto", upto)
        edge = settle(sums.where(F.col("upto") > F.col("r")).groupBy("skey")
                      .agg(F.min(F.struct(cell, (F.col("r") - F.col("upto") + F.col("s")).alias("left"))).alias("edge")))
        rest = rest.join(broadcast_if_small(edge), "skey", "left")
        inside = rest.where(F.col("edge").isNull() | (F.col(cell) < F.col(f"edge.{cell}"))).drop("edge", "room")
        taken = inside if taken is None else taken.unionByName(inside)
        rest = rest.where(F.col(cell) == F.col(f"edge.{cell}")).withColumn("room", F.col("edge.left")).drop("edge")
    order = Window.partitionBy("skey").orderBy("pick", "did", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = rest.withColumn("upto", F.sum("size").over(order)).where(F.col("upto") <= F.col("room"))
    return taken.unionByName(last.drop("upto", "room"))


def mix(docs: DataFrame, max_epochs: int = 3, share: float = 1.0, seed: str = "mix",
        cycle=WEIGHT_CYCLE) -> DataFrame:
    """Mix ``docs`` (doc_id, text, source) to weights; the budget is ``share`` of all words.

    Returns doc_id, size (words of the text), source_size, target (words its source should
    give), repeats (times the mix takes the document) and taken = size x repeats.  The
    sample depends on seed, doc_id and text alone, so reruns agree.  A null text has size 0;
    a null source is a source of its own, the last; a null doc_id is an id like any other;
    repeated rows are separate documents, taken or left by their order; empty texts get the
    whole epochs of their source only; an empty table gives an empty result."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    did = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    pick = F.md5(F.concat_ws("|", F.lit(seed), did))
    bits = F.conv(F.substring(pick, 1, 5), 16, 10).cast("int")
    base = settle(docs.select(
        "doc_id", "source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("skey"), size.alias("size"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("tkey"))
        .withColumn("uid", F.monotonically_increasing_id()))
    sizes = settle(base.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")))
    budget = share * (sizes.agg(F.sum("source_size")).first()[0] or 0)
    sources = settle(sizes.join(source_weights(sizes.select("source"), cycle).withColumn(
        "skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source"), "skey"))
    filled = settle(water_fill(sources, budget, max_epochs).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")))
    room = F.col("target") - F.col("whole") * F.col("source_size")
    rest = filled.select("skey", F.floor(room + 1e-6).cast("long").alias("room"))
    mask = (1 << CELL_BITS) - 1
    pool = base.where("size > 0").select(
        "uid", "skey", "size", did.alias("did"), pick.alias("pick"),
        F.shiftright(bits, CELL_BITS).alias("cell1"), bits.bitwiseAND(mask).alias("cell2"))
    extra = None
    for _ in range(PASSES):
        got = settle(_prefix(pool, rest))
        extra = got.select("uid") if extra is None else extra.unionByName(got.select("uid"))
        used = got.groupBy("skey").agg(F.sum("size").alias("u"))
        rest = settle(rest.join(used, "skey", "left").select("skey", (F.col("room") - F.coalesce("u", F.lit(0))).alias("room")))
        pool = settle(pool.join(got.select("uid"), "uid", "left_anti")
                      .join(broadcast_if_small(rest), "skey").where(F.col("size") <= F.col("room")).drop("room"))
    extra = extra.withColumn("more", F.lit(1))
    repeats = (F.col("whole") + F.coalesce("more", F.lit(0))).cast("long")
    return (base.join(extra, "uid", "left").join(broadcast_if_small(filled.drop("source")), "skey")
            .select("doc_id", "size", "source_size", "target", repeats.alias("repeats"),
                    (F.col("size") * repeats).alias("taken"), "source", "tkey"))
