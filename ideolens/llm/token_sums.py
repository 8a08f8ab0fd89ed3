"""Per-document sums of values looked up by token: a map-side join for the tokens that make
up most of the text, a sharded join for the others.

The rows of the value table with the largest weights, at most FREQUENT of them, are sent to
all tasks; documents are summed over these tokens where they are read.  Each remaining
distinct token of a document becomes a row that is joined with the rest of the table by key.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ideolens.llm import words as W
from ideolens.llm.rows import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of the value table that every task holds, of 16 bytes or a few more.
FREQUENT = 2_000_000
#: Weights are told apart by eighths of a power of two.
STEPS = 8


def runs(owner: np.ndarray, key: np.ndarray):
    """Sorted distinct (key, owner) and how often each occurs; the owners of one key come in
    their order, and are below 2^17 if the keys are small enough to be sorted with them."""
    if len(key) and int(key.max()) < 1 << 46 and int(owner.max()) < 1 << 17:
        both = np.sort((key << np.uint64(17)) | owner.astype(np.uint64))
        key, owner = both >> np.uint64(17), (both & np.uint64((1 << 17) - 1)).astype(np.int64)
    else:
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return key[at], owner[at], np.diff(np.concatenate((at, [len(key)])))


def distinct(key: np.ndarray):
    """Of sorted keys: the distinct ones and how many entries each has."""
    first = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
    return key[first], np.diff(np.concatenate((first, [len(key)])))


def split_table(table: DataFrame, weight: str, limit: int = FREQUENT):
    """(rows of large weight, at most ``limit``, the other rows) of a settled table."""
    level = F.floor(F.log2(F.col(weight) + 1) * STEPS).cast("int")
    sizes = {r["level"]: r["n"] for r in table.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    held, least = 0, max(sizes, default=0) + 1
    for x in sorted(sizes, reverse=True):
        if held + sizes[x] > limit:
            break
        held, least = held + sizes[x], x
    rest = table.where(level < least) if held < sum(sizes.values()) else None
    return table.where(level >= least), rest


def document_sums(docs: DataFrame, tokens, flag: str, table: DataFrame, weight: str, values: dict,
                  columns: dict | None = None, local=None, limit: int = FREQUENT) -> DataFrame:
    """doc_id, flag, size (tokens) and, for each of ``values`` (name: expression over table),
    the sum over the tokens of each row of docs (doc_id, text, flag).

    ``table`` has key, weight and what the values need.  ``tokens`` gives from the bytes and
    bounds of some texts the text index and the key of each token; a token without a row in
    the table adds nothing.  For the rows that all tasks hold, ``columns`` (name: type) are
    sent, from whose arrays ``local`` computes the values; by default these are the values."""
    frequent, rest = split_table(table, weight, limit)
    if columns is None:
        columns, local = {v: "float64" for v in values}, lambda *x: x
        frequent = frequent.select("key", *(e.alias(v) for v, e in values.items()))
    sent = frequent.select("key", *columns).toArrow()  # at most ``limit`` rows
    order = np.argsort(sent["key"].to_numpy().view(np.uint64))
    known = docs.sparkSession.sparkContext.broadcast(
        (sent["key"].to_numpy().view(np.uint64)[order], [sent[c].to_numpy()[order].astype(kind) for c, kind in columns.items()]))
    del sent, order
    names = ["doc_id", "flag", "size", *values, "missing", "times"]

    def run(batches):
        have, numbers = known.value
        for batch in batches:
            for at, end, data, bounds in W.pieces(batch.column(1), rows=1 << 17):
                n = end - at
                owner, key = tokens(data, bounds)
                size = np.bincount(owner, minlength=n)
                key, owner, count = runs(owner, key)
                asked, entries = distinct(key)
                where = np.minimum(np.searchsorted(have, asked), max(len(have) - 1, 0))
                found = have[where] == asked if len(have) else np.zeros(len(asked), bool)
                hit = np.repeat(found, entries)
                some, times, each = owner[hit], count[hit], entries[found]
                sums = [np.bincount(some, np.repeat(v, each) * times, minlength=n)
                        for v in local(*(x[where[found]] for x in numbers))]
                late = np.flatnonzero(~hit)
                late = late[np.argsort(owner[late], kind="stable")]
                offsets = W.per_text(owner[late], n)
                rows = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(2), pa.array(size.astype(np.int64)), *(pa.array(x.astype(np.float64)) for x in sums),
                     W.lists(offsets, W.signed(key[late])), W.lists(offsets, pa.array(count[late].astype(np.int64)))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", "text", flag).mapInArrow(
        run, f"doc_id {kind}, flag boolean, size long, {', '.join(f'{v} double' for v in values)}, missing array<long>, times array<long>")
    kept = ["doc_id", "flag", "size"]
    if rest is None:
        return base.select(*kept, *values)
    base = settle(base.withColumn("uid", F.monotonically_increasing_id()))
    entries = base.select("uid", F.explode(F.arrays_zip("missing", "times")).alias("x")).select("uid", F.col("x.missing").alias("key"), "x.times")
    more = entries.join(rest.select("key", *(e.alias(v) for v, e in values.items())), "key").groupBy("uid").agg(
        *(F.sum(F.col(v) * F.col("times")).alias(f"more_{v}") for v in values))
    return base.join(more, "uid", "left").select(*kept, *((F.col(v) + F.coalesce(f"more_{v}", F.lit(0.0))).alias(v) for v in values))
