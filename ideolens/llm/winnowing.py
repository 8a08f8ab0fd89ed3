"""Benchmark decontamination by winnowing.

For spans of L words the k-gram hashes (k = L - 5, at least 1) of every run of L words are
looked at and the smallest is kept, so any two texts that share L consecutive words keep the
same hash of that span.  Kept hashes of documents and benchmark items are joined; around
each hit, the L-word windows that can contain it are compared by 128-bit keys with the
windows of the items, which extends hits to all words of the shared spans.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ideolens.llm import words as W
from ideolens.llm.rows import broadcast_if_small, join_rows, settle, short_batches, text_key

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPREAD = 5


def word_hashes(data: np.ndarray, bounds: np.ndarray, seeds=(1,)):
    """(text index of each word, its hash under every seed), words by the operator's rule."""
    low = W.LOWER[data]
    starts, ends, text = W.spans(low, bounds, W.ALNUM)
    return text, [W.hash_spans(low, starts, ends, s) for s in seeds]


def winnow(text: np.ndarray, hashes: np.ndarray, length: int):
    """(word positions, k-gram hashes) kept for spans of ``length`` words: the rightmost
    smallest k-gram hash of each window of length - k + 1 k-grams."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    k = max(1, length - SPREAD)
    if len(hashes) < length:
        return none
    at = np.flatnonzero(text[:len(text) - length + 1] == text[length - 1:])
    if not len(at):
        return none
    grams = W.hash_ngrams(hashes, k, length)
    best, pos = grams[at], at.copy()
    for j in range(1, length - k + 1):
        other = grams[at + j]
        take = other <= best
        best = np.where(take, other, best)
        pos = np.where(take, at + j, pos)
    pos = pos[np.concatenate(([True], pos[1:] != pos[:-1]))]
    return pos, grams[pos]


def _fingerprints(table: DataFrame, lengths: list[int]) -> DataFrame:
    """doc_id, tkey, and for each kept hash fp its word number at and span length len."""
    def run(batches):
        for batch in batches:
            for at, end, data, bounds in W.pieces(batch.column(2)):
                text, (hashes,) = word_hashes(data, bounds)
                first = W.per_text(text, end - at)
                found = []
                for n in lengths:
                    pos, fp = winnow(text, hashes, n)
                    found.append((text[pos], fp, pos - first[text[pos]], np.full(len(pos), n)))
                owner, fp, where, n = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(owner, kind="stable")
                offsets = W.per_text(owner[order], end - at)
                rows = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), W.lists(offsets, W.signed(fp[order])),
                     W.lists(offsets, pa.array((where * 64 + n)[order].astype(np.int64)))],
                    ["doc_id", "tkey", "fp", "spot"])

    schema = f"doc_id {table.schema['doc_id'].dataType.simpleString()}, tkey long, fp array<long>, spot array<long>"
    lists = table.mapInArrow(run, schema)
    return (lists.select("doc_id", "tkey", F.explode(F.arrays_zip("fp", "spot")).alias("x"))
            .select("doc_id", "tkey", "x.fp", "x.spot"))


def _windows(rows: DataFrame, span: int, everywhere: bool) -> DataFrame:
    """doc_id, tkey, n_words and the windows of each text as struct(at, len, k1, k2).

    ``everywhere``: all windows of ``span`` words (a shorter text is one window, of its own
    length); otherwise those that contain a hit listed in the column spots."""
    def run(batches):
        for batch in batches:
            for at, end, data, bounds in W.pieces(batch.column(2)):
                rows = batch.slice(at, end - at)
                if everywhere:
                    wanted = None
                else:
                    hits = rows.column(3)
                    count = pc.fill_null(pc.list_value_length(hits), 0).to_numpy(zero_copy_only=False)
                    wanted = np.repeat(np.arange(end - at), count), np.array(hits.flatten(), np.int64)
                starts_only = wanted is not None and not len(wanted[0])
                low = W.LOWER[data]
                s, e, text = W.spans(low, bounds, W.ALNUM)
                first = W.per_text(text, end - at)
                n_words = np.diff(first)
                if starts_only:
                    z = np.zeros(0, np.int64)
                    owner, begin, length, k1, k2 = z, z, z, z.view(np.uint64), z.view(np.uint64)
                else:
                    if everywhere:
                        length = np.minimum(n_words, span)
                        count = np.where(n_words > 0, n_words - length + 1, 0)
                        owner = np.repeat(np.arange(end - at), count)
                        begin = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                        length = length[owner]
                    else:
                        owner, spot = wanted
                        n = spot % 64
                        where = spot // 64
                        k = np.maximum(1, n - SPREAD)
                        back = np.arange(SPREAD + 1)[None, :]
                        begin = where[:, None] - back
                        fits = (back <= (n - k)[:, None]) & (begin >= 0) & (begin + n[:, None] <= n_words[owner][:, None])
                        who, _ = np.nonzero(fits)
                        keys = np.unique(np.stack((owner[who], begin[fits], n[who])), axis=1)
                        owner, begin, length = keys
                    h1 = W.hash_spans(low, s, e, 21)
                    h2 = W.hash_spans(low, s, e, 22)
                    k1 = np.zeros(len(owner), np.uint64)
                    k2 = np.zeros(len(owner), np.uint64)
                    for n in np.unique(length):
                        of = np.flatnonzero(length == n)
                        where = first[owner[of]] + begin[of]
                        k1[of] = W.hash_ngrams(h1, int(n), int(n))[where]
                        k2[of] = W.hash_ngrams(h2, int(n), int(n))[where]
                window = pa.StructArray.from_arrays(
                    [pa.array(begin.astype(np.int32)), pa.array(length.astype(np.int32)), W.signed(k1), W.signed(k2)],
                    ["at", "len", "k1", "k2"])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(n_words.astype(np.int64)),
                     W.lists(W.per_text(owner, end - at), window)],
                    ["doc_id", "tkey", "n_words", "windows"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, tkey long, n_words long, windows array<struct<at:int,len:int,k1:long,k2:long>>")


def find_overlaps(docs: DataFrame, items: DataFrame, span: int = 13) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, tkey, n_words, n_hit (words inside any
    occurrence of a window of ``items``), item_ids (sorted, distinct) of the windows found.

    ``items`` has item_id and text.  A window is ``span`` consecutive words of an item, or all
    words of a shorter one.  Null texts have no words and no hits; items without words have
    no window; an item without id marks words but is not listed; repeated items and repeated
    documents change nothing for the others and get equal results."""
    short_batches(docs)
    cols = items.select(F.col("item_id").alias("doc_id"), text_key().alias("tkey"), "text")
    own = settle(_windows(cols, span, True).select("doc_id", F.explode("windows").alias("w"))
                 .select("doc_id", "w.len", "w.k1", "w.k2").distinct())
    lengths = sorted(r["len"] for r in own.select("len").distinct().collect()) or [span]  # span of them at most
    marks = settle(_fingerprints(cols, lengths).select("fp").distinct())
    windows = settle(own.groupBy("len", "k1", "k2").agg(F.sort_array(F.collect_set("doc_id")).alias("items")))

    base = docs.select("doc_id", text_key().alias("tkey"), "text")
    hits = _fingerprints(base, lengths).join(broadcast_if_small(marks), "fp")
    spots = settle(hits.groupBy("doc_id", "tkey").agg(F.collect_set("spot").alias("spots")))
    small = broadcast_if_small(spots, F.size("spots") * 8 + 48)
    rows = join_rows(base, small, "left").select("doc_id", "tkey", "text", "spots")
    seen = settle(_windows(rows, span, False))
    found = (seen.where(F.size("windows") > 0).dropDuplicates(["doc_id", "tkey"]).select("doc_id", "tkey", F.explode("windows").alias("w"))
             .select("doc_id", "tkey", "w.at", "w.len", "w.k1", "w.k2")
             .join(broadcast_if_small(windows, F.size("items") * 8 + 64), ["len", "k1", "k2"])
             .groupBy("doc_id", "tkey").agg(
                 F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("len")).alias("end")))).alias("covered"),
                 F.array_distinct(F.flatten(F.collect_set("items"))).alias("item_ids")))
    n_hit = F.aggregate("covered", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["at"], a["upto"]))).alias("n"),
        F.greatest(a["upto"], x["end"]).alias("upto")), lambda a: a["n"])
    found = found.select("doc_id", "tkey", n_hit.cast("long").alias("n_hit"), F.sort_array("item_ids").alias("item_ids"))
    none = F.array().cast(f"array<{items.schema['item_id'].dataType.simpleString()}>")
    return join_rows(seen.select("doc_id", "tkey", "n_words"), found, "left").select(
        "doc_id", "tkey", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", none).alias("item_ids"))


def contaminated():
    """The rule over the columns of find_overlaps: at least a twentieth of the words are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
