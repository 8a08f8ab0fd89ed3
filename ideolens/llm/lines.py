"""Removal of lines that many documents share.

Lines are reduced to a key (ASCII blanks stripped, A-Z lower-cased), exploded as 128-bit key
hashes, and counted by distinct documents.  Lines whose key is too common are dropped by
their position, everywhere but in the largest doc_id that holds them, and the rest of the
text is put together again in the order of positions.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ideolens.llm import words as W
from ideolens.llm.rows import broadcast_if_small, join_rows, pack, settle, short_batches, text_key, unpack

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINE = W.byte_class((0x0A, 0x0A))


def line_keys(texts: pa.Array, min_chars: int):
    """Per piece: (first row, last row, text index, line number, two key hashes) of the lines
    whose key has ``min_chars`` code points or more."""
    for at, end, data, bounds in W.pieces(texts):
        if not len(data):
            continue
        starts, ends, text = W.spans(data, bounds, LINE)
        # number of the line in its text: newlines before it
        newline = np.concatenate(([0], np.cumsum(data == 10)))
        number = newline[starts] - newline[bounds[text]]
        # strip blanks: first and last byte of the line that is none
        blank = ~W.NOT_SPACE[data]
        ink = np.flatnonzero(~blank)
        if not len(ink):
            continue
        first = np.searchsorted(ink, starts)
        last = np.searchsorted(ink, ends) - 1
        some = last >= first
        first, last, text, number = first[some], last[some], text[some], number[some]
        starts, ends = ink[first], ink[last] + 1
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        long = chars[ends] - chars[starts] >= min_chars
        starts, ends, text, number = starts[long], ends[long], text[long], number[long]
        low = W.LOWER[data]
        yield at, end, text, number, W.hash_spans(low, starts, ends, 11), W.hash_spans(low, starts, ends, 12)


def _lines(docs: DataFrame, min_chars: int, positions: bool) -> DataFrame:
    """One row per long line and document: doc_id, tkey, key hashes h1 and h2, and with
    ``positions`` the line number pos; without, a document's repeated lines count once."""
    def run(batches):
        for batch in batches:
            for at, end, text, number, h1, h2 in line_keys(batch.column(2), min_chars):
                if not positions and len(text):
                    order = np.lexsort((h2, h1, text))
                    text, h1, h2 = text[order], h1[order], h2[order]
                    new = np.ones(len(text), bool)
                    new[1:] = (text[1:] != text[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                    text, number, h1, h2 = text[new], number[:0], h1[new], h2[new]
                rows = pa.array(text + at)
                cols = [batch.column(0).take(rows), batch.column(1).take(rows), W.signed(h1), W.signed(h2)]
                names = ["doc_id", "tkey", "h1", "h2"]
                if positions:
                    cols.append(pa.array(number.astype(np.int32)))
                    names.append("pos")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tkey long, h1 long, h2 long"
    return docs.select("doc_id", "tkey", "text").mapInArrow(run, schema + (", pos int" if positions else ""))


def common_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """Keys found in at least ``min_docs`` documents, with the largest doc_id holding them.

    Repeated rows of one doc_id are one document; all rows without doc_id are one document,
    below every number.  Both aggregates combine on the map side first."""
    holders = _lines(docs, min_chars, False).groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    return (holders.groupBy("h1", "h2").agg(F.count("one").alias("docs"), F.max("doc_id").alias("keeper"))
            .where(F.col("docs") >= min_docs))


def _without():
    """Text without the lines at the given positions, the others in their order; rows
    without positions are not sent."""
    def cut(texts, gone):
        out = []
        for text, at in zip(texts.to_pylist(), gone.to_pylist()):
            if at is None:
                out.append(None)
                continue
            at = set(at)
            out.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in at))
        return pa.array(out, pa.string())

    return F.arrow_udf(cut, "string")


def drop_common_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...) plus kept_text, n_lines and n_dropped.

    A line's key is the line without the blanks ``[\\x20\\x09-\\x0D]`` at its ends, A-Z in
    lower case.  Lines with a key of at least ``min_chars`` code points that is found in at
    least ``min_docs`` documents are dropped except in the largest doc_id holding it.  Other
    lines stay as they are, joined by a newline.  A null or empty text is one empty line
    (kept_text is empty); a null doc_id is an id below all others; repeated rows are treated
    alike and count as one document; an empty table gives an empty result."""
    short_batches(docs)
    base = pack(docs, "doc_id", "text", text_key().alias("tkey"))
    common = settle(common_lines(base, min_chars, min_docs))
    lines = _lines(base, min_chars, True).alias("l")
    hit = (lines.join(broadcast_if_small(common).alias("c"), ["h1", "h2"])
           .where(~F.col("l.doc_id").eqNullSafe(F.col("c.keeper"))))
    gone = settle(hit.groupBy("l.doc_id", "tkey").agg(F.collect_set("pos").alias("gone_at")))
    gone = broadcast_if_small(gone, F.size("gone_at") * 4 + 48)
    text = F.coalesce("text", F.lit(""))
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    kept = F.coalesce(_without()(F.when(F.col("gone_at").isNotNull(), text), "gone_at"), text)
    return unpack(join_rows(base, gone, "left"), docs, n_lines=n_lines.cast("long"),
                  n_dropped=F.coalesce(F.size("gone_at"), F.lit(0)).cast("long"), kept_text=kept)
