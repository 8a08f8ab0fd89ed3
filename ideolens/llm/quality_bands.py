"""Quality rules: compression bands, with word, symbol and repetition counts.

A text that zstandard shrinks very much repeats itself; one that it hardly shrinks is noise.
The ratio (compressed by raw bytes) of the whole text and of its fixed chunks must lie in
a band that depends on the number of bytes, since short texts shrink less.  The bands are
quantiles of trusted texts, widened, for each half octave of bytes; lengths of which too few
trusted texts are known have wide fixed bands.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ideolens.llm import words as W
from ideolens.llm.lines import LINE
from ideolens.llm.rows import broadcast_if_small, settle, short_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEVEL = 3
#: Bytes of a chunk; a rest of less than a quarter of it belongs to the chunk before.
CHUNK = 4096
#: Fixed bands: (bytes below which the row holds, least ratio, largest ratio).
BANDS = ((256, 0.20, 1.20), (1_024, 0.16, 0.95), (4_096, 0.12, 0.85), (16_384, 0.10, 0.75), (1 << 62, 0.06, 0.70))
#: Share of the chunks that may lie outside their band.
MAX_BAD_CHUNKS = 0.2
#: Fitted bands: quantiles of the trusted texts' ratios on either side of the median, how many
#: times as far from the median the limits lie, and how far at least.
QUANTILES = (0.01, 0.99)
WIDER = 1.5
LEAST_WIDTH = 0.03
#: Trusted texts of a length (a half octave of bytes) that a fitted band needs.
MIN_TRUSTED = 30

FIELDS = (("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"),
          ("n_repeat_words", "bigint"), ("n_bytes", "bigint"), ("ratio", "double"))
#: Chunks of a text of more than CHUNK bytes, in order.
CHUNKS = "array<struct<n_bytes:bigint,ratio:double>>"


def _repeats(text, key):
    """Flags of the entries whose (text, key) occurs twice or more, and of those not the first."""
    order = np.lexsort((key, text))
    t, k = text[order], key[order]
    same = np.zeros(len(t), bool)
    same[1:] = (t[1:] == t[:-1]) & (k[1:] == k[:-1])
    more = same.copy()
    more[:-1] |= same[1:]
    twice, later = np.zeros(len(t), bool), np.zeros(len(t), bool)
    twice[order], later[order] = more, same
    return twice, later


def cuts(n: int) -> list[int]:
    """Bounds of the chunks of n bytes; a text of one chunk at most has none."""
    return [*range(0, n - CHUNK // 4 + 1, CHUNK), n] if n > CHUNK else []


def measure(texts: pa.Array) -> pa.StructArray:
    """The columns of FIELDS and the chunks of each text; null counts as empty."""
    cols = {name: np.zeros(len(texts), np.int64 if kind == "bigint" else np.float64) for name, kind in FIELDS}
    symbols = np.zeros(256, bool)
    symbols[list(b"#*$%&|<>")] = True
    press = zstandard.ZstdCompressor(level=LEVEL).compress
    sizes, ratios, upto = [], [], np.zeros(len(texts) + 1, np.int32)
    for at, end, data, bounds in W.pieces(texts):
        n = end - at
        starts, ends, text = W.spans(data, bounds, W.NOT_SPACE)
        put = {"n_words": np.bincount(text, minlength=n)}
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        put["word_chars"] = np.bincount(text, chars[ends] - chars[starts], minlength=n)
        marks = np.concatenate(([0], np.cumsum(symbols[data])))
        put["n_symbols"] = marks[bounds[1:]] - marks[bounds[:-1]]

        a, b, owner = W.spans(data, bounds, LINE)
        first = np.searchsorted(starts, a)  # lines with a word: one starts in the line
        some = (first < len(starts)) & (starts[np.minimum(first, len(starts) - 1)] < b) if len(starts) else np.zeros(len(a), bool)
        a, b, owner = a[some], b[some], owner[some]
        _, later = _repeats(owner, W.hash_spans(data, a, b, 41))
        put["n_dup_lines"] = np.bincount(owner[later], minlength=n)

        grams = W.hash_ngrams(W.hash_spans(data, starts, ends, 42), 3)
        whole = np.flatnonzero(text[:len(grams)] == text[2:]) if len(grams) else np.zeros(0, np.int64)
        twice, _ = _repeats(text[whole], grams[whole])
        inside = np.zeros(len(text) + 2, bool)
        for j in range(3):
            inside[whole[twice] + j] = True
        put["n_repeat_words"] = np.bincount(text[inside[:len(text)]], minlength=n)
        put["n_bytes"] = np.diff(bounds)

        for name, values in put.items():
            cols[name][at:end] = values
        raw = data.tobytes()
        for i in range(n):
            own = raw[bounds[i]:bounds[i + 1]]
            if own:
                cols["ratio"][at + i] = len(press(own)) / len(own)
            bound = cuts(len(own))
            for x, y in zip(bound, bound[1:]):
                sizes.append(y - x)
                ratios.append(len(press(own[x:y])) / (y - x))
            upto[at + i + 1] = len(sizes)
    chunk = pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(ratios, pa.float64())], ["n_bytes", "ratio"])
    return pa.StructArray.from_arrays([*(pa.array(cols[name]) for name, _ in FIELDS), pa.ListArray.from_arrays(pa.array(upto), chunk)],
                                      [*(name for name, _ in FIELDS), "chunks"])


def length_band(n_bytes):
    """Half octaves of the number of bytes."""
    return F.floor(2 * F.log2(F.greatest(n_bytes, F.lit(1)).cast("double"))).cast("int")


def fit_bands(measured: DataFrame) -> dict[int, tuple[float, float]]:
    """Limits of the ratio by length band, from measured trusted texts that pass the base
    rules; equal ratios of texts of equal size count once, so copies have little weight.  The
    driver gets a row for each band, 64 at most."""
    values = measured.select(length_band(F.col("n_bytes")).alias("band"), "n_bytes", F.round("ratio", 4).alias("r")).distinct()
    lo, mid, hi = (F.get("q", F.lit(i)) for i in range(3))
    rows = values.groupBy("band").agg(F.count("*").alias("n"), F.percentile("r", F.array(*[F.lit(x) for x in (QUANTILES[0], 0.5, QUANTILES[1])])).alias("q")).where(
        F.col("n") >= MIN_TRUSTED).select("band", (mid - F.greatest(WIDER * (mid - lo), F.lit(LEAST_WIDTH))).alias("lo"),
                                          (mid + F.greatest(WIDER * (hi - mid), F.lit(LEAST_WIDTH))).alias("hi"))
    return {r["band"]: (r["lo"], r["hi"]) for r in rows.collect()}


def in_band(n_bytes, ratio, fitted: dict[int, tuple[float, float]]):
    """Whether a ratio lies in the fitted band of its length, or else in the fixed one."""
    fixed = F.lit(False)
    for below, lo, hi in reversed(BANDS):
        fixed = F.when(n_bytes < below, ratio.between(lo, hi)).otherwise(fixed)
    own = length_band(n_bytes)
    limit = lambda k: F.get(F.array(*[F.lit(fitted[b][k] if b in fitted else None).cast("double") for b in range(64)]), own)
    return F.coalesce(ratio.between(limit(0), limit(1)), fixed) if fitted else fixed


def base_failed():
    """Fewer than 50 words, or over half of them in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, trusted: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, the columns of FIELDS, bad_chunks (share of
    the chunks outside their band), base_failed (fewer than 50 words, or over half of them in
    repeated 3-word windows) and kept (not base_failed, the whole text's ratio in its band,
    and at most MAX_BAD_CHUNKS of the chunks outside theirs).

    The bands are fitted to the texts that pass the base rules and whose doc_id is in
    ``trusted`` (doc_id); a length with fewer than MIN_TRUSTED of them, and every length
    without ``trusted``, has its fixed band.  Null and empty texts have no words and fail;
    repeated rows are judged alike; a null doc_id is never trusted; an empty table gives an
    empty result."""
    short_batches(docs)
    kind = "struct<" + ",".join(f"{n}:{k}" for n, k in FIELDS) + f",chunks:{CHUNKS}>"
    out = docs.select("doc_id", F.arrow_udf(lambda texts: measure(texts), kind)("text").alias("m")).select("doc_id", "m.*")
    fitted = {}
    if trusted is not None:
        out = settle(out)
        ids = settle(trusted.select(F.col("doc_id").alias("trusted_id")).where("trusted_id IS NOT NULL").distinct())
        known = out.where(~base_failed()).join(broadcast_if_small(ids, 16), F.col("doc_id") == F.col("trusted_id"), "left_semi")
        fitted = fit_bands(known)
    outside = F.size(F.filter("chunks", lambda c: ~in_band(c["n_bytes"], c["ratio"], fitted)))
    fits = in_band(F.col("n_bytes"), F.col("ratio"), fitted)
    bad = F.when(F.size("chunks") > 0, outside / F.size("chunks")).otherwise((~fits).cast("double"))
    return (out.withColumn("bad_chunks", bad).withColumn("base_failed", base_failed())
            .withColumn("kept", ~base_failed() & fits & (bad <= MAX_BAD_CHUNKS)).drop("n_bytes", "chunks"))
