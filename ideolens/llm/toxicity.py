"""Toxicity classifier by non-negative positive-unlabelled learning.

Training sees confirmed toxic documents (P) and unlabelled ones (U), no confirmed clean ones.
With the class prior pi, the risk of a scorer f under the logistic loss l is

    pi E_P[l(f)] + max(0, E_U[l(-f)] - pi E_P[l(-f)]);

the second part estimates the risk on the clean documents hidden in U and cannot be negative,
so a step that would make it negative climbs it instead.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ideolens.llm import words as W
from ideolens.llm.rows import broadcast_if_small, pack, settle, short_batches, text_key, unpack

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Word starts of so many bytes are features beside whole words.
STARTS = (4, 5, 6)
#: Bounds of the training sample: confirmed toxic rows, unlabelled rows (about so many; of
#: repeated rows with one id and text there is one).
MAX_TOXIC, MAX_UNLABELLED = 5_000, 10_000
#: Rows of P that must have a feature of the model, least z value.  All features of the sample
#: that meet both are kept.
MIN_ROWS, MIN_Z = 3, 3.5
#: Share of toxic documents if no labelled row tells it.
DEFAULT_PRIOR = 0.05


def features(data: np.ndarray, bounds: np.ndarray):
    """(text index, 64-bit feature hash) for each word and each of its starts: A-Z in lower
    case, blanks and ASCII punctuation separate words."""
    low = W.LOWER[data]
    starts, ends, text = W.spans(low, bounds, W.ALNUM)
    owners, hashes = [text], [W.hash_spans(low, starts, ends, 31)]
    for n in STARTS:
        longer = ends - starts > n
        owners.append(text[longer])
        hashes.append(W.hash_spans(low, starts[longer], starts[longer] + n, 31 + n))
    return np.concatenate(owners), np.concatenate(hashes)


def _distinct(owner, value):
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


class Model:
    """Sorted feature hashes, their weights, and the bias."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.hashes, self.weights, self.bias = hashes, weights, bias
        self.sieve = None

    def hits(self, data, bounds):
        """Distinct (text index, feature number) of the features that the model knows."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.sieve is None:
            self.sieve = np.zeros(1 << 22, bool)
            self.sieve[(self.hashes >> np.uint64(42)).astype(np.int64)] = True
        owner, h = features(data, bounds)
        some = self.sieve[(h >> np.uint64(42)).astype(np.int64)]
        owner, h = owner[some], h[some]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[at] == h
        return _distinct(owner[known], at[known])

    def score(self, texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for at, end, data, bounds in W.pieces(texts):
            owner, feature = self.hits(data, bounds)
            f = self.bias + np.bincount(owner, self.weights[feature], minlength=end - at)
            out[at:end] = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        return pa.array(out)


def fit_nnpu(rows_p, cols_p, n_p, rows_u, cols_u, n_u, start, prior, steps=400, rate=0.05, decay=1e-4):
    """Weights and bias that lower the non-negative risk, by Adam over the whole sample.
    rows and cols list the features that each row of P and of U has; start: first weights."""
    k = len(start)
    w = np.concatenate((start, [np.log(prior / (1 - prior)) - 1.0]))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    sigma = lambda f: 1 / (1 + np.exp(-np.clip(f, -30, 30)))

    def gradient(rows, cols, n, d):
        """Of the mean over n rows, d: derivative by the row's score."""
        return np.concatenate((np.bincount(cols, d[rows], minlength=k), [d.sum()])) / max(n, 1)

    for step in range(1, steps + 1):
        f_p = w[k] + np.bincount(rows_p, w[cols_p], minlength=n_p)
        f_u = w[k] + np.bincount(rows_u, w[cols_u], minlength=n_u)
        clean = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
        g_clean = gradient(rows_u, cols_u, n_u, sigma(f_u)) - prior * gradient(rows_p, cols_p, n_p, sigma(f_p))
        g_toxic = prior * gradient(rows_p, cols_p, n_p, -sigma(-f_p))
        g = g_toxic + g_clean if clean >= 0 else -g_clean
        g[:k] += decay * w[:k]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:k], float(w[k])


def _sample(keys: DataFrame, n: int) -> DataFrame:
    """About n rows of the distinct keys (doc_id, tkey), by their hash; all if there are fewer."""
    total = keys.count()
    share = int(min(1.0, n / max(total, 1)) * (1 << 30))
    return keys.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "tkey"), F.lit(1 << 30)) < share)


def train(docs: DataFrame, labels: DataFrame, usable=None) -> Model:
    """Fit on documents whose id passes ``usable`` (a column over doc_id; all if None).

    P: documents labelled toxic = 1, at most about MAX_TOXIC rows; U: documents whatever their
    label, at most about MAX_UNLABELLED rows, so that toxic ones are among them as among all
    text.  Rows are drawn by a hash of (doc_id, text), repeated ones once, so a frequent id has
    the weight of its different texts only.
    The prior is the share of toxic rows among the labelled ones.  Several labels of one id
    count as the largest; labels without id, value or document are ignored."""
    usable = F.lit(True) if usable is None else usable
    marks = settle(labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & usable)
                   .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    seen = marks.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    prior = min(max((seen["t"] or 0) / seen["n"], 0.001), 0.5) if seen["n"] else DEFAULT_PRIOR
    keys = settle(docs.where(F.col("doc_id").isNotNull() & usable).select("doc_id", text_key().alias("tkey")).distinct())
    toxic = keys.join(broadcast_if_small(settle(marks.where("toxic = 1").select("doc_id")), 16), "doc_id", "left_semi")
    chosen = settle(_sample(settle(toxic), MAX_TOXIC).withColumn("positive", F.lit(1))
                    .unionByName(_sample(keys, MAX_UNLABELLED).withColumn("positive", F.lit(0))))

    def extract(batches):
        for batch in batches:
            for at, end, data, bounds in W.pieces(batch.column(1)):
                owner, h = _distinct(*features(data, bounds))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), W.lists(W.per_text(owner, end - at), W.signed(h))], ["positive", "h"])

    # chosen is bounded by MAX_TOXIC and MAX_UNLABELLED, its texts too once repeated rows are one
    texts = (docs.select("doc_id", "text", text_key().alias("tkey")).join(F.broadcast(chosen), ["doc_id", "tkey"])
             .dropDuplicates(["positive", "doc_id", "tkey"]))
    rows = settle(texts.select("positive", "text").mapInArrow(extract, "positive int, h array<long>"))
    size = rows.agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("u")).first()
    n_p, n_u = size["p"] or 0, size["u"] or 0
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), -6.0)
    if not n_p or not n_u:
        return nothing
    p, u = (F.col("p") + 0.5) / (n_p + 1), (F.col("u") + 0.5) / (n_u + 1)
    pooled = (F.col("p") + F.col("u") + 1) / (n_p + n_u + 2)
    z = (p - u) / F.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
    kept = (rows.select("positive", F.explode("h").alias("h")).groupBy("h")
            .agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("u"))
            .where(F.col("p") >= MIN_ROWS).select("h", z.alias("z"), F.log(p / u).alias("odds")).where(F.col("z") >= MIN_Z)
            .toPandas())
    if not len(kept):
        return nothing
    hashes = kept["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    hashes, odds = hashes[order], kept["odds"].to_numpy(float)[order]

    def select(batches):
        for batch in batches:
            lists = batch.column(1)
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            h = np.array(lists.flatten(), np.int64).view(np.uint64)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            known = hashes[at] == h
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), W.lists(W.per_text(owner[known], len(lists)), pa.array(at[known].astype(np.int32)))],
                ["positive", "features"])

    matrix = rows.mapInArrow(select, "positive int, features array<int>").toPandas()

    def csr(part):
        lens = part["features"].map(len).to_numpy(np.int64)
        cols = np.concatenate([*part["features"], np.zeros(0, np.int32)]).astype(np.int64)
        return np.repeat(np.arange(len(part)), lens), cols, len(part)

    weights, bias = fit_nnpu(*csr(matrix[matrix["positive"] == 1]), *csr(matrix[matrix["positive"] == 0]), odds, prior)
    return Model(hashes, weights, bias)


def held_out(fold: int = 5):
    """True for the ids that training must not see; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold)) == 0, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, fold: int = 5) -> DataFrame:
    """All columns of ``docs`` plus held_out, score (0 to 1) and predicted (score >= 0.5).

    Only labels of ids that are not held out are learnt from; the score depends on the text
    alone.  Null and empty texts get the score of a text without known features; repeated
    rows score alike; with no toxic label every score is near 0; an empty table gives an
    empty result."""
    short_batches(docs)
    model = train(docs, labels, ~held_out(fold))
    udf = F.arrow_udf(lambda texts: model.score(texts), "double")
    scored = pack(docs, "doc_id", udf("text").alias("score"))
    return unpack(scored, docs, held_out=held_out(fold), score=F.col("score"), predicted=(F.col("score") >= 0.5).cast("int"))
