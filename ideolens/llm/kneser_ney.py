"""Quality classifier: interpolated modified Kneser-Ney model of trusted text.

The units are UTF-8 bytes, so no text has unknown units and the tables grow with the
language, not with the number of words.  Counts are tables sharded by n-gram; the probability
of every n-gram that documents hold is put together by joins, from the shortest to the
longest, and documents are joined with the result by n-gram (token_sums).
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ideolens.llm import token_sums as T
from ideolens.llm import words as W
from ideolens.llm.rows import broadcast_if_small, settle, short_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER = 4
#: Bits of a symbol: a byte, the start of a text (256) or its end (257).
BITS, START, END = 9, 256, 257
#: Documents are kept up to this quantile of the perplexity of trusted documents in their
#: language, times a slack.  Each FOLD-th trusted document (by a hash of its id) gives the
#: quantile and is not trained on.
QUANTILE, SLACK, FOLD = 0.995, 1.1, 5


def ngrams(order: int):
    """Tokens function of ``token_sums``: the n-grams that end at each byte of a text and at
    its end, packed with the first symbol in the highest bits."""
    def tokens(data, bounds):
        n = len(bounds) - 1
        lens = np.diff(bounds)
        # every text with order - 1 starts before and one end after it
        at = np.arange(n) * order + bounds[:-1]
        line = np.full(len(data) + order * n, START, np.uint64)
        owner = np.repeat(np.arange(n), lens)
        line[np.arange(len(data)) + (owner + 1) * order - 1] = data
        line[at + order - 1 + lens] = END
        keys = np.zeros(len(line) - order + 1 if len(line) else 0, np.uint64)
        for j in range(order):
            keys = (keys << np.uint64(BITS)) | line[j:len(line) - order + 1 + j]
        whole = np.repeat(np.arange(n), lens + 1)
        first = np.cumsum(lens + 1) - (lens + 1)
        return whole, keys[np.arange(len(whole)) - first[whole] + at[whole]]

    return tokens


def count_ngrams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, n): all n-grams of docs (text, trusted) and their count in trusted texts."""
    tokens = ngrams(order)

    def run(batches):
        for batch in batches:
            trusted = np.array(batch.column(1)).astype(bool)
            for at, end, data, bounds in W.pieces(batch.column(0), 8 << 20):
                owner, key = tokens(data, bounds)
                learn = trusted[at:end][owner]
                known, n = np.unique(key[learn], return_counts=True)
                other = np.setdiff1d(np.unique(key[~learn]), known, assume_unique=True)
                yield pa.RecordBatch.from_arrays(
                    [W.signed(np.concatenate((known, other))), pa.array(np.concatenate((n, np.zeros(len(other), np.int64))))], ["key", "n"])

    return docs.select("text", "trusted").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more."""
    r = counts.agg(*(F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4))).first()
    n = [0] + [r[f"n{i}"] or 0 for i in (1, 2, 3, 4)]
    if not all(n[1:4]):
        return 0.5, 1.0, 1.5
    y = n[1] / (n[1] + 2 * n[2])
    return tuple(min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) for i in (1, 2, 3))


def probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, logp): log10 of the interpolated probability of the last symbol of every n-gram
    in counts (key, n), given the symbols before it.  n-grams with n = 0 only ask."""
    tables = {order: counts.where("n > 0").select(F.col("key").alias("gram"), F.col("n").alias("c"))}
    for k in range(order - 1, 0, -1):
        # continuation count: symbols that come before this shorter n-gram
        tables[k] = settle(tables[k + 1].groupBy(F.col("gram").bitwiseAND((1 << BITS * k) - 1).alias("gram"))
                           .agg(F.count("*").alias("c")))
    lower = None
    for k in range(1, order + 1):
        gram = F.col("key").bitwiseAND((1 << BITS * k) - 1)
        asked = counts.select(gram.alias("gram")).distinct()
        d = discounts(tables[k])
        context = F.shiftright("gram", BITS)
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        seen = tables[k].groupBy(context.alias("context")).agg(F.sum("c").alias("total"), F.sum(off).alias("left"))
        p = asked.join(tables[k], "gram", "left").withColumn("context", context).join(seen, "context", "left")
        if lower is None:
            p = p.withColumn("below", F.lit(1.0 / (END + 1)))  # the start is never predicted, its share is lost
        else:
            p = p.withColumn("short", F.col("gram").bitwiseAND((1 << BITS * (k - 1)) - 1)).join(
                lower.select(F.col("gram").alias("short"), F.col("p").alias("below")), "short", "left")
        own = F.coalesce((F.col("c") - off) / F.col("total"), F.lit(0.0))
        p = p.select("gram", (own + F.coalesce(F.col("left") / F.col("total"), F.lit(1.0)) * F.col("below")).alias("p"))
        lower = settle(p)
    return lower.select(F.col("gram").alias("key"), F.log10("p").alias("logp"))


def classify(docs: DataFrame, trusted_ids: DataFrame, order: int = ORDER, quantile: float = QUANTILE,
             slack: float = SLACK) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, lang, trusted, n_symbols (bytes and
    the end), log10_prob, perplexity (per symbol), threshold (of its language) and kept.

    ``trusted_ids`` (doc_id) names the text to learn from; trusted tells which rows were.  The
    threshold is the quantile of the perplexity of trusted documents left out of training, by
    language, times ``slack``; a language without any (and a null one likewise) uses that of
    all languages, and without any left-out text every text that is not empty is kept.
    Null and empty texts have one symbol and are not kept; repeated rows are judged alike."""
    short_batches(docs)
    marks = settle(trusted_ids.where("doc_id is not null").select("doc_id").distinct().withColumn("trusted", F.lit(True)))
    left_out = F.coalesce(F.col("trusted") & (F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLD)) == 0), F.lit(False))
    base = (docs.select("doc_id", "text", "lang").join(broadcast_if_small(marks, 24), "doc_id", "left")
            .withColumn("left_out", left_out).withColumn("trusted", F.coalesce(F.col("trusted") & ~F.col("left_out"), F.lit(False))))
    counts = settle(count_ngrams(base, order))
    table = probabilities(counts, order)
    tagged = base.select(F.struct("doc_id", "lang", "left_out").alias("doc_id"), "text", "trusted")
    values = settle(table.join(counts, "key"))
    sums = settle(T.document_sums(tagged, ngrams(order), "trusted", values, "n", {"logp": F.col("logp")})
                  .select("doc_id.*", F.col("flag").alias("trusted"), F.col("size").alias("n_symbols"), F.col("logp").alias("log10_prob"))
                  .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("log10_prob") / F.col("n_symbols"))))
    good = sums.where(F.col("left_out") & (F.col("n_symbols") > 1))
    cut = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)) * slack
    by_lang = good.groupBy(F.col("lang").alias("of")).agg(cut.alias("own"))
    overall = good.agg(cut.alias("overall")).first()["overall"]
    threshold = F.coalesce("own", F.lit(overall).cast("double"))
    out = sums.join(by_lang, sums["lang"] == by_lang["of"], "left").withColumn("threshold", threshold).drop("of", "own", "left_out")
    return out.withColumn("kept", (F.col("n_symbols") > 1) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
