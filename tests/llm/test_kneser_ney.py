import collections
import functools
import math

import pytest

from ideolens.llm import kneser_ney as K


def events(text, order):
    s = [K.START] * (order - 1) + list((text or "").encode()) + [K.END]
    return [tuple(s[i:i + order]) for i in range(len(s) - order + 1)]


def brute_model(texts, order):
    counts = {order: collections.Counter(g for t in texts for g in events(t, order))}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    off, total, left = {}, {}, {}
    for k, c in counts.items():
        n = collections.Counter(c.values())
        if n[1] and n[2] and n[3]:
            y = n[1] / (n[1] + 2 * n[2])
            off[k] = [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) for i in (1, 2, 3)]
        else:
            off[k] = [0, 0.5, 1.0, 1.5]
        total[k], left[k] = collections.Counter(), collections.Counter()
        for g, x in c.items():
            total[k][g[:-1]] += x
            left[k][g[:-1]] += off[k][min(x, 3)]

    @functools.lru_cache(None)
    def p(g):
        if not g:
            return 1 / (K.END + 1)
        k, low = len(g), p(g[1:])
        if not total[k][g[:-1]]:
            return low
        x = counts[k][g]
        return (x - off[k][min(x, 3)] + left[k][g[:-1]] * low) / total[k][g[:-1]]

    return p


@pytest.mark.parametrize("order", [2, 4])
def test_brute_force(spark, clashing, odd_rows, prose, order):
    more = [(200 + i, prose(i, 40), "en" if i % 2 else "de", "s", 0) for i in range(60)] + [(300, "?!" * 60, "en", "s", 0)]
    docs = clashing.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    ids = [(i,) for i in [*range(200, 255), 1, 999]] + [(None,), (200,)]
    got = K.classify(docs, spark.createDataFrame(ids, "doc_id long"), order).collect()
    rows = [*odd_rows, *more]
    assert len(got) == len(rows)
    learnt = {r["doc_id"] for r in got if r["trusted"]}
    assert learnt and learnt < {i for i, in ids}
    p = brute_model([r[1] for r in rows if r[0] in learnt], order)
    want = sorted((repr((r[0], r[2], len((r[1] or "").encode()) + 1)), sum(math.log10(p(g)) for g in events(r[1], order))) for r in rows)
    have = sorted((repr((r["doc_id"], r["lang"], r["n_symbols"])), r["log10_prob"]) for r in got)
    assert [x for x, _ in have] == [x for x, _ in want]
    assert all(abs(a - b) < 1e-6 * max(1, abs(b)) for (_, a), (_, b) in zip(have, want))
    for r in got:
        assert r["kept"] == (r["n_symbols"] > 1 and r["perplexity"] <= r["threshold"])
    assert not next(r for r in got if r["doc_id"] == 300)["kept"]
    assert all(r["kept"] for r in got if r["doc_id"] is not None and 200 <= r["doc_id"] < 260)


def test_probabilities_sum_to_one(spark, prose):
    counts = K.count_ngrams(spark.createDataFrame([(prose(i, 30), True) for i in range(5)], "text string, trusted boolean"), 3)
    context = counts.where("n > 0").first()["key"] >> K.BITS
    asked = spark.createDataFrame([((context << K.BITS) | s, 0) for s in range(K.END + 1)], "key long, n long")
    table = K.probabilities(counts.unionByName(asked).groupBy("key").sum("n").toDF("key", "n"), 3)
    mass = sum(10 ** r["logp"] for r in table.collect() if r["key"] >> K.BITS == context)
    assert abs(mass - 1) < 1e-9


def test_no_trusted_text(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long")
    out = K.classify(odd, none).collect()
    assert len(out) == odd.count() and all(r["kept"] == (r["n_symbols"] > 1) for r in out)
    assert K.classify(empty, none).count() == 0
