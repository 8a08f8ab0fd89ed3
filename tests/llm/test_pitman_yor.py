import collections
import math
import zlib

import numpy as np
import pytest
from helpers import lower, words

from ideolens.llm import pitman_yor as Y


def held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def test_base_columns(spark, clashing, odd_rows, prose):
    more = [(200 + i, prose(i % 9, 50)) for i in range(40)]
    docs = clashing.select("doc_id", "text", "score", "key").unionByName(
        spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r[0], r[1]) for r in odd_rows] + more
    tokens = [words(lower(t)) + [""] for _, t in rows]
    counts = collections.Counter(w for (d, _), ws in zip(rows, tokens) if not held_out(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((repr((d, held_out(d), len(ws), sum(counts[w] > 0 for w in ws), n)), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
                  for (d, _), ws in zip(rows, tokens))
    got = Y.score(docs).collect()
    have = sorted((repr((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"])), r["base_score"]) for r in got)
    assert [x for x, _ in have] == [x for x, _ in want]
    assert all(abs(a - b) < 1e-6 * max(1, abs(b)) for (_, a), (_, b) in zip(have, want))
    assert all(r["score"] < 0 for r in got)
    again = {(r["doc_id"], r["score"]) for r in Y.score(docs.repartition(5)).collect()}
    assert len(again) == len({(r["doc_id"], r["score"]) for r in got})


def two_languages(prose, n):
    """Texts in which a common word tells which half of the vocabulary follows."""
    vocabulary = [[f"{p}{i}" for i in range(150)] for p in "ab"]
    rng = np.random.default_rng(3)
    out = []
    for i in range(n):
        side = i % 2
        w = []
        for x in rng.zipf(1.4, 60) % 150:
            w += [("the", "der")[side]] * (rng.random() < 0.3) + [vocabulary[side][x]]
        out.append((i, " ".join(w)))
    return out


def test_context_beats_the_unigram_on_held_out_text(spark, prose):
    rows = two_languages(prose, 400)
    got = [r for r in Y.score(spark.createDataFrame(rows, "doc_id long, text string"), contexts=4).collect() if r["held_out"]]
    n = sum(r["n_tokens"] for r in got)
    assert len(got) > 30
    assert sum(r["score"] for r in got) / n > sum(r["base_score"] for r in got) / n + 0.15


def test_predictive_probabilities_sum_to_one(spark, prose):
    """Over the training words and the class of unknown words, in every context."""
    rows = [(f"t{i}", x, False) for i, (_, x) in enumerate(two_languages(prose, 30))]
    docs = spark.createDataFrame(rows, "doc_id string, text string, held_out boolean")
    common = Y.common_words(docs, 2)
    counts = Y._counts(docs, Y.in_context(common))
    words = [r["w"] for r in counts.selectExpr("key & -16L as w").distinct().collect()] + [12352]
    every = spark.createDataFrame([(k + c, 0) for k in words for c in range(3)], "key long, c long")
    model, n, v = Y.fit(counts.unionByName(every), 3)
    mass = [0.0] * 3
    for r in model.collect():
        mass[r["key"] & 15] += 10 ** r["model"]
    assert v == len(words) - 1 and all(abs(x - 1) < 1e-9 for x in mass)


def gibbs_marginal(c, alpha, discount):
    """Distribution of the number of tables of one dish with c customers, new tables weighing
    alpha: proportional to alpha^t S(c, t), S the generalised Stirling numbers."""
    s = np.zeros((c + 1, c + 1))
    s[1, 1] = 1
    for n in range(1, c):
        for t in range(1, n + 2):
            s[n + 1, t] = s[n, t - 1] + (n - discount * t) * s[n, t]
    w = s[c, 1:] * alpha ** np.arange(1, c + 1)
    return w / w.sum()


@pytest.mark.parametrize("c, alpha, discount", [(6, 0.8, 0.5), (12, 2.5, 0.3)])
def test_seating_has_the_right_distribution(c, alpha, discount):
    n = 20_000
    key = np.arange(n, dtype=np.uint64) * np.uint64(977)
    tables, sizes = Y.seat(key, np.ones(n, int), np.full(n, c), np.full(n, alpha), discount, np.ones(n), np.zeros(n, int), 150, 5)
    assert sizes.sum() == n * c and (sizes > 0).all() and tables.sum() == len(sizes)
    have = np.bincount(tables, minlength=c + 1)[1:] / n
    assert np.abs(have - gibbs_marginal(c, alpha, discount)).max() < 0.015


@pytest.mark.parametrize("c, alpha, discount", [(12, 2.5, 0.3), (64, 0.4, 0.8), (300, 0.02, 0.5), (300, 40.0, 0.5), (3000, 0.7, 0.8), (3000, 200.0, 0.3)])
def test_a_draw_seats_all_customers_of_a_cell(c, alpha, discount):
    n = 6000
    log_p = Y.log_stirling(c, discount)[c, 1:c + 1] + np.log(alpha) * np.arange(1, c + 1)
    want = np.exp(log_p - log_p.max())
    have = Y.draw_tables(np.arange(n, dtype=np.uint64) * np.uint64(977), np.full(n, c), np.full(n, alpha), discount, 5)
    assert np.abs(np.cumsum(np.bincount(have, minlength=c + 1)[1:]) / n - np.cumsum(want / want.sum())).max() < 0.025


def test_one_sweep_leaves_the_starting_seating_of_large_cells(spark):
    """300 words of 3000 customers each in one context, seated at one table at first."""
    keys = [((i + 1) * 0x51ED270B1 << 4) + 1 for i in range(300)]
    state = Y._first_state(spark.createDataFrame([(k, 3000) for k in keys], "key long, c long"))
    customers, tables = Y._sum_state(state, 2)[:2], Y._sum_state(state, 2)[2:4]
    totals = Y.Totals(customers + [tables[1], 0], tables, (0.5, 0.5), 300)
    weight = totals.weight[1] * totals.root(1, 1)
    log_p = Y.log_stirling(3000, 0.5)[3000, 1:3001] + np.log(weight) * np.arange(1, 3001)
    p = np.exp(log_p - log_p.max())
    expected = (p / p.sum() * np.arange(1, 3001)).sum()
    after = Y._sum_state(Y._sweep(state, totals, 0, False, True), 2)[3] / 300
    assert expected > 1.4 and abs(after - expected) < 0.25


def test_customers_come_and_go():
    tables, sizes = Y.seat(np.arange(4, dtype=np.uint64), np.array([1, 2, 0, 1]), np.array([5, 3, 1, 2]), np.ones(4), 0.5, np.ones(4),
                           np.array([3, -2, 4, 0]), 0, 1)
    ends = np.cumsum(tables)
    assert [int(x.sum()) for x in np.split(sizes, ends[:-1])] == [8, 2, 4, 2]


def test_shuffled_join_of_rare_words_agrees(spark, prose):
    docs = spark.createDataFrame(two_languages(prose, 60) + [(99, None)], "doc_id long, text string")
    whole = {r["doc_id"]: r for r in Y.score(docs).collect()}
    for limit in (0, 40):
        split = {r["doc_id"]: r for r in Y.score(docs, limit=limit).collect()}
        assert whole.keys() == split.keys()
        for k, r in whole.items():
            assert r["n_known"] == split[k]["n_known"] and abs(r["score"] - split[k]["score"]) < 1e-4
            assert abs(r["base_score"] - split[k]["base_score"]) < 1e-6


def test_empty(empty):
    assert Y.score(empty).count() == 0
