import collections

import numpy as np
import pytest
from helpers import lower, words

from ideolens.llm import context_restaurants as C
from ideolens.llm import pitman_yor as Y

WORD = "doc_id long, text string"


def topics(n, contexts=40, seed=5):
    """Texts in which each of many equally frequent words has a word of its own after it."""
    rng = np.random.default_rng(seed)
    return [(i, " ".join(f"c{x} a{x}" for x in rng.integers(0, contexts, 30))) for i in range(n)]


def test_every_preceding_word_is_a_context(spark):
    """Beyond any number of most frequent words: the word before tells the next in all of them."""
    docs = spark.createDataFrame(topics(200), WORD)
    every = [r for r in Y.score(docs).collect() if r["held_out"]]
    some = [r for r in Y.score(docs, contexts=15).collect() if r["held_out"]]
    n = sum(r["n_tokens"] for r in every)
    assert len(every) > 15 and len(some) == len(every)
    gain = (sum(r["score"] for r in every) - sum(r["score"] for r in some)) / n
    assert gain > 0.3
    # half of the tokens follow from the word before, the others are one of 40 or the end
    assert sum(r["score"] for r in every) / n > -0.5 * np.log10(40) - 0.1


def test_pairs_are_whole_and_probabilities_sum_to_one(spark):
    """In every restaurant, over the training words and one unknown word; with several blocks
    and parts."""
    rng = np.random.default_rng(7)
    train = [(i, " ".join(f"w{x}" for x in rng.zipf(1.5, 60) % 12), False) for i in range(40)]
    vocabulary = sorted({w for _, t, _ in train for w in t.split()})
    # every pair of words, each word and none after the end of a text, and an end after each
    asked = [(100 + i, t, True) for i, t in enumerate([f"{a} {b}" for a in [*vocabulary, "never"] for b in [*vocabulary, "never"]] + [""])]
    docs = spark.createDataFrame(train + asked, WORD + ", held_out boolean")
    rows, roots, n, v, _ = C.fit(C.settle(C.blocks(docs, held=500)), 3, 2, 1, 2)
    texts = [[*words(lower(t)), ""] for _, t, _ in train]
    assert n == sum(map(len, texts)) and v == len(vocabulary) + 1 and len(roots) == 2
    parts = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in sorted((r for table in rows for r in table.collect()), key=lambda r: (r["kind"], r["source"])):
        parts[r["to"]][r["kind"]].append(r)
    assert len(parts) == 3 and len({r["source"] for x in parts.values() for r in x[C.ASKED]}) > 1
    mass, times = collections.Counter(), collections.Counter()
    for x in parts.values():
        keys = C.unpack(x[C.PAIRS][0]["a"], np.uint64, True)
        first, _, p, _ = C.probabilities(x, roots)
        for a, y in zip(keys[first].tolist(), p.tolist()):
            mass[a] += y
        for a, c in zip(keys[first].tolist(), C.unpack(x[C.PAIRS][0]["d"]).tolist()):
            times[a] += c
        assert (p > 0).all()
    assert len(mass) == len(vocabulary) + 2 and all(abs(y - 1) < 1e-9 for y in mass.values())
    # customers of the restaurants: how often a word, or the end of a text, has a word after it
    counts = collections.Counter(w for t in texts for w in t)
    assert sorted(times.values()) == sorted([*counts.values(), 0])


@pytest.mark.parametrize("sizes", [dict(), dict(held=300, pair_part=400, word_part=700)])
def test_blocks_and_parts_lose_nothing(spark, odd_rows, sizes):
    rows = [(r[0], r[1]) for r in odd_rows[:8]] + [(1000 + i, t) for i, t in topics(30)]
    docs = spark.createDataFrame(rows, WORD).withColumn("held_out", Y.held_out())
    got = C.score(docs, 1, 1, **sizes).collect()
    tokens = {(d, t): [*words(lower(t)), ""] for d, t in rows}
    assert sorted(repr((r["doc_id"], r["n_tokens"])) for r in got) == sorted(repr((d, len(tokens[d, t]))) for d, t in rows)
    whole = {r["doc_id"]: r for r in Y.score(docs.drop("held_out"), contexts=2).collect()}
    for r in got:
        if r["doc_id"] not in (None, 1):
            other = whole[r["doc_id"]]
            assert (r["held_out"], r["n_known"], r["train_tokens"]) == (other["held_out"], other["n_known"], other["train_tokens"])
            assert abs(r["base_score"] - other["base_score"]) < 1e-6
    again = C.score(docs, 1, 1, **sizes).collect()
    assert sorted(repr(r) for r in again) == sorted(repr(r) for r in got)


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for x, kind in ((np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2)), np.uint64), (np.arange(0, 4_000_000_000, 999_999_937), np.uint32),
                    (np.zeros(0), np.uint32)):
        assert (C.unpack(C.pack(x, kind, True), kind, True) == x.astype(kind)).all() and (C.unpack(C.pack(x, kind), kind) == x.astype(kind)).all()
    y = np.log10(rng.random(100))
    assert (C.unpack(C.pack(y, np.float32), np.float32) == y.astype(np.float32)).all()
