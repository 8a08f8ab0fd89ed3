import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ideolens.llm import periodic_runs as R
from ideolens.llm import queries


def brute_lyndon(x):
    """Distance to the next smaller suffix."""
    return [next((j for j in range(i + 1, len(x)) if x[j:] < x[i:]), len(x)) - i for i in range(len(x))]


def brute_runs(x, min_length, min_exponent):
    """Every stretch, period by period, in which words a period apart agree."""
    out, number = [], {}
    ids = np.array([number.setdefault(v, len(number)) for v in x], np.int64)
    for q in range(1, len(x) // min_exponent + 1):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ids[q:] == ids[:-q], [0]))))
        for i, j in edges.reshape(-1, 2).tolist():
            n, own = j - i + q, x[i:j + q]
            if n >= max(min_length, min_exponent * q) and all(own[d:] != own[:-d] for d in range(1, q)):
                out.append((i, n, q))
    return sorted(out)


def brute(text, min_length=6, min_exponent=4):
    w = words(text)
    found = brute_runs(w, min_length, min_exponent)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return len(w), found, " ".join(x for k, x in enumerate(w) if k not in gone)


def measured(texts, *limits):
    return [(r["n_words"], [tuple(x.values()) for x in r["runs"]], r["collapsed"])
            for r in R.measure(pa.array(texts, pa.string()), *limits).to_pylist()]


def symbols(most, size):
    part = st.builds(lambda x, n, y: x * n + y, st.lists(st.integers(1, most), max_size=6), st.integers(1, 9), st.lists(st.integers(1, most), max_size=5))
    return st.lists(part, max_size=size).map(lambda parts: [v for p in parts for v in p])


@settings(max_examples=300, deadline=None)
@given(symbols(3, 6))
def test_lyndon_lengths(x):
    assert R.lyndon_lengths(x) == brute_lyndon(x)


@settings(max_examples=200, deadline=None)
@given(st.lists(symbols(3, 5), min_size=1, max_size=4), st.sampled_from([(6, 4), (2, 2), (5, 3), (1, 2), (12, 5)]))
def test_all_runs(lists, limits):
    texts = [" ".join("abc"[v - 1] for v in x) for x in lists]
    assert measured(texts, *limits) == [brute(t, *limits) for t in texts]


def test_window_rule():
    """No run of the wanted kind has a window that occurs less often than the rule says."""
    assert R.window_rule(6, 4) == (3, 3)
    for min_length in range(1, 12):
        for exponent in range(2, 7):
            k, c = R.window_rule(min_length, exponent)
            for q in range(1, 20):
                n = max(min_length, exponent * q)
                run = [i % q for i in range(n)]
                grams = [tuple(run[i:i + k]) for i in range(n - k + 1)]
                assert grams and min(grams.count(g) for g in grams) >= c


@pytest.mark.parametrize("name", ["thue_morse", "fibonacci", "powers", "long_period"])
def test_long_words(name):
    """Words with many squares, deep powers, and one that the hash sums cannot tell apart well."""
    if name == "thue_morse":
        x = [bin(i).count("1") % 2 for i in range(2000)] * 1 + [0] * 9
    elif name == "fibonacci":
        a, b = [0], [0, 1]
        while len(b) < 1500:
            a, b = b, b + a
        x = b
    elif name == "powers":
        x = ((([0] * 6 + [1]) * 5 + [2]) * 6 + [3]) * 4
    else:
        rng = random.Random(3)
        x = [rng.randrange(50) for _ in range(300)] * 5 + [7, 7, 7]
    text = " ".join("wxyz"[v] if v < 4 else f"v{v}" for v in x)
    limits = (6, 4) if name == "long_period" else (4, 2)
    assert measured([text], *limits) == [brute(text, *limits)]


def test_sums_that_always_agree(monkeypatch):
    """The words are compared in the end: equal hash sums alone make no run."""
    monkeypatch.setattr(R.W, "mix", lambda x: np.zeros(len(x), np.uint64))
    rng = random.Random(5)
    for _ in range(60):
        x = np.array([rng.randrange(1, 3) for _ in range(60)] + [0], np.int64)
        first, end = np.zeros(61, np.int64), np.full(61, 60, np.int64)
        assert [tuple(r) for r in R.runs_of(x, first, end, 2, 2).tolist()] == brute_runs(x[:-1].tolist(), 2, 2)


def test_operator_on_odd_rows(spark, odd_rows, clashing, empty):
    texts = ["ha " * 50, "a b " * 5 + "a", "x x x x x", "x x x x x x", "one\n" * 6 + "two", "é è é è é è é è é", " \t".join("abcabcabcabcabca"), "a" * 90_000 + " b" * 30]
    rows = [(r[0], r[1]) for r in odd_rows] + [(100 + i, t) for i, t in enumerate(texts)]
    got = R.find_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) == brute(r["text"])
    out = R.find_runs(clashing.withColumnRenamed("n", "RUNS"))
    assert "runs" in out.columns and "RUNS" not in out.columns and out.count() == clashing.count()
    assert R.find_runs(empty).count() == 0
    with pytest.raises(ValueError):
        R.find_runs(empty, 6, 1)


def planted(doc_id, text):
    """The query's text as its contract states it."""
    w = words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return " ".join(w)


def test_query(spark, odd_rows, prose, table_dir):
    """op12 against its contract, planted periods included."""
    rows = [(r[0], r[1]) for r in odd_rows] + [(200 + i, prose(i % 40, 3 + i % 90) + (" la" * 9 + " la di" * 5) * (i % 3 == 0)) for i in range(250)]
    rows += [(900 + i, t) for i, t in enumerate([None, "", " ", "w", "a a a a a a", "b c " * 40])]
    at = table_dir(documents=spark.createDataFrame(rows, "doc_id long, text string"))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text in rows:
        _, found, collapsed = brute(planted(doc_id, text))
        best = next((r for r in found if all(r[1] * o[2] >= o[1] * r[2] for o in found)), None)
        want.append((doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                     digest("".join("%d,%d,%d\n" % r for r in found)), digest(collapsed)))
    got = queries.op12_periodic_runs(spark, at)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert sum(w[1] > 0 for w in want) > 30
    changed = queries.with_planted_periods(spark.createDataFrame(rows, "doc_id long, text string")).where(F.col("doc_id") >= 200).collect()
    assert [words(r["text"]) for r in changed] == [planted(*x).split() for x in rows if (x[0] or 0) >= 200]
