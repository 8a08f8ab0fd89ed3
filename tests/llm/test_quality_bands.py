import base64
import collections
import math
import os
import random
import re

import numpy as np
import pytest
import zstandard
from helpers import words

from ideolens.llm import quality_bands as Q


def fixed(n):
    return next((lo, hi) for below, lo, hi in Q.BANDS if n < below)


def brute(text, band=fixed):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    counts, mark = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            mark.update((i, i + 1, i + 2))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(mark) > 50 * len(w)
    raw, press, kept = text.encode(), zstandard.ZstdCompressor(level=Q.LEVEL).compress, False
    if raw:
        def ok(part):
            lo, hi = band(len(part))
            return lo <= len(press(part)) / len(part) <= hi
        parts = [raw[i:i + Q.CHUNK] for i in range(0, len(raw), Q.CHUNK)]
        if len(parts) > 1 and len(parts[-1]) < Q.CHUNK // 4:
            parts[-2:] = [parts[-2] + parts[-1]]
        bad = sum(not ok(p) for p in parts) / len(parts)
        kept = not failed and ok(raw) and bad <= Q.MAX_BAD_CHUNKS
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(mark), failed, kept


@pytest.fixture(scope="module")
def rows(odd_rows, prose):
    texts = [prose(1, 80), prose(2, 60) + "\n" + prose(2, 60), "a b c " * 30, "a a a a", "x\nx\n \n \ny\n\nx", "#*$%&|<> é# ",
             base64.b64encode(os.urandom(9000)).decode(), "spam ham eggs ".join(["q"] * 900), " ".join(prose(i, 90) for i in range(90)),
             "\n".join(prose(i, 9) for i in range(12)), prose(3, 49), prose(3, 50), "a b c d a b c", prose(4, 5000)[:4097 * 5]]
    return [(r[0], r[1]) for r in odd_rows] + [(100 + i, t) for i, t in enumerate(texts)]


def test_brute_force(spark, rows):
    got = Q.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    have = sorted(map(repr, ((r["doc_id"], *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))) for r in got)))
    assert have == sorted(map(repr, ((d, *brute(t)) for d, t in rows)))
    assert {r["kept"] for r in got} == {True, False}


def fitted_bands(texts):
    """Limits by half octave from trusted texts, by numpy."""
    press, by = zstandard.ZstdCompressor(level=Q.LEVEL).compress, collections.defaultdict(set)
    for text in texts:
        if not brute(text)[5]:
            raw = text.encode()
            by[math.floor(2 * math.log2(len(raw)))].add((len(raw), round(len(press(raw)) / len(raw), 4)))
    out = {}
    for b, values in by.items():
        if len(values) >= Q.MIN_TRUSTED:
            lo, mid, hi = np.quantile([r for _, r in values], [Q.QUANTILES[0], 0.5, Q.QUANTILES[1]])
            out[b] = mid - max(Q.WIDER * (mid - lo), Q.LEAST_WIDTH), mid + max(Q.WIDER * (hi - mid), Q.LEAST_WIDTH)
    return out


@pytest.fixture(scope="module")
def corpus(prose):
    """Trusted prose of some lengths, with copies; planted repetitive and incompressible texts that
    pass the base rules; clean texts beyond the trusted ones."""
    rng = random.Random(8)
    trusted = [(i, prose(i, 110 + i % 60)) for i in range(300)] + [(300 + i, prose(i, 900 + 3 * i)) for i in range(80)] + [(380 + i, prose(1, 111)) for i in range(90)]
    clean = [(1000 + i, prose(5000 + i, 115 + i % 50)) for i in range(60)] + [(1100 + i, prose(6000 + i, 920 + i)) for i in range(20)]
    words = [prose(9, 400).split()[i] for i in range(24)]
    dull = [(2000 + i, " ".join(rng.choice(words[:14]) for _ in range(150 + i))) for i in range(12)]
    noise = [(3000 + i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(7)) for _ in range(100 + i))) for i in range(12)]
    half = [(4000 + i, prose(7000 + i, 450) + " " + " ".join(rng.choice(words[:14]) for _ in range(600))) for i in range(6)]
    return trusted, clean, dull, noise, half


def test_fitted_bands_decide(spark, corpus):
    """Planted texts pass the base rules and the fixed bands, and are refused; clean ones stay."""
    trusted, clean, dull, noise, half = corpus
    docs = spark.createDataFrame([x for part in corpus for x in part] + [(None, trusted[0][1]), (5000, None), (5001, "")], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i, _ in trusted] * 2 + [(None,)], "doc_id long")
    got = {r["doc_id"]: r for r in Q.judge(docs, ids).collect()}
    bands = fitted_bands([t for _, t in trusted])
    assert len(bands) >= 2
    both = lambda n: bands.get(math.floor(2 * math.log2(n)), fixed(n))
    for i, text in [x for part in corpus for x in part]:
        assert (got[i]["base_failed"], got[i]["kept"]) == brute(text, both)[5:], i
    free = {r["doc_id"]: r for r in Q.judge(docs).collect()}
    planted = [i for part in (dull, noise) for i, _ in part]
    assert not any(got[i]["base_failed"] for i in planted) and sum(free[i]["kept"] for i in planted) >= len(planted) // 2
    assert not any(got[i]["kept"] for i in planted)
    assert sum(got[i]["kept"] for i, _ in clean) >= 0.97 * len(clean)
    assert sum(got[i]["kept"] for i, _ in trusted) >= 0.98 * len(trusted)


def test_too_few_trusted_texts(spark, corpus):
    trusted, clean, *_ = corpus
    docs = spark.createDataFrame(trusted[:10] + clean, "doc_id long, text string")
    ids = docs.where("doc_id < 10").select("doc_id")
    assert sorted(map(repr, Q.judge(docs, ids).collect())) == sorted(map(repr, Q.judge(docs).collect()))


def test_small_pieces_agree(rows):
    """The batches in which texts arrive do not matter."""
    import pyarrow as pa
    whole = Q.measure(pa.array([t for _, t in rows], pa.string()))
    single = pa.concat_arrays([Q.measure(pa.array([t], pa.string())) for _, t in rows])
    assert whole.equals(single)


def test_empty_and_clashing(empty, clashing):
    assert Q.judge(empty).count() == 0
    assert Q.judge(clashing).count() == clashing.count()
    assert Q.judge(empty, empty).count() == 0
    assert Q.judge(clashing, clashing).count() == clashing.count()
