import numpy as np
import xxhash
from helpers import lower, words

from ideolens.llm import simhash


def fingerprint(text, shingle=4):
    w = words(lower(text))
    shingles = [" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, bits):
    """Smallest position reachable through values within so many bits."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def near_values(n, seed):
    """Random fingerprints, chains of small changes, and a dense ball."""
    rng = np.random.default_rng(seed)
    base = [int(x) for x in rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)]
    out = list(base)
    for x in base:
        for _ in range(2):
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(b)
            out.append(x)
    ball = base[0]
    for _ in range(n // 4):
        out.append(ball ^ sum(1 << int(b) for b in rng.choice(12, 6, replace=False)))
    return sorted(set(out))


def test_fingerprints(odd, odd_rows):
    got = {(r["doc_id"], r["fp"] & (1 << 64) - 1) for r in simhash.near_duplicates(odd).collect()}
    assert got == {(r[0], fingerprint(r[1])) for r in odd_rows}


def test_trie_links_alone():
    for seed in range(6):
        values = near_values(200, seed)
        x = np.array(values, np.uint64)
        for shared in (1, 5):
            i, j = simhash.trie_links(x, shared, 4)
            assert all(bin(values[a] ^ values[b]).count("1") <= 4 for a, b in zip(i, j))
            assert len(i) < len(values)
            same = [v >> (64 - shared) for v in values]
            buckets = {}
            for k, s in enumerate(same):
                buckets.setdefault(s, []).append(k)
            find = list(range(len(values)))

            def top(k):
                while find[k] != k:
                    k = find[k]
                return k

            for a, b in zip(i, j):
                find[max(top(a), top(b))] = min(top(a), top(b))
            for members in buckets.values():
                inside = groups([values[k] for k in members], 4)
                assert [top(k) for k in members] == [members[m] for m in inside]


def test_components_of_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    values = near_values(300, 9)
    prints = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    roots = {r["node"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in simhash.components(simhash.near_links(prints, 4)).collect()}
    want = groups(values, 4)
    label = [roots.get(v, v) for v in values]
    assert len(set(zip(label, want))) == len(set(label)) == len(set(want))


def test_documents(spark, prose, odd, odd_rows, empty):
    rows = [(r[0], r[1]) for r in odd_rows] + [(100 + i, prose(77, 300) + f" tail{i}") for i in range(8)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = [fingerprint(t) for _, t in rows]
    want = groups(fps, 4)
    ids = {}
    for (doc, _), g in zip(rows, want):
        if doc is not None:
            ids[g] = min(doc, ids.get(g, doc))
    expected = sorted(map(repr, ((d, f, ids.get(g)) for (d, _), f, g in zip(rows, fps, want))))
    assert sorted(map(repr, ((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got))) == expected
    assert simhash.near_duplicates(empty).count() == 0


def test_long_chain_of_components(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert roots == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}
