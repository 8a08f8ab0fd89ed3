import collections

from helpers import words

from ideolens.llm import mixing


def expected_targets(sizes, weights, total, cap):
    """Shares by weight; whoever is above the ceiling is held there, the rest shared again."""
    held = set()
    while True:
        w = sum(weights[s] for s in sizes if s not in held)
        if not w:
            return {s: cap * sizes[s] for s in sizes}
        level = (total - sum(cap * sizes[s] for s in held)) / w
        above = {s for s in sizes if s not in held and weights[s] * level > cap * sizes[s]}
        if not above:
            return {s: cap * sizes[s] if s in held else weights[s] * level for s in sizes}
        held |= above


def check(rows, got):
    sizes = collections.Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(words(text))
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weights = {s: [1.0, 2.0, 3.0][i % 3] for i, s in enumerate(order)}
    targets = expected_targets(sizes, weights, sum(sizes.values()), 3)
    taken = collections.Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - targets[r["source"]]) < 1e-6
        assert r["taken"] == r["repeats"] * r["size"] and r["taken"] <= 3 * r["size"]
        assert r["taken"] >= r["size"] * int(r["target"] // max(r["source_size"], 1))
        taken[r["source"]] += r["taken"]
    return targets, taken


def test_odd_rows(clashing, odd_rows):
    got = mixing.mix(clashing).collect()
    targets, taken = check(odd_rows, got)
    assert all(taken[s] <= targets[s] + 1e-6 for s in targets)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(clashing.repartition(3)).collect()))


def test_targets_are_met(spark, prose):
    rows = [(i, prose(i, 5 + i % 40), "en", f"s{i % 7 if i % 3 else 0}", 0) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    targets, taken = check(rows, got)
    assert all(abs(taken[s] - targets[s]) <= 40 for s in targets)


def test_ceiling(spark):
    """A tiny source with a large weight is repeated three times, the others take the rest."""
    rows = [(i, "w " * 10, "a") for i in range(50)] + [(100, "w " * 4, "b"), (101, "w", "c")]
    got = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[100]["taken"] == 12 and got[101]["taken"] == 3
    assert abs(got[0]["target"] - (505 - 12 - 3)) < 1e-9


def test_empty(empty):
    assert mixing.mix(empty).count() == 0
