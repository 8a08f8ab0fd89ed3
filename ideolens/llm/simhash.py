"""SimHash near-duplicates: fingerprints, a binary trie self-join and connected components.

Fingerprints that differ in at most b of 64 bits agree on at least m - b of m blocks of
bits.  With m = b + 2, every pair of blocks makes one copy of the distinct fingerprints, in
which these two blocks come first; only fingerprints that agree on them stay together.  Each
such subtree of the trie is joined with itself: node pairs are walked down together, the
differing bits add up, and a pair of nodes is dropped as soon as they exceed b.
"""

from __future__ import annotations

import itertools
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ideolens.llm import words as W
from ideolens.llm.rows import discard, settle, short_batches, text_key

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Node pairs that are walked down at once; more are split and wait their turn.
FRONTIER = 1 << 20
#: Fingerprints read before the subtrees that are complete are joined.
ROWS = 1 << 18


def fingerprints(texts: pa.Array, shingle: int = 4, seed: int = 42) -> pa.Array:
    """64-bit SimHash of each text over its word shingles (XXH64, repeats included)."""
    out = np.zeros(len(texts), np.uint64)
    for at, end, data, bounds in W.pieces(texts, 1 << 19):
        low = W.LOWER[data]
        starts, ends, text = W.spans(low, bounds, W.NOT_SPACE)
        if not len(starts):
            continue
        # one text of single-spaced words: a shingle is one slice of it
        lens = ends - starts
        new_ends = np.cumsum(lens + 1) - 1
        new_starts = new_ends - lens
        joined = np.full(int(new_ends[-1]), 0x20, np.uint8)
        k = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        joined[k + np.repeat(new_starts, lens)] = low[k + np.repeat(starts, lens)]
        flat = joined.tobytes()
        first = W.per_text(text, end - at)
        n_words = np.diff(first)
        count = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
        owner = np.repeat(np.arange(end - at), count)
        head = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]
        tail = np.minimum(head + shingle, first[owner + 1]) - 1
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(flat[a:b], seed) for a, b in zip(new_starts[head].tolist(), new_ends[tail].tolist())),
                        np.uint64, len(head))
        some = np.flatnonzero(count)
        cut = np.cumsum(count) - count
        for b in range(64):
            ones = np.add.reduceat(((h >> np.uint64(b)) & np.uint64(1)).astype(np.int64), cut[some])
            out[at + some] |= (2 * ones > count[some]).astype(np.uint64) << np.uint64(b)
    return pa.array(out.view(np.int64))


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    """(first bit from the top, number of bits) of nearly equal blocks of 64 bits."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def bring_to_front(x: np.ndarray, blocks: int, chosen: tuple[int, ...]):
    """Bits of x with the chosen blocks first; and how many bits these have."""
    parts = block_bounds(blocks)
    out = np.zeros(len(x), np.uint64)
    for i in [*chosen, *(i for i in range(blocks) if i not in chosen)]:
        a, n = parts[i]
        out = (out << np.uint64(n)) | ((x >> np.uint64(64 - a - n)) & np.uint64((1 << n) - 1))
    return out, sum(parts[i][1] for i in chosen)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def trie_links(values: np.ndarray, shared: int, budget: int):
    """Links that span the components of ``values`` (sorted, distinct) among those that agree
    on their first ``shared`` bits: pairs of positions differing in ``budget`` bits or fewer.

    A node is a range of the sorted values.  A node pair is dropped when its differing bits
    exceed the budget, and when all leaves of both are already known to be connected."""
    n = len(values)
    parent = np.arange(n)

    def roots():
        nonlocal parent
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                return parent
            parent = up

    left, right = [], []

    def link(i, j):
        """Hook the larger root under the smaller; links that meet at one root come again."""
        while len(i):
            r = roots()
            a, b = r[i], r[j]
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            if not len(i):
                return
            hi, lo = np.maximum(a, b), np.minimum(a, b)
            _, one = np.unique(hi, return_index=True)
            parent[hi[one]] = lo[one]
            left.append(i[one])
            right.append(j[one])

    bucket = values >> np.uint64(64 - shared)
    near = np.flatnonzero((bucket[1:] == bucket[:-1]) & (popcount(values[1:] ^ values[:-1]) <= budget))
    link(near, near + 1)
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    lo, hi = edge[:-1], edge[1:]
    wide = hi - lo > 1
    lo, hi = lo[wide], hi[wide]
    todo = [(shared, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while todo:
        depth, alo, ahi, blo, bhi, err = todo.pop()
        if not len(alo):
            continue
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            for s in (slice(half, None), slice(None, half)):
                todo.append((depth, alo[s], ahi[s], blo[s], bhi[s], err[s]))
            continue
        # leaves compare their other bits at once
        single = (ahi - alo == 1) & (bhi - blo == 1) & (alo != blo)
        if single.any():
            i, j = alo[single], blo[single]
            ok = popcount(values[i] ^ values[j]) <= budget
            link(i[ok], j[ok])
        r = roots()
        change = np.concatenate(([0], np.cumsum(r[1:] != r[:-1])))
        joined = (change[alo] == change[ahi - 1]) & (change[blo] == change[bhi - 1]) & (r[alo] == r[blo])
        go = ~single & ~joined
        if depth == 64 or not go.any():
            continue
        alo, ahi, blo, bhi, err = alo[go], ahi[go], blo[go], bhi[go], err[go]
        bit = np.uint64(1 << (63 - depth))
        keep = np.uint64(((1 << 64) - 1) ^ ((1 << (63 - depth)) - 1)) ^ bit

        def middle(lo, hi):
            return np.clip(np.searchsorted(values, (values[lo] & keep) | bit), lo, hi)

        amid, bmid = middle(alo, ahi), middle(blo, bhi)
        same = alo == blo
        children = []
        for (xlo, xhi), (ylo, yhi), cost, which in (
                ((alo, amid), (blo, bmid), 0, None), ((amid, ahi), (bmid, bhi), 0, None),
                ((alo, amid), (bmid, bhi), 1, None), ((amid, ahi), (blo, bmid), 1, ~same)):
            ok = (xhi > xlo) & (yhi > ylo) & (err + cost <= budget)
            if which is not None:
                ok &= which
            ok &= ~((xlo == ylo) & (xhi - xlo == 1))
            children.append((xlo[ok], xhi[ok], ylo[ok], yhi[ok], err[ok] + cost))
        todo.append((depth + 1, *(np.concatenate(x) for x in zip(*children))))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def near_links(prints: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all those within
    ``max_bits`` bits of each other, directly or through others.  Every link joins two that
    are within max_bits; links that others already imply are left out."""
    blocks = max_bits + 2
    choices = list(itertools.combinations(range(blocks), 2))

    def copies(batches):
        for batch in batches:
            x = np.array(batch.column(0), np.int64).view(np.uint64)
            for c, chosen in enumerate(choices):
                moved, n = bring_to_front(x, blocks, chosen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), c, np.int32)), W.signed(moved >> np.uint64(64 - n)), W.signed(moved ^ np.uint64(1 << 63)), batch.column(0)],
                    ["choice", "block", "moved", "fp"])

    def join(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = [np.array(c, np.int64) for c in batch.columns]
                held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
                if len(held[0]) < ROWS:
                    continue
                # the last subtree may go on in the next batch
                last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
                upto = int(np.argmax(last))
            elif held is None:
                return
            else:
                upto = len(held[0])
            done, held = [x[:upto] for x in held], [x[upto:] for x in held]
            for c in np.unique(done[0]):
                of = done[0] == c
                moved = done[2][of].view(np.uint64) ^ np.uint64(1 << 63)
                n = sum(block_bounds(blocks)[i][1] for i in choices[c])
                i, j = trie_links(moved, n, max_bits)
                fp = done[3][of]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], ["a", "b"])

    moved = prints.select("fp").mapInArrow(copies, "choice int, block long, moved long, fp long")
    return (moved.repartition("choice", "block").sortWithinPartitions("choice", "moved")
            .select("choice", "block", "moved", "fp").mapInArrow(join, "a long, b long").distinct())


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row (node, root) for each node of a link.

    Every round hooks each node to its smallest smaller neighbour and contracts; the number
    of nodes with links at least halves.  Rounds are written tables, superseded ones go."""
    edges = settle(links.where("a <> b"))
    member = settle(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
                    .withColumn("root", F.col("node")))
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        up = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("root"), F.least("a", "m").alias("to")))
        jump = up.alias("x").join(up.alias("y"), F.col("x.to") == F.col("y.root")).select(
            F.col("x.root").alias("root"), F.col("y.to").alias("to"))
        jump = settle(jump)
        by_a = edges.join(jump.select(F.col("root").alias("a"), F.col("to").alias("x")), "a")
        by_b = by_a.join(jump.select(F.col("root").alias("b"), F.col("to").alias("y")), "b")
        new_edges = settle(by_b.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct())
        new_member = settle(member.join(jump, "root", "left").select(
            "node", F.coalesce("to", "root").alias("root")))
        for old in (edges, member, up, jump):
            discard(old)
        edges, member = new_edges, new_member
    return member


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, tkey, fp (long), root and component_id (smallest doc_id reachable) per row of docs.

    Texts whose fingerprints differ in ``max_bits`` bits or fewer are linked, and links chain.
    Null and empty texts have fingerprint zero, linked like any other; fewer words than a
    shingle make one shingle; repeated rows share their fingerprint.  A component without
    any doc_id has a null component_id, and two may have the same one if their rows share the
    id; ``root``, a fingerprint, tells components apart.  An empty table gives an empty result."""
    short_batches(docs)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fingerprints(batch.column(2), shingle)], ["doc_id", "tkey", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_key().alias("tkey"), "text").mapInArrow(run, f"doc_id {kind}, tkey long, fp long")
    base = settle(rows)
    prints = settle(base.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(prints, max_bits))
    of = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    table = settle(of.join(least, "root").select("fp", "root", "component_id"))
    return base.join(table, "fp").select("doc_id", "tkey", "fp", "root", "component_id")
