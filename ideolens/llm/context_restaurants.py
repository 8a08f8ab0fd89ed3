"""Hierarchical Pitman-Yor language model with a restaurant for every preceding word.

A token is drawn in the restaurant of the token before it, whatever its frequency (the first
word of a text: in that of the end of a text).  All restaurants share the root as their
parent, whose base is uniform over the training words and one class of unknown words; a word
that no training text goes on after has an empty restaurant, which is the root.

Tokens are held in blocks of some million with a list of their words.  Distinct pairs of
adjacent words are sent to parts by a hash of the pair, so that no part follows a frequent
word, and counted there.  Words are in parts of their own, by their key: customers and tables
of a word in the root, tables of the restaurant of the context it is.  Of a sweep of the Gibbs
sampler, the parts of pairs seat all customers of their cells again, given the totals of the
restaurant and the root, and send the numbers of tables to the parts of words, which sum them,
seat the root's customers again and send the totals back.  A pair of one customer has one
seating, so only the others take part.  At the end every pair that a block asked for is
answered with its probability, averaged over the samples.
"""

from __future__ import annotations

import sys
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ideolens.llm import words as W
from ideolens.llm.pitman_yor import END_KEY, STRENGTH, _discount, draw_tables, tokens
from ideolens.llm.rows import discard, settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tokens of a block and, on average, of a part of the pairs and of the words.
HELD, PAIR_PART, WORD_PART = 3 << 20, 4 << 20, 16 << 20
#: Tasks per part or block.
SPREAD = 4

# Everything between the parts is a row of packed arrays, of one of these kinds.  To a part of
# pairs: what a block asks for (its words; first and second word and training count of every
# pair), the summed pairs, the places among them of what a block asked for, the cells that
# are seated (first, second word, customers, tables, tables summed over samples), and the
# totals of its words (customers and tables in the root, tables and customers of the
# restaurant; REPLY and the number of the sweep).  To a part of words: what a part of pairs has
# of them (words; training count, fixed and moving tables as second word, the same as first),
# the places of these words, moving tables as second and first word after a sweep, and the
# words (training count, fixed tables as second and first word).
# To a block: log10 of the probability of its pairs, training counts of their second words.
ASK, PAIRS, ASKED, CELLS, HAS, ROUTE, MOVED, WORDS, VALUE, REPLY = range(10)
BLOBS = ("a", "b", "c", "d", "e", "f")
ROW = "to long, kind int, source long, " + ", ".join(f"{x} binary" for x in BLOBS) + ", s1 long, s2 long, s3 long, s4 long"


def pack(x: np.ndarray, kind=np.uint32, ascending: bool = False) -> bytes:
    """Numbers by bytes of equal weight, compressed; ascending ones as differences."""
    x = np.asarray(x).astype(kind)
    if ascending and len(x):
        x = np.concatenate((x[:1], x[1:] - x[:-1]))
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(x).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unpack(blob: bytes, kind=np.uint32, ascending: bool = False) -> np.ndarray:
    n, size = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(blob[8:], n * size, "zstd", asbytes=True), np.uint8)
    x = np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if ascending else x


def row(to: int, kind: int, source: int, *blobs: bytes, sums=(0, 0, 0, 0)) -> pa.RecordBatch:
    blobs = (*blobs, *[None] * (len(BLOBS) - len(blobs)))
    return pa.RecordBatch.from_arrays(
        [pa.array([to], pa.int64()), pa.array([kind], pa.int32()), pa.array([source], pa.int64()), *(pa.array([x], pa.binary()) for x in blobs),
         *(pa.array([int(x)], pa.int64()) for x in sums)], ["to", "kind", "source", *BLOBS, "s1", "s2", "s3", "s4"])


NO_ROWS = row(0, 0, 0).slice(0, 0)


def each(batch: pa.RecordBatch):
    """The rows of a batch, one copied at a time."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def deal(tables: list[DataFrame], handle, parts: int) -> DataFrame:
    """Rows that ``handle`` makes of all the rows to one place: {kind: [row, ...]}, by source;
    in some times more tasks than ``parts``, so that few take two of them."""
    def run(table: pa.Table) -> pa.Table:
        by_kind = {}
        for r in sorted(table.select(["to", "kind", "source", *BLOBS]).to_pylist(), key=lambda r: (r["kind"], r["source"])):
            by_kind.setdefault(r["kind"], []).append(r)
        out = pa.Table.from_batches(list(handle(table["to"][0].as_py(), by_kind)), NO_ROWS.schema)
        W.give_back()
        return out

    return reduce(DataFrame.unionByName, tables).repartition(SPREAD * parts, "to").groupBy("to").applyInArrow(run, ROW)


def blocks(docs: DataFrame, held: int = HELD) -> DataFrame:
    """The tokens of docs (doc_id, text, held_out): per block the ids, held-out flags and
    numbers of tokens of its texts, the sorted keys of its words and the tokens' places there."""
    def run(batches):
        own, n = ([], [], [], []), 0
        number = TaskContext.get().partitionId() << 32

        def block():
            key = np.concatenate(own[3])
            own[3].clear()
            words, seq = ranks(key)
            ids = pa.concat_arrays(own[0])
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([n]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                 *(pa.array([x], pa.binary()) for x in (pack(np.concatenate(own[1]), np.uint8), pack(np.concatenate(own[2])), pack(words, np.uint64, True), pack(seq)))],
                ["block", "tokens", "ids", "held_out", "size", "words", "seq"])

        for batch in batches:
            flags = np.array(batch.column(2)).astype(bool)
            for at, end, data, bounds in W.pieces(batch.column(1)):
                owner, key = tokens(data, bounds)
                for x, y in zip(own, (batch.column(0).slice(at, end - at), flags[at:end], np.bincount(owner, minlength=end - at), key)):
                    x.append(y)
                n += len(key)
                if n >= held:
                    yield block()
                    own, n, number = ([], [], [], []), 0, number + 1
        if n:
            yield block()
        own = None
        W.give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "held_out").mapInArrow(
        run, f"block long, tokens long, ids array<{kind}>, held_out binary, size binary, words binary, seq binary")


def ranks(x: np.ndarray):
    """np.unique(x, return_inverse=True) in less memory: sorted distinct values, places there."""
    order = np.argsort(x).astype(np.int32 if len(x) < 1 << 31 else np.int64)
    x = x[order]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    place = np.empty(len(x), order.dtype)
    place[order] = np.cumsum(new, dtype=order.dtype) - 1
    return x[new], place


def block_pairs(words: np.ndarray, seq: np.ndarray, parts: int):
    """(first, second word, bounds, place): the distinct pairs of adjacent words of a block by
    part and, in a part, by their words; where each part begins; the pair of every token.
    The first word of a text follows the end of a text."""
    pair = np.empty(len(seq), np.uint64)
    pair[0], pair[1:] = np.searchsorted(words, END_KEY), seq[:-1]
    pair, place = ranks((pair << np.uint64(32)) | seq)
    first, second = (pair >> np.uint64(32)).astype(np.int32), (pair & np.uint64(0xFFFFFFFF)).astype(np.int32)
    part = pair_key(words[first], words[second]) % np.uint64(parts)
    order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.uint64), kind="stable")
    where = np.empty(len(order), place.dtype)
    where[order] = np.arange(len(order), dtype=place.dtype)
    bounds = np.concatenate(([0], np.cumsum(np.bincount(part.astype(np.int64), minlength=parts))))
    return first[order], second[order], bounds, where[place]


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return W.mix(W.mix(first) * np.uint64(0xD6E8FEB86659FD93) + second)


def ask(table: DataFrame, parts: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for r in each(batch):
                words, seq = unpack(r["words"], np.uint64, True), unpack(r["seq"])
                first, second, bounds, place = block_pairs(words, seq, parts)
                learn = np.repeat(unpack(r["held_out"], np.uint8) == 0, unpack(r["size"]))
                c = np.bincount(place[learn], minlength=len(first))
                for part in np.flatnonzero(np.diff(bounds)):
                    of = slice(bounds[part], bounds[part + 1])
                    own, at = np.unique(np.concatenate((first[of], second[of])), return_inverse=True)
                    n = len(at) // 2
                    yield row(int(part), ASK, r["block"], pack(words[own], np.uint64, True), pack(at[:n], ascending=True), pack(at[n:]), pack(c[of]))
                del words, seq, first, second, place, learn, c
                W.give_back()

    return table.select("block", "held_out", "size", "words", "seq").mapInArrow(run, ROW)


def sum_pairs(part: int, rows):
    """The pairs of all blocks, summed; s1 and s2: how many have one and two customers."""
    asks = [(r["source"], unpack(r["a"], np.uint64, True), unpack(r["b"], ascending=True), unpack(r["c"]), unpack(r["d"])) for r in rows[ASK]]
    words = np.unique(np.concatenate([x[1] for x in asks]))
    codes = []
    for _, own, first, second, _ in asks:
        at = np.searchsorted(words, own).astype(np.uint64)
        codes.append((at[first] << np.uint64(32)) | at[second])
    pair = np.unique(np.concatenate(codes))
    c = np.zeros(len(pair), np.int64)
    for code, (block, *_, more) in zip(codes, asks):
        at = np.searchsorted(pair, code)
        c[at] += more
        yield row(part, ASKED, block, pack(at, ascending=True))
    yield row(part, PAIRS, -1, pack(words, np.uint64, True), pack(pair >> np.uint64(32), ascending=True), pack(pair & np.uint64(0xFFFFFFFF)), pack(c),
              sums=((c == 1).sum(), (c == 2).sum(), 0, 0))


def edges(words: np.ndarray, parts: int) -> np.ndarray:
    """Where the words of each part of words begin, by ranges of their keys."""
    at = [np.searchsorted(words, np.uint64((i << 64) // parts)) for i in range(parts)]
    return np.array([*at, len(words)])


def tell(pairs: DataFrame, parts: int) -> DataFrame:
    """What parts of pairs have of their words, to the parts of words, and their first cells:
    all customers of a pair at one table."""
    def run(batches):
        for batch in batches:
            for r in each(batch):
                words, first, second, c = unpack(r["a"], np.uint64, True), unpack(r["b"], ascending=True), unpack(r["c"]), unpack(r["d"])
                n, one, more = len(words), c == 1, c > 1
                sums = [np.bincount(second, c, minlength=n), *(np.bincount(x[of], minlength=n) for of in (one, more) for x in (second, first))]
                bounds = edges(words, parts)
                for i in np.flatnonzero(np.diff(bounds)):
                    of = slice(bounds[i], bounds[i + 1])
                    yield row(int(i), HAS, r["to"], pack(words[of], np.uint64, True), *(pack(x[of]) for x in sums))
                yield row(r["to"], CELLS, -1, pack(first[more], ascending=True), pack(second[more]), pack(c[more]), pack(np.ones(more.sum())), pack(np.zeros(more.sum())))

    return pairs.mapInArrow(run, ROW)


def first_words(part: int, rows):
    """The words of a part, where each part of pairs has them, and their first totals."""
    told = [(r["source"], unpack(r["a"], np.uint64, True), *(unpack(r[x]) for x in BLOBS[1:])) for r in rows[HAS]]
    words = np.unique(np.concatenate([x[1] for x in told]))
    sums, routes = np.zeros((5, len(words)), np.int64), []
    for source, own, *more in told:
        at = np.searchsorted(words, own)
        sums[:, at] += np.array(more, np.int64).reshape(5, -1)
        routes.append((source, at))
        yield row(part, ROUTE, source, pack(at, ascending=True))
    c, second, first = sums[0], sums[1] + sums[3], sums[2] + sums[4]
    t_root = (second > 0).astype(np.int64)
    yield row(part, WORDS, -1, pack(c), pack(sums[1]), pack(sums[2]),
              sums=(c.sum(), (c > 0).sum(), (second == 1).sum(), (second == 2).sum()))
    yield from replies(part, routes, 0, second, t_root, first, c)


def replies(part, routes, sweep, customers, t_root, tables, c):
    """Totals to the parts of pairs; with them, once, their sums (a row to nowhere)."""
    for to, at in routes:
        yield row(to, REPLY + sweep, part, pack(customers[at]), pack(t_root[at]), pack(tables[at]), pack(c[at]))
    yield row(-1, REPLY + sweep, part, sums=(customers.sum(), t_root.sum(), 0, 0))


def move_words(alpha: float, discount: float, sweep: int):
    """Sum the tables that the parts of pairs sent; seat the customers of the root again."""
    def run(part, rows):
        r = rows[WORDS][0]
        c, second, first = (unpack(r[x]).astype(np.int64) for x in "abc")
        routes = [(x["source"], unpack(x["a"], ascending=True)) for x in rows[ROUTE]]
        at = dict(routes)
        for x in rows[MOVED]:
            second[at[x["source"]]] += unpack(x["a"])
            first[at[x["source"]]] += unpack(x["b"])
        word = pair_key(np.array([part], np.uint64), np.arange(len(c), dtype=np.uint64))
        t_root = draw_tables(word, second, np.full(len(c), alpha), discount, 2 * sweep + 2)
        yield row(part, WORDS, -1, *(r[x] for x in "abc"))
        yield from replies(part, routes, sweep, second, t_root, first, c)

    return run


class Root:
    """Probabilities in the root, from its totals; discounts and strength of the restaurants."""

    def __init__(self, customers, tables, discounts, v):
        self.discount_root, self.discount = discounts
        self.alpha = (STRENGTH + self.discount_root * tables) / (v + 1)
        self.all = STRENGTH + customers

    def of(self, customers, tables):
        return (customers - self.discount_root * tables + self.alpha) / self.all


def read_replies(rows):
    """Of the words of a part of pairs: customers and tables in the root, tables and customers
    of the restaurant."""
    return [np.concatenate([np.zeros(0, np.int64), *(unpack(r[x]) for r in rows)]).astype(np.float64) for x in "abcd"]


def move_cells(root: Root, sweep: int, sample: bool):
    """Seat the customers of all cells again; with ``sample``, add up the tables before."""
    def run(part, rows):
        customers, t_root, tables, _ = read_replies(rows[REPLY + sweep])
        r = rows[CELLS][0]
        first, second, c, t, total = unpack(r["a"], ascending=True), *(unpack(r[x]).astype(np.int64) for x in "bcde")
        p = root.of(customers, t_root)
        cell = pair_key(np.array([part], np.uint64), (first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64))
        new = draw_tables(cell, c, (STRENGTH + root.discount * tables[first]) * p[second], root.discount, 2 * sweep + 1)
        yield row(part, CELLS, -1, r["a"], r["b"], r["c"], pack(new), pack(total + t if sample else total))
        sums, at = [np.bincount(x, new, minlength=len(p)) for x in (second, first)], 0
        for x in rows[REPLY + sweep]:
            n = int.from_bytes(x["a"][:8], "little")
            yield row(x["source"], MOVED, part, *(pack(y[at:at + n]) for y in sums))
            at += n

    return run


def probabilities(rows, samples: dict):
    """(first, second word and probability of every pair, training counts of the words) of a
    part of pairs; ``samples``: the root by its sweep."""
    r, x = rows[PAIRS][0], rows[CELLS][0]
    first, second, c = unpack(r["b"], ascending=True), unpack(r["c"]), unpack(r["d"]).astype(np.float64)
    t = len(samples) * np.minimum(c, 1)
    t[c > 1] = unpack(x["d"]).astype(np.int64) + unpack(x["e"])
    mass = 0.0
    for sweep, root in samples.items():
        customers, t_root, tables, count = read_replies(rows[REPLY + sweep])
        mass = mass + (STRENGTH + root.discount * tables)[first] * root.of(customers, t_root)[second]
    p = (c - (root.discount * t - mass) / len(samples)) / (STRENGTH + count[first])
    return first, second, p, count


def answer(samples: dict):
    def run(part, rows):
        _, second, p, count = probabilities(rows, samples)
        p = np.log10(p)
        for r in rows[ASKED]:
            at = unpack(r["a"], ascending=True)
            yield row(r["source"], VALUE, part, pack(p[at], np.float32), pack(count[np.unique(second[at])]))

    return run


def kind(table: DataFrame, *kinds: int) -> DataFrame:
    return table.where(F.col("kind").isin(*kinds) & (F.col("to") >= 0))


def fit(table: DataFrame, parts: int, word_parts: int, burn_in: int, samples: int):
    """(tables of rows to the parts of pairs, from which ``answer`` tells the probabilities;
    the root of each sample by its sweep; numbers of training tokens and words) of blocks."""
    pairs = settle(deal([ask(table, parts)], sum_pairs, parts))
    ones, twos = (x or 0 for x in pairs.agg(F.sum("s1"), F.sum("s2")).first())
    told = settle(tell(kind(pairs, PAIRS), word_parts))
    words = settle(deal([kind(told, HAS)], first_words, word_parts))
    cells, routes, old, kept = told, words, [], {}
    for sweep in range(burn_in + samples):
        s = words.where("to < 0").agg(F.sum("s1"), F.sum("s2")).first()
        if sweep == 0:
            n, v, r1, r2 = (x or 0 for x in words.where(F.col("kind") == WORDS).agg(*(F.sum(f"s{i}") for i in (1, 2, 3, 4))).first())
            discounts = (_discount(r1, r2), _discount(ones, twos))
        root = Root(s[0] or 0, s[1] or 0, discounts, v)
        if sweep >= burn_in:
            kept[sweep] = root
        if sweep == burn_in + samples - 1:
            break
        moved = settle(deal([kind(cells, CELLS), kind(words, REPLY + sweep)], move_cells(root, sweep, sweep >= burn_in), parts))
        discard(cells)
        new = settle(deal([kind(words, WORDS), kind(routes, ROUTE), kind(moved, MOVED)], move_words(root.alpha, root.discount_root, sweep + 1), word_parts))
        old.append(words)
        cells, words = moved, new
    all_words = [*old, words]
    for x in all_words[:burn_in]:
        discard(x)
    rows = [kind(pairs, PAIRS, ASKED), kind(cells, CELLS)] + [kind(all_words[i], REPLY + i) for i in kept]
    return rows, kept, n, v, [pairs, cells, *all_words[burn_in:]]


@contextmanager
def short_lived_shuffles(spark):
    """Delete the shuffle files of a step when it has been written, not some time later."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def score(docs: DataFrame, burn_in: int, samples: int, held: int = HELD, pair_part: int = PAIR_PART, word_part: int = WORD_PART) -> DataFrame:
    """``pitman_yor.score`` of docs (doc_id, text, held_out) by the preceding word."""
    with short_lived_shuffles(docs.sparkSession):
        table = settle(blocks(docs, held))
        size, n_blocks = table.agg(F.sum("tokens"), F.count("*")).first()
        parts, word_parts = -(-(size or 0) // pair_part) or 1, -(-(size or 0) // word_part) or 1
        rows, roots, n, v, used = fit(table, parts, word_parts, burn_in, samples)
        # the keys of the words are not needed any more
        rows = [x.withColumn("a", F.when(F.col("kind") != PAIRS, F.col("a"))) for x in rows]
        values = settle(deal(rows, answer(roots), parts))
        for x in used:
            discard(x)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.select(["held_out", "size", "words", "seq"]).to_pylist()[0]
        words, seq, size = unpack(r["words"], np.uint64, True), unpack(r["seq"]), unpack(r["size"])
        _, second, bounds, place = block_pairs(words, seq, parts)
        p, c = np.zeros(len(second)), np.zeros(len(words))
        for x in right.select(["source", "a", "b"]).to_pylist():
            of = slice(bounds[x["source"]], bounds[x["source"] + 1])
            p[of] = unpack(x["a"], np.float32)
            c[np.unique(second[of])] = unpack(x["b"])
        start = np.cumsum(size.astype(np.int64)) - size
        sums = [np.add.reduceat(x, start) for x in ((c > 0).astype(np.int64)[seq], np.log10((c + 1) / (n + v + 1))[seq], p[place])]
        ids = pa.concat_arrays([x.flatten() for x in left["ids"].chunks])
        return pa.Table.from_arrays([ids, pa.array(unpack(r["held_out"], np.uint8).astype(bool)), pa.array(size.astype(np.int64)), *map(pa.array, sums)], names)

    type_ = docs.schema["doc_id"].dataType.simpleString()
    places = SPREAD * max(n_blocks, 1)
    out = table.repartition(places, "block").groupBy("block").cogroup(values.repartition(places, "to").groupBy("to")).applyInArrow(
        run, f"doc_id {type_}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
