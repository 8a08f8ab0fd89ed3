"""Periodic runs of words, by Lyndon roots from the first phase of a grouping suffix sorter.

A run is a stretch of consecutive words with smallest period q that no neighbouring word
extends.  By the runs theorem each run holds a Lyndon word of length q, its root, which is
the longest Lyndon word at its start for the order of words or for the reversed order.  The
first phase of Baier's suffix sorter refines groups of suffixes from the highest to the
lowest until each group's context is that longest Lyndon word, which gives the array for
either order directly.  Roots are extended to both sides as far as the words a period apart
agree (longest common extensions, from prefix sums of word hashes by bisection), and every
run found is compared word by word.

A run of exponent e or more repeats each of its short windows about e times.  Only
stretches of a text covered by windows that occur that often are searched: no run of the
wanted kind reaches beyond one (``window_rule``).
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ideolens.llm import words as W
from ideolens.llm.rows import pack, short_batches, unpack

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words of the longest windows that are counted.
WINDOW = 3


def window_rule(min_length: int, min_exponent: int) -> tuple[int, int]:
    """(k, c): in a run with ``min_length`` words and ``min_exponent`` periods or more, every
    window of k words occurs c times or more.

    A run of n words with period q has n - k + 1 windows, which repeat every q: each occurs
    (n - k + 1) // q times at least.  From q = k - 1 on that is min_exponent - 1 or more."""
    for k in range(WINDOW, 1, -1):
        c = min([(max(min_length, min_exponent * q) - k + 1) // q for q in range(1, k)] + [min_exponent - 1])
        if c > 1:
            return k, c
    return 1, min_exponent


def lyndon_lengths(x: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each position: phase one of Baier's sorter.

    Groups of positions start as those of equal symbols.  The highest group not yet treated
    has its final context; its positions leave, and each points to the position left before
    it.  Positions pointed to by l members take the context l times to the end of their own
    and move to a new group just above their old one, higher for larger l."""
    n = len(x)
    out = [0] * (n + 1)
    left, right = list(range(-1, n + 1)), list(range(1, n + 3))  # positions 1..n still there
    symbols = sorted(set(x))
    number = {s: g for g, s in enumerate(symbols, 1)}
    group = [0, *map(number.__getitem__, x)]
    top = len(symbols) + 1
    members: list = [[] for _ in range(top + 1)]
    for i in range(1, n + 1):
        members[group[i]].append(i)
    size = [1] * (top + 1)
    below, above = list(range(-1, top)), list(range(1, top + 2))
    g = top - 1
    while g > 0:
        context, targets, last, times = size[g], [], 0, 0
        for i in members[g]:  # in ascending order, so a member before has left already
            if group[i] != g:
                continue
            out[i] = context
            p, r = left[i], right[i]
            right[p] = r
            left[r] = p
            if p == last:
                times += 1
            else:
                if last:
                    targets.append((times, last))
                last, times = p, 1
        if last:
            targets.append((times, last))
        members[g] = ()
        if len(targets) > 1:
            targets.sort(key=_times, reverse=True)  # stable: positions stay in order
        made, l = {}, 0
        for times, p in targets:
            if times != l:
                made, l = {}, times
            old = group[p]
            new = made.get(old)
            if new is None:
                new = made[old] = len(size)
                size.append(size[old] + times * context)
                members.append([])
                up = above[old]
                above.append(up)
                below.append(old)
                below[up], above[old] = new, new
            group[p] = new
            members[new].append(p)
        g = below[g]
    return out[1:]


def _times(target):
    return target[0]


class Extensions:
    """Longest common extensions of positions of ``x``, in segments none of which reaches into
    another: sums of word hashes times powers of an odd number, in 64 bits."""

    def __init__(self, x: np.ndarray, first: np.ndarray, end: np.ndarray, seed: int = 71):
        self.first, self.end = first, end  # of the segment of each position
        base = W._stream(seed, 1)[0] | np.uint64(1)
        self.power = np.full(len(x) + 1, base, np.uint64)
        self.power[0] = 1
        self.power = np.multiply.accumulate(self.power)
        value = W.mix(x.astype(np.uint64) + np.uint64(seed))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * self.power[:-1], dtype=np.uint64)))

    def _grow(self, i: np.ndarray, q: np.ndarray, most: np.ndarray, ahead: bool) -> np.ndarray:
        got = np.zeros(len(i), np.int64)
        factor = self.power[q]
        step = 1 << int(max(most.max(initial=0), 1)).bit_length() - 1
        while step:
            fits = np.flatnonzero(got + step <= most)
            a = i[fits] + got[fits] if ahead else i[fits] - got[fits] - step
            d = q[fits]
            same = (self.sums[a + step] - self.sums[a]) * factor[fits] == self.sums[a + d + step] - self.sums[a + d]
            got[fits[same]] += step
            step >>= 1
        return got

    def around(self, i: np.ndarray, q: np.ndarray):
        """How far the words q apart agree from position i on, and before it."""
        return (self._grow(i, q, self.end[i] - i - q, True), self._grow(i, q, i - self.first[i], False))


def _exact(x: np.ndarray, first: int, end: int, i: int, q: int) -> tuple[int, int]:
    """Start and end of the stretch around i whose words q apart agree, word by word."""
    unlike = np.flatnonzero(x[first:end - q] != x[first + q:end]) + first
    k = int(np.searchsorted(unlike, i))
    return (int(unlike[k - 1]) + 1 if k else first), (int(unlike[k]) + q if k < len(unlike) else end)


def runs_of(x: np.ndarray, first: np.ndarray, end: np.ndarray, min_length: int, min_exponent: int):
    """(start, length, period) of the runs in the segments of ``x``: numbers from 1 up, with 0
    between segments; ``first`` and ``end`` give the segment of each position."""
    found = []
    extend = Extensions(x, first, end)
    for order in (x, np.where(x > 0, x.max(initial=0) + 1 - x, 0)):
        q = np.array(lyndon_lengths(order.tolist()), np.int64)
        i = np.flatnonzero((x > 0) & (q * min_exponent <= end - first))
        q = q[i]
        ahead, before = extend.around(i, q)
        length = before + q + ahead
        some = (length >= min_length) & (length >= min_exponent * q)
        found.append(np.stack((i[some] - before[some], i[some] + q[some] + ahead[some], q[some], i[some]), 1))
    found = np.concatenate(found)
    if not len(found):
        return found[:, :3]
    # sums may agree where words differ, never the other way: compare the words
    triples, back = np.unique(found[:, :3], axis=0, return_inverse=True)
    right = np.array([np.array_equal(x[s:e - q], x[s + q:e]) for s, e, q in triples.tolist()], bool)
    good = triples[right]
    if not right.all():
        again = []
        for _, _, q, i in found[~right[back.reshape(-1)]].tolist():
            s, e = _exact(x, int(first[i]), int(end[i]), i, q)
            if e - s >= min_length and e - s >= min_exponent * q:
                again.append((s, e, q))
        good = np.unique(np.concatenate((good, np.array(again, np.int64).reshape(-1, 3))), axis=0)
    return np.stack((good[:, 0], good[:, 1] - good[:, 0], good[:, 2]), 1)


def _stretches(key: np.ndarray, text: np.ndarray, min_length: int, min_exponent: int):
    """Starts and ends (word numbers of the piece) of the stretches that may hold a run."""
    k, c = window_rule(min_length, min_exponent)
    m = len(key) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = np.flatnonzero(text[:m] == text[k - 1:])
    gram = W.hash_ngrams(key, k, 5)[whole] + W.mix(text[whole].astype(np.uint64))
    order = np.argsort(gram, kind="stable")
    sorted_gram = gram[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(m, len(gram), 1), bool), sorted_gram[1:] != sorted_gram[:-1])))
    often = np.repeat(np.diff(np.concatenate((new, [len(gram)]))) >= c, np.diff(np.concatenate((new, [len(gram)]))))
    at = whole[order[often]]
    cover = np.zeros(len(key) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    inside = np.concatenate(([False], np.cumsum(cover)[:-1] > 0, [False]))
    edge = np.ones(len(key) + 1, bool)
    edge[1:-1] = text[1:] != text[:-1]
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge)) if len(key) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    long = ends - starts >= min_length
    return starts[long], ends[long]


def _piece_runs(key: np.ndarray, text: np.ndarray, min_length: int, min_exponent: int):
    """(start, length, period) of the runs among the words of a piece, in order."""
    starts, ends = _stretches(key, text, min_length, min_exponent)
    if not len(starts):
        return np.zeros((0, 3), np.int64)
    size = ends - starts
    to = np.cumsum(size + 1)  # a zero follows each stretch
    base = to - size - 1
    x = np.zeros(int(to[-1]), np.int64)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    place = within + np.repeat(base, size)
    x[place] = np.unique(key[within + np.repeat(starts, size)], return_inverse=True)[1].reshape(-1) + 1
    first, end = np.repeat(base, size + 1), np.repeat(to - 1, size + 1)
    found = runs_of(x, first, end, min_length, min_exponent)
    of = np.searchsorted(base, found[:, 0], side="right") - 1
    found[:, 0] += starts[of] - base[of]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


RUN = "struct<start: bigint, length: bigint, period: bigint>"


def measure(texts: pa.Array, min_length: int, min_exponent: int) -> pa.Array:
    """n_words, runs and collapsed for each text."""
    out = []
    for at, end, data, bounds in W.pieces(texts):
        n = end - at
        starts, ends, text = W.spans(data, bounds, W.NOT_SPACE)
        key = W.hash_spans(data, starts, ends, 61)
        found = _piece_runs(key, text, min_length, min_exponent)
        upto = W.per_text(text, n)
        of = text[found[:, 0]]
        drop = np.zeros(len(key) + 1, np.int64)
        np.add.at(drop, found[:, 0] + found[:, 2], 1)
        np.add.at(drop, found[:, 0] + found[:, 1], -1)
        keep = np.flatnonzero(np.cumsum(drop)[:-1] == 0)
        final = np.zeros(len(keep), bool)  # the last word kept of its text
        final[:-1] = text[keep[1:]] != text[keep[:-1]]
        final[-1:] = True
        mark = np.zeros(len(data) + 1, np.int8)
        mark[starts[keep]] = 1
        mark[ends[keep]] -= 1
        shown = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
        blank = ends[keep[~final]]
        joined = data.copy()
        joined[blank], shown[blank] = 0x20, True
        sizes = np.concatenate(([0], np.cumsum(shown)))[bounds]
        kept = pa.LargeStringArray.from_buffers(n, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(joined[shown])))
        run = pa.StructArray.from_arrays([pa.array(found[:, 0] - upto[of]), pa.array(found[:, 1]), pa.array(found[:, 2])], ["start", "length", "period"])
        out.append(pa.StructArray.from_arrays(
            [pa.array(np.diff(upto)), W.lists(W.per_text(of, n), run), kept.cast(pa.string())], ["n_words", "runs", "collapsed"]))
    return pa.concat_arrays(out) if out else pa.array([], KIND)


KIND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))), ("collapsed", pa.string())])


def find_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """All columns of ``docs`` (text, ...) and, over the words ``[^\\x20\\x09-\\x0D]+`` of the
    text: n_words; runs, the runs of at least ``min_length`` words and ``min_exponent`` (2 or
    more) periods as (start word, length, period), by start and period; and collapsed, the
    words that no run holds after its first period, joined by one blank.

    Null, empty and blank texts have no words, no runs and an empty collapsed text; repeated
    rows are treated alike; an empty table gives an empty result; columns named like the new
    ones are replaced.  Words are told apart by 64-bit hashes.  One text is held whole by its
    task; the sorter's lists hold only stretches in which windows repeat."""
    if min_exponent < 2 or min_length < 1:
        raise ValueError("a run has two periods or more")
    short_batches(docs)
    spec = f"struct<n_words: bigint, runs: array<{RUN}>, collapsed: string>"
    rows = pack(docs, F.col("text").cast("string").alias("t"))
    out = rows.select("row", F.arrow_udf(lambda texts: measure(texts, min_length, min_exponent), spec)("t").alias("m"))
    return unpack(out, docs, **{c: F.col(f"m.{c}") for c in ("n_words", "runs", "collapsed")})
