"""Hierarchical Pitman-Yor language model, sampled by Gibbs seating.

``score`` has a restaurant for every preceding word, by the module ``context_restaurants``.
The form with few contexts, which its callers may ask for by their number, is here: a
token is drawn in the restaurant of its context, the nearest common word before it in the
text (one of the most frequent training words); before the first common word it is
drawn in the root.  All context restaurants share the root as their parent, whose base is
uniform over the V training words and one class of unknown words.  A table of a context
restaurant is a customer of the root.

Given the totals of the restaurants, words are seated independently of each other, so the
state of a word holds its customers and tables in every restaurant, and a sweep is one pass
of Spark over chunks of words; totals are summed between the sweeps.  A sweep seats all
customers of a word in a restaurant again, in one exact draw: of a seating of c customers at
t tables the weight is alpha^t S(c, t), S the generalised Stirling numbers and alpha (strength
+ discount x tables of the restaurant) x the parent's probability, and probabilities need no
more of a seating than its number of tables.  Predictive probabilities are averaged over
the samples after the burn-in.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ideolens.llm import token_sums as T
from ideolens.llm import words as W
from ideolens.llm.rows import discard, settle, short_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Of the form with few contexts: the number of the context is the last four bits of a pair's
#: key, the other 60 are the hash of the word.
MOST_CONTEXTS = 15
BURN_IN, SAMPLES = 1, 3
STRENGTH = 1.0
#: Tokens that a counting task holds before it counts them; words in a chunk of the state.
HELD, CHUNK = 2 << 20, 8192
#: Up to so many customers numbers of tables are drawn from their listed probabilities; the
#: others by rejection, with so many proposals of a cell at once at most.
LISTED, AT_ONCE = 64, 32
WORD_BITS = ~np.uint64(15)
END_KEY = W.mix(np.array([0xE0D], np.uint64))[0] & WORD_BITS


def tokens(data: np.ndarray, bounds: np.ndarray):
    """(text index, key) of the words of each text, A-Z in lower case, followed by its end."""
    low = W.LOWER[data]
    starts, ends, text = W.spans(low, bounds, W.NOT_SPACE)
    n = len(bounds) - 1
    last = np.cumsum(np.bincount(text, minlength=n) + 1) - 1
    key = np.full(len(text) + n, END_KEY, np.uint64)
    owner = np.empty(len(key), np.int64)
    owner[last] = np.arange(n)
    at = np.arange(len(text)) + text
    key[at] = W.hash_spans(low, starts, ends, 61) & WORD_BITS
    owner[at] = text
    return owner, key


def in_context(common: np.ndarray):
    """Tokens function that gives (text index, key of the word in its context: the number of
    the context, 0 for the root, in the last bits); ``common``: sorted keys of common words."""
    def run(data, bounds):
        owner, key = tokens(data, bounds)
        if not len(common):
            return owner, key
        at = np.minimum(np.searchsorted(common, key), len(common) - 1)
        number = np.where(common[at] == key, at + 1, 0)
        last = np.maximum.accumulate(np.where(number > 0, np.arange(len(key)), -1))
        before = np.concatenate(([-1], last[:-1]))
        same = (before >= 0) & (owner[before] == owner)
        return owner, key | np.where(same, number[before], 0).astype(np.uint64)

    return run


def _counts(docs: DataFrame, of) -> DataFrame:
    """(key, c): keys of the tokens of docs (text, held_out) and how often training rows hold
    them, counted over HELD tokens at a time; keys that only other rows hold have c = 0."""
    def run(batches):
        held, n = ([], []), 0

        def counted():
            known, c = np.unique(np.concatenate([*held[1], np.zeros(0, np.uint64)]), return_counts=True)
            other = np.setdiff1d(np.concatenate([*held[0], np.zeros(0, np.uint64)]), known)
            return pa.RecordBatch.from_arrays([W.signed(np.concatenate((known, other))),
                                               pa.array(np.concatenate((c, np.zeros(len(other), np.int64))))], ["key", "c"])

        for batch in batches:
            learn = ~np.array(batch.column(1)).astype(bool)
            for at, end, data, bounds in W.pieces(batch.column(0)):
                owner, key = of(data, bounds)
                train = learn[at:end][owner]
                held[1].append(key[train])
                held[0].append(key[~train])
                n += len(key)
                if n > HELD:
                    yield counted()
                    held, n = ([], []), 0
        if n:
            yield counted()

    return docs.select("text", "held_out").mapInArrow(run, "key long, c long")


def common_words(docs: DataFrame, n: int) -> np.ndarray:
    """Sorted keys of the n most frequent words of the training rows."""
    top = (_counts(docs, tokens).where("c > 0").groupBy("key").agg(F.sum("c").alias("c"))
           .where(F.col("key") != int(END_KEY.view(np.int64))).orderBy(F.desc("c"), "key").limit(n).collect())
    return np.sort(np.array([r["key"] for r in top], np.int64).view(np.uint64))


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on key and salt alone, so a lost task repeats them."""
    with np.errstate(over="ignore"):
        x = W.mix(key + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15))
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


def seat(key, tables, sizes, weight, discount, base, change, steps, salt):
    """Gibbs steps over dishes.  Dish i has tables[i] tables, their sizes one after the other
    in ``sizes``; a new table has weight[i] x base[i] against (size - discount) of the others.
The chain of single customers, whose stationary distribution draw_tables draws from at once.
    First ``change`` customers come (or go, if negative), then ``steps`` random customers, one
    at a time, are seated again.  Returns the new tables and sizes."""
    n = len(tables)
    growth = np.maximum(change, 0) + np.where(tables > 0, steps, 0)
    room = tables + growth
    start = np.concatenate(([0], np.cumsum(room)))
    owner = np.repeat(np.arange(n), room)
    table = np.zeros(start[-1], np.int64)
    first = np.cumsum(tables) - tables
    table[np.arange(int(tables.sum())) - np.repeat(first, tables) + np.repeat(start[:-1], tables)] = sizes
    free = start[:-1] + tables
    total = np.bincount(owner, table, minlength=n).astype(np.int64)
    taken = np.bincount(owner, table > 0, minlength=n).astype(np.int64)
    change = change.copy()

    def leave(some, draw):
        upto = np.cumsum(table)
        before = upto[start[some]] - table[start[some]]
        at = np.searchsorted(upto, before + np.floor(uniform(key[some], draw) * total[some]).astype(np.int64), side="right")
        table[at] -= 1
        total[some] -= 1
        taken[some[table[at] == 0]] -= 1

    def come(some, draw):
        old_mass = np.where(taken[some] > 0, total[some] - discount * taken[some], 0.0)
        new_mass = weight[some] * base[some]
        make = (taken[some] == 0) | (uniform(key[some], draw) * (old_mass + new_mass) >= old_mass)
        old = some[~make]
        if len(old):
            own = np.where(table > 0, table - discount, 0.0)
            upto = np.cumsum(own)
            low = upto[start[old]] - own[start[old]]
            at = np.searchsorted(upto, low + uniform(key[old], draw + 1) * (upto[start[old + 1] - 1] - low), side="right")
            at = np.clip(at, start[old], start[old + 1] - 1)
            for i in np.flatnonzero(table[at] == 0):  # by rounding at an end of the range: the largest table
                at[i] = start[old[i]] + np.argmax(table[start[old[i]]:start[old[i] + 1]])
            table[at] += 1
        fresh = some[make]
        table[free[fresh]] += 1
        free[fresh] += 1
        taken[fresh] += 1
        total[some] += 1

    draw = salt << 20
    while (change != 0).any():
        leave(np.flatnonzero(change < 0), draw)
        come(np.flatnonzero(change > 0), draw + 1)
        change -= np.sign(change)
        draw += 3
    some = np.flatnonzero((total > 1) & (tables > 0))
    for _ in range(steps if len(some) else 0):
        leave(some, draw)
        come(some, draw + 1)
        draw += 3
    kept = table > 0
    return np.bincount(owner[kept], minlength=n), table[kept]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers."""
    y = x + 8
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * y * y)) / (y * y)) / (y * y)) / y
    below = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - below


def log_stirling(most: int, discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) of up to ``most`` customers."""
    s = np.full((most + 1, most + 2), -np.inf)
    s[1, 1] = 0
    t = np.arange(1, most + 1)
    for c in range(1, most):
        s[c + 1, 1:-1] = np.logaddexp(s[c, :-2], np.log(np.maximum(c - discount * t, 1e-300)) + s[c, 1:-1])
    return s


def draw_tables(key, customers, alpha, discount: float, salt: int):
    """Numbers of tables of cells whose customers are all seated again: exact draws of t with
    probability proportional to alpha^t S(customers, t).

    Cells of more than LISTED customers are drawn by rejection.  In a Pitman-Yor restaurant of
    strength phi - discount, t has weight S(c, t) x Gamma(phi / discount + t - 1) discount^t, so
    a proposal from it counts in proportion to (alpha / discount)^t / Gamma(phi / discount + t - 1),
    which has its maximum where the next factor falls below one.  Any phi is right; the one
    that accepts most is taken from a grid.  The time of a proposal grows with the tables."""
    tables = np.minimum(customers, 1)
    stirling = log_stirling(LISTED, discount)
    listed = np.flatnonzero((customers > 1) & (customers <= LISTED))
    listed = listed[np.argsort(customers[listed], kind="stable")]
    of, at = np.unique(customers[listed], return_index=True)
    for c, some in zip(of.tolist(), np.split(listed, at[1:])):
        log_p = np.log(alpha[some])[:, None] * np.arange(1, c + 1) + stirling[c, 1:c + 1]
        upto = np.cumsum(np.exp(log_p - log_p.max(axis=1, keepdims=True)), axis=1)
        tables[some] = 1 + (upto[:, :-1] <= uniform(key[some], salt << 40)[:, None] * upto[:, -1:]).sum(axis=1)

    open_ = np.flatnonzero(customers > LISTED)
    c, a = customers[open_].astype(float), alpha[open_]
    phi, peak, best = np.ones(len(open_)), np.ones(len(open_)), np.full(len(open_), -np.inf)
    width = np.log(1e3 * (a + 1) / np.minimum(a, 1))
    middle = np.log(1e-3 * np.minimum(a, 1)) + width / 2
    for points in (32, *[8] * 6):  # each time around the best so far
        for f in np.linspace(-0.5, 0.5, points + 1):
            x = np.exp(middle + f * width)
            k = np.clip(np.floor((a - x) / discount + 1) + 1, 1, c)
            rate = (log_gamma(x - discount + 1) - log_gamma(x - discount + c) - log_gamma(x / discount)
                    + log_gamma(x / discount + k - 1) - k * np.log(a / discount))
            more = rate > best
            phi, peak, best = np.where(more, x, phi), np.where(more, k, peak), np.where(more, rate, best)
        middle, width = np.log(phi), 2 * width / points
    first = (1 - peak) * np.log(a / discount) - log_gamma(phi / discount) + log_gamma(phi / discount + peak - 1)
    todo, tried, copies = np.arange(len(open_)), 0, 1
    while len(todo):
        found = np.zeros(len(todo) * copies)
        on = np.arange(len(found))
        cell = np.repeat(todo, copies)
        own = W.mix(key[open_[cell]] + np.tile(np.arange(tried, tried + copies, dtype=np.uint64), len(todo)) * np.uint64(0xD6E8FEB86659FD93))
        weight, k, seated = first[cell], np.ones(len(cell)), np.ones(len(cell))
        least, draw = np.log(1 - uniform(own, (salt << 40) + 1)), (salt << 40) + 2
        p, top, n, log_g = phi[cell], peak[cell], c[cell], np.log(a[cell] / discount)
        while len(on):
            # the next customer that may open a table, at a rate no smaller than the true one
            rate, left = p + discount * (k - 1), seated - discount * k
            power = np.maximum(rate, 1.0)
            seated = seated + np.floor(np.minimum(left * np.expm1(np.minimum(-np.log(1 - uniform(own, draw)) / power, 700.0)), n))
            left = seated - discount * k
            opens = (seated < n) & (uniform(own, draw + 1) * -np.expm1(-power * np.log1p(1 / left)) < rate / (left + rate))
            weight = weight + np.where(opens, log_g - np.log(p / discount + k - 1), 0.0)
            k, seated, draw = k + opens, seated + 1, draw + 2
            whole = (seated >= n)
            fits = whole & (weight >= least)
            found[on[fits]] = k[fits]
            go = ~whole & ((k <= top) | (weight >= least))
            if not go.all():
                on, own, weight, k, seated, least, p, top, n, log_g = (x[go] for x in (on, own, weight, k, seated, least, p, top, n, log_g))
        found = found.reshape(len(todo), copies)
        some = found.max(axis=1) > 0
        tables[open_[todo[some]]] = found[some, np.argmax(found[some] > 0, axis=1)].astype(np.int64)
        todo, tried, copies = todo[~some], tried + copies, min(2 * copies, AT_ONCE)
    return tables


class Totals:
    """Customers and tables of all restaurants (0: the root), parameters and vocabulary."""

    def __init__(self, customers, tables, discounts, v):
        self.customers, self.tables = np.array(customers, float), np.array(tables, float)
        self.discount_root, self.discount = discounts
        self.base = 1.0 / (v + 1)
        d = np.full(len(self.tables), self.discount)
        d[0] = self.discount_root
        self.weight = STRENGTH + d * self.tables

    def root(self, customers, tables):
        """Probability in the root of words with so many customers and tables there."""
        return (customers - self.discount_root * tables + self.weight[0] * self.base) / (STRENGTH + self.customers[0])

    def context(self, context, customers, tables, root):
        return (customers - self.discount * tables + self.weight[context] * root) / (STRENGTH + self.customers[context])


# The state is kept as rows of up to CHUNK words, each column the packed numbers (of 8 bytes)
# of all of them: by word its key, the number of its pairs (contexts in which documents hold
# it) and its tables in the root; by pair the context, customers c (of the root itself for
# context 0), tables t (none for context 0) and the sum p of sampled probabilities.
COLUMNS = ("key", "pairs", "t_root", "context", "c", "t", "p")
KINDS = {"key": np.uint64, "p": np.float64}
STATE = "busy boolean, " + ", ".join(f"{x} binary" for x in COLUMNS)


def _pack(busy: bool, *numbers) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([busy]), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in numbers)],
                                      ["busy", *COLUMNS])


def _unpack(batches):
    """The columns of every chunk of a state."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield [np.frombuffer(batch.column(k + 1)[i].as_buffer(), KINDS.get(x, np.int64)) for k, x in enumerate(COLUMNS)]


def _first_state(counts: DataFrame) -> DataFrame:
    """All customers of a word in a restaurant at one table; from (key, c), whose rows are
    brought together by word and summed.  Words with at most one training customer have only
    one seating; they are in chunks of their own (not busy), which sweeps leave out."""
    def chunk(keys, n):
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        c, pair = np.add.reduceat(n, first), keys[first]
        key, start, pairs = np.unique(pair & WORD_BITS, return_index=True, return_counts=True)
        context = (pair & ~WORD_BITS).astype(np.int64)
        t = ((c > 0) & (context > 0)).astype(np.int64)
        root = np.add.reduceat(np.where(context == 0, c, t), start)
        busy = np.add.reduceat(c, start) > 1
        for flag in (False, True):
            of = np.flatnonzero(busy == flag)
            for i in range(0, len(of), CHUNK):
                x = of[i:i + CHUNK]
                at = np.arange(int(pairs[x].sum())) - np.repeat(np.cumsum(pairs[x]) - pairs[x], pairs[x]) + np.repeat(start[x], pairs[x])
                yield _pack(flag, key[x], pairs[x], (root[x] > 0).astype(np.int64), context[at], c[at], t[at], np.zeros(len(at)))

    def run(batches):
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate((keys, np.array(batch.column(0), np.int64).view(np.uint64)))
            n = np.concatenate((n, np.array(batch.column(1), np.int64)))
            if len(keys) > 32 * CHUNK:  # the last word may go on
                upto = int(np.argmax((keys & WORD_BITS) == (keys[-1] & WORD_BITS)))
                if upto:
                    yield from chunk(keys[:upto], n[:upto])
                    keys, n = keys[upto:], n[upto:]
        if len(keys):
            yield from chunk(keys, n)

    word = F.col("key").bitwiseAND(-16)
    return counts.repartition(word).sortWithinPartitions("key").mapInArrow(run, STATE)


def _sum_state(state: DataFrame, width: int):
    """Customers and tables of all restaurants, training words, and how many words have one
    and two customers, in the root and in contexts."""
    def run(batches):
        total = np.zeros(2 * width + 5, np.int64)
        for _, pairs, t_root, context, c, t, _ in _unpack(batches):
            word = np.repeat(np.arange(len(pairs)), pairs)
            root = np.bincount(word, np.where(context == 0, c, t), minlength=len(pairs))
            tables = np.bincount(context, t, minlength=width)
            tables[0] = t_root.sum()
            total += np.concatenate((np.bincount(context, c, minlength=width), tables, [(np.bincount(word, c, minlength=len(pairs)) > 0).sum()],
                                     [(root == i).sum() for i in (1, 2)], [(c[context > 0] == i).sum() for i in (1, 2)])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in total], names)

    names = [f"s{i}" for i in range(2 * width + 5)]
    r = state.mapInArrow(run, ", ".join(f"{x} long" for x in names)).agg(*(F.sum(x).alias(x) for x in names)).first()
    return np.array([r[x] or 0 for x in names])


def _probabilities(totals: Totals, word, t_root, context, c, t):
    """Of every pair, and of every word in the root."""
    customers = np.bincount(word, np.where(context == 0, c, t), minlength=len(t_root))
    root = totals.root(customers, t_root)
    return np.where(context == 0, root[word], totals.context(context, c, t, root[word])), root


def _sweep(state: DataFrame, totals: Totals, sweep: int, sample: bool, move: bool) -> DataFrame:
    """With ``sample``, add up the probabilities of every pair, given the seating that totals
    were summed from; with ``move``, seat the customers again."""
    def run(batches):
        for key, pairs, t_root, context, c, t, p in _unpack(batches):
            n = len(key)
            word = np.repeat(np.arange(n), pairs)
            each, root = _probabilities(totals, word, t_root, context, c, t)
            if sample:
                p = p + each
            if move:
                some = np.flatnonzero(t > 0)
                t = t.copy()
                t[some] = draw_tables(W.mix(key[word[some]] | context[some].astype(np.uint64)), c[some],
                                      totals.weight[context[some]] * root[word[some]], totals.discount, 2 * sweep + 1)
                now = np.bincount(word, np.where(context == 0, c, t), minlength=n).astype(np.int64)
                t_root = draw_tables(W.mix(key), now, np.full(n, totals.weight[0] * totals.base), totals.discount_root, 2 * sweep + 2)
            yield _pack(True, key, pairs, t_root, context, c, t, p)

    return state.mapInArrow(run, STATE)


def _discount(ones, twos) -> float:
    return min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones and twos else 0.5


def fit(counts: DataFrame, width: int, burn_in: int = BURN_IN, samples: int = SAMPLES):
    """(key, model, c, weight) per word and context in which it is asked for, from counts
    (key, c): model is log10 of the averaged probability, c the training count of the word,
    weight that of the word in the context.  Also the numbers of training tokens and words."""
    state = settle(_first_state(counts))
    idle, busy = state.where("not busy"), state.where("busy")
    fixed = _sum_state(idle, width)
    sampled, discounts = [], None
    for sweep in range(burn_in + samples):
        total = fixed + _sum_state(busy, width)
        customers, tables, (v, r1, r2, c1, c2) = total[:width].copy(), total[width:2 * width], total[2 * width:]
        if discounts is None:
            n, discounts = int(customers.sum()), (_discount(r1, r2), _discount(c1, c2))
        customers[0] += tables[1:].sum()
        totals = Totals(customers, tables, discounts, v)
        if sweep >= burn_in:
            sampled.append(totals)
        new = settle(_sweep(busy, totals, sweep, sweep >= burn_in, sweep < burn_in + samples - 1))
        discard(busy)
        busy = new

    def pairs(batches):
        for key, pairs, t_root, context, c, t, p in _unpack(batches):
            word = np.repeat(np.arange(len(key)), pairs)
            if not p.any():
                p = sum(_probabilities(totals, word, t_root, context, c, t)[0] for totals in sampled)
            yield pa.RecordBatch.from_arrays(
                [W.signed(key[word] | context.astype(np.uint64)), pa.array(np.log10(p / samples)),
                 pa.array(np.bincount(word, c, minlength=len(key)).astype(np.int64)[word]), pa.array(c)], ["key", "model", "c", "weight"])

    return idle.unionByName(busy).mapInArrow(pairs, "key long, model double, c long, weight long"), n, int(v)


def held_out(fold: int = 7, of: int = 2):
    """True for the ids that the model must not learn from; a null id is learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold)) == of, F.lit(False))


def score(docs: DataFrame, contexts: int | None = None, limit: int = T.FREQUENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (add-one unigram) and score (log10 probability of the text under the model).

    Every preceding word is a context (``context_restaurants``).  With ``contexts``, only so
    many most frequent words are, MOST_CONTEXTS at most, and ``limit`` bounds the rows that all tasks hold
    of the model.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case, and the end of the text.
    Rows that are held out are not learnt from.  Null and empty texts have the end as their
    only token; repeated rows count and score as documents of their own; very long texts are
    read whole; an empty table gives an empty result."""
    base = docs.select("doc_id", "text").withColumn("held_out", held_out())
    short_batches(docs)
    if contexts is None:
        from ideolens.llm import context_restaurants

        return context_restaurants.score(base, BURN_IN, SAMPLES)
    common = common_words(base, min(contexts, MOST_CONTEXTS))
    of = in_context(common)
    model, n, v = fit(_counts(base, of), len(common) + 1)
    base_log = lambda c: np.log10((c + 1) / (n + v + 1))
    c = F.col("c")
    table = settle(model)
    sums = T.document_sums(
        base, of, "held_out", table, weight="weight", limit=limit, columns={"c": "int32", "model": "float32"},
        local=lambda c, model: [base_log(c.astype(np.float64)), model, c > 0],
        values={"base": F.log10((c + 1) / F.lit(float(n + v + 1))), "model": F.col("model"), "known": (c > 0).cast("double")})
    return sums.select("doc_id", F.col("flag").alias("held_out"), F.col("size").alias("n_tokens"),
                       F.col("known").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                       F.col("base").alias("base_score"), F.col("model").alias("score"))
