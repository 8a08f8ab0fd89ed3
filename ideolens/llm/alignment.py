"""Cross-tokenizer alignment of a byte-level BPE (A) and a piece BPE with byte fallback (B).

Both token sequences cover the bytes of a blank and the text.  Their shared cuts (byte
offsets at which a token of each ends) are found by divide and conquer: in an interval
between two shared cuts, the common end nearest behind its middle token, or else before it,
is located by bisection that leaps from one sequence to the other; both sides of it are
intervals again, and an interval without an inner cut is a group.  All intervals of a batch
are divided at once, level by level.

A link is a pair of token occurrences whose byte ranges overlap.  A pair of ids counts the
documents that hold it linked, summed by the tasks first and by the shuffle then; the second
pass looks the counts up as ``token_sums`` does: the pairs in most documents are sent to all
tasks, the others are joined by key.

Texts are tokenised in chunks cut before a blank that follows no blank, when the
vocabularies allow no token across such a place (else whole); each chunk is encoded once
while it is remembered.
"""

from __future__ import annotations

import functools
import json
import os
import sys

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ideolens.llm import vocabularies as V
from ideolens.llm import words as W
from ideolens.llm.byte_bpe import encode_text
from ideolens.llm.rows import pack, settle, short_batches, unpack
from ideolens.llm.token_sums import distinct, runs, split_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Chunks whose tokens a task remembers.
REMEMBERED = 1 << 19
#: Pairs that a task gathers before it hands their counts on.
GATHERED = 1 << 20
#: First character beyond the Latin blocks, whose classes no version of Unicode has changed,
#: and the largest first byte of a character before it.
LATIN_END, LATIN_BYTE = "\u0250", 0xC9
#: Bytes that are no blank or part of a character above ASCII.
INK = W.byte_class((0x20, 0x20), (0x09, 0x0D), (0x1C, 0x1F))
#: Pair keys are id of A * SHIFT + id of B.
SHIFT = 1 << 24


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters for themselves, the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A: encodes texts as they are; ``token[id]`` are its bytes."""

    def __init__(self, data: bytes):
        # one thread for each task: Spark gives a task one core
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = tokenizers.Tokenizer.from_str(data.decode())
        self.model.encode_special_tokens = True
        alphabet = byte_alphabet()
        size = self.model.get_vocab_size(with_added_tokens=True)
        self.token = [b""] * size
        for text, i in self.model.get_vocab(with_added_tokens=False).items():
            self.token[i] = bytes(alphabet[c] for c in text)
        kind = json.loads(data)
        before, model = kind.get("pre_tokenizer") or {}, kind["model"]
        self.cuts_at_blanks = (before.get("type") == "ByteLevel" and before.get("use_regex", True)
                               and not before.get("add_prefix_space") and not kind.get("normalizer"))
        # merges that make their tokens in the order of ids are a table of ranks, which the
        # faster library takes; both libraries split Latin text alike, whatever their Unicode
        vocab, merges = model.get("vocab", {}), [x.split(" ") if isinstance(x, str) else x for x in model.get("merges", [])]
        made = [vocab.get(a + b, -1) for a, b in merges]
        plain = not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
        self.ranked = None
        if self.cuts_at_blanks and plain and made == sorted(set(made)) and len(made) + 256 == len(vocab) and min(made, default=256) >= 256:
            self.ranked = tiktoken.Encoding("ranked", pat_str=V.PATTERN, special_tokens={},
                                            mergeable_ranks={self.token[i]: i for i in vocab.values()})

    def encode(self, text: str) -> list[int]:
        if self.ranked is not None and max(text) < LATIN_END:
            return encode_text(self.ranked, text).tolist()
        return self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids


class Pieces:
    """B: puts a blank before a text itself."""

    def __init__(self, data: bytes):
        self.model = m = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.token = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts_at_blanks = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, text: str) -> list[int]:
        return self.model.encode([text[1:]], num_threads=1)[0]


class Flat:
    """Remembered lists of numbers in one array; list k is values[at[k]:at[k + 1]]."""

    def __init__(self, kind):
        self.values, self.at = np.zeros(0, kind), np.zeros(1, np.int64)

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values = np.concatenate((self.values, values))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(sizes)))

    def take(self, which: np.ndarray):
        """The lists ``which`` joined, and the length of each."""
        size = self.at[which + 1] - self.at[which]
        last = np.cumsum(size)
        shift = np.repeat(self.at[which] - last + size, size)
        return self.values[np.arange(len(shift)) + shift], size


def with_blank(data: np.ndarray, bounds: np.ndarray):
    """The bytes and bounds with a blank before every text that is not empty."""
    some = bounds[1:] > bounds[:-1]
    out = np.insert(data, bounds[:-1][some], 0x20)
    return out, bounds + np.concatenate(([0], np.cumsum(some)))


def chunk_starts(data: np.ndarray, bounds: np.ndarray, cut: bool) -> np.ndarray:
    """Starts of the chunks: the texts' own, and (``cut``) blanks behind a character that is
    none and before the text's last byte.  Some characters of three bytes or after U+007F are
    passed over with the blanks among them; a place less does not change the tokens."""
    own = bounds[:-1][bounds[1:] > bounds[:-1]]
    if not cut or len(data) < 3:
        return own
    at = np.flatnonzero(data[1:-1] == 0x20) + 1
    one = data[at - 1]
    two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    odd = (one >= 0x80) & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3) & np.isin(two, (0x80, 0x81, 0x9A, 0xA0))))
    at = at[INK[one] & ~odd]
    inner = np.zeros(len(data) + 1, bool)
    inner[at] = True
    inner[bounds] = False
    inner[bounds[1:][own.searchsorted(bounds[1:]) > 0] - 1] = False  # last bytes
    inner[own] = True
    return np.flatnonzero(inner[:-1])


class Aligner:
    """Tokens and links of many texts; a chunk is encoded once while it is remembered.  Chunks
    are told apart by 64-bit hashes and their lengths."""

    def __init__(self, a: ByteLevel, b: Pieces, remembered: int = REMEMBERED):
        self.a, self.b, self.remembered = a, b, remembered
        self.cut = a.cuts_at_blanks and b.cuts_at_blanks
        self.length_a = np.array([len(x) for x in a.token], np.int64)
        self.length_b = np.array([len(x) for x in b.token], np.int64)
        self.digits = digits(max(len(a.token), len(b.token)))
        self.forget()

    def forget(self) -> None:
        self.key, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted
        self.ids_a, self.ids_b, self.pairs, self.same = Flat(np.int32), Flat(np.int32), Flat(np.uint64), np.zeros(0, bool)

    def _encode(self, chunks: list[bytes]):
        """(ids, number of them in each chunk) of A and of B, and whether both vocabularies
        give a chunk's bytes back; a chunk of which they do not has no ids.  Chunks are
        encoded together; those that disturb are found by halving."""
        raw = b"".join(chunks)
        ends = np.cumsum([len(c) for c in chunks])
        parts = []
        for model, length in ((self.a, self.length_a), (self.b, self.length_b)):
            ids = np.array(model.encode(raw.decode()), np.int32)
            upto = np.cumsum(length[ids])
            at = np.searchsorted(upto, ends)
            whole = len(ids) and upto[-1] == len(raw) and np.array_equal(upto[np.minimum(at, len(upto) - 1)], ends)
            if not whole or b"".join(map(model.token.__getitem__, ids.tolist())) != raw:
                break
            parts.append((ids, np.diff(at, prepend=-1)))
        if len(parts) == 2:
            return *parts, np.ones(len(chunks), bool)
        if len(chunks) == 1:
            none = np.zeros(0, np.int32), np.zeros(1, np.int64)
            return none, none, np.zeros(1, bool)
        half = len(chunks) // 2
        return self._joined(self._encode(chunks[:half]), self._encode(chunks[half:]))

    @staticmethod
    def _joined(one, two):
        (a, m, x), (b, n, y) = one, two
        both = lambda p, q: tuple(np.concatenate(z) for z in zip(p, q))
        return both(a, b), both(m, n), np.concatenate((x, y))

    def _learn(self, data, starts, ends, key) -> np.ndarray:
        """Remember the chunks and return their places."""
        asked, first, back = np.unique(key, return_index=True, return_inverse=True)
        where = np.minimum(np.searchsorted(self.key, asked), max(len(self.key) - 1, 0))
        known = self.key[where] == asked if len(self.key) else np.zeros(len(asked), bool)
        new = first[~known]
        if len(self.key) + len(new) > self.remembered and len(self.key):
            self.forget()
            return self._learn(data, starts, ends, key)
        if len(new):
            # a blank at the end would join the next chunk's: these chunks come last, alone
            final = data[ends[new] - 1]
            alone = ~INK[final]
            for k in np.flatnonzero(final >= 0x80):
                alone[k] = data[max(starts[new[k]], ends[new[k]] - 3):ends[new[k]]].tobytes().decode(errors="ignore")[-1:].isspace()
            # Latin chunks together, then the other ones, then those
            part = np.where(alone, 2, np.maximum.reduceat(data, starts)[new] > LATIN_BYTE)
            order = np.argsort(part, kind="stable")
            new, named = new[order], asked[~known][order]
            raw = data.tobytes()
            chunks = [raw[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist())]
            latin, joined = np.searchsorted(part[order], (1, 2)).tolist()
            parts = [x for x in (chunks[:latin], chunks[latin:joined]) if x] + [[c] for c in chunks[joined:]]
            a, b, same = functools.reduce(self._joined, map(self._encode, parts))
            self.place = np.concatenate((self.place, len(self.same) + np.arange(len(new))))
            self.key = np.concatenate((self.key, named))
            order = np.argsort(self.key)
            self.key, self.place = self.key[order], self.place[order]
            self.same = np.concatenate((self.same, same))
            self.ids_a.add(*a)
            self.ids_b.add(*b)
            i, j = links(np.cumsum(self.length_a[a[0]]), np.cumsum(self.length_b[b[0]]))
            pairs = a[0][i].astype(np.uint64) * np.uint64(SHIFT) + b[0][j].astype(np.uint64)
            self.pairs.add(pairs, np.bincount(np.repeat(np.arange(len(new)), a[1])[i], minlength=len(new)))
            where = np.searchsorted(self.key, asked)
        return self.place[where][back.reshape(-1)]

    def chunks(self, texts: pa.Array):
        """Per piece of consecutive texts: (first row, texts, places of the chunks, and the
        text of each); a text has no chunks when it is null or empty or when a vocabulary's
        bytes differ from it."""
        for at, end, data, bounds in W.pieces(texts):
            n = end - at
            data, bounds = with_blank(data, bounds)
            starts = chunk_starts(data, bounds, self.cut)
            place, owner = starts, starts
            if len(starts):
                ends = np.concatenate((starts[1:], [len(data)]))
                key = W.hash_spans(data, starts, ends, 111) ^ (ends - starts).astype(np.uint64)
                place = self._learn(data, starts, ends, key)
                owner = np.searchsorted(bounds, starts, side="right") - 1
                bad = np.zeros(n, bool)
                bad[owner[~self.same[place]]] = True
                good = ~bad[owner]
                place, owner = place[good], owner[good]
            yield at, n, place, owner

    def linked(self, n: int, place: np.ndarray, owner: np.ndarray):
        """Text and pair of ids of every link of n texts."""
        pairs, size = self.pairs.take(place)
        return np.repeat(owner, size), pairs

    def tokens(self, n: int, place: np.ndarray, owner: np.ndarray):
        """For A and B: ids, and the positions in them of the n texts' and of the chunks' bounds."""
        for flat in (self.ids_a, self.ids_b):
            ids, size = flat.take(place)
            yield ids, *(np.concatenate(([0], np.cumsum(x))) for x in (np.bincount(owner, size, n).astype(np.int64), size))


def _leap(ends_a: np.ndarray, ends_b: np.ndarray, at: np.ndarray, ahead: bool):
    """For each position of A, the nearest position at or behind it (``ahead``) or at or before
    it whose end is an end of B too, and that position of B.  The ends of the interval that
    holds ``at`` are shared, so a leap stops there at the latest."""
    i, j = at.copy(), np.zeros_like(at)
    todo = np.arange(len(at))
    side, back = ("left", 0) if ahead else ("right", 1)
    while len(todo):
        x = ends_a[i[todo]]
        k = np.searchsorted(ends_b, x, side) - back
        j[todo] = k
        y = ends_b[k]
        missed = y != x
        todo, y = todo[missed], y[missed]
        i[todo] = np.searchsorted(ends_a, y, side) - back
    return i, j


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, bounds_a: np.ndarray, bounds_b: np.ndarray):
    """Positions in ends_a and ends_b (both start with 0, and rise) of all shared cuts, in
    order, without the first; ``bounds`` are positions of shared cuts to start from, those of
    the texts or of their chunks."""
    lo_a, hi_a, lo_b, hi_b = bounds_a[:-1], bounds_a[1:], bounds_b[:-1], bounds_b[1:]
    some = hi_a > lo_a
    found_a, found_b = [hi_a[some]], [hi_b[some]]
    while True:
        wide = (hi_a - lo_a > 1) & (hi_b - lo_b > 1)
        lo_a, hi_a, lo_b, hi_b = lo_a[wide], hi_a[wide], lo_b[wide], hi_b[wide]
        if not len(lo_a):
            break
        i, j = _leap(ends_a, ends_b, (lo_a + hi_a) >> 1, True)
        behind = i < hi_a  # a cut at or behind the middle: both sides go on
        before = ~behind
        p, q = _leap(ends_a, ends_b, ((lo_a + hi_a) >> 1)[before], False)
        inner = p > lo_a[before]  # a cut before the middle only: the right side is a group
        found_a += [i[behind], p[inner]]
        found_b += [j[behind], q[inner]]
        left = lambda x: x[before][inner]
        lo_a, hi_a, lo_b, hi_b = (np.concatenate(x) for x in (
            (lo_a[behind], i[behind], left(lo_a)), (i[behind], hi_a[behind], p[inner]),
            (lo_b[behind], j[behind], left(lo_b)), (j[behind], hi_b[behind], q[inner])))
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


def links(ends_a: np.ndarray, ends_b: np.ndarray):
    """Positions of the tokens of A and B of every overlapping pair, in order: each stretch
    between neighbouring ends of either sequence belongs to one pair."""
    size = int(ends_a[-1]) + 1 if len(ends_a) else 1
    a, b = np.zeros(size, bool), np.zeros(size, bool)
    a[ends_a], b[ends_b] = True, True
    ends = np.flatnonzero(a | b)
    a, b = a[ends], b[ends]
    return np.cumsum(a) - a, np.cumsum(b) - b  # ends before


def digits(size: int):
    """Decimal digits of the numbers below ``size``: a row of bytes each, and their lengths."""
    text = [b"%d" % i for i in range(size)]
    width = max(map(len, text), default=1)
    rows = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in text), np.uint8).reshape(size, width)
    return rows, np.array([len(x) for x in text], np.int64)


def describe(ids_a, ids_b, cuts_a, cuts_b, last: np.ndarray, number):
    """The groups as bytes ``a1,a2|b1;a3|b2,b3;``, and the number of bytes up to each group's
    end; no mark follows the group when it is the ``last`` of its text."""
    first_a, first_b = np.concatenate(([0], cuts_a[:-1])), np.concatenate(([0], cuts_b[:-1]))
    at_a = np.arange(len(ids_a)) + np.repeat(first_b, cuts_a - first_a)
    at_b = np.arange(len(ids_b)) + np.repeat(cuts_a, cuts_b - first_b)
    rows, size = number
    out = np.zeros(len(ids_a) + len(ids_b), np.int32)
    out[at_a], out[at_b] = ids_a, ids_b
    mark = np.full(len(out), ord(","), np.uint8)
    mark[at_a[cuts_a - 1]], mark[at_b[cuts_b - 1]] = ord("|"), ord(";")
    length = size[out]
    wide = np.zeros((len(out), rows.shape[1] + 1), np.uint8)
    wide[:, :-1] = rows[out]
    wide[np.arange(len(out)), length] = mark
    ends = at_b[cuts_b - 1]
    kept = length + 1
    kept[ends[last]] -= 1
    return wide[np.arange(wide.shape[1]) < kept[:, None]], np.cumsum(kept)[ends]


def _aligner(a, b) -> Aligner:
    """One for each Python worker, kept with the broadcast vocabulary."""
    shipped = a.value
    if getattr(shipped, "aligner", None) is None:
        shipped.aligner = Aligner(shipped.get(), b.value.get())
    return shipped.aligner


def count_pairs(texts: DataFrame, a, b) -> DataFrame:
    """key (id of A * SHIFT + id of B) and n, the documents that hold the pair linked; each
    row of ``texts`` (t) is a document."""
    def run(batches):
        aligner = _aligner(a, b)
        held, size = [], 0

        def hand_on():
            key, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            return key[new], np.add.reduceat(n, new)

        for batch in batches:
            for _, n, place, owner in aligner.chunks(batch.column(0)):
                key, n = distinct(runs(*aligner.linked(n, place, owner))[0])
                held.append((key, n.astype(np.int64)))
                size += len(key)
                if size > GATHERED:
                    held = [hand_on()]
                    size = len(held[0][0])
                    if size > GATHERED // 2:
                        yield pa.RecordBatch.from_arrays([W.signed(held[0][0]), pa.array(held[0][1])], ["key", "n"])
                        held, size = [], 0
        if size:
            key, n = hand_on()
            yield pa.RecordBatch.from_arrays([W.signed(key), pa.array(n)], ["key", "n"])

    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def with_best(counts: DataFrame) -> DataFrame:
    """The counts, and ``best``: whether the count is the highest of its id of A (ties too)."""
    id_a = F.shiftrightunsigned("key", SHIFT.bit_length() - 1)
    top = counts.groupBy(id_a.alias("top_a")).agg(F.max("n").alias("top"))
    return counts.join(top, id_a == F.col("top_a")).select("key", "n", (F.col("n") == F.col("top")).cast("int").alias("best"))


FIELDS = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def align(docs: DataFrame, byte_level: str, piece: str, frequent: int | None = None) -> DataFrame:
    """All columns of ``docs`` (text, ...) and, for the blank and the text encoded by the
    byte-level vocabulary ``byte_level`` (A, JSON) and the piece model ``piece`` (B), which
    are paths read by the driver:

    n_a and n_b, the tokens; n_groups; n_links, the pairs of token occurrences that overlap;
    n_best, the links whose pair of ids is linked in as many documents as any pair of its id
    of A; count_sum, the links' counts of documents summed; groups, the ids in the form
    ``a1,a2|b1;a3|b2,b3``.

    A text that is null or empty, or whose bytes either vocabulary does not give back, has no
    tokens: zeros and an empty string.  Every row is a document, repeated rows too; an empty
    table gives an empty result; columns named like the new ones are replaced.  One text is
    held whole by its task.  ``frequent`` bounds the pairs that are sent to all tasks."""
    short_batches(docs)
    spark = docs.sparkSession
    a, b = V.ship(spark, byte_level, ByteLevel), V.ship(spark, piece, Pieces)
    rows = pack(docs, F.col("text").cast("string").alias("t"))
    counted = settle(with_best(settle(count_pairs(rows.select("t"), a, b))))
    sent, rest = split_table(counted, "n", *([] if frequent is None else [frequent]))
    sent = sent.toArrow()  # at most ``frequent`` rows
    order = np.argsort(sent["key"].to_numpy())
    known = spark.sparkContext.broadcast(tuple(sent[c].to_numpy()[order].astype(kind) for c, kind in
                                               (("key", np.uint64), ("n", np.int64), ("best", np.int8))))
    del sent, order

    def measure(texts: pa.Array) -> pa.Array:
        have, n_of, best_of = known.value
        aligner = _aligner(a, b)
        out = []
        for _, size, place, chunk_of in aligner.chunks(texts):
            (ids_a, bounds_a, chunks_a), (ids_b, bounds_b, chunks_b) = aligner.tokens(size, place, chunk_of)
            owner, key = aligner.linked(size, place, chunk_of)
            n_links = np.bincount(owner, minlength=size)
            ends_a = np.concatenate(([0], np.cumsum(aligner.length_a[ids_a])))
            ends_b = np.concatenate(([0], np.cumsum(aligner.length_b[ids_b])))
            cuts_a, cuts_b = shared_cuts(ends_a, ends_b, chunks_a, chunks_b)
            upto = np.searchsorted(cuts_a, bounds_a, side="right")  # groups that end by each bound
            last = np.zeros(len(cuts_a), bool)
            last[upto[1:][np.diff(upto) > 0] - 1] = True
            written, to = describe(ids_a, ids_b, cuts_a, cuts_b, last, aligner.digits) if len(ids_a) else (np.zeros(0, np.uint8), cuts_a)
            offsets = np.concatenate(([0], to))[upto]
            key, holder, times = runs(owner, key)
            asked, entries = distinct(key)
            where = np.minimum(np.searchsorted(have, asked), max(len(have) - 1, 0))
            found = have[where] == asked if len(have) else np.zeros(len(asked), bool)
            hit = np.repeat(found, entries)
            sums = [np.bincount(holder[hit], np.repeat(v[where[found]], entries[found]) * times[hit], minlength=size) for v in (best_of, n_of)]
            late = np.flatnonzero(~hit)
            late = late[np.argsort(holder[late], kind="stable")]
            missing = W.per_text(holder[late], size)
            groups = pa.LargeStringArray.from_buffers(size, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(written)))
            cols = [np.diff(bounds_a), np.diff(bounds_b), np.diff(upto), n_links, *sums]
            out.append(pa.StructArray.from_arrays(
                [*(pa.array(x.astype(np.int64)) for x in cols), groups.cast(pa.string()),
                 W.lists(missing, W.signed(key[late])), W.lists(missing, pa.array(times[late].astype(np.int64)))], names))
        return pa.concat_arrays(out) if out else pa.array([], kind)

    names = [x.split()[0] for x in FIELDS.split(", ")] + ["missing", "times"]
    kind = pa.struct([pa.field(n, pa.string() if n == "groups" else pa.list_(pa.int64()) if n in ("missing", "times") else pa.int64()) for n in names])
    spec = "struct<" + ", ".join(x.replace(" ", ": ", 1) for x in (*FIELDS.split(", "), "missing array<long>", "times array<long>")) + ">"
    new = names[:-2]
    measured = rows.select("row", F.arrow_udf(measure, spec)("t").alias("m"))
    if rest is None:
        return unpack(measured, docs, **{n: F.col(f"m.{n}") for n in new})
    base = settle(measured.withColumn("uid", F.monotonically_increasing_id()))
    entries = base.select("uid", F.explode(F.arrays_zip("m.missing", "m.times")).alias("x")).select("uid", F.col("x.missing").alias("key"), "x.times")
    more = (entries.join(rest, "key").groupBy("uid")
            .agg(F.sum(F.col("best") * F.col("times")).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
            .withColumnsRenamed({"uid": "other"}))
    both = base.join(more, F.col("uid") == F.col("other"), "left")
    add = {n: F.col(f"m.{n}") + F.coalesce(n, F.lit(0)) for n in ("n_best", "count_sum")}
    return unpack(both, docs, **{n: add.get(n, F.col(f"m.{n}")) for n in new})
