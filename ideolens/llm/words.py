"""Vectorised tokenising and hashing of UTF-8 text held in Arrow arrays.

All token classes used here are unions of ASCII ranges and "every character above ASCII",
so a byte table decides them: bytes from 0x80 up belong to characters above ASCII.
"""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Functions of this module run in Python workers that need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text handled at once; a single longer text is still handled whole.
PIECE = 1 << 20


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """256 flags, true outside the given inclusive byte ranges."""
    flags = np.ones(256, bool)
    for lo, hi in ranges:
        flags[lo:hi + 1] = False
    return flags


SPACE_RANGES = ((0x20, 0x20), (0x09, 0x0D))
NOT_SPACE = byte_class(*SPACE_RANGES)
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def pieces(texts: pa.Array, limit: int = PIECE, rows: int = 1 << 20):
    """Yield (first row, last row + 1, bytes, bounds) over at most ``rows`` consecutive rows;
    nulls are empty.  Only the rows at hand are copied, and unused memory goes back, as the
    Python workers of an executor share what its JVM leaves."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if n and not wide and texts.type != pa.string():
        texts = texts.cast(pa.string())
    kind = np.int64 if wide else np.int32

    def offsets(x):
        return np.frombuffer(x.buffers()[1], kind)[x.offset:x.offset + len(x) + 1]

    at = 0
    upto = offsets(texts) if n else None
    while at < n:
        end = max(at + 1, int(np.searchsorted(upto, int(upto[at]) + limit, side="right")) - 1)
        end = min(end, n, at + rows)
        part = texts.slice(at, end - at)
        if part.null_count:
            part = pc.fill_null(part, "")
        bounds = offsets(part).astype(np.int64)
        data = part.buffers()[2]
        data = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8)
        yield at, end, data, bounds - bounds[0]
        at = end
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def spans(data: np.ndarray, bounds: np.ndarray, is_token: np.ndarray):
    """(starts, ends, text index) of the maximal runs of token bytes; no run crosses texts."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    mask = is_token[data]
    full = bounds[1:] > bounds[:-1]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = mask[:-1]
    before[bounds[:-1][full]] = False
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after[bounds[1:][full] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _stream(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.array([seed], np.uint64)))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of each byte span (spans sorted, not overlapping; empty spans allowed)."""
    lens = ends - starts
    out = np.zeros(len(starts), np.uint64)
    some = lens > 0
    n = lens[some]
    if len(n):
        first = np.cumsum(n) - n
        total = int(n.sum())
        small = np.int32 if max(total, len(data)) < 1 << 31 else np.int64
        k = np.arange(total, dtype=small) - np.repeat(first.astype(small), n)
        at = k + np.repeat(starts[some].astype(small), n)
        base = int(_stream(seed + 100, 1)[0]) | 1
        with np.errstate(over="ignore"):
            out[some] = np.add.reduceat(_stream(seed, 256)[data[at]] * _powers(base, int(n.max()))[k], first)
            out += lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(out)


def hash_ngrams(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of n consecutive item hashes (runs may cross texts: filter them)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, salt, np.uint64)
    mult = np.uint64(0x5851F42D4C957F2D)
    with np.errstate(over="ignore"):
        for j in range(n):
            out *= mult
            out += hashes[j:j + m]
    return mix(out)


def per_text(index: np.ndarray, n: int) -> np.ndarray:
    """Offsets (n + 1) of the runs of a sorted text index."""
    return np.searchsorted(index, np.arange(n + 1))


def lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
