"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are split beforehand, at places where a match of the pre-splitting pattern ends in
any case, so the library works on short parts: its regex engine recurses over a run of blanks
and its lists of ids would hold a whole text.  A part that has no such place for long (a run
of one kind of character) is matched by the regex module and its matches are merged one by
one.  Decoding joins the tokens' bytes and does not need them to be valid UTF-8.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ideolens.llm import vocabularies as V
from ideolens.llm import words as W
from ideolens.llm.rows import pack, short_batches, unpack

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters after which a text is cut at the next safe place.
PART = 1 << 15
#: Longer parts have a run of one kind of character, which the library's regex cannot take.
LONG = 1 << 16
#: Bytes of ids that are decoded at once.
DECODED = 1 << 20


def build(data: bytes) -> tiktoken.Encoding:
    ranks = V.read_ranks(data)
    return tiktoken.Encoding("local", pat_str=V.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_text(encoding: tiktoken.Encoding, text: str, part: int = PART, long: int = LONG) -> np.ndarray:
    """Ids of a text; the strings of special tokens are ordinary text."""
    out = []
    for piece in V.safe_parts(text, part) if len(text) > part else (text,):
        if len(piece) > long:
            for match in regex.finditer(V.PATTERN, piece):
                out.append(np.array(encoding._encode_single_piece(match.group()), "<u4"))
        else:
            out.append(np.array(encoding.encode_ordinary(piece), "<u4"))
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, "<u4")


def encode(docs: DataFrame, ranks: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` and ``ids``: the token ids of the column ``text`` as
    little-endian unsigned 32-bit integers, the form of a training shard (binary).

    ``ranks`` is the path of a rank file, read by the driver.  Every match of the pattern is
    merged on its own.  A null or empty text has no ids (an empty binary); repeated rows are
    encoded alike; an empty table gives an empty result; a column named like ``ids`` is
    replaced.  A text is held whole by its task, its ids part by part."""
    short_batches(docs)
    shipped = V.ship(docs.sparkSession, ranks, build)

    def run(texts: pa.Array) -> pa.Array:
        encoding = shipped.value.get()
        out = [encode_text(encoding, x.as_py()).tobytes() if x.is_valid else b"" for x in texts]
        W.give_back()
        return pa.array(out, pa.binary())

    packed = pack(docs, F.col(f"`{text}`").cast("string").alias("t"))
    return unpack(packed, docs, **{ids: F.arrow_udf(run, "binary")("t")})


def decode_ids(encoding: tiktoken.Encoding, packed: bytes) -> bytes:
    ids = np.frombuffer(packed, "<u4")
    if len(ids) <= DECODED:
        return encoding.decode_bytes(ids.tolist())
    return b"".join(encoding.decode_bytes(ids[i:i + DECODED].tolist()) for i in range(0, len(ids), DECODED))


def decode(encoded: DataFrame, ranks: str, ids: str = "ids", raw: str = "raw") -> DataFrame:
    """All columns of ``encoded`` and ``raw``: the joined bytes of the tokens (binary, not
    necessarily UTF-8).  Null ids give null; an id that the rank file lacks is an error."""
    short_batches(encoded)
    shipped = V.ship(encoded.sparkSession, ranks, build)

    def run(packed: pa.Array) -> pa.Array:
        encoding = shipped.value.get()
        out = [decode_ids(encoding, x.as_py()) if x.is_valid else None for x in packed]
        return pa.array(out, pa.binary())

    return unpack(pack(encoded, F.col(f"`{ids}`").alias("i")), encoded, **{raw: F.arrow_udf(run, "binary")("i")})
