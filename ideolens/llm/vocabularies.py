"""Vocabulary files of public tokenizers, sent to the tasks that encode with them.

The driver reads a file once and broadcasts its bytes (at most MAX_BYTES, checked), so the
executors need no copy of it; a Python worker builds its encoder once for all its tasks.
"""

from __future__ import annotations

import base64
import sys

import regex
from pyspark import cloudpickle
from pyspark.sql import SparkSession

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Largest vocabulary file that is sent to the executors.
MAX_BYTES = 64 << 20


class Encoder:
    """Bytes of a file and what ``build`` makes of them, made when it is first asked for."""

    def __init__(self, data: bytes, build):
        self.data, self.build, self.made = data, build, None

    def __getstate__(self):
        return self.data, self.build

    def __setstate__(self, state):
        self.__init__(*state)

    def get(self):
        if self.made is None:
            self.made = self.build(self.data)
        return self.made


def ship(spark: SparkSession, path: str, build):
    """Broadcast of the file's Encoder."""
    with open(path, "rb") as f:
        data = f.read(MAX_BYTES + 1)
    if len(data) > MAX_BYTES:
        raise ValueError(f"{path} has more than {MAX_BYTES} bytes")
    return spark.sparkContext.broadcast(Encoder(data, build))


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and their ranks: a line holds the base64 form of a token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


# Places at which every match of the pre-splitting pattern below ends, whatever follows, and
# from which matching goes on as from the start of a text: after letters, digits or signs
# (not after an apostrophe, which may begin a contraction), and before the last blank of
# several.
SAFE = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=[^\s\p{L}\p{N}'])(?=[\s\p{L}\p{N}])|(?<=')(?=\s)|(?<=\s)(?=\s\S)")
# fixed value: the pre-splitting pattern of the byte-level vocabularies
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def safe_parts(text: str, limit: int):
    """Consecutive parts of a text, cut at the first safe place after every ``limit``
    characters; only a run of characters of one kind makes a part much longer."""
    at = 0
    while len(text) - at > limit:
        found = SAFE.search(text, at + limit)
        if found is None:
            break
        yield text[at:found.start()]
        at = found.start()
    if at < len(text) or not at:
        yield text[at:]
