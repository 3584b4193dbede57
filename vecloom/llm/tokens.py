"""Tokens of a public byte-level BPE tokenizer, as prefix sums over the characters of a text.

The vocabulary is a file of ranks (Base64 token and rank on each line) whose path is a parameter. The driver reads it once, checks its size and sends it to the tasks, so
executors need no copy. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import tiktoken
from pyspark import Broadcast
from pyspark.sql import SparkSession

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: how text is parted before merging; fixed value that belongs to the vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST = 64 << 20  # bytes of a vocabulary that may be sent


@lru_cache(maxsize=2)
def _encoding(ranks: bytes) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder and the length of every token in bytes; built once in a worker."""
    table = {base64.b64decode(t): int(n) for t, n in map(bytes.split, ranks.splitlines()) if t}
    sizes = np.zeros(max(table.values()) + 1, np.int64)
    for t, n in table.items():
        sizes[n] = len(t)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}), sizes


@dataclass(frozen=True)
class Tokenizer:
    """What tasks get: the vocabulary as a broadcast."""

    ranks: Broadcast

    def count(self, text: str) -> int:
        return len(_encoding(self.ranks.value)[0].encode_ordinary(text))

    def sums(self, text: str) -> np.ndarray:
        """len(text) + 1 ascending numbers: how many tokens begin before each character; the last is the number of all. A token that begins inside a
        character (scripts of several bytes a character) counts for that character."""
        encoder, sizes = _encoding(self.ranks.value)
        tokens = np.array(encoder.encode_ordinary(text), np.int64)
        starts = np.append(0, np.cumsum(sizes[tokens]))[:-1]
        if text.isascii():
            chars = np.arange(len(text) + 1)
        else:
            raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
            chars = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        return np.searchsorted(starts, chars, "left")


def tokenizer(spark: SparkSession, path: str = VOCABULARY) -> Tokenizer:
    with open(path, "rb") as f:
        ranks = f.read(MOST + 1)
    if len(ranks) > MOST:
        raise ValueError(f"{path} has more than {MOST} bytes")
    return Tokenizer(spark.sparkContext.broadcast(ranks))
